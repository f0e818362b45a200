"""All bibliographic queries and their SQL."""

from __future__ import annotations

from litsieve.plans import queries, search_queries

MODULES = [queries, search_queries]  # each registers its own
QUERIES, SQL = queries.QUERIES, queries.SQL
