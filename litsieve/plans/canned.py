"""Stand-in for the remote services in the queries over derived requests: answers made from the address alone.

The length of the query (or text) decides what happens: refused, broken, no JSON, or an answer with a hit.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

from litsieve.operators.compile import SEARCH_BASE
from litsieve.operators.citations import WORK_BASE
from litsieve.operators.works import CATALOGUE_BASE

BUSY = "<html>busy"
NO_ROUTE = "no route"


def search(url: str, headers: dict[str, str]) -> tuple[int, str]:
    query = unquote(url.removeprefix(SEARCH_BASE).split("&api_key=")[0])
    n = len(query)
    if n % 7 == 0:
        return 503, BUSY
    if n % 7 == 1:
        raise OSError(NO_ROUTE)
    if n % 7 == 2:
        return 200, BUSY
    first = {"title": query[:20], "link": f"https://doi.org/10.{1000 + n}/x", "inline_links": {"cited_by": {"total": n}}}
    return 200, json.dumps({"search_information": {"total_results": 1237 * n}, "organic_results": [first, {"title": "second", "publication_info": {"summary": "s"}}]})


def works(url: str, headers: dict[str, str]) -> tuple[int, str]:
    if not url.startswith(f"{CATALOGUE_BASE}?search="):
        identifier = url.removeprefix(f"{CATALOGUE_BASE}/").split("?mailto=")[0]
        return 200, json.dumps({"id": "W1", "title": identifier, "cited_by_count": len(identifier), "referenced_works": ["W2", "W3"], "publication_year": 2000})
    text = unquote(url.removeprefix(f"{CATALOGUE_BASE}?search=").split("&mailto=")[0])
    if len(text) % 3 == 0:
        return 200, '{"results": []}'
    return 404, BUSY if len(text) % 3 == 1 else json.dumps({"results": [{"id": "W4", "title": text, "versions_count": 2}]})


def citations(url: str, headers: dict[str, str]) -> tuple[int, str]:
    """The work `W<k>` of so many as the contact's name says; every ninth isn't known, every seventh is busy."""
    identifier, _, contact = url.removeprefix(f"{CATALOGUE_BASE}/").partition("?mailto=")
    k, n = int(identifier.rpartition("W")[2]), int(contact.partition("@")[0])
    if k % 9 == 4:
        return 404, '{"error": "no such work"}'
    if k % 7 == 5:
        return 503, BUSY
    cited = [f"{WORK_BASE}W{(k * a + b) % n}" for a, b in ((7, 3), (11, 5))]
    return 200, json.dumps({"id": f"{WORK_BASE}W{k}", "title": f"work {k}", "referenced_works": cited, "cited_by_count": k % 10, "publication_year": 1990 + k % 30})
