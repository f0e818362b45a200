"""Explicit schemas of requests, responses, works, results and the log."""

from __future__ import annotations

REQUEST_FIELDS = ["allWords", "exact", "atLeast", "without", "scope", "author", "source", "ylo", "yhi"]
REQUEST = ", ".join(f"{f} string" for f in REQUEST_FIELDS)

RESPONSE = (
    "search_information struct<total_results: bigint>, "
    "organic_results array<struct<title: string, link: string, resources: array<struct<link: string>>, "
    "inline_links: struct<cited_by: struct<total: bigint>>, publication_info: struct<summary: string>>>"
)

WORK_FIELDS = (
    "id: string, title: string, doi: string, cited_by_count: bigint, cited_by_api_url: string, "
    "referenced_works: array<string>, publication_year: bigint, versions_count: bigint"
)
WORK_RESPONSE = f"{WORK_FIELDS.replace(': ', ' ').replace('array<string>', 'array<string>')}, results array<struct<{WORK_FIELDS}>>"

RESULTS = "position int, title string, link string, doi string, pdf_link string, citations bigint, source_summary string"

LOG_FIELDS = ["logged_at", "human_link", "query", *REQUEST_FIELDS, "api_calls", "results"]
LOG = "log_id string, logged_at timestamp, human_link string, query string, " + REQUEST + ", api_calls int, results string"
