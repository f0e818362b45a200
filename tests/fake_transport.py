"""Answers of a service that isn't there."""

import tempfile
from pathlib import Path

#: Workers are started before a test sets its environment, so the folder is a fixed one.
CALLS = Path(tempfile.gettempdir()) / "litsieve-test-calls"


def search(url, headers):
    if "api_key=bad" in url:
        return 401, "no"
    return 200, '{"search_information":{"total_results":7},"organic_results":[{"title":"' + url.split("&api_key=")[0][-12:] + '"}]}'


def works(url, headers):
    return 404, '{"error":"%s"}' % url


def counted(url, headers):
    """Notes every call in the folder CALLS, then answers by what the query asks for."""
    import uuid

    (CALLS / uuid.uuid4().hex).write_text(url)
    if "q=boom" in url or "search=boom" in url:
        raise OSError("no route")
    if "q=busy" in url or "search=busy" in url:
        return 503, "busy"
    if "q=html" in url or "search=html" in url:
        return 200, "<html>"
    if "/works" in url:
        return 200, '{"results":[]}' if "?search=" in url else '{"id":"W1","title":"%s"}' % url.split("/works/")[1].split("?")[0]
    return 200, '{"search_information":{"total_results":1234},"organic_results":[{"title":"A","link":"https://doi.org/10.1234/x"},{"title":"B"}]}'


def graph(url, headers):
    """A catalogue of W0 to W39 in which Wk cites W(2k+1) and W(3k+2); notes every call. W9 isn't known, W5 is busy, W7 has no route."""
    import json
    import uuid

    (CALLS / uuid.uuid4().hex).write_text(url)
    asked = url.split("/works")[1].split("mailto=")[0].strip("/?&")
    if asked.startswith("search="):
        return 200, '{"results": []}' if "nothing" in asked else '{"results": [{"id": "https://openalex.org/W1", "title": "one"}, {"id": "https://openalex.org/W2"}]}'
    if "10." in asked:
        asked = "W3"
    k = int(asked.lstrip("W"))
    if k == 9:
        return 404, "<html>not here"
    if k == 5 and not (CALLS.parent / (CALLS.name + "-calm")).exists():
        return 503, "busy"
    if k == 7 and not (CALLS.parent / (CALLS.name + "-calm")).exists():
        raise OSError("no route")
    cites = [f"https://openalex.org/W{n}" for n in (2 * k + 1, 3 * k + 2, k) if n < 40]
    return 200, json.dumps({"id": f"https://openalex.org/W{k}", "title": f"t{k}", "publication_year": 1990 + k, "referenced_works": cites})
