"""Search requests -> boolean query strings and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import encode_component, filled

# The services' public addresses and the words of the query language.
SEARCH_BASE = "https://serpapi.com/search.json?engine=google_scholar&q="
HUMAN_BASE = "https://scholar.google.com/scholar?q="
TITLE_SCOPE = "title"
TITLE_PREFIX = "allintitle: "
ANY, NONE, AUTHOR, SOURCE = " OR ", " -", "author:", "source:"
LOW_YEAR, HIGH_YEAR = "as_ylo", "as_yhi"
LINK_LABEL = "🌐 View on Scholar"


def compiled_query(all_words: Column, exact: Column, at_least: Column, without: Column, scope: Column, author: Column, source: Column) -> Column:
    """One query string from the seven text fields; NULL and empty fields add nothing.

    A field is taken as it is: inner quotes aren't escaped, and each single space parts two terms, so doubled spaces give
    empty terms.
    """
    quoted = lambda c, head: F.concat(F.lit(f'{head}"'), filled(c), F.lit('"'))
    spaced = lambda c, by: F.replace(filled(c), F.lit(" "), F.lit(by))
    parts = F.concat_ws(
        " ",
        filled(all_words),
        quoted(exact, ""),
        F.concat(F.lit("("), spaced(at_least, ANY), F.lit(")")),
        F.concat(F.lit("-"), spaced(without, NONE)),
        quoted(author, AUTHOR),
        quoted(source, SOURCE),
    )
    return F.when(scope == TITLE_SCOPE, F.concat(F.lit(TITLE_PREFIX), parts)).otherwise(parts)


def request_query() -> Column:
    """compiled_query over the request columns."""
    return compiled_query(*(F.col(c) for c in ("allWords", "exact", "atLeast", "without", "scope", "author", "source")))


def year_suffix(low: Column, high: Column) -> Column:
    """Year bounds as URL parameters; each is optional, unchecked and goes in as it is."""
    bound = lambda c, name: F.coalesce(F.concat(F.lit(f"&{name}="), filled(c)), F.lit(""))
    return F.concat(bound(low, LOW_YEAR), bound(high, HIGH_YEAR))


def search_url(query: Column, low: Column, high: Column) -> Column:
    """Address of the search call without its key, which only the connector's transport adds."""
    return F.concat(F.lit(SEARCH_BASE), encode_component(query), year_suffix(low, high))


def human_link(query: Column, low: Column, high: Column) -> Column:
    """Address at which a person sees the same search."""
    return F.concat(F.lit(HUMAN_BASE), encode_component(query), year_suffix(low, high))


def link_formula(url: Column, label: str = LINK_LABEL) -> Column:
    """A spreadsheet formula that shows the link under a label."""
    return F.format_string(f'=HYPERLINK("%s", "{label}")', url)


def compile_requests(requests: DataFrame) -> DataFrame:
    """Adds query, search_url and human_link to a table of requests."""
    out = requests.withColumn("query", request_query())
    return out.withColumns({"search_url": search_url(F.col("query"), F.col("ylo"), F.col("yhi")), "human_link": human_link(F.col("query"), F.col("ylo"), F.col("yhi"))})
