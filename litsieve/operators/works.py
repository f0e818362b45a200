"""Identifier routing and reports about single works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.functions.text import count_or, encode_component, filled, trim_all
from litsieve.schemas import WORK_RESPONSE

# The catalogue's public address, its routing marks and the report's words.
CATALOGUE_BASE = "https://api.openalex.org/works"
DOI_BASE = "https://doi.org/"
DOI_MARK, ID_MARK = "10.", "W"
NOT_LISTED, UNDEFINED = "Not listed", "undefined"
REPORT_BANNER = "--- METADATA RECOVERED ---\n\n"
NOT_FOUND = "DIAGNOSTIC FAILED: No paper found for that input."
ERROR_PREFIX = "DIAGNOSTIC ERROR: "
REPORT_KEYS = ["Title", "OpenAlex ID", "DOI", "Citations (Total)", "Citations (API Link)", "References (Count)", "Year", "Versions Count"]

# Our own words for what the original leaves to its JSON parser.
EMPTY_ANSWER, NOT_JSON = "the answer is empty", "the answer is not a JSON object"


def route(text: Column, strict: bool = False) -> Column:
    """struct<mode, id>: `lookup` with an identifier, or `search` with the text.

    Compatible routing looks for `10.` anywhere, then for a leading `W`, so some titles are taken for identifiers and a
    whole DOI address is prefixed again. Strict routing asks for a whole DOI (its address is accepted) or W and digits.
    """
    t = trim_all(text)
    if strict:
        bare = F.regexp_replace(t, r"^(?i)(https?://(dx\.)?doi\.org/|doi:)", "")
        doi = bare.rlike(r"^10\.\d{4,9}/\S+$")
        work = t.rlike(r"^W\d+$")
        identifier = F.when(doi, F.concat(F.lit(DOI_BASE), bare)).otherwise(t)
    else:
        doi, work = F.contains(t, F.lit(DOI_MARK)), F.startswith(t, F.lit(ID_MARK))
        identifier = F.when(doi, F.concat(F.lit(DOI_BASE), t)).otherwise(t)
    return F.struct(F.when(doi | work, F.lit("lookup")).otherwise(F.lit("search")).alias("mode"), identifier.alias("id"))


def catalogue_url(routed: Column, contact: str) -> Column:
    """Address of a lookup (identifier as it is) or of a search (text encoded)."""
    lookup = F.concat(F.lit(f"{CATALOGUE_BASE}/"), routed["id"], F.lit(f"?mailto={contact}"))
    search = F.concat(F.lit(f"{CATALOGUE_BASE}?search="), encode_component(routed["id"]), F.lit(f"&mailto={contact}"))
    return F.when(routed["mode"] == "lookup", lookup).otherwise(search)


def parse_works(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Adds `work` (the first of `results` where that list is present, else the object itself; NULL where none has an id) and
    `error` (what is wrong with an answer that isn't a JSON object, else NULL).

    The answer is parsed in a generator, so that it is parsed once, however many of its fields are read.
    """
    parsed = F.from_json(payload_col, WORK_RESPONSE + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = payloads.select("*", F.explode(F.array(parsed)).alias("_r"))
    fields = ("id", "title", "doi", "cited_by_count", "cited_by_api_url", "referenced_works", "publication_year", "versions_count")
    r = F.col("_r")
    own = F.struct(*(r[f].alias(f) for f in fields))
    work = F.when(r["results"].isNotNull(), F.get(r["results"], F.lit(0))).otherwise(own)
    empty = F.coalesce(F.trim(payload_col), F.lit("")) == ""
    broken = r["_corrupt_record"].isNotNull() & r["id"].isNull() & r["results"].isNull()
    error = F.when(empty, F.lit(EMPTY_ANSWER)).when(r.isNull() | broken, F.lit(NOT_JSON))
    out = out.withColumns({"_work": work, "error": error})
    return out.withColumn("work", F.when(filled(F.col("_work.id")).isNotNull(), F.col("_work"))).drop("_r", "_work")


def report_columns() -> list[Column]:
    """The eight report columns of `work`."""
    w = F.col("work")
    return [
        w["title"].alias("title"),
        w["id"].alias("work_id"),
        w["doi"].alias("doi"),
        w["cited_by_count"].alias("citations"),
        w["cited_by_api_url"].alias("citations_link"),
        reference_count(w["referenced_works"]).alias("n_references"),
        w["publication_year"].alias("year"),
        count_or(w["versions_count"], NOT_LISTED).alias("versions"),
    ]


def report(works: DataFrame, *keep: str) -> DataFrame:
    """The eight report columns of every found work."""
    return works.where("work is not null").select(*keep, *report_columns())


def reference_count(references: Column) -> Column:
    return F.coalesce(F.size(references), F.lit(0)).cast("long")


def report_text() -> Column:
    """The report of `work` as text, one `key: value` line each; missing values are spelled `undefined`."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(c.cast("string"), F.lit(UNDEFINED)), F.lit("\n")) for k, c in zip(REPORT_KEYS, report_columns(), strict=True)]
    return F.concat(F.lit(REPORT_BANNER), *lines)


def diagnose(works: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and `message` for every row: the report, that nothing was found, or what is wrong with the answer."""
    wrong = F.concat(F.lit(ERROR_PREFIX), F.col("error"))
    return works.select(*keep, F.when(F.col("error").isNotNull(), wrong).when(F.col("work").isNotNull(), report_text()).otherwise(F.lit(NOT_FOUND)).alias("message"))
