"""Search responses (JSON text) -> hit counts, titles and the results table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from litsieve.functions.text import grouped_number, text_or
from litsieve.schemas import RESPONSE

# What stands for missing parts, and the identifier pattern.
NO_LINK, NO_DOI, NO_PDF, NO_SUMMARY = "N/A", "Not found", "None", ""
TOTAL_PATH = "$.search_information.total_results"
DOI_PATTERN = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"

NUMBER_KINDS = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"
SHOWN, SHOWN_BEFORE = "litsieve.shown", "litsieve.shown_before"  # properties of a results view


def parse_responses(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Adds `response` (typed) and `corrupt` (the text where it isn't JSON, else NULL). Bad fields become NULL alone.

    The answer is parsed in a generator, so that it is parsed once, however many of its fields are read.
    """
    parsed = F.from_json(payload_col, RESPONSE + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = payloads.select("*", F.explode(F.array(parsed)).alias("response"))
    whole = F.col("response.search_information").isNull() & F.col("response.organic_results").isNull()
    return out.withColumn("corrupt", F.when(whole, F.col("response._corrupt_record")))


def total_hits(response: Column | str = "response") -> Column:
    c = F.col(response) if isinstance(response, str) else response
    return F.coalesce(c["search_information"]["total_results"], F.lit(0)).cast("long")


def _total(payload: Column | str) -> tuple[Column, Column]:
    """The total of a whole answer as text, and its kind."""
    answer = F.try_parse_json(payload)
    return F.try_variant_get(answer, TOTAL_PATH, "string"), F.schema_of_variant(F.try_variant_get(answer, TOTAL_PATH, "variant"))


def with_totals(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Adds `total_text`, the total as a person reads it, and `total`, the number in it.

    A number is grouped, a text ("about 1,200") stays as it is and gives the number that its first digits spell; where the total
    is missing, null, 0, false or the empty text it is 0. The answer need not fit the schema: it is parsed whole, and once.
    """
    text, kind = _total(payload_col)
    found = F.explode(F.array(F.struct(text.alias("text"), kind.alias("kind"))))
    out = payloads.select("*", found.alias("_t"))
    text, kind = F.col("_t.text"), F.coalesce("_t.kind", F.lit("VOID"))
    number = F.when(kind.rlike(NUMBER_KINDS), text.try_cast("decimal(38,3)"))
    digits = F.regexp_replace(F.regexp_extract(text, r"\d[\d,]*", 0), ",", "")
    shown = F.when(number.isNotNull(), F.call_function("format_number", number, F.lit("#,##0.###"))).otherwise(text)
    nothing = text.isNull() | (text == "") | (number == 0) | ((kind == "BOOLEAN") & (text == "false"))
    counted = F.when(kind == "STRING", digits.try_cast("long")).otherwise(F.floor(number).cast("long"))
    return out.withColumns({"total_text": F.when(nothing, F.lit("0")).otherwise(shown), "total": F.coalesce(counted, F.lit(0)).cast("long")}).drop("_t")


def hits_text(hits: Column) -> Column:
    return grouped_number(hits)


def doi_of(link: Column) -> Column:
    """The first identifier in a link, anywhere in it, with its own capitals."""
    return text_or(F.regexp_extract(link, DOI_PATTERN, 0), NO_DOI)


def pdf_of(resources: Column) -> Column:
    """The first resource's link if it ends in `.pdf` (lower case); an empty list has none."""
    link = F.get(resources, F.lit(0))["link"]
    return F.when(F.endswith(link, F.lit(".pdf")), link).otherwise(NO_PDF)


def results(parsed: DataFrame, *keep: str) -> DataFrame:
    """One row per listed result, in order: the kept columns, position and the six result columns.

    Responses without results give no row.
    """
    rows = parsed.select(*keep, F.posexplode("response.organic_results").alias("position", "r"))
    r = F.col("r")
    return rows.select(
        *keep,
        F.col("position").cast("int").alias("position"),
        r["title"].alias("title"),
        text_or(r["link"], NO_LINK).alias("link"),
        doi_of(r["link"]).alias("doi"),
        pdf_of(r["resources"]).alias("pdf_link"),
        F.coalesce(r["inline_links"]["cited_by"]["total"], F.lit(0)).cast("long").alias("citations"),
        F.coalesce(r["publication_info"]["summary"], F.lit(NO_SUMMARY)).alias("source_summary"),
    )


def titles(parsed: DataFrame, *keep: str) -> DataFrame:
    """The preview: titles only; the scan reads no other part of the response."""
    rows = parsed.select(*keep, F.posexplode("response.organic_results").alias("position", "r"))
    return rows.select(*keep, F.col("position").cast("int").alias("position"), F.col("r")["title"].alias("title"))


def _whole(number: str) -> int | float:
    """A number with a fraction or an exponent; whole ones are written without either."""
    x = float(number)
    return int(x) if x.is_integer() and abs(x) < 1e21 else x


def indented(payload: str | None) -> str | None:
    """JSON text, indented by two spaces, its fields in their order; None where it isn't JSON."""
    try:
        return json.dumps(json.loads(payload or "", parse_float=_whole), indent=2, ensure_ascii=False)
    except ValueError:
        return None


def debug_dump(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Adds `dump`: the whole answer as indented JSON, fields that no schema knows included. Nothing calls this by default."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dumps = [indented(x.as_py()) for x in batch.column(batch.schema.get_field_index(payload_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dumps, pa.string())], [*batch.schema.names, "dump"])

    return payloads.mapInArrow(run, StructType([*payloads.schema.fields, StructField("dump", StringType())]))


def write_results(rows: DataFrame, table: str) -> None:
    """Replaces the results table by a view of that name on a table that is written first.

    If rows can't be written, the old results stay. The view is replaced in one step of the catalogue, and what it showed before
    is kept until the next replacement, for those who still read it. A plain table of the name becomes the first version.
    """
    spark = rows.sparkSession
    staged = f"{table}__{uuid.uuid4().hex}"
    try:
        rows.write.saveAsTable(staged)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {staged}")
        raise
    old, older = "", ""
    if spark.catalog.tableExists(table):
        if spark.catalog.getTable(table).tableType == "VIEW":
            told = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
            old, older = told.get(SHOWN, ""), told.get(SHOWN_BEFORE, "")
        else:
            old = f"{table}__{uuid.uuid4().hex}"
            spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ('{SHOWN}' = '{staged}', '{SHOWN_BEFORE}' = '{old}') AS SELECT * FROM {staged}")
    if older:
        spark.sql(f"DROP TABLE IF EXISTS {older}")


def drop_results(spark: SparkSession, table: str) -> None:
    """Removes the results with what is kept of them."""
    if not spark.catalog.tableExists(table):
        return
    told = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    spark.sql(f"DROP {'VIEW' if SHOWN in told else 'TABLE'} {table}")
    for version in (told.get(SHOWN), told.get(SHOWN_BEFORE)):
        if version:
            spark.sql(f"DROP TABLE IF EXISTS {version}")
