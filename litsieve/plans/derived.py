"""Inputs for the queries, derived from the supplied tables, which hold no bibliographic records.

Each view is a set of expressions that Spark and DuckDB both understand, computed from `doc_id` and real columns; links,
identifiers, counts, authors and years are made up by arithmetic and say so here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUESTS = {
    "doc_id": "doc_id",
    "allWords": "CASE WHEN doc_id % 2 = 0 THEN split_part(text, ' ', 1) ELSE '' END",
    "exact": "CASE WHEN doc_id % 3 = 0 THEN split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) ELSE '' END",
    "atLeast": "CASE WHEN doc_id % 5 = 0 THEN source || ' ' || lang WHEN doc_id % 5 = 1 THEN lang || '  ' || source WHEN doc_id % 5 = 2 THEN '' ELSE NULL END",
    "without": "CASE WHEN doc_id % 7 = 0 THEN lang || ' x' WHEN doc_id % 7 = 1 THEN 'x' ELSE '' END",
    "scope": "CASE WHEN doc_id % 4 = 0 THEN 'title' WHEN doc_id % 4 = 1 THEN '' ELSE 'anywhere' END",
    "author": "CASE WHEN doc_id % 11 = 0 THEN 'Author ' || CAST(doc_id % 50 AS VARCHAR(20)) ELSE '' END",
    "source": "CASE WHEN doc_id % 6 = 0 THEN source ELSE '' END",
    "ylo": "CASE WHEN doc_id % 3 = 1 THEN CAST(1990 + doc_id % 30 AS VARCHAR(20)) ELSE '' END",
    "yhi": "CASE WHEN doc_id % 5 = 1 THEN CAST(2000 + doc_id % 25 AS VARCHAR(20)) WHEN doc_id % 5 = 2 THEN NULL ELSE '' END",
}

WORKS = {
    "doc_id": "doc_id",
    "title": "split_part(text, chr(10), 1)",
    "body": "text",
    "link": (
        "CASE WHEN doc_id % 5 = 0 THEN 'https://doi.org/10.' || CAST(1000 + doc_id AS VARCHAR(20)) || '/abc.DEF' "
        "WHEN doc_id % 5 = 1 THEN 'https://example.org/doi/10.5555/a(b)' || CAST(doc_id AS VARCHAR(20)) || '?x=1' "
        "WHEN doc_id % 5 = 2 THEN 'https://example.org/plain/' || CAST(doc_id AS VARCHAR(20)) WHEN doc_id % 5 = 3 THEN '' ELSE NULL END"
    ),
    "resource": "CASE WHEN doc_id % 4 = 1 THEN 'https://example.org/' || CAST(doc_id AS VARCHAR(20)) || '.pdf' WHEN doc_id % 4 = 2 THEN 'https://example.org/x.PDF' WHEN doc_id % 4 = 3 THEN 'https://example.org/x.pdf?x' ELSE NULL END",
    "cited_by": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 97 END",
    "summary": "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang || ' - ' || source END",
    "author": "'Author ' || CAST(doc_id % 50 AS VARCHAR(20))",
    "source": "source",
    "year": "CAST(1980 + doc_id % 45 AS INT)",
    "hits": "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE doc_id * 1237 END",
    "work_id": "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 13 = 1 THEN '' ELSE 'W' || CAST(doc_id AS VARCHAR(20)) END",
    "n_refs": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 7 END",
    "versions": "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 0 ELSE doc_id % 20 END",
    "doi": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'https://doi.org/10.1/' || CAST(doc_id AS VARCHAR(20)) END",
}

INPUTS = {
    "doc_id": "doc_id",
    "input": (
        "CASE WHEN doc_id % 6 = 0 THEN ' 10.1/' || CAST(doc_id AS VARCHAR(20)) || ' ' WHEN doc_id % 6 = 1 THEN 'https://doi.org/10.1234/' || CAST(doc_id AS VARCHAR(20)) "
        "WHEN doc_id % 6 = 2 THEN 'W' || CAST(doc_id AS VARCHAR(20)) WHEN doc_id % 6 = 3 THEN 'Water quality' WHEN doc_id % 6 = 4 THEN split_part(text, ' ', 1) || ' ' || lang ELSE '' END"
    ),
}


def sql(view: dict[str, str], table: str = "documents") -> str:
    """The view as a DuckDB subquery."""
    return "(SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in view.items()) + f" FROM {table})"


def frame(spark: SparkSession, sf_dir: str, view: dict[str, str], table: str = "documents") -> DataFrame:
    """The view as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS `{c}`" for c, e in view.items()))


def payloads(works: DataFrame) -> DataFrame:
    """One search response (JSON text) per derived work."""
    result = F.struct(
        "title",
        "link",
        F.when(F.col("resource").isNotNull(), F.array(F.struct(F.col("resource").alias("link")))).alias("resources"),
        F.struct(F.struct(F.col("cited_by").alias("total")).alias("cited_by")).alias("inline_links"),
        F.struct("summary").alias("publication_info"),
    )
    response = F.struct(F.struct(F.col("hits").alias("total_results")).alias("search_information"), F.array(result).alias("organic_results"))
    return works.select("doc_id", F.to_json(response).alias("payload"))


def work_payloads(works: DataFrame) -> DataFrame:
    """One catalogue answer (JSON text) per derived work: even ids as an object, odd ones as the first of `results`."""
    work = F.struct(
        F.col("work_id").alias("id"),
        "title",
        "doi",
        F.coalesce("cited_by", F.lit(0)).alias("cited_by_count"),
        F.concat(F.lit("https://example.org/cites/"), F.col("doc_id").cast("string")).alias("cited_by_api_url"),
        F.when(F.col("n_refs").isNotNull(), F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_refs"), F.lit(1))), lambda i: F.concat(F.lit("W"), i.cast("string")))).alias("referenced_works"),
        F.col("year").alias("publication_year"),
        F.col("versions").alias("versions_count"),
    )
    payload = F.when(F.col("doc_id") % 2 == 0, F.to_json(work)).otherwise(F.to_json(F.struct(F.array(work).alias("results"))))
    return works.select("doc_id", payload.alias("payload"))
