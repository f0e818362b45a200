"""Awkward inputs that every operator gets."""

LONG = "very long text, " * 40_000

#: nulls in any column, empty texts, ties, repeated rows, no letters, a very long text; names that operators use inside
DOCS = [
    (0, None, None, None),
    (None, "no id", "en", "a"),
    (1, "", "en", "a"),
    (2, "Same text here", "en", "a"),
    (3, "sAME TEXT HERE", None, "b"),
    (3, "sAME TEXT HERE", None, "b"),
    (4, "12345 !!! ...", "fr", "b"),
    (5, LONG, "en", None),
    (6, LONG + "end", "en", "c"),
    (7, "ÄÖ straße  \n\t 漢字 😀", "de", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["body", "digest", "kept", "score", "rep", "n", "g", "chunk", "a", "b", "y", "rank", "label", "_kept_id", "text_sha256", "n_shingles", "held_out"]


def docs(spark, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS if rows is None else rows, SCHEMA)
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))


def empty(spark):
    return docs(spark, [])


def documents(sf, spark):
    return spark.read.parquet(f"{sf}/documents.parquet")
