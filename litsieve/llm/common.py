"""Shared parts of the corpus operators: reading, tables in the shared folder, fixed hash folds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from litsieve.session import drop_table as drop_table  # for the operators here
from litsieve.session import ship_package
from litsieve.session import write_table as write_table


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; also makes sure that executors can import this package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(text: Column | str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit("")).cast("binary")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, *keep: Column | str, folds: int = 5) -> DataFrame:
    """The rows of at most `rows` labelled ids outside fold 0 (those of smallest id hash): doc_id, y, the kept columns, body.

    Of several labels for one id the largest counts; null labels don't count. The chosen labels are at most `rows` small
    rows, so they are broadcast. An id that repeats brings all its rows: `one_row_an_id` leaves one, once they are encoded.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != 0))
    one = one.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    slim = docs.select("doc_id", *keep, text_bytes().alias("body"))
    return slim.join(F.broadcast(chosen), "doc_id")


def one_row_an_id(rows: DataFrame, by: str) -> DataFrame:
    """Of the rows that share a doc_id the one with the least `by`: however often an id repeats, it counts once."""
    rest = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.col(by)).alias("_one")).select("doc_id", "_one.*")


def rows_within(rows: DataFrame, order: Column, size: Column, most: int) -> list[Row]:
    """The rows of a bounded sample, each whole: all of them if their sizes sum to `most` at most.

    Else those of more than a twentieth of it are left out, so that a few giants don't stand for the rest, and the others are taken
    in `order` (a hash of what identifies a row) until the next would be too much. So no row's place or partition matters.
    """
    kept = write_table(rows.withColumns({"_order": order.cast("long"), "_size": size.cast("long")}), "sample")
    sizes = sorted((r._order, r._size) for r in kept.select("_order", "_size").collect())  # as many as the sample has rows
    chosen = kept
    if sum(n for _, n in sizes) > most:
        total, last = 0, None
        for key, n in sizes:
            if 20 * n > most:
                continue
            if total + n > most:
                break
            total, last = total + n, key
        chosen = kept.where((20 * F.col("_size") <= most) & (F.col("_order") <= F.lit(last).cast("long")))
    out = chosen.drop("_order", "_size").collect()
    drop_table(kept)
    return out


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def with_digest(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs and the SHA-256 of every text in UTF-8 with A-Z lowered (null: empty) as the binary column `name`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            digests = [hashlib.sha256((x.as_py() or "").encode("utf-8", "surrogatepass").lower()).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for every (doc_id, digest) of `decided`, a null id included.

    Rows that repeat an id with its text are one: of those the row with the least hash of all columns stays. They are
    collapsed before the shuffle, so a row with a third of all copies reaches its owner once a task.
    """
    digest = free_name(docs, "_digest")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = with_digest(docs, digest, text_col).groupBy(F.col(id_col).cast("long").alias("_id"), F.col(digest).alias("_text"))
    one = one.agg(F.min_by(F.struct(*columns), F.xxhash64(*(c.cast("string") for c in columns))).alias("_row"))
    want = decided.select(F.col("doc_id").alias("_want_id"), F.col("digest").alias("_want_text"))
    same = (F.col("_text") == F.col("_want_text")) & F.col("_id").eqNullSafe(F.col("_want_id"))
    return one.join(want, same, "left_semi").select("_row.*")
