"""The corpus pipeline: language ID, quality, exact dedup, near dedup, packing.

Each stage gets the documents that its predecessor kept (all columns of `documents`), reads them whole and its decisions
take effect; the last returns the packed pieces. `run` writes each stage's rows as Parquet in the folder that driver and
executors share and rereads them as the next one's input, so a lost executor costs a task and never an earlier stage.

Defined results, besides those of the operators: documents without a letter (null and empty texts too) go with the language
stage; where no language can be learned (no row has one) all go. Without any labelled document the quality stage keeps all.
Ids may be null, repeat, and stand for different texts: of equal texts (A-Z in either case) exactly one row stays, that of the
largest id, a row without an id only where no other holds its text; of each group of near copies exactly one row stays, that of
the least id. Rows that repeat whole are one row from the third stage on. Extra columns of documents are kept, whatever their
names. An empty table of documents gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litsieve.llm.common import read, write_table
from litsieve.llm.exact_dedup import keep_first_copies
from litsieve.llm.jaccard_join import keep_one_of_each
from litsieve.llm.language_id import keep_identified
from litsieve.llm.packing import pack, word_vocabulary
from litsieve.llm.quality import keep_good
from litsieve.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents without a language that the model knows go."""
    ship_package(spark)
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the quality classifier rejects go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts the row with the largest id stays."""
    ship_package(spark)
    return keep_first_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies (five-word shingles, similarity 0.8) one document stays."""
    ship_package(spark)
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the remaining documents as pieces of training sequences."""
    ship_package(spark)
    return pack(docs, word_vocabulary())


STAGES = [("language", language), ("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("packing", packing)]

#: Trained models, similarity components and packing have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"stage-{name}")
    return docs
