"""Snowballing over the live catalogue: seeds are looked up, then the works that they cite, hop by hop, each once.

All answers are captured in a folder, which is the whole state, so a run that stopped goes on where it was: `answers` has what
was asked and answered, `frontier/hop=<k>` what hop k asks for. A hop's calls are made in slices, each a job of its own whose
tasks keep their answers as they finish; what a slice had no answer for is asked for again by the next run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litsieve.functions.text import trim_all
from litsieve.operators.works import ERROR_PREFIX, NOT_FOUND, parse_works, reference_count
from litsieve.session import drop_table, exists, write_table
from litsieve.sources.literature import fetch

# Fixed value: the address before a work's id in the catalogue's answers.
WORK_BASE = "https://openalex.org/"

SLICE_ROWS = 10_000
_ANSWERS = "hop int, asked string, status int, payload string"


def work_node(work_id: Column) -> Column:
    """The id by which a work can be looked up: without the address before it."""
    return F.regexp_replace(work_id, f"^{WORK_BASE}", "")


class Snowball:
    """Works reached from seeds along citations, over the captured answers in `path`.

    `options` are those of `literature.fetch`. A call that failed (no route, too many requests, a server's error) is no answer:
    it is made again when the run goes on, until a later hop has begun. Everything else is final, also that a work isn't known.
    """

    def __init__(self, spark: SparkSession, path: str, slice_rows: int = SLICE_ROWS, **options: str) -> None:
        self.spark, self.path, self.slice_rows, self.options = spark, path, slice_rows, options | {"mode": "works"}

    # -- state -----------------------------------------------------------------------------------------------------------

    @property
    def hop(self) -> int:
        """The last hop that was begun; -1 before the start."""
        k = -1
        while exists(self.spark, f"{self.path}/frontier/hop={k + 1}/_SUCCESS"):
            k += 1
        return k

    def answers(self) -> DataFrame:
        """hop, asked, status, payload: one row for everything that was asked for; a final answer before a failed call."""
        if not exists(self.spark, f"{self.path}/answers"):
            return self.spark.createDataFrame([], _ANSWERS)
        rows = self.spark.read.schema(_ANSWERS).parquet(f"{self.path}/answers")
        best = F.min_by(F.struct("hop", "status", "payload"), F.struct(~_final(F.col("status")), "hop", "status", "payload"))
        return rows.groupBy("asked").agg(best.alias("_row")).select("_row.hop", "asked", "_row.status", "_row.payload")

    def works(self) -> DataFrame:
        """node, hop, title, doi, year, citations, n_references, cites: each found work at the hop that reached it first."""
        found = parse_works(self.answers().where(_final(F.col("status")))).where("work is not null")
        w = F.col("work")
        rows = found.select(
            work_node(w["id"]).alias("node"), "hop", w["title"].alias("title"), w["doi"].alias("doi"), w["publication_year"].alias("year"), w["cited_by_count"].alias("citations"),
            reference_count(w["referenced_works"]).alias("n_references"), F.transform(F.coalesce(w["referenced_works"], F.array().cast("array<string>")), work_node).alias("cites"), "asked",
        )
        first = F.row_number().over(Window.partitionBy("node").orderBy("hop", "asked"))
        return rows.withColumn("_first", first).where("_first = 1").drop("_first", "asked")

    def edges(self) -> DataFrame:
        """src, dst: every citation of a found work, whether the cited one was looked up or not."""
        return self.works().select(F.col("node").alias("src"), F.explode(F.array_distinct("cites")).alias("dst"))

    def errors(self) -> DataFrame:
        """asked, hop, message of what gave no work."""
        told = parse_works(self.answers()).where(~_final(F.col("status")) | F.col("work").isNull())
        failed = F.when(F.col("status") == 0, F.col("payload")).otherwise(F.concat(F.lit("the catalogue answered "), F.col("status").cast("string")))
        message = F.when(~_final(F.col("status")), F.concat(F.lit(ERROR_PREFIX), failed)).when(F.col("error").isNotNull(), F.concat(F.lit(ERROR_PREFIX), F.col("error"))).otherwise(F.lit(NOT_FOUND))
        return told.select("asked", "hop", message.alias("message"))

    # -- steps -----------------------------------------------------------------------------------------------------------

    def start(self, inputs: DataFrame, input_col: str = "input") -> DataFrame:
        """Looks the seeds up (identifiers or titles; null and blank ones aren't asked for). A started run goes on instead."""
        if self.hop < 0:
            asked = inputs.select(trim_all(F.col(input_col)).alias("asked")).where("asked <> ''").distinct()
            asked.write.mode("overwrite").parquet(f"{self.path}/frontier/hop=0")
        self._fill()
        return self.works()

    def expand(self, include: Column | DataFrame | None = None) -> DataFrame:
        """The next hop: what the works of the last one cite and nobody has asked for yet.

        `include` chooses among the works of the last hop: a condition on the columns of `works`, or a table of their nodes.
        """
        if self.hop < 0:
            raise ValueError("start with seeds first")
        self._fill()  # what a stopped run left
        works, hop = self.works(), self.hop
        last = works.where(F.col("hop") == hop)
        if isinstance(include, Column):
            last = last.where(include)
        elif include is not None:
            last = last.join(include.select("node"), "node", "left_semi")
        known = works.select(F.col("node").alias("asked")).unionByName(self.answers().select("asked"))
        asked = last.select(F.explode("cites").alias("asked")).where("asked <> ''").distinct().join(known, "asked", "left_anti")
        asked.write.mode("overwrite").parquet(f"{self.path}/frontier/hop={hop + 1}")
        self._fill()
        return self.works()

    def run(self, inputs: DataFrame, hops: int, include: Column | DataFrame | None = None, input_col: str = "input") -> DataFrame:
        """The works within so many hops; repeated after a stop, it makes the calls that are missing."""
        self.start(inputs, input_col)
        while self.hop < hops:
            self.expand(include)
        return self.works()

    def _fill(self) -> None:
        """Asks for what the last frontier holds and has no final answer."""
        hop = self.hop
        frontier = self.spark.read.schema("asked string").parquet(f"{self.path}/frontier/hop={hop}")
        done = self.answers().where(_final(F.col("status"))).select("asked")
        left = write_table(frontier.join(done, "asked", "left_anti"), "frontier")
        slices = -(-left.count() // self.slice_rows)
        for k in range(slices):
            own = left.where(F.pmod(F.xxhash64("asked"), F.lit(slices)) == k)
            answers = fetch(own, "asked", **self.options).select(F.lit(hop).alias("hop"), "asked", "status", "payload")
            # a task's answers are kept as it ends, whatever becomes of the others
            answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/answers")
        drop_table(left)


def _final(status: Column) -> Column:
    return (status > 0) & (status < 500) & ~status.isin(408, 429)
