"""Streams of requests: logged with the hits that they bring, or searched for batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from litsieve.operators.querylog import RunLog, log_rows
from litsieve.operators.search import run_searches
from litsieve.schemas import REQUEST, RESULTS


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON requests with `log_id`, `asked_at` and `hits`, read as they arrive."""
    return spark.readStream.schema(f"log_id string, asked_at timestamp, hits bigint, {REQUEST}").json(path)


def log_stream(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the log rows of new requests as Parquet; the file sink with its checkpoint writes each row once."""
    rows = log_rows(requests, F.coalesce("hits", F.lit(0)), F.col("log_id"), F.col("asked_at"))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def search_batch(path: str, **options: str) -> Callable[[DataFrame, int], None]:
    """A batch of requests (`log_id`, `asked_at`, the nine fields) to answers, log, results and errors in `path`.

    All is kept by the batch's number, and the answers first: a batch that Spark hands over again calls nobody for answers that
    are whole, adds nothing to the log, and writes the same results.
    """

    def handle(batch: DataFrame, number: int) -> None:
        log = RunLog(batch.sparkSession, f"{path}/log")
        out = run_searches(batch, f"{path}/answers/batch={number}", F.col("asked_at"), request_id="log_id", log=log, run_id=f"batch-{number}", **options)
        out.results.write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        out.errors.write.mode("overwrite").parquet(f"{path}/errors/batch={number}")

    return handle


def search_stream(requests: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Searches for every request of a stream as it arrives."""
    return requests.writeStream.foreachBatch(search_batch(path, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def searched_results(spark: SparkSession, path: str) -> DataFrame:
    """The results of all batches: log_id and the results table."""
    return spark.read.schema(f"log_id string, {RESULTS}").parquet(f"{path}/results").drop("batch")


def searched_errors(spark: SparkSession, path: str) -> DataFrame:
    """The requests of all batches whose call failed or whose answer is no JSON."""
    return spark.read.schema("log_id string, message string").parquet(f"{path}/errors").drop("batch")
