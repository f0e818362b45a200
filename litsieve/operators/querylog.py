"""The append-only query log, recall of a logged request, and replay."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.functions.text import filled
from litsieve.operators.compile import human_link, link_formula, request_query
from litsieve.operators.numbering import numbered
from litsieve.operators.response import hits_text
from litsieve.schemas import LOG, REQUEST_FIELDS
from litsieve.session import create_once, exists

# The scope that an empty one stands for, the log sheet's name and its two header rows (column D is a spacer),
# and what is said about a selection that isn't a row of the log.
DEFAULT_SCOPE = "anywhere"
SHEET = "Log"
HEADERS = [
    ["TimeStamp", "Scholar Link", "Search Query", "", "All Words", "Exact Phrase", "At least one of", "Without words", "Where", "Author", "Published in", "Years", "", "API Calls", "Results"],
    ["", "", "", "", "", "", "", "", "", "", "", "From", "To", "", ""],
]
WRONG_SHEET = "Please click on a row in the 'Log' sheet first."
HEADER_ROW = "Please select a data row."


class LogRowError(LookupError):
    """There is no such row in the log."""


def log_rows(requests: DataFrame, hits: Column, log_id: Column, logged_at: Column, api_calls: int = 1, results: Column | None = None) -> DataFrame:
    """One log row per request: when, link, query, the nine inputs ('' for missing ones), calls and the hit count as text.

    `results` is that text where the service gave one. `log_id` has to be unique; pass `F.expr("uuid()")` for new rows. The clock is an argument, so that runs can be repeated.
    """
    rows = requests.withColumn("query", request_query())
    return rows.select(
        log_id.cast("string").alias("log_id"),
        logged_at.cast("timestamp").alias("logged_at"),
        human_link(F.col("query"), F.col("ylo"), F.col("yhi")).alias("human_link"),
        "query",
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in REQUEST_FIELDS),
        F.lit(api_calls).cast("int").alias("api_calls"),
        (hits_text(hits) if results is None else results).alias("results"),
    )


def append_log(rows: DataFrame, table: str) -> None:
    """Creates the log table if it isn't there, then appends. `RunLog.append` can be repeated, this can't."""
    rows.sparkSession.sql(f"CREATE TABLE IF NOT EXISTS {table} ({LOG}) USING parquet")
    rows.select(*(f.split()[0] for f in LOG.split(", "))).write.mode("append").insertInto(table)


class RunLog:
    """A log that runs append to, each run once, in a folder: `rows/run=<id>` has a run's rows, `runs/<id>` says that they are whole.

    Nothing has to be created first. A run that stopped before its marker left rows that no reader sees; its repetition writes
    them again. A row whose log_id an earlier run has committed isn't added, and where two runs added one at the same time, readers see
    that of the run that was committed first.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _marker(self, run_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run_id):
            raise ValueError(f"a run is named by letters, digits, '.', '_' and '-', not {run_id!r}")
        return f"{self.path}/runs/{run_id}"

    def committed(self, run_id: str) -> bool:
        return exists(self.spark, self._marker(run_id))

    def append(self, rows: DataFrame, run_id: str) -> bool:
        """Adds the rows of a run, one for each log_id; False if the run is in the log already."""
        marker = self._marker(run_id)
        if exists(self.spark, marker):
            return False
        self._write(rows, run_id)
        return create_once(self.spark, marker, run_id)

    def _write(self, rows: DataFrame, run_id: str) -> None:
        known = self.read().select("log_id")
        one = rows.groupBy("log_id").agg(F.min(F.struct(*(c for c in rows.columns if c != "log_id"))).alias("_row")).select("log_id", "_row.*")
        one.join(known, "log_id", "left_anti").write.mode("overwrite").parquet(f"{self.path}/rows/run={run_id}")

    def read(self) -> DataFrame:
        """The rows of committed runs, one for each log_id."""
        if not exists(self.spark, f"{self.path}/runs"):
            return self.spark.createDataFrame([], LOG)
        runs = self.spark.read.text(f"{self.path}/runs", wholetext=True).select(F.col("value").alias("run"), F.col("_metadata.file_modification_time").alias("_since"))
        rows = self.spark.read.schema(f"{LOG}, run string").parquet(f"{self.path}/rows").join(runs, "run")
        names = [f.split()[0] for f in LOG.split(", ")]
        first = F.min_by(F.struct(*names), F.struct("_since", "run"))
        return rows.groupBy("log_id").agg(first.alias("_row")).select("_row.*")


def numbered_log(log: DataFrame) -> DataFrame:
    """The log with `number`, the place of each row from 1 in the order of logging (then of log_id)."""
    return numbered(log, ["logged_at", "log_id"])


def recalled(log: DataFrame, *keep: str) -> DataFrame:
    """The nine inputs of logged requests; an empty scope is the default one."""
    scope = F.coalesce(filled(F.col("scope")), F.lit(DEFAULT_SCOPE))
    return log.select(*keep, *(scope.alias("scope") if c == "scope" else F.coalesce(F.col(c), F.lit("")).alias(c) for c in REQUEST_FIELDS))


def recall(log: DataFrame, log_id: str) -> dict[str, str]:
    """The request of one log row, for a form."""
    row = recalled(log.where(F.col("log_id") == log_id)).first()
    if row is None:
        raise LogRowError(f"no row {log_id} in the log")
    return row.asDict()


def sheet_rows(log: DataFrame, number: Column) -> DataFrame:
    """row, c1 to c15: the log as it lies on its sheet, headers first; `number` counts the log's rows from 1."""
    cells = [F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss"), link_formula(F.col("human_link")), F.col("query"), F.lit(""), *(F.col(c) for c in REQUEST_FIELDS), F.col("api_calls").cast("string"), F.col("results")]
    rows = log.select((number + len(HEADERS)).cast("long").alias("row"), *(c.alias(f"c{k}") for k, c in enumerate(cells, 1)))
    headers = [(k, *cells) for k, cells in enumerate(HEADERS, 1)]
    return log.sparkSession.createDataFrame(headers, rows.schema).unionByName(rows)


def selected(log: DataFrame, number: Column, selections: DataFrame, *keep: str) -> DataFrame:
    """What each selection (sheet, row on it) restores: `error`, or the nine inputs; a row below the log restores an empty form."""
    rows = recalled(log, (number + len(HEADERS)).cast("long").alias("_row"))
    found = selections.join(rows, F.col("row") == F.col("_row"), "left")
    error = F.when(~F.col("sheet").eqNullSafe(F.lit(SHEET)), F.lit(WRONG_SHEET)).when(F.col("row") <= len(HEADERS), F.lit(HEADER_ROW))
    restored = [F.when(error.isNull(), F.coalesce(F.col(c), F.lit(DEFAULT_SCOPE if c == "scope" else ""))).alias(c) for c in REQUEST_FIELDS]
    return found.select(*keep, error.alias("error"), *restored)
