"""A search from form to results, and a diagnosis from input to report: one call a request, everything else from its answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.operators.compile import compile_requests
from litsieve.operators.querylog import RunLog, append_log, log_rows
from litsieve.operators.response import parse_responses, results, titles, total_hits, with_totals, write_results
from litsieve.operators.works import diagnose, parse_works
from litsieve.sources.literature import captured, fetch

# Fixed value: how a failed search begins its message.
ERROR_PREFIX = "Error: "


@dataclass
class Searched:
    """What a run of searches left: all frames read the captured answers."""

    hits: DataFrame  # request_id, total_hits of the answered requests
    titles: DataFrame | None  # request_id, position, title; None where they weren't wanted
    results: DataFrame | None  # request_id and the results table; None where it wasn't wanted
    errors: DataFrame  # request_id, message of the others


def _always(frame: DataFrame) -> bool:
    return True


def run_searches(
    requests: DataFrame, path: str, logged_at: Column, log_table: str | None = None, results_table: str | None = None,
    list_titles: Callable[[DataFrame], bool] = _always, import_metadata: Callable[[DataFrame], bool] = _always, request_id: str = "request_id",
    log: RunLog | None = None, run_id: str | None = None, **options: str,
) -> Searched:
    """Searches for every row of requests (request_id and the nine fields).

    Without a key nothing is called. Each request is called for once and its answer written to `path`. Answers that parse
    are logged, in one append, before anything else is made of them; failed calls and answers that are no JSON are errors and
    aren't logged. `list_titles` sees the hits and decides whether titles are made, `import_metadata` sees the titles and decides
    whether the results table is (and replaces `results_table`).

    With a `run_id` the run can be repeated after a stop: answers that are whole at `path` aren't called for again, and `log`
    takes the run's rows once.
    """
    if (log is None) != (run_id is None):
        raise ValueError("a run log needs a run_id, and a run_id a run log")
    compiled = compile_requests(requests)
    raw = captured(fetch(compiled, **options), path, resume=run_id is not None)
    answers = parse_responses(raw)
    good = F.col("status").between(200, 299) & F.col("corrupt").isNull() & (F.coalesce(F.trim("payload"), F.lit("")) != "")
    answered = answers.where(good)
    hits = answered.select(request_id, total_hits().alias("total_hits"))
    message = F.when(F.col("status") == 0, F.col("payload")).when(~F.col("status").between(200, 299), F.concat(F.lit("the search service answered "), F.col("status").cast("string"))).otherwise(F.lit("the answer is not JSON"))
    errors = answers.where(~good).select(request_id, F.concat(F.lit(ERROR_PREFIX), message).alias("message"))
    if log_table is not None or log is not None:
        rows = log_rows(with_totals(answered), total_hits(), F.col(request_id), logged_at, results=F.col("total_text"))
        if log_table is not None:
            append_log(rows, log_table)
        if log is not None:
            log.append(rows, run_id)
    listed = titles(answered, request_id) if list_titles(hits) else None
    table = results(answered, request_id) if listed is not None and import_metadata(listed) else None
    if table is not None and results_table is not None:
        write_results(table, results_table)
    return Searched(hits, listed, table, errors)


def run_diagnostics(inputs: DataFrame, path: str, input_col: str = "input", **options: str) -> DataFrame:
    """Every row of inputs with `message`: the report about its work, that none was found, or the error."""
    answers = captured(fetch(inputs, input_col, **options | {"mode": "works"}), path)
    works = parse_works(answers)
    works = works.withColumn("error", F.when(F.col("status") == 0, F.col("payload")).otherwise(F.col("error")))
    return diagnose(works, *inputs.columns)
