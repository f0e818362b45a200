"""Runs that stop and go on: live snowball, appended logs, replaced results, streams; numbers of rows; answers of any kind."""

import json
import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from litsieve.operators import citations
from litsieve.operators import querylog as L
from litsieve.operators import response as R
from litsieve.operators.numbering import numbered
from litsieve.operators.search import run_searches
from litsieve.schemas import LOG, REQUEST, REQUEST_FIELDS
from litsieve.session import create_once, exists
from litsieve.streaming.requests import request_stream, search_batch, search_stream, searched_errors, searched_results
from tests.fake_transport import CALLS

CALM = CALLS.parent / (CALLS.name + "-calm")


@pytest.fixture
def counted():
    shutil.rmtree(CALLS, ignore_errors=True)
    CALM.unlink(missing_ok=True)
    CALLS.mkdir()
    yield lambda: Counter(f.read_text().split("?mailto")[0].split("/works/")[-1] for f in CALLS.iterdir())
    shutil.rmtree(CALLS, ignore_errors=True)
    CALM.unlink(missing_ok=True)


# -- live snowball ---------------------------------------------------------------------------------------------------------

OPTIONS = dict(transport="tests.fake_transport:graph", contact="c@x")
UNKNOWN, FAILING = {9}, {5, 7}


def reached(seeds, hops, closed):
    """Hop of every node of the test's catalogue that is reached, found ones only."""
    hop, frontier, found = 0, set(seeds), {}
    asked = set()
    while frontier and hop <= hops:
        asked |= frontier
        new = {k for k in frontier if k not in closed}
        found |= {k: hop for k in new if k not in found}
        frontier = {n for k in new for n in (2 * k + 1, 3 * k + 2, k) if n < 40} - asked
        hop += 1
    return found


def seeds(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "input string")


def hops(frame):
    return {int(r.node[1:]): r.hop for r in frame.collect()}


def test_snowball_calls_once_a_work(spark, tmp_path, counted):
    ball = citations.Snowball(spark, str(tmp_path / "ball"), slice_rows=3, **OPTIONS)
    ball.start(seeds(spark, " W0 ", "W0", "W4", None, "  "))
    assert ball.hop == 0 and hops(ball.works()) == {0: 0, 4: 0} and counted() == {"W0": 1, "W4": 1}
    for k in (1, 2, 3):
        ball.expand()
        assert ball.hop == k
        assert hops(ball.works()) == reached([0, 4], k, UNKNOWN | FAILING)
    calls = counted()
    assert all(n == 1 for node, n in calls.items() if int(node[1:]) not in FAILING)
    before = dict(calls)
    again = citations.Snowball(spark, str(tmp_path / "ball"), **OPTIONS)  # another driver
    assert hops(again.run(seeds(spark, "W0", "W4"), 3)) == reached([0, 4], 3, UNKNOWN | FAILING)
    assert {k for k, n in counted().items() if n != before.get(k)} <= {"W5", "W7"}
    told = {r.asked: r.message for r in again.errors().collect()}
    assert told["W5"] == "DIAGNOSTIC ERROR: the catalogue answered 503" and told["W7"] == "DIAGNOSTIC ERROR: no route" and "W9" in told
    assert {(r.src, r.dst) for r in again.edges().where("src = 'W4'").collect()} == {("W4", "W9"), ("W4", "W14"), ("W4", "W4")}


def test_snowball_goes_on_in_mid_hop(spark, tmp_path, counted, monkeypatch):
    ball = citations.Snowball(spark, str(tmp_path / "ball"), slice_rows=1, **OPTIONS)
    ball.start(seeds(spark, "W0", "W1", "W2", "W4"))
    fetch, left = citations.fetch, [3]

    def stops(*args, **options):
        if not left[0]:
            raise KeyboardInterrupt("the driver stops")
        left[0] -= 1
        return fetch(*args, **options)

    monkeypatch.setattr(citations, "fetch", stops)
    with pytest.raises(KeyboardInterrupt):
        ball.expand()
    monkeypatch.setattr(citations, "fetch", fetch)
    half = counted()
    ball = citations.Snowball(spark, str(tmp_path / "ball"), slice_rows=2, **OPTIONS)
    assert ball.hop == 1 and 4 < sum(half.values()) <= 4 + 3 * 4
    found = ball.run(seeds(spark, "W0", "W1", "W2", "W4"), 2)
    assert hops(found) == reached([0, 1, 2, 4], 2, UNKNOWN | FAILING)
    assert all(n == 1 for node, n in counted().items() if int(node[1:]) not in FAILING)


def test_snowball_asks_again_for_failed_calls(spark, tmp_path, counted):
    ball = citations.Snowball(spark, str(tmp_path / "ball"), **OPTIONS)
    ball.run(seeds(spark, "W2"), 1)  # W2 cites W5 and W8
    assert hops(ball.works()) == {2: 0, 8: 1}
    CALM.touch()
    assert hops(ball.run(seeds(spark, "W2"), 1)) == {2: 0, 8: 1, 5: 1}
    assert counted() == {"W2": 1, "W8": 1, "W5": 2} and ball.errors().count() == 0


def test_snowball_seeds_and_choice(spark, tmp_path, counted):
    ball = citations.Snowball(spark, str(tmp_path / "ball"), **OPTIONS)
    with pytest.raises(ValueError, match="seeds"):
        ball.expand()
    ball.start(seeds(spark, "10.1234/three", "a title", "nothing like it"))
    assert hops(ball.works()) == {1: 0, 3: 0}
    ball.expand(F.col("year") > 1992)  # W3 alone: W7 and W11
    assert hops(ball.works()) == {1: 0, 3: 0, 11: 1}
    ball.expand(spark.createDataFrame([("W11",), ("W99",)], "node string"))
    assert hops(ball.works()) == {1: 0, 3: 0, 11: 1, 23: 2, 35: 2}
    ball.expand(F.lit(False))
    assert ball.hop == 3 and max(hops(ball.works()).values()) == 2


# -- log -------------------------------------------------------------------------------------------------------------------


def log_of(spark, ids, more=0):
    rows = spark.createDataFrame([(str(k), *(f"{f}{k}" for f in REQUEST_FIELDS)) for k in ids], f"id string, {REQUEST}")
    return L.log_rows(rows, F.col("id").cast("int") + more, F.col("id"), F.lit("2024-05-01 12:00:00"))


def shown(log):
    return sorted((r.log_id, r.results) for r in log.read().collect())


def test_log_takes_each_run_once(spark, tmp_path):
    log = L.RunLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0
    assert log.append(log_of(spark, [1, 2, 2]), "a") and not log.append(log_of(spark, [1, 2], 50), "a")
    assert log.append(log_of(spark, [2, 3], 50), "b")
    assert shown(log) == [("1", "1"), ("2", "2"), ("3", "53")]
    assert log.read().schema.simpleString() == spark.createDataFrame([], LOG).schema.simpleString()
    assert log.append(log_of(spark, []), "2024") and shown(log) == [("1", "1"), ("2", "2"), ("3", "53")]
    with pytest.raises(ValueError, match="named by"):
        log.append(log_of(spark, [9]), "../x")


def test_log_after_a_stop_between_rows_and_marker(spark, tmp_path, monkeypatch):
    log = L.RunLog(spark, str(tmp_path / "log"))
    log.append(log_of(spark, [1]), "a")

    def stops(*args):
        raise KeyboardInterrupt("the driver stops")

    monkeypatch.setattr(L, "create_once", stops)
    with pytest.raises(KeyboardInterrupt):
        log.append(log_of(spark, [1, 2, 3]), "b")
    monkeypatch.setattr(L, "create_once", create_once)
    assert shown(log) == [("1", "1")] and not log.committed("b")  # nobody sees half a run
    assert log.append(log_of(spark, [1, 2, 3]), "b") and not log.append(log_of(spark, [1, 2, 3]), "b")
    assert shown(log) == [("1", "1"), ("2", "2"), ("3", "3")]


def test_log_of_runs_at_the_same_time(spark, tmp_path):
    log = L.RunLog(spark, str(tmp_path / "log"))
    log._write(log_of(spark, [1, 2], 10), "z")  # both see an empty log
    log._write(log_of(spark, [2, 3], 20), "a")
    assert create_once(spark, log._marker("z"), "z") and not create_once(spark, log._marker("z"), "z")
    assert shown(log) == [("1", "11"), ("2", "12")]
    assert create_once(spark, log._marker("a"), "a")
    assert [k for k, _ in shown(log)] == ["1", "2", "3"]


def test_numbers(spark):
    r = random.Random(2)
    rows = [(r.choice([None, "a", "b", "c"]), r.choice([None, 1, 2, 3]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, t int, id long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = numbered(df, ["t", "id"])
        order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert {r.id: r.number for r in got.collect()} == {x[2]: k for k, x in enumerate(order, 1)}
        own = numbered(df, ["t", "id"], ["g"], "n").collect()
        for g in (None, "a", "b", "c"):
            mine = [x for x in order if x[0] == g]
            assert {r.id: r.n for r in own if r.g == g} == {x[2]: k for k, x in enumerate(mine, 1)}
            assert {(r.n_size, r.n_start) for r in own if r.g == g} == {(len(mine), sum((x[0] or "") < (g or "") for x in rows))}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert numbered(df.limit(0), ["id"]).count() == numbered(df.limit(0), ["id"], ["g"]).count() == 0
    with pytest.raises(ValueError, match="order"):
        numbered(df, [])


# -- results ---------------------------------------------------------------------------------------------------------------


def test_results_are_replaced_whole_or_not_at_all(spark):
    frame = lambda *ids: spark.createDataFrame([(k,) for k in ids], "k long")
    frame(0).write.mode("overwrite").saveAsTable("kept_results")  # a plain table of an older time
    R.write_results(frame(1, 2), "kept_results")
    bad = frame(3, 4).withColumn("k", F.when(F.col("k") == 4, F.raise_error(F.lit("broken row"))).otherwise(F.col("k")).cast("long"))
    for _ in range(2):
        with pytest.raises(Exception, match="broken row"):
            R.write_results(bad, "kept_results")
        assert {r.k for r in spark.table("kept_results").collect()} == {1, 2}
    reader = spark.table("kept_results")
    R.write_results(frame(5), "kept_results")
    assert {r.k for r in spark.table("kept_results").collect()} == {5} and {r.k for r in reader.collect()} == {1, 2}
    R.write_results(spark.table("kept_results").selectExpr("k + 1 AS k", "'new' AS more"), "kept_results")
    assert [tuple(r) for r in spark.table("kept_results").collect()] == [(6, "new")]
    assert len([t for t in spark.catalog.listTables() if t.name.startswith("kept_results__")]) == 2
    R.drop_results(spark, "kept_results")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("kept_results")]
    R.drop_results(spark, "kept_results")


# -- answers of any kind ---------------------------------------------------------------------------------------------------


def test_totals(spark):
    told = {
        "12": ("12", 12), "1234567": ("1,234,567", 1234567), '"about 1,200"': ("about 1,200", 1200), '"many"': ("many", 0), '""': ("0", 0), "null": ("0", 0), "0": ("0", 0),
        "true": ("true", 0), "false": ("0", 0), "1.5": ("1.5", 1), "1e3": ("1,000", 1000), "-7": ("-7", -7), '"99999999999999999999"': ("99999999999999999999", 0),
    }
    rows = [(k, f'{{"search_information": {{"total_results": {t}}}}}') for k, t in enumerate(told)]
    rows += [(100, "{}"), (101, '{"search_information": 3}'), (102, "<html>"), (103, None), (104, "")]
    got = {r.k: (r.total_text, r.total) for r in R.with_totals(spark.createDataFrame(rows, "k int, payload string")).collect()}
    assert got == dict(enumerate(told.values())) | {k: ("0", 0) for k in range(100, 105)}


def test_dump_has_everything(spark):
    answer = '{"z": [1, 2.0, 2.50, 1e2, -0.5, null, true, [], {}], "ä": "\\u00e9 \\" / \\n 😀", "search_information": {"total_results": "about 12"}}'
    got = {r.k: r.dump for r in R.debug_dump(spark.createDataFrame([(1, answer), (2, "<html>"), (3, None), (4, "[]")], "k int, payload string")).collect()}
    assert json.loads(got[1]) == json.loads(answer) and list(json.loads(got[1])) == ["z", "ä", "search_information"]
    assert got[1].startswith('{\n  "z": [\n    1,\n    2,\n    2.5,\n    100,\n    -0.5,\n    null,\n    true,\n    [],\n    {}\n  ],\n  "ä": "é \\" / \\n 😀"')
    assert (got[2], got[3], got[4]) == (None, None, "[]")


def test_answers_are_parsed_once(spark):
    payloads = spark.createDataFrame([('{"organic_results": [{"title": "T"}]}',), (None,), ("<html>",)], "payload string")
    parsed = R.parse_responses(payloads)
    for frame in (R.results(parsed), R.titles(parsed), parsed.select(R.total_hits(), "corrupt")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, plan
    assert [(r.response is None, r.corrupt) for r in parsed.collect()] == [(False, None), (True, None), (False, "<html>")]


# -- searches that go on ---------------------------------------------------------------------------------------------------


def requests(spark, *rows):
    return spark.createDataFrame([(str(k), *(r.get(f) for f in REQUEST_FIELDS)) for k, r in enumerate(rows)], "request_id string, " + REQUEST)


def test_a_repeated_run_calls_nobody(spark, tmp_path, counted, monkeypatch):
    asked = requests(spark, dict(allWords="a"), dict(exact="b"), dict(allWords="boom"))
    log, options = L.RunLog(spark, str(tmp_path / "log")), dict(transport="tests.fake_transport:counted", api_key="k")
    run = lambda: run_searches(asked, str(tmp_path / "answers"), F.lit("2024-05-01"), log=log, run_id="one", **options)
    with monkeypatch.context() as m:
        m.setattr(L.RunLog, "append", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt("the driver stops")))
        with pytest.raises(KeyboardInterrupt):
            run()
    assert sum(counted().values()) == 3 and log.read().count() == 0
    for _ in range(2):
        out = run()
        assert out.hits.count() == 2 and out.errors.count() == 1 and sorted(r.log_id for r in log.read().collect()) == ["0", "1"]
    assert sum(counted().values()) == 3
    with pytest.raises(ValueError, match="run_id"):
        run_searches(asked, str(tmp_path / "other"), F.lit("2024-05-01"), log=log, **options)


def test_stream_searches_each_request_once(spark, tmp_path, counted):
    source, out, options = tmp_path / "in", str(tmp_path / "out"), dict(transport="tests.fake_transport:counted", api_key="k")
    source.mkdir()

    def run():
        search_stream(request_stream(spark, str(source)), out, str(tmp_path / "check"), **options).awaitTermination()

    def logged():
        return sorted((r.log_id, r.results) for r in L.RunLog(spark, f"{out}/log").read().collect())

    (source / "1.json").write_text('{"log_id":"a","asked_at":"2024-05-01T12:00:00","allWords":"x"}\n{"log_id":"b","asked_at":"2024-05-01T12:00:00","allWords":"html"}\n')
    run()
    run()  # finds nothing new
    assert sum(counted().values()) == 2 and logged() == [("a", "1,234")]
    (source / "2.json").write_text('{"log_id":"c","exact":"y"}\n')
    run()
    shutil.rmtree(tmp_path / "check" / "commits")  # the last batches were done but not noted
    run()
    assert sum(counted().values()) == 3 and logged() == [("a", "1,234"), ("c", "1,234")]
    search_batch(out, **options)(spark.read.schema(request_stream(spark, str(source)).schema).json(str(source)), 1)  # batch 1 again
    assert sum(counted().values()) == 3 and logged() == [("a", "1,234"), ("c", "1,234")]
    got = sorted((r.log_id, r.position, r.title) for r in searched_results(spark, out).collect())
    assert got == [("a", 0, "A"), ("a", 1, "B"), ("c", 0, "A"), ("c", 1, "B")]
    assert [(r.log_id, r.message) for r in searched_errors(spark, out).collect()] == [("b", "Error: the answer is not JSON")]


def test_create_once(spark, tmp_path):
    path = str(tmp_path / "x" / "marker")
    assert create_once(spark, path, "ä") and not create_once(spark, path, "b") and exists(spark, path)
    assert spark.read.text(path).first().value == "ä"
