"""The data source with a transport of its own; no network."""

import shutil

import pytest
from pyspark.sql import functions as F

from litsieve.operators import response as R
from litsieve.operators.search import run_diagnostics, run_searches
from litsieve.operators.works import NOT_FOUND
from litsieve.schemas import REQUEST, REQUEST_FIELDS
from litsieve.sources.literature import LiteratureSource, MissingKeyError, payload_files, register
from tests.fake_transport import CALLS
from litsieve.streaming.requests import log_stream, request_stream


def reader(spark, **options):
    register(spark)
    return spark.read.format("literature").options(transport="tests.fake_transport:search", **options)


def test_search(spark):
    rows = reader(spark, api_key="k").load().where("query = 'a b'")
    got = R.results(R.parse_responses(rows), "query").collect()
    assert [(r.query, r.title) for r in got] == [("a b", "olar&q=a%20b")]
    assert "api_key" not in rows._jdf.queryExecution().toString()


def test_missing_key_and_errors(spark, monkeypatch):
    monkeypatch.delenv("LITSIEVE_API_KEY", raising=False)
    with pytest.raises(Exception, match="api_key"):
        reader(spark, query="x").load().collect()
    with pytest.raises(Exception, match="401"):
        reader(spark, query="x", api_key="bad").load().collect()


def test_works_mode(spark):
    register(spark)
    df = spark.read.format("literature").options(transport="tests.fake_transport:works", mode="works", contact="c@x")
    assert "/works/https://doi.org/10.1/x?mailto=c@x" in df.option("query", " 10.1/x ").load().first().payload
    assert "works?search=w%201&mailto=c@x" in df.option("query", "w 1").load().first().payload


def test_flag(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        with pytest.raises(RuntimeError, match="filterPushdown"):
            register(spark)
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert LiteratureSource.name() == "literature"


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from litsieve.session import shared_dir

    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default)))


def test_payload_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"organic_results":\n[{"title":"T"}]}')
    assert [r.title for r in R.titles(R.parse_responses(payload_files(spark, str(tmp_path)))).collect()] == ["T"]


def test_log_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"log_id":"a","asked_at":"2024-05-01T12:00:00","hits":1000,"allWords":"x"}\n')
    for _ in range(2):  # the second run finds nothing new
        log_stream(request_stream(spark, str(source)), str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    (source / "2.json").write_text('{"log_id":"b","exact":"y"}\n')
    log_stream(request_stream(spark, str(source)), str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    got = {r.log_id: (r.query, r.results) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {"a": ("x", "1,000"), "b": ('"y"', "0")}


def calls(folder):
    return sorted(f.read_text() for f in folder.iterdir())


@pytest.fixture
def counted():
    shutil.rmtree(CALLS, ignore_errors=True)
    CALLS.mkdir()
    yield CALLS
    shutil.rmtree(CALLS, ignore_errors=True)


def requests(spark, *rows):
    return spark.createDataFrame([(k, *(r.get(f) for f in REQUEST_FIELDS)) for k, r in enumerate(rows)], "request_id long, " + REQUEST)


def test_search_from_form_to_results(spark, tmp_path, counted):
    """One call a request, whatever is read afterwards; the log before the titles; failures end nothing and aren't logged."""
    asked = requests(spark, dict(allWords="a b", ylo="1990"), dict(allWords="boom"), dict(allWords="busy"), dict(allWords="html"), dict(exact="c", scope="title"))
    seen = []

    def gate(frame):
        seen.append((frame.columns, frame.count(), spark.table("search_log").count()))
        return True

    out = run_searches(asked, str(tmp_path / "answers"), F.lit("2024-05-01 12:00:00"), "search_log", "search_results", gate, gate, transport="tests.fake_transport:counted", api_key="SECRET")
    for _ in range(2):
        assert [tuple(r) for r in out.hits.orderBy("request_id").collect()] == [(0, 1234), (4, 1234)]
        assert out.titles.count() == out.results.count() == spark.table("search_results").count() == 4
        assert {r.request_id: r.message for r in out.errors.collect()} == {1: "Error: no route", 2: "Error: the search service answered 503", 3: "Error: the answer is not JSON"}
    assert len(calls(counted)) == 5 and all("api_key=SECRET" in u for u in calls(counted))
    assert seen == [(["request_id", "total_hits"], 2, 2), (["request_id", "position", "title"], 4, 2)]
    log = {r.log_id: (r.query, r.results, r.api_calls) for r in spark.table("search_log").collect()}
    assert log == {"0": ("a b", "1,234", 1), "4": ('allintitle: "c"', "1,234", 1)}
    assert "SECRET" not in out.results._jdf.queryExecution().toString()


def test_search_stops_at_its_gates(spark, tmp_path, counted, monkeypatch):
    monkeypatch.delenv("LITSIEVE_API_KEY", raising=False)
    with pytest.raises(MissingKeyError):
        run_searches(requests(spark, dict(allWords="a")), str(tmp_path / "none"), F.lit("2024-05-01"))
    assert calls(counted) == []
    options = dict(transport="tests.fake_transport:counted", api_key="k")
    out = run_searches(requests(spark, dict(allWords="a")), str(tmp_path / "one"), F.lit("2024-05-01"), list_titles=lambda hits: False, **options)
    assert out.titles is None and out.results is None and out.hits.count() == 1
    out = run_searches(requests(spark, dict(allWords="a")), str(tmp_path / "two"), F.lit("2024-05-01"), import_metadata=lambda titles: False, **options)
    assert out.titles.count() == 2 and out.results is None
    empty = run_searches(requests(spark, dict(allWords="a")).limit(0), str(tmp_path / "three"), F.lit("2024-05-01"), **options)
    assert empty.hits.count() == empty.results.count() == empty.errors.count() == 0 and len(calls(counted)) == 2


def test_diagnosis_from_input_to_report(spark, tmp_path, counted):
    inputs = spark.createDataFrame([(1, " W7\ufeff\n"), (2, "some title"), (3, "boom"), (4, "html"), (5, "10.1234/a"), (6, None)], "k int, input string")
    out = run_diagnostics(inputs, str(tmp_path / "answers"), transport="tests.fake_transport:counted", contact="c@x")
    got = {r.k: r.message for r in out.collect()}
    out.count()
    assert len(calls(counted)) == 6
    assert got[1].startswith("--- METADATA RECOVERED ---\n\nTitle: W7\n") and "Title: https://doi.org/10.1234/a\n" in got[5]
    assert got[2] == got[6] == NOT_FOUND and got[3] == "DIAGNOSTIC ERROR: no route" and got[4].startswith("DIAGNOSTIC ERROR: ")


def test_several_queries_in_one_read(spark, counted):
    rows = reader(spark, api_key="k").option("transport", "tests.fake_transport:counted").load().where("query in ('a', 'b', 'a')").collect()
    assert sorted(r.query for r in rows) == ["a", "b"] and len(calls(counted)) == 2


def test_strict_routing(spark, counted):
    frame = spark.read.format("literature").options(transport="tests.fake_transport:counted", mode="works", contact="c@x", route="strict")
    register(spark)
    for text, path in (("Water quality", "works?search=Water%20quality"), ("https://doi.org/10.1234/x", "works/https://doi.org/10.1234/x?"), ("W12", "works/W12?")):
        frame.option("query", text).load().collect()
        assert any(path in u for u in calls(counted)), path
