"""Edge tables of the bibliographic operators."""

from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litsieve.functions.text import encode_component, trim_all
from litsieve.operators import compile as C
from litsieve.operators import match as M
from litsieve.operators import querylog as L
from litsieve.operators import response as R
from litsieve.operators import snowball as S
from litsieve.operators import works as W
from litsieve.schemas import REQUEST, REQUEST_FIELDS


def requests(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f) for f in REQUEST_FIELDS) for r in rows], REQUEST)


COMPILED = [
    (dict(allWords="a b", exact="c d", atLeast="e f", without="g h", author="Au", source="So", scope="title"), 'allintitle: a b "c d" (e OR f) -g -h author:"Au" source:"So"'),
    (dict(scope="anywhere"), ""),
    (dict(scope="title"), "allintitle: "),
    (dict(atLeast="m"), "(m)"),
    (dict(atLeast="a  b", without="a  b"), "(a OR  OR b) -a - -b"),
    (dict(allWords=" "), " "),
    (dict(allWords="0"), "0"),
    ({}, ""),
]


def test_compile(spark):
    got = requests(spark, *(r for r, _ in COMPILED)).select(C.request_query().alias("q")).collect()
    assert [r.q for r in got] == [q for _, q in COMPILED]


def test_urls(spark):
    r = C.compile_requests(requests(spark, dict(allWords="a b&c", ylo="1990"), dict(exact="x", yhi="2001"))).collect()
    assert r[0].search_url == C.SEARCH_BASE + "a%20b%26c&as_ylo=1990"
    assert r[1].human_link == C.HUMAN_BASE + "%22x%22&as_yhi=2001"
    assert "api_key" not in r[0].search_url


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\0"), max_size=20), min_size=40, max_size=80))
def test_encoder(spark, texts):
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", encode_component(F.col("t")).alias("e")).collect()
    assert {r.k: r.e for r in got} == {k: quote(t, safe="-_.!~*'()") for k, t in enumerate(texts)}


LINKS = [
    ("https://doi.org/10.1234/abc.DEF", "10.1234/abc.DEF"),
    ("https://x/110.12345/a", "10.12345/a"),
    ("https://x/10.123/short", "Not found"),
    ("https://x/10.1234567890/long", "Not found"),
    ("https://x/10.1000/", "Not found"),
    ("https://x/doi/10.5555/a(b)c?x=1", "10.5555/a(b)c"),
    ("https://x/10.1000/a;10.2000/b", "10.1000/a;10.2000/b"),
    ("", "Not found"),
    (None, "Not found"),
]


def test_doi(spark):
    got = spark.createDataFrame(LINKS, "link string, want string").select(R.doi_of(F.col("link")).alias("d"), "want").collect()
    assert [r.d for r in got] == [r.want for r in got]


def test_pdf(spark):
    cases = [(["https://x.pdf", "y"], "https://x.pdf"), (["x.PDF"], "None"), (["x.pdf?q"], "None"), ([], "None"), (None, "None"), ([None], "None"), (["a", "b.pdf"], "None")]
    rows = [(None if x is None else [(y,) for y in x], w) for x, w in cases]
    got = spark.createDataFrame(rows, "r array<struct<link: string>>, want string").select(R.pdf_of(F.col("r")).alias("p"), "want").collect()
    assert [r.p for r in got] == [r.want for r in got]


def test_responses(spark):
    payloads = [
        (1, '{"search_information":{"total_results":1234567},"organic_results":[{"title":"T","link":"https://doi.org/10.1234/x","inline_links":{"cited_by":{"total":5}},"publication_info":{"summary":"S"}},{}]}'),
        (2, '{"organic_results":[]}'),
        (3, "{}"),
        (4, "<html>busy</html>"),
        (5, '{"search_information":{"total_results":"about 12"},"organic_results":[{"title":"U","resources":[]}]}'),
        (6, None),
    ]
    parsed = R.parse_responses(spark.createDataFrame(payloads, "k int, payload string")).cache()
    assert [r.h for r in parsed.orderBy("k").select(R.total_hits().alias("h")).collect()] == [1234567, 0, 0, 0, 0, 0]
    assert [tuple(r) for r in R.results(parsed, "k").orderBy("k", "position").collect()] == [
        (1, 0, "T", "https://doi.org/10.1234/x", "10.1234/x", "None", 5, "S"),
        (1, 1, None, "N/A", "Not found", "None", 0, ""),
        (5, 0, "U", "N/A", "Not found", "None", 0, ""),
    ]
    assert [r.k for r in parsed.where("corrupt is not null").collect()] == [4]
    assert parsed.where("k = 1").select(R.hits_text(R.total_hits()).alias("t")).first().t == "1,234,567"


ROUTES = [
    ("10.1/x", "lookup", "https://doi.org/10.1/x"),
    ("https://doi.org/10.1/x", "lookup", "https://doi.org/https://doi.org/10.1/x"),
    ("W123", "lookup", "W123"),
    ("W10.5", "lookup", "https://doi.org/W10.5"),
    ("Water quality", "lookup", "Water quality"),
    ("graph 10.5 study", "lookup", "https://doi.org/graph 10.5 study"),
    ("w123", "search", "w123"),
    ("", "search", ""),
    (" \n W1 ﻿", "lookup", "W1"),
]


def test_routes(spark):
    df = spark.createDataFrame([(a,) for a, _, _ in ROUTES], "i string")
    assert [tuple(r.r) for r in df.select(W.route(F.col("i")).alias("r")).collect()] == [(m, i) for _, m, i in ROUTES]
    strict = {r.i: tuple(r.r) for r in df.select("i", W.route(F.col("i"), strict=True).alias("r")).collect()}
    assert strict["Water quality"] == ("search", "Water quality") and strict["W123"] == ("lookup", "W123")
    doi = spark.createDataFrame([("https://doi.org/10.1234/x",), ("doi:10.1234/x",)], "i string").select(W.route(F.col("i"), strict=True).alias("r")).collect()
    assert {tuple(r.r) for r in doi} == {("lookup", "https://doi.org/10.1234/x")}


def test_works(spark):
    payloads = [
        (1, '{"id":"W1","title":"T","cited_by_count":3,"referenced_works":["W2","W3"],"publication_year":1999,"versions_count":0}'),
        (2, '{"results":[{"id":"W9","versions_count":4,"doi":"d"},{"id":"W8"}]}'),
        (3, '{"results":[]}'),
        (4, '{"error":"x"}'),
        (5, "nonsense"),
        (6, None),
        (7, " "),
        (8, '{"id":"W5","cited_by_count":"many"}'),
        (9, "null"),
    ]
    works = W.parse_works(spark.createDataFrame(payloads, "k int, payload string"))
    got = {r.k: r for r in W.report(works, "k").collect()}
    assert sorted(got) == [1, 2, 8] and got[8].citations is None
    assert (got[1].n_references, got[1].versions, got[2].n_references, got[2].versions) == (2, "Not listed", 0, "4")
    messages = {r.k: r.message for r in W.diagnose(works, "k").collect()}
    assert messages[3] == messages[4] == W.NOT_FOUND and messages[5] == messages[9] == W.ERROR_PREFIX + W.NOT_JSON and messages[6] == messages[7] == W.ERROR_PREFIX + W.EMPTY_ANSWER
    plan = W.diagnose(works, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1, plan
    assert messages[1].startswith("--- METADATA RECOVERED ---\n\nTitle: T\n") and "DOI: undefined\n" in messages[1] and messages[1].endswith("Versions Count: Not listed\n")


def test_log(spark):
    asked = requests(spark, dict(allWords="a", scope=None), dict(exact="b", scope="title", ylo="1990")).withColumn("k", F.monotonically_increasing_id())
    for _ in range(2):  # a uuid is drawn once for each plan, so every append plans its own rows
        L.append_log(L.log_rows(asked, F.lit(1234), F.expr("uuid()"), F.lit("2024-05-01 12:00:00")), "query_log")
    log = spark.table("query_log")
    assert log.count() == 4 and log.select("log_id").distinct().count() == 4
    row = log.where("exact = 'b'").orderBy("log_id").first()
    assert row.results == "1,234" and row.api_calls == 1 and row.author == ""
    back = L.recall(log, row.log_id)
    assert back == {f: "" for f in REQUEST_FIELDS} | {"exact": "b", "scope": "title", "ylo": "1990"}
    assert L.recall(log, log.where("allWords = 'a'").first().log_id)["scope"] == "anywhere"
    with pytest.raises(L.LogRowError):
        L.recall(log, "2")


def test_overwrite(spark):
    parsed = R.parse_responses(spark.createDataFrame([('{"organic_results":[{"title":"T"}]}',)], "payload string"))
    R.write_results(R.results(parsed), "results_table")
    R.write_results(R.results(parsed), "results_table")
    assert spark.table("results_table").count() == 1


def test_matches(spark):
    works = spark.createDataFrame([(1, "The cat, of the house", "The cat", "Ann Lee", "Nature", 1999), (2, "a dog", "dog", None, None, None)], "k int, body string, title string, author string, source string, year int")
    ask = lambda **r: [x.k for x in works.where(M.matches(r, *(F.col(c) for c in ("body", "title", "author", "source", "year")))).collect()]
    assert ask(allWords="CAT the") == [1] and ask(exact="of the") == [1] and ask(exact="the of") == [] and ask(atLeast="dog house") == [1, 2]
    assert ask(without="dog") == [1] and ask(allWords="house", scope="title") == [] and ask(author="lee") == [1] and ask(source="NAT") == [1]
    plan = works.where(M.matches(dict(allWords="a", atLeast="b", without="c", exact="d"), *(F.col(c) for c in ("body", "title", "author", "source", "year"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(coalesce(body") == plan.count("regexp_extract_all") == 1, plan
    assert ask(ylo="1999") == [1] and ask(yhi="1998") == [] and ask() == [1, 2]


def test_snowball(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in S.snowball(edges, seeds, 5).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r.node for r in S.snowball(edges, seeds, 5, include=F.col("node") != 3).collect()} == {1, 2, 3}


def test_trim(spark):
    assert spark.range(1).select(trim_all(F.lit(" \t x y \n﻿")).alias("t")).first().t == "x y"
