"""The bibliographic queries over derived inputs (see plans/derived.py), with their DuckDB equivalents."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.functions.text import encode_component, tokens
from litsieve.operators import compile as C
from litsieve.operators import match as M
from litsieve.operators import querylog as L
from litsieve.operators import response as R
from litsieve.operators import snowball as S
from litsieve.operators import works as W
from litsieve.operators.search import ERROR_PREFIX as SEARCH_ERROR
from litsieve.operators.search import Searched, run_diagnostics, run_searches
from litsieve.plans import canned
from litsieve.plans import derived as D
from litsieve.schemas import REQUEST_FIELDS
from litsieve.session import scratch, ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CONTACT = "contact@example.org"
LOGGED_AT = "2024-05-01 12:00:00"


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.frame(spark, sf_dir, D.REQUESTS)


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.frame(spark, sf_dir, D.WORKS)


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parse_responses(D.payloads(_works(spark, sf_dir)))


# -- SQL pieces ------------------------------------------------------------------------------------------------------------

_R, _W, _I = D.sql(D.REQUESTS), D.sql(D.WORKS), D.sql(D.INPUTS)


def _enc(e: str) -> str:
    out = f"url_encode({e})"
    for was, now in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{was}', '{now}')"
    return out


_PARTS = f"""concat_ws(' ', nullif("allWords", ''), '"' || nullif(exact, '') || '"', '(' || replace(nullif("atLeast", ''), ' ', '{C.ANY}') || ')',
  '-' || replace(nullif(without, ''), ' ', '{C.NONE}'), '{C.AUTHOR}"' || nullif(author, '') || '"', '{C.SOURCE}"' || nullif(source, '') || '"')"""
_QUERY = f"CASE WHEN scope = '{C.TITLE_SCOPE}' THEN '{C.TITLE_PREFIX}' || {_PARTS} ELSE {_PARTS} END"
_YEARS = f"coalesce('&{C.LOW_YEAR}=' || nullif(ylo, ''), '') || coalesce('&{C.HIGH_YEAR}=' || nullif(yhi, ''), '')"
_TRIM = r"regexp_replace(input, '^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$', '', 'g')"
_DOI = f"coalesce(nullif(regexp_extract(link, '{R.DOI_PATTERN}', 0), ''), '{R.NO_DOI}')"
_PDF = f"CASE WHEN ends_with(resource, '.pdf') THEN resource ELSE '{R.NO_PDF}' END"
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


# -- responses -------------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, CAST(0 AS INTEGER) AS position, title, coalesce(nullif(link, ''), '{R.NO_LINK}') AS link, {_DOI} AS doi, {_PDF} AS pdf_link,
  CAST(coalesce(cited_by, 0) AS BIGINT) AS citations, coalesce(summary, '') AS source_summary FROM {_W}""")
def results_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full results table from JSON responses."""
    return R.results(_parsed(spark, sf_dir), "doc_id")


@query(f"SELECT doc_id, CAST(0 AS INTEGER) AS position, title FROM {_W}")
def response_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preview of titles."""
    return R.titles(_parsed(spark, sf_dir), "doc_id")


@query(f"SELECT doc_id, CAST(coalesce(hits, 0) AS BIGINT) AS total_hits FROM {_W}")
def response_total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total number of hits, 0 where it is missing."""
    return _parsed(spark, sf_dir).select("doc_id", R.total_hits().alias("total_hits"))


@query(f"SELECT doc_id, format('{{:,}}', CAST(coalesce(hits, 0) AS BIGINT)) AS hits_text FROM {_W}")
def hits_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of hits with grouped thousands."""
    return _parsed(spark, sf_dir).select("doc_id", R.hits_text(R.total_hits()).alias("hits_text"))


@query(f"SELECT doc_id, {_DOI} AS doi FROM {_W}")
def doi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifier in each link."""
    return _works(spark, sf_dir).select("doc_id", R.doi_of(F.col("link")).alias("doi"))


@query(f"SELECT doc_id, {_PDF} AS pdf_link FROM {_W}")
def pdf_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first resource's link where it is a PDF."""
    resources = F.when(F.col("resource").isNotNull(), F.array(F.struct(F.col("resource").alias("link"))))
    return _works(spark, sf_dir).select("doc_id", R.pdf_of(resources).alias("pdf_link"))


@query(f"SELECT doc_id, doc_id % 3 = 0 AS corrupt FROM {_W}")
def corrupt_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which response texts aren't JSON (every third is cut short here)."""
    cut = F.when(F.col("doc_id") % 3 == 0, F.lit("<html>busy")).otherwise(F.col("payload"))
    broken = D.payloads(_works(spark, sf_dir)).withColumn("payload", cut)
    return R.parse_responses(broken).select("doc_id", F.col("corrupt").isNotNull().alias("corrupt"))


# -- requests --------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_QUERY} AS query FROM {_R}")
def compile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query string of each request."""
    return _requests(spark, sf_dir).select("doc_id", C.request_query().alias("query"))


@query(f"SELECT doc_id, '{C.SEARCH_BASE}' || {_enc(_QUERY)} || {_YEARS} AS url FROM {_R}")
def search_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search address of each request, without a key."""
    return C.compile_requests(_requests(spark, sf_dir)).select("doc_id", F.col("search_url").alias("url"))


@query(f"SELECT doc_id, '{C.HUMAN_BASE}' || {_enc(_QUERY)} || {_YEARS} AS url FROM {_R}")
def human_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address for people of each request."""
    return C.compile_requests(_requests(spark, sf_dir)).select("doc_id", F.col("human_link").alias("url"))


@query(f"""SELECT doc_id, '=HYPERLINK("' || '{C.HUMAN_BASE}' || {_enc(_QUERY)} || {_YEARS} || '", "{C.LINK_LABEL}")' AS formula FROM {_R}""")
def link_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spreadsheet formula for each link."""
    return C.compile_requests(_requests(spark, sf_dir)).select("doc_id", C.link_formula(F.col("human_link")).alias("formula"))


@query(f"SELECT doc_id, {_enc('text')} AS encoded FROM documents")
def encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent-encoding of whole texts."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", encode_component(F.col("text")).alias("encoded"))


# -- works -----------------------------------------------------------------------------------------------------------------

_ROUTED = f"""(SELECT doc_id, t, CASE WHEN contains(t, '10.') OR starts_with(t, 'W') THEN 'lookup' ELSE 'search' END AS mode,
  CASE WHEN contains(t, '10.') THEN 'https://doi.org/' || t ELSE t END AS id FROM (SELECT doc_id, {_TRIM} AS t FROM {_I}))"""
_FOUND = f"(SELECT * FROM {_W} WHERE coalesce(work_id, '') <> '')"
_NREFS = "CAST(coalesce(n_refs, 0) AS BIGINT)"
_VERSIONS = f"coalesce(CAST(nullif(versions, 0) AS VARCHAR), '{W.NOT_LISTED}')"
_CITES = "'https://example.org/cites/' || CAST(doc_id AS VARCHAR)"


@query(f"SELECT doc_id, mode, id FROM {_ROUTED}")
def route_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup or search for each input, compatible rules."""
    return D.frame(spark, sf_dir, D.INPUTS).select("doc_id", W.route(F.col("input")).alias("r")).select("doc_id", "r.mode", "r.id")


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(bare, '^10\.\d{{4,9}}/\S+$') OR regexp_matches(t, '^W\d+$') THEN 'lookup' ELSE 'search' END AS mode,
  CASE WHEN regexp_matches(bare, '^10\.\d{{4,9}}/\S+$') THEN 'https://doi.org/' || bare ELSE t END AS id
  FROM (SELECT doc_id, t, regexp_replace(t, '(?i)^(https?://(dx\.)?doi\.org/|doi:)', '') AS bare FROM (SELECT doc_id, {_TRIM} AS t FROM {_I}))""")
def route_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup or search for each input, anchored rules."""
    return D.frame(spark, sf_dir, D.INPUTS).select("doc_id", W.route(F.col("input"), strict=True).alias("r")).select("doc_id", "r.mode", "r.id")


@query(f"""SELECT doc_id, CASE WHEN mode = 'lookup' THEN '{W.CATALOGUE_BASE}/' || id || '?mailto={CONTACT}'
  ELSE '{W.CATALOGUE_BASE}?search=' || {_enc('id')} || '&mailto={CONTACT}' END AS url FROM {_ROUTED}""")
def catalogue_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue address for each input."""
    return D.frame(spark, sf_dir, D.INPUTS).select("doc_id", W.catalogue_url(W.route(F.col("input")), CONTACT).alias("url"))


@query(f"""SELECT doc_id, title, work_id, doi, CAST(coalesce(cited_by, 0) AS BIGINT) AS citations, {_CITES} AS citations_link, {_NREFS} AS n_references,
  CAST(year AS BIGINT) AS year, {_VERSIONS} AS versions FROM {_FOUND}""")
def work_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report columns of each found work."""
    return W.report(W.parse_works(D.work_payloads(_works(spark, sf_dir))), "doc_id")


_VALUES = ["title", "work_id", "doi", "CAST(coalesce(cited_by, 0) AS VARCHAR)", _CITES, f"CAST({_NREFS} AS VARCHAR)", "CAST(year AS VARCHAR)", _VERSIONS]
_LINES = " || ".join(f"'{k}: ' || coalesce({v}, '{W.UNDEFINED}') || chr(10)" for k, v in zip(W.REPORT_KEYS, _VALUES, strict=True))
_MESSAGE = f"""CASE WHEN coalesce(work_id, '') = '' THEN '{W.NOT_FOUND}' ELSE '{W.REPORT_BANNER.strip()}' || chr(10) || chr(10) || {_LINES} END"""


@query(f"SELECT doc_id, {_MESSAGE} AS message FROM {_W}")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as text, or that nothing was found."""
    return W.diagnose(W.parse_works(D.work_payloads(_works(spark, sf_dir))), "doc_id")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '{W.ERROR_PREFIX}{W.NOT_JSON}' WHEN doc_id % 5 = 1 THEN '{W.ERROR_PREFIX}{W.EMPTY_ANSWER}'
  ELSE {_MESSAGE} END AS message FROM {_W}""")
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message for each answer: the report, nothing found, or what is wrong (a fifth is cut short, a fifth empty here)."""
    works = D.work_payloads(_works(spark, sf_dir))
    broken = F.when(F.col("doc_id") % 5 == 0, F.lit('{"id": "W1", ')).when(F.col("doc_id") % 10 == 1, F.lit(" ")).when(F.col("doc_id") % 10 != 6, F.col("payload"))
    return W.diagnose(W.parse_works(works.withColumn("payload", broken)), "doc_id")


@query(f"SELECT doc_id, {_NREFS} AS n_references FROM {_FOUND}")
def reference_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of references of each found work."""
    works = W.parse_works(D.work_payloads(_works(spark, sf_dir))).where("work is not null")
    return works.select("doc_id", W.reference_count(F.col("work.referenced_works")).alias("n_references"))


# -- log -------------------------------------------------------------------------------------------------------------------

_FIELDS = ", ".join(f"coalesce(\"{f}\", '') AS \"{f}\"" for f in REQUEST_FIELDS)
_RECALLED = ", ".join("coalesce(nullif(scope, ''), 'anywhere') AS scope" if f == "scope" else f"coalesce(\"{f}\", '') AS \"{f}\"" for f in REQUEST_FIELDS)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.log_rows(_requests(spark, sf_dir), F.col("doc_id") * 3, F.col("doc_id"), F.lit(LOGGED_AT))


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS log_id, '{LOGGED_AT}' AS logged_at, '{C.HUMAN_BASE}' || {_enc(_QUERY)} || {_YEARS} AS human_link, {_QUERY} AS query,
  {_FIELDS}, CAST(1 AS INTEGER) AS api_calls, format('{{:,}}', doc_id * 3) AS results FROM {_R}""")
def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log row of each request (the time as text)."""
    return _log(spark, sf_dir).withColumn("logged_at", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS log_id, {_RECALLED} FROM {_R}")
def log_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request that each log row restores."""
    return L.recalled(_log(spark, sf_dir), "log_id")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS log_id, {_QUERY} AS query, TRUE AS same FROM {_R}")
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled requests compile to the query that was logged."""
    log = _log(spark, sf_dir)
    again = L.recalled(log, "log_id", F.col("query").alias("logged")).withColumn("query", C.request_query())
    return again.select("log_id", "query", (F.col("query") == F.col("logged")).alias("same"))



def _number() -> Column:
    """The rows of the derived log are numbered by their ids: row 1 is id 0."""
    return F.col("log_id").cast("long") + 1


_ON_SHEET = f"""CAST(doc_id AS BIGINT) + 3 AS "row", '{LOGGED_AT}' AS c1, '=HYPERLINK("' || '{C.HUMAN_BASE}' || {_enc(_QUERY)} || {_YEARS} || '", "{C.LINK_LABEL}")' AS c2, {_QUERY} AS c3, '' AS c4, """
_ON_SHEET += ", ".join(f"coalesce(\"{f}\", '') AS c{k}" for k, f in enumerate(REQUEST_FIELDS, 5)) + ", '1' AS c14, format('{:,}', doc_id * 3) AS c15"
_HEADS = ", ".join("(" + ", ".join([f"CAST({k} AS BIGINT)", *(f"'{c}'" for c in cells)]) + ")" for k, cells in enumerate(L.HEADERS, 1))


@query(f"""SELECT * FROM (VALUES {_HEADS}) AS h("row", {", ".join(f"c{k}" for k in range(1, 16))}) UNION ALL SELECT {_ON_SHEET} FROM {_R}""")
def log_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as it lies on its sheet: two header rows, then fifteen columns with a spacer."""
    return L.sheet_rows(_log(spark, sf_dir), _number())


_SELECTIONS = "(SELECT doc_id AS pick, CASE WHEN doc_id % 9 = 0 THEN 'Results' WHEN doc_id % 9 = 1 THEN NULL ELSE 'Log' END AS sheet, (doc_id * 2) % 1500 + 1 AS \"row\" FROM documents)"
_WRONG = f"CASE WHEN sheet IS DISTINCT FROM '{L.SHEET}' THEN '{L.WRONG_SHEET.replace(chr(39), chr(39) * 2)}' WHEN \"row\" <= 2 THEN '{L.HEADER_ROW}' END"
_RESTORED = ", ".join(f"CASE WHEN {_WRONG} IS NULL THEN coalesce(nullif(\"{f}\", ''), '{L.DEFAULT_SCOPE if f == 'scope' else ''}') END AS \"{f}\"" for f in REQUEST_FIELDS)


@query(f"""SELECT pick, {_WRONG} AS error, {_RESTORED} FROM {_SELECTIONS} LEFT JOIN {_R} ON doc_id + 3 = "row" """)
def log_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What selections on sheets restore: the request of a log row, an empty form below the log, or an error."""
    picks = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id AS pick", "CASE WHEN doc_id % 9 = 0 THEN 'Results' WHEN doc_id % 9 = 1 THEN NULL ELSE 'Log' END AS sheet", "(doc_id * 2) % 1500 + 1 AS row"
    )
    return L.selected(_log(spark, sf_dir), _number(), picks, "pick")


# -- whole searches over canned answers ------------------------------------------------------------------------------------


def _searched(spark: SparkSession, sf_dir: str, **more: str) -> Searched:
    requests = _requests(spark, sf_dir).withColumnRenamed("doc_id", "request_id")
    options = {"transport": "litsieve.plans.canned:search", "api_key": "none"}
    ship_package(spark)
    return run_searches(requests, scratch(spark, "answers"), F.lit(LOGGED_AT), **more, **options)


def _table(spark: SparkSession, name: str) -> str:
    """A table name of its own, dropped when the driver ends."""
    table = f"litsieve_{name}_{uuid.uuid4().hex}"

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            R.drop_results(spark, table)

    atexit.register(drop)
    return table


_ASKED = f"(SELECT doc_id AS request_id, q, CAST(length(q) AS BIGINT) AS n, * FROM (SELECT *, {_QUERY} AS q FROM {_R}))"
_ROWS = f"""SELECT request_id, CAST(0 AS INTEGER) AS position, left(q, 20) AS title, 'https://doi.org/10.' || (1000 + n) || '/x' AS link, '10.' || (1000 + n) || '/x' AS doi,
  '{R.NO_PDF}' AS pdf_link, n AS citations, '{R.NO_SUMMARY}' AS source_summary FROM {_ASKED} WHERE n % 7 > 2
  UNION ALL SELECT request_id, 1, 'second', '{R.NO_LINK}', '{R.NO_DOI}', '{R.NO_PDF}', 0, 's' FROM {_ASKED} WHERE n % 7 > 2"""


@query(f"SELECT request_id, 1237 * n AS total_hits FROM {_ASKED} WHERE n % 7 > 2")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From request to hit count: every request is compiled, called for once and parsed."""
    return _searched(spark, sf_dir).hits


@query(f"SELECT request_id, position, title FROM ({_ROWS})")
def search_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From request to the preview of titles."""
    return _searched(spark, sf_dir).titles


@query(_ROWS)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From request to the results table, as it was written (over an older one)."""
    table = _table(spark, "results")
    R.write_results(spark.range(3).withColumnRenamed("id", "old"), table)
    _searched(spark, sf_dir, results_table=table)
    return spark.table(table)


@query(f"""SELECT request_id, '{SEARCH_ERROR}' || CASE n % 7 WHEN 0 THEN 'the search service answered 503' WHEN 1 THEN '{canned.NO_ROUTE}' ELSE 'the answer is not JSON' END AS message
  FROM {_ASKED} WHERE n % 7 <= 2""")
def search_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests whose call failed or whose answer is no JSON."""
    return _searched(spark, sf_dir).errors


@query(f"""SELECT CAST(request_id AS VARCHAR) AS log_id, '{LOGGED_AT}' AS logged_at, q AS query, {_FIELDS}, CAST(1 AS INTEGER) AS api_calls, format('{{:,}}', 1237 * n) AS results
  FROM {_ASKED} WHERE n % 7 > 2""")
def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that searches leave: one row for every answered request, none for the others."""
    table = _table(spark, "log")
    _searched(spark, sf_dir, log_table=table)
    return spark.table(table).withColumn("logged_at", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss")).drop("human_link")


_REPORTED = " || ".join(f"'{k}: ' || {{}} || chr(10)" for k in W.REPORT_KEYS)


def _reported(*values: str) -> str:
    return f"'{W.REPORT_BANNER.strip()}' || chr(10) || chr(10) || " + _REPORTED.format(*values)


_NONE = f"'{W.UNDEFINED}'"


@query(f"""SELECT doc_id, CASE WHEN mode = 'lookup' THEN {_reported("id", "'W1'", _NONE, "length(id)", _NONE, "2", "2000", f"'{W.NOT_LISTED}'")}
  WHEN length(t) % 3 = 0 THEN '{W.NOT_FOUND}' WHEN length(t) % 3 = 1 THEN '{W.ERROR_PREFIX}{W.NOT_JSON}'
  ELSE {_reported("t", "'W4'", _NONE, _NONE, _NONE, "0", _NONE, "'2'")} END AS message FROM {_ROUTED}""")
def works_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From input to report: every input is routed, called for once and reported on."""
    inputs = D.frame(spark, sf_dir, D.INPUTS)
    ship_package(spark)
    return run_diagnostics(inputs, scratch(spark, "answers"), transport="litsieve.plans.canned:works", contact=CONTACT).drop("input")


# -- local evaluation ------------------------------------------------------------------------------------------------------

_T, _TT = _TOKENS.format("body"), _TOKENS.format("title")
_SPACED = "' ' || array_to_string({}, ' ') || ' '"


def _matching(name: str, request: dict[str, str], sql: str, doc: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = (F.col(c) for c in ("body", "title", "author", "source", "year"))
        return _works(spark, sf_dir).where(M.matches(request, *columns)).select("doc_id")

    run.__name__, run.__doc__ = name, doc
    query(f"SELECT doc_id FROM {_W} WHERE {sql}")(run)


_matching("match_all", {"allWords": "the, of, and"}, f"list_has_all({_T}, ['the', 'of', 'and'])", "All words occur.")
_matching("match_phrase", {"exact": "of the"}, f"contains({_SPACED.format(_T)}, ' of the ')", "The phrase occurs.")
_matching("match_any", {"atLeast": "der, les"}, f"list_has_any({_T}, ['der', 'les'])", "At least one word occurs.")
_matching("match_without", {"without": "the, la"}, f"NOT list_has_any({_T}, ['the', 'la'])", "No word occurs.")
_matching("match_title_scope", {"allWords": "the", "scope": "title"}, f"list_has_all({_TT}, ['the'])", "All words occur in the title.")
_matching("match_author", {"author": "author 7"}, "contains(lower(author), 'author 7')", "The author's name holds the text.")
_matching("match_source", {"source": "SRC1"}, "contains(lower(source), 'src1')", "The source's name holds the text.")
_matching("match_years", {"ylo": "1990", "yhi": "2005"}, "year >= 1990 AND year <= 2005", "The year lies within the bounds.")
_matching(
    "match_combined",
    {"allWords": "the of", "atLeast": "ndre thth", "without": "der", "source": "src", "ylo": "1985"},
    f"list_has_all({_T}, ['the', 'of']) AND list_has_any({_T}, ['ndre', 'thth']) AND NOT list_has_any({_T}, ['der']) AND contains(lower(source), 'src') AND year >= 1985",
    "A request with several fields.",
)


@query(f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS n_tokens, md5(array_to_string({_TOKENS.format('text')}, ' ')) AS digest FROM documents")
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


# -- extension -------------------------------------------------------------------------------------------------------------

_N = "(SELECT max(doc_id) + 1 FROM documents)"
_EDGES = f"(SELECT doc_id AS src, (doc_id * 7 + 3) % {_N} AS dst FROM documents UNION SELECT doc_id, (doc_id * 11 + 5) % {_N} FROM documents)"


@query(f"""WITH RECURSIVE e AS {_EDGES}, r(node, hop) AS (
    SELECT doc_id, 0 FROM documents WHERE lang = 'es' UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.node WHERE r.hop < 3)
  SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY node""")
def ext_snowball_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: three hops along derived citations (over all ids) from every work in Spanish."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.agg(F.max("doc_id") + 1).first()[0] or 1
    targets = F.array((F.col("doc_id") * 7 + 3) % n, (F.col("doc_id") * 11 + 5) % n)
    edges = docs.select(F.col("doc_id").alias("src"), F.explode(targets).alias("dst")).distinct()
    return S.snowball(edges, docs.where("lang = 'es'").select(F.col("doc_id").alias("node")), 3)
