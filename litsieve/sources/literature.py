"""A Python Data Source for the remote search API and the open catalogue, and calls for a table of requests.

    spark.dataSource.register(LiteratureSource)
    spark.read.format("literature").option("mode", "search").option("api_key", key).load().where("query = 'graph mining'")

Modes: `search` (needs a key) and `works` (routes each input to a lookup or a search; `route=strict` asks for whole
identifiers). The query, `ylo` and `yhi` come as options or as pushed filters, `query IN (...)` is one call each. One row per
call: query, ylo, yhi, status, payload. `transport` names a function `module:function(url, headers) -> (status, text)`; the
default one uses urllib. The key is added to the URL inside the transport call only, so it is in no row, plan or log.

A frame of this source calls again at every action. `fetch` makes one call for every row of a table of requests, and
`captured` writes the answers down once, so that counts, titles and results read the same answer.
"""

from __future__ import annotations

import importlib
import os
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from litsieve.operators.compile import HIGH_YEAR, LOW_YEAR, SEARCH_BASE
from litsieve.operators.works import CATALOGUE_BASE, DOI_BASE, DOI_MARK, ID_MARK
from litsieve.session import exists

PUSHDOWN_FLAG = "spark.sql.python.filterPushdown.enabled"
KEY_VARIABLE = "LITSIEVE_API_KEY"
SAFE = "-_.!~*'()"
MODES = ("search", "works")


class MissingKeyError(ValueError):
    """A search needs an API key."""


def urllib_transport(url: str, headers: dict[str, str]) -> tuple[int, str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers), timeout=60) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except HTTPError as error:
        return error.code, error.read().decode("utf-8", "replace")


def _function(name: str | None):
    if not name:
        return urllib_transport
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def api_key(options: dict[str, str]) -> str:
    """The key of the options or of the environment; a search can't do without."""
    key = options.get("api_key") or os.environ.get(KEY_VARIABLE, "")
    mode = options.get("mode", "search")
    if mode not in MODES:
        raise ValueError(f"mode must be search or works, not {mode}")
    if mode == "search" and not key:
        raise MissingKeyError(f"set the option api_key or the variable {KEY_VARIABLE}")
    return key


def call(options: dict[str, str], key: str, query: str, ylo: str, yhi: str) -> tuple[int, str]:
    """One call: its status and the answer's text."""
    transport = _function(options.get("transport"))
    if options.get("mode", "search") == "search":
        url = SEARCH_BASE + quote(query, safe=SAFE) + f"&api_key={key}"
        return transport(url + (f"&{LOW_YEAR}={ylo}" if ylo else "") + (f"&{HIGH_YEAR}={yhi}" if yhi else ""), {})
    text, contact = re.sub(r"^[\s\ufeff]+|[\s\ufeff]+\Z", "", query), options.get("contact", "")
    identifier = text
    if options.get("route") == "strict":
        bare = re.sub(r"^(https?://(dx\.)?doi\.org/|doi:)", "", text, flags=re.I)
        doi, work = re.fullmatch(r"10\.\d{4,9}/\S+", bare), re.fullmatch(r"W\d+", text)
        identifier = DOI_BASE + bare if doi else text
    else:
        doi, work = DOI_MARK in text, text.startswith(ID_MARK)
        identifier = DOI_BASE + text if doi else text
    if doi or work:
        return transport(f"{CATALOGUE_BASE}/{identifier}?mailto={contact}", {})
    return transport(f"{CATALOGUE_BASE}?search={quote(text, safe=SAFE)}&mailto={contact}", {})


class _Call(InputPartition):
    def __init__(self, query: str, ylo: str, yhi: str) -> None:
        self.query, self.ylo, self.yhi = query, ylo, yhi


class LiteratureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.asked = {k: [self.options.get(k, "")] for k in ("query", "ylo", "yhi")}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in self.asked:
                values = list(f.value) if isinstance(f, In) else [f.value]
                if all(isinstance(v, str) for v in values):
                    self.asked[f.attribute[0]] = list(dict.fromkeys(values))
            yield f  # Spark checks them again: the rows hold what was asked

    def partitions(self) -> list[InputPartition]:
        api_key(self.options)
        return [_Call(query, ylo, yhi) for query in self.asked["query"] for ylo in self.asked["ylo"] for yhi in self.asked["yhi"]]

    def read(self, partition: _Call) -> Iterator[tuple]:
        status, body = call(self.options, api_key(self.options), partition.query, partition.ylo, partition.yhi)
        if self.options.get("mode", "search") == "search" and not 200 <= status < 300:
            raise RuntimeError(f"the search service answered {status}")
        yield (partition.query, partition.ylo, partition.yhi, status, body)


class LiteratureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return "query string, ylo string, yhi string, status int, payload string"

    def reader(self, schema) -> DataSourceReader:
        return LiteratureReader(self.options)


def register(spark: SparkSession) -> None:
    """Registers the source, and says clearly what Spark needs for its filters."""
    if spark.conf.get(PUSHDOWN_FLAG, "false") != "true":
        raise RuntimeError(f"set {PUSHDOWN_FLAG}=true: the source takes its query from pushed filters")
    spark.dataSource.register(LiteratureSource)


def fetch(requests: DataFrame, query_col: str = "query", **options: str) -> DataFrame:
    """requests with `status` and `payload`: one call a row, in the task that holds it.

    Options are those of the source. A call that raises gives status 0 and its message as the payload, so that one failed
    request ends no other. Rows are told apart by nothing but their place: each is called for, repeated ones too.
    """
    key = api_key(options)
    names = [query_col, *(c for c in ("ylo", "yhi") if c in requests.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            answers = []
            for row in zip(*asked, strict=True):
                query, ylo, yhi = ([x or "" for x in row] + ["", ""])[:3]
                try:
                    answers.append(call(options, key, query, ylo, yhi))
                except Exception as error:
                    answers.append((0, str(error)))
            status, payload = ([a[k] for a in answers] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(status, pa.int32()), pa.array(payload, pa.string())], [*batch.schema.names, "status", "payload"])

    schema = StructType([*requests.schema.fields, StructField("status", IntegerType()), StructField("payload", StringType())])
    return requests.mapInArrow(run, schema)


def captured(answers: DataFrame, path: str, resume: bool = False) -> DataFrame:
    """The answers, written to path once and read back: what reads them calls nobody.

    With `resume` answers that are there whole are taken as they are, and half-written ones are replaced; the path then has to
    stand for one set of requests.
    """
    spark = answers.sparkSession
    if not (resume and exists(spark, f"{path}/_SUCCESS")):
        answers.write.mode("overwrite" if resume else "errorifexists").parquet(path)
    return spark.read.schema(answers.schema).parquet(path)


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Captured answers, one file each: path, payload."""
    return spark.read.text(path, wholetext=True).select(F.expr("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
