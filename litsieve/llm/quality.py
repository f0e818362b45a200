"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the number of
non-zero features by the sum-of-squares identity. Features: distinct lower-cased words hashed to 2**18 buckets with
log-scaled, unit-length counts, and one indicator per binned statistic (capitals, symbols, digits, repeated words,
lengths and so on). Weights are fitted with Adagrad on the whole texts of at most `sample_rows` labelled ids (those of least id
hash, one row each) with at most `sample_features` features together (`common.rows_within`); every text is scored whole.

Defined results: null counts as empty; empty text gets the score of its statistics alone; rows without an id are scored but
never learned from; without any labelled row every score is 0.5; with one class only, scores lean to it; repeated ids come
back each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import fold, labelled_sample, one_row_an_id, read, rows_within, text_bytes
from litsieve.llm.kernel import SEGMENT, parts, word_hashes, word_spans

WORD_BUCKETS = 1 << 18
BINS = 17
STATISTICS = 12
FEATURES = WORD_BUCKETS + STATISTICS * BINS
RANK = 4
SAMPLE_ROWS = 6000
SAMPLE_FEATURES = 16_000_000
THRESHOLD = 0.3

#: upper case, lower case or non-ASCII, digit, odd symbol, line end
_CLASSES = 5
_CLASS = np.full(256, _CLASSES, np.uint8)
_CLASS[65:91] = 0
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_CLASS[list(b"!\"#$%&*+/<=>@[\\]^_`{|}~")] = 3
_CLASS[10] = 4
_ODD = _CLASS == 3


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Bytes of each class by document, a segment at a time."""
    return [
        sum((np.bincount(_CLASS[data[at : min(b, at + SEGMENT)]], minlength=_CLASSES + 1)[:_CLASSES] for at in range(a, b, SEGMENT)), np.zeros(_CLASSES, np.int64)).tolist()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    ]


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each document its feature numbers and values."""
    starts, ends, first = word_spans(data, offsets)
    buckets = (word_hashes(data, starts, ends) >> np.uint64(46)).astype(np.int32)
    n_docs = len(offsets) - 1
    per_doc = _class_counts(data, offsets)
    repeats, odd_end, lone = (np.zeros(len(buckets) + 1, np.int32) for _ in range(3))
    if len(buckets):
        repeats[2:] = np.cumsum(buckets[1:] == buckets[:-1])
        odd_end[1:] = np.cumsum(_ODD[data[ends - 1]])
        lone[1:] = np.cumsum((ends - starts == 1) & _ODD[data[starts]])
    for d in range(n_docs):
        a, b = first[d], first[d + 1]
        n, size = int(b - a), int(offsets[d + 1] - offsets[d])
        index, counts = np.unique(buckets[a:b], return_counts=True)
        upper, lower, digit, odd, lines = per_doc[d]
        words = max(1, n)
        stats = (
            upper / max(1, upper + lower), odd / max(1, size), digit / max(1, size), lines / words, (upper + lower) / max(1, size),
            int(repeats[b] - repeats[min(a + 1, b)]) / words, len(index) / words, (counts.max() if n else 0) / words,
            (odd_end[b] - odd_end[a]) / words, (lone[b] - lone[a]) / words, min(1.0, size / words / 20) ** 2, (min(1.0, np.log1p(n) / 12)) ** 2,
        )
        extra = [WORD_BUCKETS + k * BINS + min(BINS - 1, int(np.sqrt(max(0.0, v)) * (BINS - 1) + 0.5)) for k, v in enumerate(stats)]
        values = np.log1p(counts)
        values = values / max(1e-9, float(np.sqrt((values * values).sum())))
        yield np.concatenate([index, np.array(extra, np.int64)]), np.concatenate([values, np.full(STATISTICS, 0.5)])


class FactorisationMachine:
    """Weights of a degree-two factorisation machine with logistic output."""

    def __init__(self, n_features: int = FEATURES, rank: int = RANK, seed: int = 3) -> None:
        self.w0 = 0.0
        self.w = np.zeros(n_features, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (n_features, rank)).astype(np.float32)

    def logit(self, index: np.ndarray, x: np.ndarray) -> float:
        v = self.v[index] * x[:, None]
        s = v.sum(axis=0)
        return float(self.w0 + self.w[index] @ x + 0.5 * ((s * s).sum() - (v * v).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.15, l2: float = 1e-5) -> FactorisationMachine:
        gw, gv, g0 = np.full(len(self.w), 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        order = np.random.default_rng(5)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                index, x, y = rows[k]
                v = self.v[index]
                vx = v * x[:, None]
                s = vx.sum(axis=0)
                logit = float(self.w0 + self.w[index] @ x + 0.5 * ((s * s).sum() - (vx * vx).sum()))
                error = 1 / (1 + np.exp(-min(30.0, max(-30.0, logit)))) - y
                g0 += error * error
                self.w0 -= rate * error / np.sqrt(g0)
                step = error * x + l2 * self.w[index]
                gw[index] += step * step
                self.w[index] -= rate * step / np.sqrt(gw[index])
                step = error * x[:, None] * (s - vx) + l2 * v
                gv[index] += step * step
                self.v[index] -= 0.3 * rate * step / np.sqrt(gv[index])
        return self


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, values = [], []
        for _, _, data, offsets in parts(batch.column(2)):
            for i, x in features(data, offsets):
                index.append(i.astype(np.int32).tobytes())
                values.append(x.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(index, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "y", "buckets", "shares"])


def fit_quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> FactorisationMachine | None:
    """Fit on at most sample_rows labelled documents whose crc32 fold of 5 is not 0, with sample_features features; None without any."""
    sample = labelled_sample(docs, labels, label, sample_rows).select("doc_id", "y", "body")
    coded = sample.mapInArrow(_sample_features, "doc_id long, y int, buckets binary, shares binary")
    one = one_row_an_id(coded.withColumn("by", F.xxhash64("buckets", "shares")), "by")
    rows = sorted(rows_within(one, F.xxhash64("doc_id"), F.length("buckets") / 4, sample_features), key=lambda r: r.doc_id)
    if not rows:
        return None
    return FactorisationMachine().fit([(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.shares, np.float32), r.y) for r in rows])


def _scores(model: FactorisationMachine | None, column: pa.Array) -> list[float]:
    out = []
    for _, _, data, offsets in parts(column):
        if model is None:
            out += [0.5] * (len(offsets) - 1)
            continue
        logits = np.array([model.logit(i, x) for i, x in features(data, offsets)])
        out += (1 / (1 + np.exp(-np.clip(logits, -30, 30)))).tolist()
    return out


def score_quality(docs: DataFrame, model: FactorisationMachine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row of docs."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 x (1 + rank) floats, whatever the corpus size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(handle.value, batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body")).mapInArrow(run, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of rows whose crc32 fold of 5 is 0 are never read."""
    docs = read(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality_model(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs that score at least threshold, with all their columns."""
    handle = docs.sparkSession.sparkContext.broadcast(fit_quality_model(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).fill_null(b"")
            yield batch.filter(pa.array([s >= threshold for s in _scores(handle.value, column)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
