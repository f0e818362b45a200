"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, by FTRL-proximal with elastic net.

Features are hashed character bigrams and trigrams of the text in small letters (by Unicode, so Cyrillic and Greek capitals
count as their small letters and a Chinese character is one character). A feature's value is its share of the document's
n-grams times its inverse document frequency, so a score is a sum over positions and whole texts of any length are scored
in linear time and bounded memory, a block of characters at a time. Languages and document frequencies are counted over every
row that may be learned from; the weights are fitted on a sample of them: the `sample_rows` rows of least key, and of every
language the LANGUAGE_ROWS of least key, whole texts with at most `sample_grams` distinct n-grams together
(`common.rows_within`), and calibrated by one temperature on a held-back fifth.

Defined results: null, empty or letterless text gives `und` with score 0.0; if nothing can be learned (no labelled row)
every row is `und`; with one language every row with a letter gets it; rows without an id are predicted, and learned from
like others; repeated rows and ids come back each; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litsieve.llm.common import fold, read, rows_within, text_bytes
from litsieve.llm.kernel import parts

BUCKETS = 1 << 16
PIECES = 16
SAMPLE_ROWS = 3000
LANGUAGE_ROWS = 50
SAMPLE_GRAMS = 16_000_000
BLOCK = 1 << 20  # bytes of a text that are decoded at a time
RARE = 1.25  # how far beyond the rarest held-back text of a known language a text may lie
PRIOR = 50  # n-grams of average rarity that every text is given, so that a few words prove nothing

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = True
_LETTER[97:123] = True


def characters(data: np.ndarray) -> Iterator[np.ndarray]:
    """Code points of a UTF-8 text in small letters, a block at a time; each block begins with the last two of the one before."""
    at, carried = 0, np.zeros(0, np.uint32)
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and end > at + BLOCK - 4 and data[end] & 0xC0 == 0x80:
            end -= 1
        text = data[at:end].tobytes().decode("utf-8", "replace").lower()
        points = np.concatenate([carried, np.frombuffer(text.encode("utf-32-le"), np.uint32)])
        yield points
        at, carried = end, points[-2:]


def gram_buckets(data: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of a text's character bigrams and trigrams, one per position, over the whole text, in blocks."""
    fresh = True
    for c in characters(data):
        two = (c[:-1] * np.uint32(0x9E3779B1)) ^ (c[1:] * np.uint32(0x85EBCA6B))
        three = (two[:-1] * np.uint32(0xC2B2AE35)) ^ (c[2:] * np.uint32(0x27D4EB2F)) if len(c) > 2 else np.zeros(0, np.uint32)
        if not fresh:
            two = two[1:]  # the pair within the carried characters was told before
        fresh = False
        two ^= two >> np.uint32(15)
        three ^= three >> np.uint32(15)
        yield np.concatenate([(two * np.uint32(0x2C1B3C6D)) >> np.uint32(16), (three * np.uint32(0x297A2D39)) >> np.uint32(16)]).astype(np.uint16)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of every row of a binary column, without copies."""
    for _, _, data, offsets in parts(column):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield data[a:b]


def gram_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets in order and how often each occurs."""
    total, blocks = None, []
    for grams in gram_buckets(data):
        blocks.append(grams)
        if sum(map(len, blocks)) > BUCKETS:
            counts = sum(np.bincount(g, minlength=BUCKETS) for g in blocks)
            total, blocks = counts if total is None else total + counts, []
    if total is None:
        return np.unique(np.concatenate(blocks), return_counts=True) if blocks else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
    total = sum((np.bincount(g, minlength=BUCKETS) for g in blocks), total)
    index = np.flatnonzero(total)
    return index.astype(np.uint16), total[index]


def has_letter(data: np.ndarray) -> bool:
    """True if any character is a letter."""
    if _LETTER[data].any():
        return True
    return any(ch.isalpha() for points in characters(data) for ch in points.tobytes().decode("utf-32-le"))


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for data in _texts(batch.column(0)):
            index, _ = gram_counts(data)
            counts[index] += 1
            n += 1
    step = BUCKETS // PIECES
    if n:
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array([*range(PIECES), -1], pa.int32()), "counts": [counts[k * step : (k + 1) * step].tobytes() for k in range(PIECES)] + [np.int64(n).tobytes()]}
        )


def _add_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
    return pa.table({"piece": table.column("piece").slice(0, 1), "counts": [total.tobytes()]})


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, over all rows of docs, and the number of rows."""
    sums = docs.select(text_bytes(text_col).alias("body")).mapInArrow(_count_documents, "piece int, counts binary")
    rows = {r.piece: np.frombuffer(r.counts, np.int64) for r in sums.groupBy("piece").applyInArrow(_add_counts, "piece int, counts binary").collect()}
    if not rows:
        return np.zeros(BUCKETS, np.int64), 0
    return np.concatenate([rows[k] for k in range(PIECES)]), int(rows[-1][0])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buckets, shares = [], []
        for data in _texts(batch.column(2)):
            index, counts = gram_counts(data)
            share = (counts / max(1, counts.sum())).astype(np.float32)
            buckets.append(index.tobytes())
            shares.append(share.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], ["rank", "lang", "buckets", "shares"])


class LanguageModel:
    """Weights (languages x buckets) with the inverse document frequencies folded in, biases, a temperature, and how rare the
    n-grams of a text may be on average."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, idf: np.ndarray | None = None) -> None:
        self.languages, self.bias, self.temperature = languages, bias, temperature
        idf = np.zeros(BUCKETS) if idf is None else idf
        self.table = np.ascontiguousarray(np.concatenate([weights, idf[None]]).T.astype(np.float32))
        self.usual, self.rarest = 0.0, np.inf

    def totals(self, data: np.ndarray) -> tuple[np.ndarray, float]:
        """Logits and mean rarity of a text."""
        total, n = np.zeros(len(self.languages) + 1), 0
        for grams in gram_buckets(data):
            for at in range(0, len(grams), 1 << 18):  # in blocks, as one gather would need many times the text's bytes
                total += self.table[grams[at : at + (1 << 18)]].sum(axis=0, dtype=np.float64)
            n += len(grams)
        return total[:-1] / max(1, n) + self.bias, (total[-1] + PRIOR * self.usual) / (n + PRIOR)

    def predict(self, data: np.ndarray) -> tuple[str, float, bool]:
        """Language, probability, and whether the text's n-grams are ones that the known languages use."""
        if not has_letter(data):
            return "und", 0.0, False
        logits, rarity = self.totals(data)
        p = np.exp((logits - logits.max()) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max() / p.sum()), rarity <= self.rarest


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by FTRL-proximal; rows are (buckets, values, class)."""
    z, n = np.zeros((n_classes, BUCKETS)), np.zeros((n_classes, BUCKETS))
    zb, nb = np.zeros(n_classes), np.zeros(n_classes)

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            index, values, y = rows[k]
            w, wb = weights(z[:, index], n[:, index], l1), weights(zb, nb, 0.0)
            logits = w @ values + wb
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * values
            z[:, index] += g - (np.sqrt(n[:, index] + g * g) - np.sqrt(n[:, index])) / alpha * w
            n[:, index] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * wb
            nb += p * p
    return weights(z, n, l1), weights(zb, nb, 0.0)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by search over a log grid."""

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return float(min(np.geomspace(0.05, 20, 121), key=loss)) if len(y) else 1.0


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, sample_rows: int = SAMPLE_ROWS, sample_grams: int = SAMPLE_GRAMS) -> LanguageModel | None:
    """Learn from all rows of docs with a language: languages and frequencies of all of them, weights on a sample.

    `key` orders the sample (default: a hash of the text); the sample_rows rows with the smallest keys are taken, and of each
    language those with its LANGUAGE_ROWS smallest keys, so that no language is missed however rare.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    frequencies, n = document_frequencies(known, text_col)
    rank = F.xxhash64(text_col) if key is None else key
    sample = known.select(rank.alias("rank"), F.col(lang_col).cast("string").alias("lang"), text_bytes(text_col).alias("body"))
    cut = sample.select("rank").orderBy("rank").limit(sample_rows).agg(F.max("rank")).first()[0]
    if cut is None:
        return None
    place = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    cuts = sample.select("lang", "rank").withColumn("place", place).where(F.col("place") <= LANGUAGE_ROWS).groupBy("lang").agg(F.max("rank").alias("own")).collect()
    cuts = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in cuts], "lang string, own long"))  # one row a language
    near = sample.join(cuts, "lang").where((F.col("rank") <= cut) | (F.col("rank") <= F.col("own"))).select("rank", "lang", "body")
    coded = near.mapInArrow(_features, "rank long, lang string, buckets binary, shares binary")
    # rows of one key count once: an id or a text that repeats may not fill the sample
    one = coded.groupBy("rank").agg(F.min_by(F.struct("lang", "buckets", "shares"), F.struct("lang", F.xxhash64("buckets", "shares"))).alias("r")).select("rank", "r.*")
    rows = sorted(rows_within(one, F.col("rank"), F.length("buckets") / 2, sample_grams), key=lambda r: r.rank)
    languages = sorted({r.lang for r in rows})
    idf = np.log((1 + n) / (1 + frequencies)) + 0.1
    x = []
    for r in rows:
        index = np.frombuffer(r.buckets, np.uint16).astype(np.int64)
        x.append((index, np.frombuffer(r.shares, np.float32) * idf[index] * 30, languages.index(r.lang)))
    never = {r.lang: k for k, r in reversed(list(enumerate(rows)))}  # a language may have one row only
    back = sorted({k for k in range(len(x)) if k % 5 == 4} - set(never.values()) if len(x) >= 50 else set())
    weights, bias = fit_ftrl([x[k] for k in range(len(x)) if k not in set(back)], len(languages))
    logits = np.array([weights[:, x[k][0]] @ x[k][1] + bias for k in back])
    temperature = _temperature(logits, np.array([x[k][2] for k in back])) if back else 1.0
    model = LanguageModel(languages, weights * idf * 30, bias, temperature, idf)
    rarities = [float((np.frombuffer(rows[k].shares, np.float32) * idf[x[k][0]]).sum()) for k in back if len(x[k][0])]
    if rarities:
        model.usual = float(np.median(rarities))
        model.rarest = RARE * max(rarities)
    return model


def predict_language(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row of docs, from its whole text."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**16 floats, whatever the corpus size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        for batch in batches:
            told = [("und", 0.0, False) if model is None else model.predict(data) for data in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())], ["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows whose crc32 fold is 2 of 4 are never learned from."""
    docs = read(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(fold("doc_id", 4) != 2), key=F.xxhash64("doc_id"))
    return predict_language(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Rows of docs in a language that the model knows, with all their columns.

    `und` goes, scores under min_score go, and so does text whose n-grams are rarer on average than those of every held-back
    text of the known languages (by RARE): the likeliest of the known languages is then no answer.
    """
    model = fit_language_model(docs.where(fold("doc_id", 4) != 2), key=F.xxhash64("doc_id"))
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).fill_null(b"")
            told = [("und", 0.0, False) if model is None else model.predict(data) for data in _texts(column)]
            yield batch.filter(pa.array([known and score >= min_score for _, score, known in told], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
