"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of four hashed rows: two independent hashes of the whole word, so that one colliding bucket
carries only part of the evidence, and one each of its first four and six bytes. Filters of widths 1, 2 and 3 run over the
words of the whole text; max pooling over each third of the text gives a filter three values, which are sorted, so the
logistic layer on top can tell one hit from several. Embeddings, filters and the layer on top start at random and are
trained together by Adagrad. Forwards pooling takes the maximum; backwards each third shares its gradient among its windows
by a softmax that sharpens from epoch to epoch, as windows that aren't yet the maximum would otherwise learn nothing.

The model is fitted on the whole texts of at most `sample_rows` labelled ids (those of least id hash, one row each) with at
most `sample_words` words together (`common.rows_within`).

Thresholds are calibrated by language on a held-back fifth of the sample: the logit is shifted so that 0.5 is the best
threshold for the language that a small naive Bayes model reads from the text (no language column is used for a score).

Defined results: null counts as empty; a text without words gets the score of empty filters; rows without an id are scored
but never learned from; without labelled rows every score is 0.0; repeated ids come back each; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import fold, labelled_sample, one_row_an_id, read, rows_within, text_bytes
from litsieve.llm.kernel import LOWER, mix, parts, word_hashes

BUCKETS = 1 << 18
DIMENSIONS = 8
FILTERS = 6
WIDTHS = (1, 2, 3)
PREFIXES = (4, 6)
THIRDS = 3
LANGUAGE_BUCKETS = 1 << 15
SAMPLE_ROWS = 10_000
SAMPLE_WORDS = 8_000_000
STEP_WORDS = 1 << 17  # a step on more words is made in parts, at least a document each
LONG_BYTES, LONG_BLOCK = 1 << 20, 1 << 17  # texts of more bytes are scored so many words at a time
EPOCHS, STEPS = 4, 300  # so many epochs, and more of them where they have fewer steps than that
SHARPNESS = (1.0, 0.1)  # temperature of the backward softmax in the first and the last epoch

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words here are runs of letters, digits and non-ASCII bytes."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inner = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inner.copy()
    first[1:] &= ~inner[:-1] | edge[1:n]
    last = inner.copy()
    last[:-1] &= ~inner[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all words (words x 4: two of the word, two of its beginnings), and word counts by document end."""
    starts, ends, first = _spans(data, offsets)
    return _codes(data, starts, ends), first


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    whole = word_hashes(data, starts, ends)
    shift = np.uint64(46)
    columns = [whole >> shift, mix(whole * _SECOND) >> shift]
    head = np.zeros(len(starts), np.uint64)
    for k in range(max(PREFIXES)):
        at = starts + k
        head = (head << np.uint64(8)) | np.where(at < ends, LOWER[data[np.minimum(at, len(data) - 1)]], 0).astype(np.uint64)
        if k + 1 in PREFIXES:
            columns.append(mix(head + np.uint64(0x1234567 * (k + 1))) >> shift)
    return np.stack(columns, axis=1).astype(np.int32)


class ConvolutionalClassifier:
    """Hashed embeddings, filters of several widths, max pooling, logistic output, shifts by language."""

    def __init__(self, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS * THIRDS
        self.embedding = r.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.filters = [r.normal(0, 0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(n, np.float32)
        self.out = np.full(n, 0.1, np.float32)
        self.out_bias = np.float32(-1.5)
        self.language = np.zeros((LANGUAGE_BUCKETS, 1), np.float32)
        self.shifts = np.zeros(1)

    def embedded(self, codes: np.ndarray) -> np.ndarray:
        e = self.embedding[codes[:, 0]]
        for j in range(1, codes.shape[1]):
            e += self.embedding[codes[:, j]]
        return e

    def pooled(self, e: np.ndarray, first: np.ndarray, temperature: float | None = None) -> tuple[np.ndarray, tuple, list[np.ndarray]]:
        """Greatest value of every filter in every third (documents x thirds x filters; 0 without words).

        Also which third of which document each of them is with the third that each word is in, and with a temperature the
        words' shares of the gradient by width.
        """
        sizes = np.diff(first)
        cuts = first[:-1, None] + sizes[:, None] * np.arange(THIRDS + 1) // THIRDS
        doc, third = np.nonzero(cuts[:, 1:] > cuts[:, :-1])
        begins, ends = cuts[doc, third], cuts[doc, third + 1]
        of = np.repeat(np.arange(len(begins)), ends - begins)
        values, shares = np.zeros((len(sizes), THIRDS, len(WIDTHS) * FILTERS), np.float32), []
        if len(e):
            last = first[1:][sizes > 0]
            for k, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                z = e @ f[0]
                for j in range(1, width):
                    z[:-j] += e[j:] @ f[j]
                for j in range(1, width):  # windows that cross a document's end count nothing
                    z[np.maximum(last - j, 0)] = 0
                top = np.maximum.reduceat(z, begins, axis=0)
                values[doc, third, k * FILTERS : (k + 1) * FILTERS] = top
                if temperature is not None:
                    share = np.exp((z - top[of]) / temperature)
                    for j in range(1, width):
                        share[np.maximum(last - j, 0)] = 0
                    shares.append(share / np.maximum(np.add.reduceat(share, begins, axis=0), 1e-9)[of])
        return values, (doc, third, of), shares

    def raw_logits(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self._top(self.pooled(self.embedded(codes), first)[0])

    def _top(self, values: np.ndarray) -> np.ndarray:
        values = -np.sort(-values, axis=1)
        return np.maximum(values.reshape(len(values), -1) + self.bias, 0) @ self.out + self.out_bias

    def long_logit(self, data: np.ndarray) -> tuple[float, int]:
        """Logit and language of one long text, LONG_BLOCK words at a time."""
        starts, ends, _ = _spans(data, np.array([0, len(data)]))
        n = len(starts)
        cuts = n * np.arange(THIRDS + 1) // THIRDS
        values = np.full((THIRDS, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        evidence = np.zeros(self.language.shape[1])
        for a in range(0, n, LONG_BLOCK):
            b = min(n, a + LONG_BLOCK)
            beyond = min(n, b + max(WIDTHS) - 1)  # windows of the last words reach into the next block
            codes = _codes(data, starts[a:beyond], ends[a:beyond])
            e = self.embedded(codes)
            evidence += self.language[codes[: b - a, 0] % LANGUAGE_BUCKETS].sum(axis=0, dtype=np.float64)
            for k, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                z = e @ f[0]
                for j in range(1, width):
                    z[:-j] += e[j:] @ f[j]
                z = z[: b - a]
                z[max(0, n - width + 1 - a) :] = 0
                for t in range(THIRDS):
                    low, high = max(a, cuts[t]), min(b, cuts[t + 1])
                    if low < high:
                        own = values[t, k * FILTERS : (k + 1) * FILTERS]
                        np.maximum(own, z[low - a : high - a].max(axis=0), out=own)
        values[cuts[1:] == cuts[:-1]] = 0
        return float(self._top(values[None])[0]), int(evidence.argmax())

    def languages(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Number of the likeliest language of each document."""
        total = np.zeros((len(first), self.language.shape[1]))
        if not len(codes) or self.language.shape[1] == 1:
            return np.zeros(len(first) - 1, np.int64)
        evidence = np.zeros((len(codes) + 1, self.language.shape[1]), np.float64)
        np.cumsum(self.language[codes[:, 0] % LANGUAGE_BUCKETS], axis=0, out=evidence[1:])
        total = evidence[first[1:]] - evidence[first[:-1]]
        return total.argmax(axis=1)

    def scores(self, column: pa.Array) -> list[float]:
        out: list[float] = []
        for _, _, data, offsets in parts(column, LONG_BYTES):
            if len(data) > LONG_BYTES:  # one text
                logit, language = self.long_logit(data)
                logits = np.array([logit - self.shifts[language]])
            else:
                codes, first = word_codes(data, offsets)
                logits = self.raw_logits(codes, first) - self.shifts[self.languages(codes, first)]
            out += (1 / (1 + np.exp(-np.clip(logits, -30, 30)))).tolist()
        return out


class _Trainer:
    """Adagrad steps on a classifier."""

    def __init__(self, model: ConvolutionalClassifier, rate: float = 0.05, embedding_rate: float = 0.3) -> None:
        self.model, self.rate, self.embedding_rate = model, rate, embedding_rate
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in (model.bias, model.out, *model.filters)]
        self.embedding_squares = np.full((BUCKETS, 1), 1e-3, np.float32)
        self.bias_square = 1e-3

    def step(self, docs: list[np.ndarray], y: np.ndarray, temperature: float) -> None:
        model = self.model
        codes = np.concatenate(docs)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        e = model.embedded(codes)
        values, (doc, third, of), shares = model.pooled(e, first, temperature)
        order = np.argsort(-values, axis=1, kind="stable")
        ranked = np.take_along_axis(values, order, 1).reshape(len(docs), -1) + model.bias
        hidden = np.maximum(ranked, 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30))) - y).astype(np.float32) / len(docs)
        back = error[:, None] * model.out * (ranked > 0)
        gradients = [back.sum(axis=0), hidden.T @ error]
        by_third = np.empty_like(values)
        np.put_along_axis(by_third, order, back.reshape(values.shape), 1)
        de = np.zeros_like(e)
        for k, (width, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
            g = by_third[doc, third, k * FILTERS : (k + 1) * FILTERS][of] * shares[k] if shares else np.zeros((0, FILTERS), np.float32)
            own = np.zeros_like(f)
            for j in range(width if len(g) else 0):
                own[j] = e[j:].T @ g[: len(g) - j]
                de[j:] += g[: len(g) - j] @ f[j].T
            gradients.append(own)
        for p, g, s in zip((model.bias, model.out, *model.filters), gradients, self.squares, strict=True):
            s += g * g
            p -= self.rate * g / np.sqrt(s)
        total = float(error.sum())
        self.bias_square += total * total
        model.out_bias = np.float32(model.out_bias - self.rate * total / np.sqrt(self.bias_square))
        weight = np.abs(de).max(axis=1, initial=0)
        strong = np.flatnonzero(weight > 1e-3 * weight.max(initial=0))  # the rest moves nothing
        if len(strong):
            rows, inverse = np.unique(codes[strong].ravel(), return_inverse=True)
            g = np.zeros((len(rows), DIMENSIONS), np.float32)
            np.add.at(g, inverse, np.repeat(de[strong], codes.shape[1], axis=0))
            self.embedding_squares[rows] += (g * g).sum(axis=1, keepdims=True)
            model.embedding[rows] -= self.embedding_rate * g / np.sqrt(self.embedding_squares[rows])


def fit(docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], epochs: int | None = None, batch: int = 32) -> ConvolutionalClassifier:
    """Train on word codes (one array a document), labels, and languages for the calibration."""
    model = ConvolutionalClassifier()
    held = np.zeros(len(docs), bool)
    if len(docs) >= 50:
        held[4::5] = True
    use = np.flatnonzero(~held)
    steps = max(1, len(use) // batch)
    epochs = max(EPOCHS, -(-STEPS // steps)) if epochs is None else epochs
    trainer, order = _Trainer(model), np.random.default_rng(2)
    for temperature in np.geomspace(*SHARPNESS, epochs) if epochs else ():
        for at in np.array_split(order.permutation(use), steps):
            for some in _in_parts(at, docs, STEP_WORDS):
                trainer.step([docs[k] for k in some], y[some], temperature)
    _fit_languages(model, docs, langs)
    _calibrate(model, docs, y, np.flatnonzero(held) if held.any() else use)
    return model


def _fit_languages(model: ConvolutionalClassifier, docs: list[np.ndarray], langs: list[str | None]) -> None:
    names = sorted({x for x in langs if x is not None})
    if len(names) < 2:
        return
    counts = np.full((LANGUAGE_BUCKETS, len(names)), 0.1)
    for codes, lang in zip(docs, langs, strict=True):
        if lang is not None:
            np.add.at(counts[:, names.index(lang)], codes[:, 0] % LANGUAGE_BUCKETS, 1)
    model.language = (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32)


def _calibrate(model: ConvolutionalClassifier, docs: list[np.ndarray], y: np.ndarray, rows: np.ndarray) -> None:
    """For each language the logit that parts the classes with the fewest errors.

    Within the widest such gap it lies nearer the class whose logits spread less.
    """
    logits, lang = [], []
    steps = np.array_split(rows, max(1, len(rows) // 64))
    for some in (part for step in steps for part in _in_parts(step, docs, STEP_WORDS)):
        codes = np.concatenate([docs[k] for k in some])
        first = np.concatenate([[0], np.cumsum([len(docs[k]) for k in some])])
        logits.append(model.raw_logits(codes, first))
        lang.append(model.languages(codes, first))
    logits, lang = np.concatenate(logits), np.concatenate(lang)
    model.shifts = np.zeros(model.language.shape[1])
    everywhere = _threshold(logits, y[rows])
    for k in range(len(model.shifts)):
        own = lang == k
        enough = own.sum() >= 20 and 3 <= y[rows][own].sum() < own.sum()
        model.shifts[k] = _threshold(logits[own], y[rows][own]) if enough else everywhere


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(logits, kind="stable")
    s, t = logits[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    gaps = np.concatenate([[0], s[1:] - s[:-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    k = int(best[gaps[best].argmax()])
    low, high = s[max(0, k - 1)], s[min(len(s) - 1, k)]
    clean, toxic = float(s[t == 0].std()), float(s[t == 1].std())
    return float(low + (high - low) * (clean + 1e-3) / (clean + toxic + 2e-3))


def _in_parts(at: np.ndarray, docs: list[np.ndarray], most: int) -> Iterator[np.ndarray]:
    """The documents of a step in order, so many together that they have `most` words at most; a longer one alone."""
    begin, words = 0, 0
    for k, d in enumerate(at.tolist()):
        if k > begin and words + len(docs[d]) > most:
            yield at[begin:k]
            begin, words = k, 0
        words += len(docs[d])
    yield at[begin:]


def _sample_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, _, data, offsets in parts(batch.column(3)):
            codes, first = word_codes(data, offsets)
            out += [codes[first[d] : first[d + 1]].tobytes() for d in range(len(offsets) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "y", "lang", "codes"])


def draw_sample(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS) -> list[tuple[int, int, str | None, np.ndarray]]:
    """(doc_id, label, lang, word codes) of the rows to fit on, by id."""
    sample = labelled_sample(docs, labels, label, sample_rows, F.col("lang").cast("string").alias("lang")).select("doc_id", "y", "lang", "body")
    coded = sample.mapInArrow(_sample_codes, "doc_id long, y int, lang string, codes binary")
    one = one_row_an_id(coded.withColumn("by", F.xxhash64("codes", "lang")), "by").select("doc_id", "y", "lang", "codes")
    rows = rows_within(one, F.xxhash64("doc_id"), F.length("codes") / (4 * (2 + len(PREFIXES))), sample_words)
    return sorted(((r.doc_id, r.y, r.lang, np.frombuffer(r.codes, np.int32).reshape(-1, 2 + len(PREFIXES))) for r in rows), key=lambda r: r[0])


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_words: int = SAMPLE_WORDS) -> ConvolutionalClassifier | None:
    """Fit on at most sample_rows labelled documents outside fold 0 of 5, with sample_words words; None without any label."""
    rows = draw_sample(docs, labels, label, sample_rows, sample_words)
    if not rows:
        return None
    return fit([r[3] for r in rows], np.array([r[1] for r in rows], np.float32), [r[2] for r in rows])


def score_toxicity(docs: DataFrame, model: ConvolutionalClassifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row of docs, from its whole text."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 x 8 floats, whatever the corpus size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = handle.value.scores(batch.column(1)) if handle.value is not None else [0.0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body")).mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of rows whose crc32 fold of 5 is 0 are never read."""
    docs = read(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity_model(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
