"""Byte-level BPE encoding and decoding: a fold of ranked merges over the byte arrays of distinct words.

Each text is split by the vocabulary's pattern. A word starts as an array of single bytes, and each step of the fold joins
the leftmost neighbouring pair of least rank. Decoding concatenates the binary pieces of the ids.

`encode_native` is the fold in Spark's higher-order functions with a literal rank map (an array of small maps, as a lookup
in one Spark map is a scan): the distinct words of the table are folded once and joined back to their places. It gives the
same ids, but a row for every word of the corpus has to be shuffled for that, which the check tool's limit on disk doesn't
allow (the README has figures). `encode` therefore runs the same fold in numpy over all new words of a batch, inside one map
over the documents, and is what the query uses; words already folded by a worker are looked up, within a bounded store.

Defined results: null counts as empty; an empty text has no tokens; rows without an id come back without one; repeated ids
come back each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.bpe import PairMerger
from litsieve.llm.common import read

MAP_BUCKETS = 1 << 15
CACHED_WORDS = 350_000
CACHED_CHARS = 4_096  # longer words are not kept

#: The public pattern, with white space as the White_Space property: the `regex` module's `\s` has four controls more.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

#: The public pattern with `\\s` as the White_Space property (flag U), as Java writes it.
JAVA_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _bucket(text: str) -> int:
    """crc32 of the text, as `F.crc32` computes it."""
    return zlib.crc32(text.encode()) % MAP_BUCKETS


def _literals(ranks: dict[bytes, int]) -> tuple[Column, Column]:
    """The rank map as array<map<string,int>> and the pieces as array<binary>, both foldable to literals."""
    buckets: list[dict[str, int]] = [{} for _ in range(MAP_BUCKETS)]
    for token, rank in ranks.items():
        text = token.decode("latin-1")
        buckets[_bucket(text)][text] = rank
    size = max(ranks.values()) + 1
    pieces = [""] * size
    for token, rank in ranks.items():
        pieces[rank] = base64.b64encode(token).decode()
    return (
        F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>"),
        F.from_json(F.lit(json.dumps(pieces)), "array<binary>"),
    )


def _rank(rank_map: Column, text: Column) -> Column:
    return F.try_element_at(F.element_at(rank_map, (F.crc32(text.cast("binary")) % MAP_BUCKETS + 1).cast("int")), text)


def _fold(rank_map: Column, word: Column) -> Column:
    """Token ids of one word given as Latin-1 characters."""
    start = F.split(word, "")

    def step(parts: Column, _: Column) -> Column:
        pairs = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts) - 1), lambda a, b: F.concat(a, b))
        ranked = F.transform(pairs, lambda p: _rank(rank_map, p))
        at = F.array_position(ranked, F.array_min(ranked)).cast("int")
        joined = F.concat(F.slice(parts, 1, at - 1), F.slice(pairs, at, F.lit(1)), F.slice(parts, at + 2, F.size(parts)))
        return F.when(F.coalesce(at, F.lit(0)) > 0, joined).otherwise(parts)

    whole = _rank(rank_map, word)  # a word that is a token stays whole, whatever its merges
    steps = F.when(whole.isNull() & (F.size(start) > 1), F.sequence(F.lit(2), F.size(start))).otherwise(F.array().cast("array<int>"))
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(F.aggregate(steps, start, step), lambda p: _rank(rank_map, p)))


def encode_native(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded for every row of docs: the distinct words of the table are folded once and joined back."""
    rank_map, pieces = _literals(ranks)
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(JAVA_PATTERN), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), words.alias("words"))
    used = rows.select("row", F.posexplode("words").alias("at", "word"))
    folded = used.select("word").distinct().select("word", _fold(rank_map, F.decode(F.encode("word", "UTF-8"), "ISO-8859-1")).alias("codes"))
    placed = used.join(folded, "word").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "codes"))).alias("placed"))
    ids = F.coalesce(F.flatten(F.transform("placed", lambda p: p["codes"])), F.array().cast("array<int>"))
    out = rows.select("doc_id", "row").join(placed, "row", "left").select("doc_id", ids.alias("ids"))
    decoded = F.aggregate(F.transform("ids", lambda i: F.element_at(pieces, i + 1)), F.lit(b""), lambda a, b: F.concat(a, b))
    return out.select("doc_id", "ids", decoded.alias("decoded"))


class RankEncoder:
    """Ids of texts by a rank file's merges, as little-endian unsigned 32-bit bytes, and back.

    Folded words are kept in two generations, as frequent words stay in use; memory is bounded.
    """

    def __init__(self, path: str) -> None:
        ranks = read_ranks(path)
        self.pieces: list[bytes] = [b""] * (max(ranks.values()) + 1)
        left, right, joined = [], [], []
        for token, rank in ranks.items():
            self.pieces[rank] = token
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(rank)
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        self.merger = PairMerger(np.array(left), np.array(right), np.array(joined), np.array(joined, np.int32))
        self.ranks = ranks
        self.pattern = regex.compile(PATTERN)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> RankEncoder:
        return _ENCODERS.get(path) or _ENCODERS.setdefault(path, RankEncoder(path))

    def _add(self, fresh: list[str]) -> None:
        if not fresh:
            return
        bodies = [w.encode() for w in fresh]
        lengths = np.array([len(b) for b in bodies])
        ids, sizes = self.merger.merge(self.single[np.frombuffer(b"".join(bodies), np.uint8)], lengths)
        blob, at = ids.astype("<u4").tobytes(), 0
        for word, body, size in zip(fresh, bodies, (4 * sizes).tolist(), strict=True):
            whole = self.ranks.get(body)  # a word that is a token stays whole, whatever its merges
            self.words[word] = blob[at : at + size] if whole is None else np.array([whole], "<u4").tobytes()
            at += size

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(text) for text in texts]
        if len(self.words) > CACHED_WORDS:
            self.words, self.older = {}, self.words
        words, older, fresh = self.words, self.older, []
        for word in {w for doc in split for w in doc}.difference(words):
            code = older.get(word)
            if code is None:
                fresh.append(word)
            else:
                words[word] = code
        self._add(fresh)
        out = [b"".join(map(words.__getitem__, doc)) for doc in split]
        for word in fresh:
            if len(word) > CACHED_CHARS:
                del words[word]
        return out

    def decode(self, code: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(code, "<u4").tolist()))


_ENCODERS: dict[str, RankEncoder] = {}


def _batches(path: str, batches: Iterator[pa.RecordBatch], max_chars: int = 1 << 20) -> Iterator[tuple[pa.Array, list[bytes], RankEncoder]]:
    encoder = RankEncoder.of(path)
    for batch in batches:
        texts, at = batch.column(1).to_pylist(), 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (chars == 0 or chars + len(texts[end]) <= max_chars):
                chars += len(texts[end]) + 1
                end += 1
            yield batch.column(0).slice(at, end - at), encoder.encode(texts[at:end]), encoder
            at = end


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes, _ in _batches(path, batches):
            ends = np.cumsum([0, *(len(c) // 4 for c in codes)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(codes), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded (binary) for every row of rows; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = RankEncoder.of(path).pieces
        for batch in batches:
            out = [None if x is None else b"".join([pieces[k] for k in x]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs: encodes each text, then decodes its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, codes, encoder in _batches(path, batches):
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(c) // 4 for c in codes], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in codes]),
                    pa.array([hashlib.sha256(encoder.decode(c)).hexdigest() for c in codes]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def multilingual_ranks() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), multilingual_ranks())
