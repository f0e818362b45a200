"""Packing: vector bin packing by the dot-product heuristic, for fixed-length training sequences.

An example asks for a vector (tokens, segments, loss-bearing tokens); a sequence has limits on all three. Each partition
packs its own rows as they stream by, so nothing is shuffled: whole sequences are cut off long examples, and the rest goes
to the open sequence whose residual vector has the largest dot product with the request, among those where it fits. If it
fits in none it is cut, which fills the fullest open sequence to the brim. At the end of a partition the open sequences
are laid out again, cut to full length; the last rest is cut into lengths that are powers of two, which need no padding.

Ids are those of the `tokenizers` library at its defaults (a special token's string in a text is that token). As its words
never cross ASCII white space, each distinct space-separated word is encoded once and looked up afterwards: words of ASCII
and Latin-1 letters by a vectorised fold of the same merges, all others and those with `<|` by the library itself.

Defined results: null and empty texts are one end id; rows without an id are packed like others; repeated ids are packed
each as its own example; pieces keep document order within an example but may lie in several sequences; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.bpe import PairMerger
from litsieve.llm.common import read, text_bytes

MAX_TOKENS = 4096
MAX_SEGMENTS = 256
MAX_LOSS_TOKENS = 4096
END_ID = 2
OPEN_SEQUENCES = 24
CACHED_WORDS = 250_000
CACHED_CHARS = 4_096  # longer words are not kept
BATCH_BYTES = 384 << 10

_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())

#: Words of visible ASCII and the letters of Latin-1: each of these letters has one lower form and no parts to compose.
_PLAIN = re.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """Ids of texts by a `tokenizers` file whose words end at white space, as little-endian unsigned 32-bit bytes.

    New words in which lower case and word pattern are beyond doubt (`_PLAIN`) are lowered, split and merged here, all of a
    batch together in numpy; the library encodes the rest. Words are kept in two generations: when the young one is full
    it becomes the old one, and words in use move up again, so frequent words stay and memory is bounded. One encoder serves
    all tasks of a worker process; its words go with the task.
    """

    def __init__(self, path: str, specials_are_text: bool = False) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        suffix = file["model"]["end_of_word_suffix"]
        names = byte_characters()
        self.inner = np.array([vocabulary[c] for c in names], np.int32)
        self.final = np.array([vocabulary[c + suffix] for c in names], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right = np.array([vocabulary[a] for a, _ in pairs]), np.array([vocabulary[b] for _, b in pairs])
        self.merger = PairMerger(left, right, np.arange(len(pairs)), np.array([vocabulary[a + b] for a, b in pairs], np.int32))
        (pattern,) = [p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(pattern)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = specials_are_text
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def of(path: str, specials_are_text: bool = False) -> WordEncoder:
        key = (path, specials_are_text)
        return _ENCODERS.get(key) or _ENCODERS.setdefault(key, WordEncoder(*key))

    def _pieces(self, word: bytes) -> bytes | list[bytes] | None:
        """The word lowered and split by the pattern, one piece bare; None if it is the library's."""
        body = word.rstrip(_MARKS)  # the marks at the end are one piece, whatever precedes
        if not body.isalpha():  # ASCII letters only
            try:
                text = body.decode()
                text.encode("latin-1")
            except UnicodeError:  # letters beyond Latin-1, or no UTF-8
                return None
            if not text.isalpha():
                text = word.decode()
                if not _PLAIN.fullmatch(text) or "<|" in text:
                    return None
                return [x.encode() for x in self.pattern.findall(text.lower())]
            lowered = text.lower().encode()
        else:
            lowered = body.lower()
        return lowered if len(body) == len(word) else [lowered, word[len(body) :]]

    def _add(self, fresh: list[bytes]) -> None:
        split = list(map(self._pieces, fresh))
        several = [p for p in split if type(p) is list]
        pieces = list({p for p in split if type(p) is bytes}.union(*several))
        codes: dict[bytes, bytes] = {}
        if pieces:
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            data = np.frombuffer(b"".join(pieces), np.uint8)
            symbols = self.inner[data]
            ends = np.cumsum(lengths) - 1
            symbols[ends] = self.final[data[ends]]
            ids, sizes = self.merger.merge(symbols, lengths)
            blob = ids.astype("<u4").tobytes()
            cuts = [0, *np.cumsum(4 * sizes).tolist()]
            codes = {piece: blob[a:b] for piece, a, b in zip(pieces, cuts, cuts[1:], strict=False)}
        words, foreign = self.words, []
        for word, own in zip(fresh, split, strict=True):
            if type(own) is bytes:
                words[word] = codes[own]
            elif own is None:
                foreign.append(word)
            else:
                words[word] = b"".join(map(codes.__getitem__, own))
        for word in foreign:
            ids = self.library.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
            words[word] = np.array(ids, "<u4").tobytes()

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        # bytes split at ASCII white space only; A-Z may be lowered first but in special tokens, which are told by their case, and
        # before combining marks (lead bytes CC and CD), as some small letters compose with them and their capitals don't
        split = [(body if b"<|" in body or b"\xcc" in body or b"\xcd" in body else body.lower()).split() for body in bodies]
        if len(self.words) > CACHED_WORDS:
            self.words, self.older = {}, self.words
        words, older = self.words, self.older
        fresh = []
        for word in set(chain.from_iterable(split)).difference(words):
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


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


class Sequence:
    """An open sequence: the pieces placed so far and what is left of each limit."""

    __slots__ = ("loss", "pieces", "segments", "tokens")

    def __init__(self, tokens: int, segments: int, loss: int) -> None:
        self.tokens, self.segments, self.loss, self.pieces = tokens, segments, loss, []


class Packer:
    """Packs examples into sequences under the three limits; `emit` gets the pieces of each finished sequence.

    A piece is (example, start, length); an example is any object with `loss_from`, the first loss-bearing position.
    """

    def __init__(self, emit: Callable[[list], None], tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS_TOKENS, open_sequences: int = OPEN_SEQUENCES) -> None:
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.emit, self.limits, self.most = emit, (tokens, segments, loss), open_sequences
        self.open: list[Sequence] = []

    @staticmethod
    def _loss(example, start: int, length: int) -> int:
        return max(0, start + length - max(start, example.loss_from))

    def _fitting(self, example, start: int, room: int, loss: int) -> int:
        """The longest piece from start that fits room tokens and loss loss-bearing tokens."""
        free = max(0, example.loss_from - start)
        return min(room, free + loss)

    def add(self, example, n: int) -> None:
        tokens, _, loss = self.limits
        start = 0
        while n - start >= tokens and self._fitting(example, start, tokens, loss) == tokens:
            self.emit([(example, start, tokens)])
            start += tokens
        while start < n:
            start += self._place(example, start, n - start)

    def _place(self, example, start: int, length: int) -> int:
        """Places a piece from start, whole if some open sequence takes it; returns its length."""
        tokens, segments, loss = self.limits
        ask_loss = self._loss(example, start, length)
        best, best_dot = None, -1.0
        for s in self.open:
            if s.segments == 1 and s.tokens != length:
                continue  # the last segment of a sequence waits for a piece that fills it
            if length <= s.tokens and ask_loss <= s.loss:
                dot = length * s.tokens / tokens**2 + s.segments / segments**2 + ask_loss * s.loss / loss**2
                if dot > best_dot:
                    best, best_dot = s, dot
        if best is None and len(self.open) < self.most and length <= tokens and ask_loss <= loss:
            best = Sequence(tokens, segments, loss)
            self.open.append(best)
        if best is not None:
            return self._put(best, example, start, length)
        # cut: fill the sequence with the least room that this piece can fill
        full = [s for s in self.open if self._fitting(example, start, min(length, s.tokens), s.loss) == s.tokens]
        if full:
            s = min(full, key=lambda s: s.tokens)
            return self._put(s, example, start, s.tokens)
        self._lay_out(self.open)
        self.open = [Sequence(tokens, segments, loss)]
        return self._put(self.open[0], example, start, max(1, self._fitting(example, start, min(length, tokens), loss)))

    def _put(self, s: Sequence, example, start: int, length: int) -> int:
        s.pieces.append((example, start, length))
        s.tokens -= length
        s.segments -= 1
        s.loss -= self._loss(example, start, length)
        if s.tokens == 0:
            self.emit(s.pieces)
            self.open.remove(s)
        return length

    def finish(self) -> None:
        self._lay_out(self.open)
        self.open = []

    def _lay_out(self, sequences: list[Sequence]) -> None:
        """Lays the pieces of open sequences end to end, cut to full length or else to powers of two."""
        tokens, segments, loss = self.limits
        left = [p for s in sequences for p in s.pieces][::-1]
        while left:
            taken, room, room_loss = [], tokens, loss
            while left and room and len(taken) < segments:
                example, start, length = left.pop()
                n = self._fitting(example, start, min(length, room), room_loss)
                if n < length:
                    left.append((example, start + n, length - n))
                if n == 0:
                    break
                taken.append((example, start, n))
                room -= n
                room_loss -= self._loss(example, start, n)
            filled = tokens - room
            if filled == 0:
                raise ValueError("no piece fits an empty sequence")
            if room:
                want = 1 << (filled.bit_length() - 1)
                while filled > want:  # give back what is beyond the power of two
                    example, start, length = taken.pop()
                    n = min(length, filled - want)
                    filled -= n
                    left.append((example, start + length - n, n))
                    if n < length:
                        taken.append((example, start, length - n))
            self.emit(taken)


class _Example:
    __slots__ = ("body", "doc_id", "loss_from", "n")

    def __init__(self, doc_id: int | None, body: bytes, loss_from: int) -> None:
        self.doc_id, self.body, self.loss_from, self.n = doc_id, body, loss_from, len(body) // 4


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", loss_from_col: str | None = None,
    max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss_tokens: int = MAX_LOSS_TOKENS, end_id: int = END_ID, specials_are_text: bool = False,
) -> DataFrame:
    """One row per piece of every row of docs. `loss_from_col` names the first loss-bearing token of a row (instruction
    data: the length of its prompt); without it all tokens bear loss. `specials_are_text` splits the strings of special tokens
    like other text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(vocabulary, specials_are_text)
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        # 2**33 sequences a partition; a retried task reads the same rows and numbers them alike
        number = [TaskContext.get().partitionId() << 33]

        def emit(pieces: list) -> None:
            offset = 0
            for example, start, length in pieces:
                crc = zlib.crc32(example.body[4 * start : 4 * (start + length)])
                rows.append((example.doc_id, start, length, crc, example.n, number[0], offset, Packer._loss(example, start, length)))
                offset += length
            number[0] += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _FIELDS)

        packer = Packer(emit, max_tokens, max_segments, max_loss_tokens)
        for batch in batches:
            ids, bodies, froms, at = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), 0
            while at < len(ids):
                some, held = [], 0
                while at + len(some) < len(ids) and held < BATCH_BYTES:
                    some.append(bodies[at + len(some)].as_py())
                    held += len(some[-1])
                until = at + len(some)
                for doc_id, code, loss_from in zip(ids[at:until], encoder.encode(some), froms[at:until], strict=True):
                    example = _Example(doc_id, code + end, loss_from)
                    packer.add(example, example.n)
                if len(rows) > 20_000:
                    yield batch_of()
                at = until
        packer.finish()
        encoder.words, encoder.older = {}, {}  # a worker that does other work holds no words
        if rows:
            yield batch_of()

    loss_from = F.lit(0) if loss_from_col is None else F.greatest(F.coalesce(F.col(loss_from_col), F.lit(0)), F.lit(0))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"), loss_from.cast("long").alias("loss_from"))
    return slim.mapInArrow(run, _SCHEMA)


def word_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), word_vocabulary())
