"""Fill-in-middle: every text is cut at two places and its parts are put in another order, with sentinels between them.

A kernel works on the Arrow UTF-8 buffer of all rows of a batch together. A lookup table gives every byte a class; a table of
class pairs says whether a unit begins between two adjacent bytes; the first byte of a document always begins one. The running
sum of these marks, less its value where the document begins, numbers the units of each document, and one searchsorted finds
the bytes of both cuts of all rows. Long buffers go in blocks, so memory is a few bytes a byte of a block and not of the text.
The three parts of a text lie next to each other in its buffer, so they become an Arrow column without a copy and are joined
with the sentinels by one Arrow call for all rows.

Units: `char` (code points), `word` (white space goes with the word before it), `line` (with its line end).

The cuts and the form come from SHA-256 of `seed:doc_id`, so they don't depend on partitions, order or other rows.

Defined results: null counts as the empty text, a null id as empty digits; the empty text and texts that hold a sentinel are
`plain`, that is unchanged; rows that repeat come back each, equal texts under different ids have different cuts; an empty table
gives an empty result; other columns are ignored, whatever their names. A text of one unit has two empty parts or one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import read
from litsieve.llm.kernel import parts

PLAIN, PSM, SPM = "plain", "psm", "spm"
SENTINELS = ("<P>", "<S>", "<M>")
SEED, PLAIN_PERCENT, SPM_PERCENT = 1, 10, 20
BATCH_BYTES, BLOCK_BYTES = 8 << 20, 2 << 20  # rows joined at a time, bytes counted at a time


def _unit(classes: dict[int, range | bytes], begins: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Class of every byte (0 unless named) and, for (class before) * 4 + class, whether a unit begins there."""
    lookup, pairs = np.zeros(256, np.uint8), np.zeros(16, bool)
    for k, members in classes.items():
        lookup[list(members)] = k
    for before, own in begins:
        pairs[before * 4 + own] = True
    return lookup, pairs


#: a continuation byte begins no code point; a word begins after white space; a line after a line end
UNITS = {
    "char": _unit({1: range(0x80, 0xC0)}, [(0, 0), (1, 0)]),
    "word": _unit({1: b" \t\n\v\f\r"}, [(1, 0)]),
    "line": _unit({1: b"\n"}, [(1, 0), (1, 1)]),
}


class UnitIndex:
    """The units of documents that lie one after another in `data`, document d in [offsets[d], offsets[d + 1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "char", block: int = BLOCK_BYTES) -> None:
        self.data, self.offsets, self.block = data, offsets, block
        self.lookup, self.pairs = UNITS[unit]
        self.heads = offsets[:-1][offsets[:-1] < offsets[1:]]  # first bytes of documents that have any
        self.totals = np.zeros(len(range(0, len(data), block)) + 1, np.int64)  # units before each block
        self.before = np.zeros(len(offsets), np.int64)  # units before each offset
        self.sums: np.ndarray | None = None  # of the only block, where there is one
        for k in range(len(self.totals) - 1):
            sums = self._sums(k)
            self.totals[k + 1] = self.totals[k] + sums[-1]
            a, b = np.searchsorted(offsets, k * block + 1), np.searchsorted(offsets, k * block + len(sums), "right")
            self.before[a:b] = self.totals[k] + sums[offsets[a:b] - k * block - 1]
            self.sums = sums if len(self.totals) == 2 else None
        self.counts = np.diff(self.before)

    def _sums(self, k: int) -> np.ndarray:
        """Running number of units that begin in block k."""
        low, high = k * self.block, min((k + 1) * self.block, len(self.data))
        codes = self.lookup[self.data[max(0, low - 1) : high]]
        if not low:
            codes = np.concatenate([codes[:1], codes])
        marks = self.pairs[codes[:-1] * 4 + codes[1:]]
        a, b = np.searchsorted(self.heads, [low, high])
        marks[self.heads[a:b] - low] = True
        return np.cumsum(marks, dtype=np.int64 if self.block >= 1 << 31 else np.int32)

    def bytes_at(self, units: np.ndarray) -> np.ndarray:
        """For each document the byte where unit units[d, j] begins, columns ascending; its end for the unit after its last."""
        wanted = (self.before[:-1, None] + units).ravel()  # ascending: documents lie in order
        out = np.empty(len(wanted), np.int64)
        cuts = np.searchsorted(wanted, self.totals)
        for k in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[k], cuts[k + 1])
            sums = self._sums(int(k)) if self.sums is None else self.sums
            out[own] = k * self.block + np.searchsorted(sums, wanted[own] - self.totals[k] + 1)
        out = out.reshape(units.shape)
        return np.where(units >= self.counts[:, None], self.offsets[1:, None], out)


def _joined(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, form: np.ndarray, sentinels: tuple[str, ...]) -> pa.Array:
    """The output texts; form: 0 plain, 1 psm, 2 spm."""
    rows = len(form)
    bounds = np.empty(3 * rows + 1, np.int32)
    bounds[0::3], bounds[1::3], bounds[2::3] = offsets, cuts[:, 0], cuts[:, 1]
    pieces = pa.StringArray.from_buffers(3 * rows, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    pieces = pa.concat_arrays([pieces, pa.array([*sentinels, ""], pa.string())])
    first = 3 * np.arange(rows)
    own = {"prefix": first, "middle": first + 1, "suffix": first + 2, "P": 3 * rows, "S": 3 * rows + 1, "M": 3 * rows + 2, "": 3 * rows + 3}
    orders = (("", "prefix", "", "middle", "", "suffix"), ("P", "prefix", "S", "suffix", "M", "middle"), ("S", "suffix", "P", "prefix", "M", "middle"))
    columns = [pieces.take(pa.array(np.choose(form, [own[order[k]] for order in orders]))) for k in range(6)]
    return pc.binary_join_element_wise(*columns, "")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
    sentinels: tuple[str, str, str] = SENTINELS, unit: str = "char", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units (null if plain) and output for every row of docs."""
    if unit not in UNITS or len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError(f"units are {', '.join(UNITS)}; sentinels are three different texts")
    doc_id = F.col(id_col).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    slim = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    draws = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in parts(batch.column(1), BATCH_BYTES):
                texts = batch.column(1).slice(i, j - i)
                h1, h2, h3, h4 = (np.asarray(batch.column(2 + k).slice(i, j - i)) for k in range(4))
                units = UnitIndex(data, offsets, unit, block_bytes)
                n = units.counts
                where = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)], axis=1), axis=1)
                plain = (offsets[1:] == offsets[:-1]) | (h3 % 100 >= 100 - plain_percent)
                for sentinel in sentinels:
                    plain |= np.asarray(pc.match_substring(texts, sentinel))
                form = np.where(plain, 0, np.where(h4 % 100 < spm_percent, 2, 1))
                output = _joined(data, offsets, units.bytes_at(where), form, sentinels)
                chars = [pa.array(x, pa.int64(), mask=plain) for x in (where[:, 0], where[:, 1] - where[:, 0])]
                names = pa.array([PLAIN, PSM, SPM]).take(pa.array(form))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), names, *chars, output], ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    schema = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"
    return slim.select("doc_id", "text", *draws).mapInArrow(run, schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from. Texts with sentinels are plain, so the three in an output are its own."""
    marks = F.array(F.split(output, "|".join(re.escape(s) for s in sentinels)))  # a lambda's argument: split once
    ordered = F.transform(marks, lambda p: F.when(form == PSM, F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(3)), F.get(p, F.lit(2)))).otherwise(F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3)), F.get(p, F.lit(1)))))
    return F.when(form == PLAIN, output).otherwise(F.get(ordered, F.lit(0)))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def _draw(k: int) -> str:
    """The k-th 8-digit group as a number, by its digits."""
    digit = "(instr('0123456789abcdef', substr(d, {}, 1)) - 1)"
    return " + ".join(f"CAST({digit.format(8 * k + i)} AS BIGINT) * {16 ** (8 - i)}" for i in range(1, 9))


SQL = {
    "op11_fill_middle": f"""
WITH t AS (SELECT doc_id, coalesce("text", '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, body, CAST(length(body) AS BIGINT) AS n, {", ".join(f"{_draw(k)} AS h{k + 1}" for k in range(4))} FROM t),
c AS (
  SELECT doc_id, body, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT *, substr(body, 1, a) AS prefix, substr(body, a + 1, b - a) AS middle, substr(body, b + 1) AS suffix FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM p
"""
}
