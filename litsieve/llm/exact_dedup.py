"""Exact dedup: Patricia-trie owners.

Map side, each task inserts whole byte strings into a compressed radix trie and passes on one row per distinct text that
it holds, so a text with a third of all rows reaches its owner as one row a task. These rows are dealt by (length, content
hash); the owner task inserts the full strings into one trie per length, in whatever order they come, and the tries alone
decide which are equal. Terminal nodes hold the smallest and the largest identifier and the count.

Memory is bounded by spilling subtrees: once the tries of a task hold more than `spill_bytes`, the largest subtrees below the
roots' first bytes are turned into rows and cut off until half is left. A text that comes again after its subtree was spilled
starts a new terminal; the rows of one text, a few numbers and its hash each, are added up at the end.

Defined results: null and empty texts are equal to one another; rows with a null id are kept in their group but never
own it unless all ids are null; ids may repeat, also with different texts (each row comes back, and owns its text if its id
does); an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import keep_rows, read, text_bytes, write_table


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal is [smallest id, largest id, count].

    A node is [edge label, terminal or None, children by first byte].
    """

    NODE_BYTES = 400

    def __init__(self) -> None:
        self.root: list = [b"", None, {}]
        self.held_bytes = 0

    def insert(self, key: bytes, smallest: int | None, largest: int | None, count: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[2].get(key[at])
            if child is None:
                fresh = [key[at:], [smallest, largest, count], {}]
                node[2][key[at]] = fresh
                self.held_bytes += len(fresh[0]) + self.NODE_BYTES
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = _shared_prefix(label, key[at : at + len(label)])
            lower = [label[shared:], child[1], child[2]]
            child[0], child[1], child[2] = label[:shared], None, {label[shared]: lower}
            self.held_bytes += self.NODE_BYTES
            node, at = child, at + shared
        node[1] = _merged(node[1], smallest, largest, count)

    def terminals(self, node: list | None = None) -> Iterator[tuple[bytes, list]]:
        """Every string stored below a child of the root (or all) with its terminal, in no set order, without recursion."""
        stack = [(node or self.root, b"")]
        while stack:
            node, above = stack.pop()
            key = above + node[0]
            if node[1] is not None:
                yield key, node[1]
            stack.extend((child, key) for child in node[2].values())

    def subtrees(self) -> list[tuple[int, int]]:
        """Held bytes and first byte of every subtree below the root."""
        sizes = []
        for first, child in self.root[2].items():
            size, stack = 0, [child]
            while stack:
                node = stack.pop()
                size += len(node[0]) + self.NODE_BYTES
                stack.extend(node[2].values())
            sizes.append((size, first))
        return sizes

    def cut(self, first: int, size: int) -> Iterator[tuple[bytes, list]]:
        """Cuts the subtree of a first byte off and tells its terminals."""
        self.held_bytes -= size
        yield from self.terminals(self.root[2].pop(first))


class Owner:
    """Tries by length that give up their largest subtrees once they hold more than spill_bytes."""

    def __init__(self, spill_bytes: int) -> None:
        self.spill_bytes, self.tries, self.held = spill_bytes, {}, 0

    def insert(self, key: bytes, smallest: int | None, largest: int | None, count: int) -> None:
        trie = self.tries.get(len(key)) or self.tries.setdefault(len(key), PatriciaTrie())
        before = trie.held_bytes
        trie.insert(key, smallest, largest, count)
        self.held += trie.held_bytes - before

    def spilled(self) -> Iterator[tuple[bytes, list]]:
        """The terminals of the largest subtrees, until the tries hold half of what they may; nothing below the limit."""
        if self.held <= self.spill_bytes:
            return
        sizes = sorted(((size, n, first) for n, trie in self.tries.items() for size, first in trie.subtrees()), reverse=True)
        for size, n, first in sizes:
            if 2 * self.held <= self.spill_bytes:
                break
            self.held -= size
            yield from self.tries[n].cut(first, size)
        self.tries = {n: t for n, t in self.tries.items() if t.root[2] or t.root[1]}

    def rest(self) -> Iterator[tuple[bytes, list]]:
        for trie in self.tries.values():
            yield from trie.terminals()


def _shared_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _merged(terminal: list | None, smallest: int | None, largest: int | None, count: int) -> list:
    if terminal is None:
        return [smallest, largest, count]
    ids = [x for x in (terminal[0], smallest) if x is not None]
    terminal[0] = min(ids, default=None)
    ids = [x for x in (terminal[1], largest) if x is not None]
    terminal[1] = max(ids, default=None)
    terminal[2] += count
    return terminal


_LOCAL = pa.schema(
    [("n_bytes", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("smallest", pa.int64()), ("largest", pa.int64()), ("copies", pa.int64())]
)
_OWNER = pa.schema([("digest", pa.binary()), ("smallest", pa.int64()), ("largest", pa.int64()), ("copies", pa.int64())])
_ROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])


def _batches(terminals: Iterator[tuple[bytes, list]], schema: pa.Schema, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Terminals as rows of `schema`, a few MB at a time."""
    rows: list[tuple] = []
    size = 0
    for key, (smallest, largest, copies) in terminals:
        digest = hashlib.sha256(key).digest()
        rows.append((len(key), digest, key, smallest, largest, copies) if "body" in schema.names else (digest, smallest, largest, copies))
        size += len(key) + 100
        if size > limit:
            yield _batch(rows, schema)
            rows, size = [], 0
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _local_owners(spill_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = Owner(spill_bytes)
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                owner.insert(body.as_py().lower(), doc_id, doc_id, 1)
            yield from _batches(owner.spilled(), _LOCAL)
        yield from _batches(owner.rest(), _LOCAL)

    return run


def _owners(spill_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = Owner(spill_bytes)
        for batch in batches:
            for body, smallest, largest, copies in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                owner.insert(body.as_py(), smallest, largest, copies)
            yield from _batches(owner.spilled(), _OWNER)
        yield from _batches(owner.rest(), _OWNER)

    return run


def _row_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(body.as_py().lower()).digest() for body in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], schema=_ROW)


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spill_bytes: int = 64 << 20) -> DataFrame:
    """One row per distinct text: digest (SHA-256 of the text with A-Z lowered), smallest and largest id, copies."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    local = slim.mapInArrow(_local_owners(spill_bytes), "n_bytes long, digest binary, body binary, smallest long, largest long, copies long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = local.repartition(parts, "n_bytes", "digest").select("body", "smallest", "largest", "copies")
    owned = dealt.mapInArrow(_owners(spill_bytes), "digest binary, smallest long, largest long, copies long")
    return owned.groupBy("digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("copies").alias("copies"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", spill_bytes: int = 64 << 20) -> DataFrame:
    """Per row of docs: doc_id, keep_id (smallest or largest id of its text's group), group_size, kept, text_sha256."""
    # a table of its own, so that both sides of the join are plain shuffles, whose hot keys Spark splits
    owners = write_table(text_owners(docs, id_col, text_col, spill_bytes), "owners")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    rows = slim.mapInArrow(_row_digests, "doc_id long, digest binary")
    return rows.join(owners, "digest").select(
        "doc_id",
        F.col(keep).alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col(keep)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for every distinct text, with all its columns: that of the largest id (a null one only where all are).

    Of rows that repeat an id with its text, in any capitals, one stays.
    """
    owners = text_owners(docs, id_col, text_col)
    return keep_rows(docs, owners.select(F.col("largest").alias("doc_id"), "digest"), id_col, text_col)


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS body FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM d
"""
}
