"""Merkle manifest of a dataset: a tree for each source over its rows by id, and a tree over the sources' roots.

Rows are numbered within their source without a task that sees a whole source. Bottom up, every level is a table in the shared
folder whose rows are the runs of `arity` consecutive nodes below. Top down, the rows of a level are joined to their parents:
each child prepends the other nodes of its run to the proof that its parent has inherited, so a proof ends as the list of
siblings from the leaf to the root. A level has a third of the rows of the one below it, and both its shuffles are on (tree,
parent), which no source makes hot. Folding a proof with a leaf is a sum over that list with built-in functions.

A digest is SHA-256 over its inputs one after another, as lowercase hex; it is stored in 32 bytes.

Defined results: each field of a row counts, null apart from empty; rows whose fields are all equal are leaves of their own, with
equal digests and proofs of their own; ids may be null (first) or repeat (then by leaf). A null source is a source, apart from
the empty one. A source of one row has its leaf as its root, as has a dataset of one source its root; a proof without siblings is
the digest of nothing. An empty table has no root and gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import drop_table, fold, read, write_table
from litsieve.operators.numbering import numbered

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVEL_ROWS = 100_000  # nodes that one task of a level gets, where the level has no more: small levels go to few tasks

_PROOF = "array<struct<before: binary, after: binary>>"


def digest(*inputs: Column) -> Column:
    """SHA-256 over texts one after another, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*inputs), 256))


def as_text(binary: Column) -> Column:
    """A stored digest, or several one after another, in lowercase hex."""
    return F.lower(F.hex(binary))


def counted(value: Column) -> Column:
    """A value as its length in bytes, `:` and its text; `-` for null. No two rows of fields share such a text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return digest(*(counted(c) for c in fields.values()))


@dataclass
class _Tree:
    """Levels from the leaves to the roots; tree, pos (from 0), nodes (of the tree in this level), hash, run (the nodes below)."""

    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        ends = [level.where("nodes = 1").select("tree", "hash") for level in self.levels]
        out = ends[0]
        for more in ends[1:]:
            out = out.unionByName(more)
        return out


@dataclass
class Manifest:
    """A built manifest: its root in hex (None for an empty table), and the levels that proofs are made from.

    A source's tree is named by the number of rows before the source; the nodes of the lowest level of `top` have that in `first`.
    """

    root: str | None
    arity: int
    sources: _Tree = field(repr=False)
    top: _Tree = field(repr=False)
    carried: tuple[str, ...] = ()

    def proofs(self) -> DataFrame:
        """doc_id, leaf, the carried columns, proof and subroot (digests in 32 bytes) for every row."""
        start = self.top.levels[-1].where("nodes = 1").select("tree", F.array().cast(_PROOF).alias("proof"), F.col("hash").alias("subroot"))
        over = write_table(_push(self.top, start, self.arity).select(F.col("first").alias("tree"), "proof", F.col("hash").alias("subroot")), "merkle-proofs")
        return _push(self.sources, over, self.arity).select("doc_id", F.col("hash").alias("leaf"), *self.carried, "proof", "subroot")


def _parts(rows: int) -> int:
    return max(1, -(-rows // LEVEL_ROWS))


def _grow(leaves: DataFrame, rows: int, trees: int, largest: int, arity: int) -> _Tree:
    """Levels above `leaves` (tree, pos, nodes, hash) until every tree has one node; rows, trees and the largest tree bound their sizes."""
    levels, most, at_most = [leaves], largest, rows
    while most > 1:
        most, at_most = -(-most // arity), at_most // arity + trees
        runs = levels[-1].where("nodes > 1").groupBy("tree", F.floor(F.col("pos") / arity).cast("long").alias("pos"))
        runs = runs.agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("run"), F.max("nodes").alias("below"))  # arity nodes at most
        nodes = runs.select("tree", "pos", F.ceil(F.col("below") / arity).cast("long").alias("nodes"), F.transform("run", lambda x: x["hash"]).alias("run"))
        level = nodes.withColumn("hash", digest(F.array_join(F.transform("run", as_text), "")))
        levels.append(write_table(level.coalesce(_parts(at_most)) if _parts(at_most) == 1 else level, "merkle-level"))
    return _Tree(levels)


def _push(tree: _Tree, start: DataFrame, arity: int) -> DataFrame:
    """The lowest level with proof and subroot; `start` has both for every root (by tree)."""
    joined = lambda hashes: F.aggregate(hashes, F.lit("").cast("binary"), lambda a, b: F.concat(a, b))
    above: DataFrame | None = None
    for level in reversed(tree.levels):
        here = level.where("nodes = 1").join(start, "tree")
        if above is not None:
            place = (F.col("pos") % arity).cast("int")
            parent = above.select("tree", F.col("pos").alias("up"), F.col("run").alias("siblings"), F.col("proof").alias("inherited"), "subroot")
            children = level.where("nodes > 1").withColumn("up", F.floor(F.col("pos") / arity).cast("long")).join(parent, ["tree", "up"])
            own = F.struct(joined(F.slice("siblings", 1, place)).alias("before"), joined(F.slice("siblings", place + 2, arity)).alias("after"))
            children = children.withColumn("proof", F.concat(F.array(own), F.col("inherited")).cast(_PROOF))
            here = here.unionByName(children.select(*here.columns))
        above = here if level is tree.levels[0] else write_table(here, "merkle-proofs")
    return above


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", arity: int = ARITY, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs; `carry` names columns to keep with the leaves."""
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    carry = carry or {}
    leaf = leaf_digest({c: F.col(f"`{c}`") for c in fields})
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))  # null before every text
    columns = [c.alias(name) for name, c in carry.items()]
    rows = write_table(docs.select(source.alias("source"), F.col(id_col).cast("long").alias("doc_id"), leaf.alias("hash"), F.monotonically_increasing_id().alias("row"), *columns), "merkle-rows")
    placed = numbered(rows, ["doc_id", "hash", "row"], ["source"], "pos")
    leaves = write_table(placed.select(F.col("pos_start").alias("tree"), (F.col("pos") - 1).alias("pos"), F.col("pos_size").alias("nodes"), "hash", "doc_id", *carry), "merkle-level")
    drop_table(rows)
    trees = leaves.where("pos = 0").select("tree", "nodes")
    total, count, largest = (x or 0 for x in trees.agg(F.sum("nodes"), F.count(F.lit(1)), F.max("nodes")).first())
    sources = _grow(leaves, total, count, largest, arity)
    subroots = numbered(sources.roots().withColumnRenamed("tree", "first"), ["first"], name="place")  # trees ascend with their sources
    top = _grow(subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("place") - 1).alias("pos"), F.lit(count).cast("long").alias("nodes"), "hash", "first"), count, 1, count, arity)
    root = top.levels[-1].select(as_text(F.col("hash"))).first()
    return Manifest(root[0] if root else None, arity, sources, top, tuple(carry))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to, 32 bytes."""
    return F.aggregate(proof, leaf, lambda node, run: digest(as_text(run["before"]), as_text(node), as_text(run["after"])))


def proof_digest(proof: Column) -> Column:
    """SHA-256 over the siblings from the leaf to the root, left to right, in hex."""
    return F.sha2(F.array_join(F.transform(proof, lambda run: F.concat(as_text(run["before"]), as_text(run["after"]))), ""), 256)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents against leaves of which half have lost their line ends."""
    docs = read(spark, sf_dir, "documents")
    cut = {c: F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS}
    tampered = (fold("doc_id", 2) == 0) & F.contains("text", F.lit("\n"))
    manifest = build(docs, carry={"claimed": F.when(tampered, leaf_digest(cut))})
    out = manifest.proofs().withColumn("folded_root", as_text(folded(F.coalesce("claimed", "leaf"), F.col("proof"))))
    root = F.lit(manifest.root).cast("string")
    return out.select("doc_id", as_text(F.col("leaf")).alias("leaf"), as_text(F.col("subroot")).alias("subroot"), root.alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def _counted(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _climb(tag: str, levels: int) -> list[str]:
    """Levels of all trees of `{tag}0` (tree, pos, nodes, h), and walks of `{tag}w0` (spot, proof, node) up through them."""
    out = []
    for k in range(levels):
        out.append(f"""{tag}r{k} AS (SELECT tree, pos // 3 AS pos, max(nodes) AS below, string_agg(h, '' ORDER BY pos) AS run FROM {tag}{k} GROUP BY tree, pos // 3)""")
        out.append(f"""{tag}{k + 1} AS (SELECT tree, pos, (below + 2) // 3 AS nodes, CASE WHEN below > 1 THEN sha256(run) ELSE run END AS h FROM {tag}r{k})""")
        out.append(f"""{tag}w{k + 1} AS (SELECT w.* REPLACE (spot // 3 AS spot,
  CASE WHEN below > 1 THEN proof || substr(run, 1, 64 * (spot % 3)) || substr(run, 64 * (spot % 3) + 65) ELSE proof END AS proof,
  CASE WHEN below > 1 THEN sha256(substr(run, 1, 64 * (spot % 3)) || node || substr(run, 64 * (spot % 3) + 65)) ELSE node END AS node)
  FROM {tag}w{k} w JOIN {tag}r{k} r ON w.tree = r.tree AND w.spot // 3 = r.pos)""")
    return out


def _crc_parity(digits: str, longest: int = 20) -> str:
    """The lowest bit of a decimal's crc32: for texts of one length it is a sum modulo 2 of a bit for each character's place."""
    bit = lambda text: zlib.crc32(text) & 1
    odd = ["".join(c for c in "-0123456789" if bit(c.encode() + bytes(j)) != bit(bytes(j + 1))) for j in range(longest)]
    places = [f"CAST(length({digits}) > {j} AND contains('{own}', substr({digits}, length({digits}) - {j}, 1)) AS INTEGER)" for j, own in enumerate(odd) if own]
    lengths = ", ".join(str(n) for n in range(longest + 1) if bit(bytes(n)))
    return f"(({' + '.join(places)} + CAST(length({digits}) IN ({lengths}) AS INTEGER)) % 2)"


_DIGITS = "coalesce(CAST(doc_id AS VARCHAR), '')"
_LEVELS, _TOP_LEVELS = 14, 8  # for 3**14 rows of a source and 3**8 sources
_LEAF = " || ".join(_counted(f'"{c}"') for c in FIELDS)
SQL = {
    "op12_merkle": ",\n".join(
        [
            f"""WITH d AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256({_LEAF}) AS h,
  sha256({_LEAF.replace(_counted('"text"'), _counted("""replace("text", chr(10), '')"""))}) AS cut, {_crc_parity("digits")} AS odd FROM (SELECT *, {_DIGITS} AS digits FROM documents))""",
            "s0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS nodes FROM d)",
            "sw0 AS (SELECT doc_id, tree, pos AS spot, h AS leaf, '' AS proof, CASE WHEN odd = 0 THEN cut ELSE h END AS node FROM s0)",
            *_climb("s", _LEVELS),
            f"t0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS nodes, h, tree AS source FROM s{_LEVELS})",
            f"tw0 AS (SELECT doc_id, 0 AS tree, pos AS spot, leaf, h AS subroot, proof, node FROM sw{_LEVELS} JOIN t0 ON sw{_LEVELS}.tree = source)",
            *_climb("t", _TOP_LEVELS),
        ]
    )
    + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = h AS verified FROM tw{_TOP_LEVELS} JOIN t{_TOP_LEVELS} ON t{_TOP_LEVELS}.tree = 0
""",
}
