"""Embedding near-dedup: sorted projection passes, verified pairs, components, exact link counts.

1. Equal vectors of a label become one class with a number of its own and its count of copies, whatever their ids.
2. In each pass the classes of a label are ordered by the concatenated signs of KEY_BITS random projections of the vector
   less the label's mean (so that a direction which all vectors share doesn't bunch the keys). Rows of a pass carry the key, the
   class's number and a SKETCH of further signs, not the vector.
3. The order is cut into blocks of BLOCK rows by position, with `window` rows of either neighbour, so that every row meets the
   `window` rows before and after it, whatever the number of partitions. Pairs whose sketches differ in more bits than a pair at
   the threshold does (five standard deviations) are left out; the others are candidates.
4. Passes go on until a pair at the threshold is missed with a chance of at most MISSED. That chance is measured, not assumed:
   a row's neighbours at distance `window` tell how many leading bits b of the key a partner has to share to lie within reach,
   and its distance from the mean tells how likely one bit is shared (q), so a pass finds it with chance q**b. Every label takes
   the passes that its size asks for, and nothing caps those that the measure adds; where the added ones would cost more than
   comparing all pairs of the label, that follows instead (step 6), which misses none.
5. Candidates are verified by cosine in double precision: first every row's nearest ones, then those that would connect
   different components.
6. Every pair of classes within a component (and within a label whose passes don't suffice) is compared in cells: members are dealt
   into groups (of GROUP_BYTES at most, few small ones where that is all), and each pair of groups is one task, which adds up exact link counts and emits no pair but links
   that unite something new. So n_links holds every link within a component, also those that no window saw.

Defined results: vectors that are null, empty, zero or hold null or non-finite components (or finite ones whose squares
overflow), and rows with a null label, link with nothing and are kept; vectors of other length never link; repeated ids are vectors of their own, each with its own links;
rows without an id take part, and a component's id is the least id in it, null if there is none (then its rows are kept); an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litsieve.llm.common import drop_table, read, write_table
from litsieve.llm.components import connected_components

THRESHOLD = 0.93
WINDOW = 32
MISSED = 0.01
KEY_BITS = 62
SKETCH = 256
BLOCK = 2048
GROUP_BYTES = 8 << 20
GROUP_ROWS, FEW_GROUPS = 128, 16  # smaller owners are dealt too, into groups of so many rows but not more groups than that
TILE = 1024
MEAN_BYTES = 64 << 20
GRID = [1, 1.25, 1.5, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64]  # multiples of the passes done for which misses are measured


def passes_needed(n: int, threshold: float, window: int, missed: float = MISSED) -> int:
    """The passes to begin with: so many would do among n vectors if every bit halved them."""
    bits = max(0.0, math.log2(max(2, n) / window))
    together = min((1 - math.acos(threshold) / math.pi) ** bits, 1 - 1e-9)
    return max(2, math.ceil(math.log(missed) / math.log(1 - together)))


def _passes_column(n: Column, threshold: float, window: int) -> Column:
    bits = F.greatest(F.lit(0.0), F.log2(n / window))
    together = F.least(F.pow(F.lit(1 - math.acos(threshold) / math.pi), bits), F.lit(1 - 1e-9))
    return F.greatest(F.lit(2.0), F.ceil(math.log(MISSED) / F.log(1 - together))).cast("long")


def _projections(dims: int, number: int, bits: int) -> np.ndarray:
    """The fixed random directions of a pass (or, as number -1, of the sketch)."""
    return np.random.default_rng([dims, number + 1]).normal(size=(dims, bits)).astype(np.float32)


def _valid(kind: str):
    """vec_id, label, digest of the vector (null where it links with nothing), the vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                blob = None
                if label is not None and v.is_valid and not v.values.null_count and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False)
                    wide = x.astype(np.float64)
                    norm = float(np.sqrt((wide * wide).sum()))
                    if np.isfinite(wide).all() and 0 < norm < math.inf:
                        blob = (x + x.dtype.type(0)).astype(kind).tobytes()
                digests.append(hashlib.sha256(blob).digest()[:16] if blob else None)
                vectors.append(blob)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], ["vec_id", "label", "digest", "vector"])

    return run


def _units(blobs: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sums(kind: str):
    """Sums of unit vectors by label and length, as far as one task sees them: label, size, n, total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list] = {}
        held = 0

        def told() -> pa.RecordBatch:
            rows = [(label, size, n, total.tobytes()) for (label, size), (n, total) in totals.items()]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["label", "size", "n", "total"])

        for batch in batches:
            for label, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                unit = _units([blob], kind)[0]
                own = totals.get((label, len(blob)))
                if own is None:
                    totals[label, len(blob)] = [1, unit]
                    held += unit.nbytes
                else:
                    own[0] += 1
                    own[1] = own[1] + unit
            if held > MEAN_BYTES:
                yield told()
                totals, held = {}, 0
        if totals:
            yield told()

    return run


def _add_sums(table: pa.Table) -> pa.Table:
    n = sum(table.column("n").to_pylist())
    mean = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("total")) / n
    return pa.table({"label": table.column("label").slice(0, 1), "size": table.column("size").slice(0, 1), "n": pa.array([n], pa.int64()), "mean": pa.array([mean.tobytes()], pa.binary())})


def _signs(x: np.ndarray) -> np.ndarray:
    """Signs of the columns as 64-bit words, the first column's in the highest bit."""
    bits = np.packbits(x >= 0, axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
    return np.ascontiguousarray(bits).view(">u8").astype(np.uint64)


def _project(kind: str, threshold: float):
    """One row a class and pass: label, size, pass, hash, key, sketch, same (chance that a partner at the threshold shares a bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}

        def directions(dims: int, number: int, bits: int) -> np.ndarray:
            if (dims, number) not in known:
                if len(known) > 256:
                    known.clear()
                known[dims, number] = _projections(dims, number, bits)
            return known[dims, number]

        for batch in batches:
            key, label, size, begin, end = (batch.column(k).to_numpy() for k in range(5))
            for one in np.unique(size):
                rows = np.flatnonzero(size == one)
                units = _units(batch.column(5).take(pa.array(rows)).to_pylist(), kind)
                means = np.frombuffer(b"".join(batch.column(6).take(pa.array(rows)).to_pylist()), np.float64).reshape(len(rows), -1)
                apart = units - means
                square = np.maximum((apart * apart).sum(axis=1), 1e-12)
                same = 1 - np.arccos(np.clip(1 - (1 - threshold) / square, -1, 1)) / math.pi
                dims = units.shape[1]
                sketch = _signs(units.astype(np.float32) @ directions(dims, -1, SKETCH))
                sketches = [s.tobytes() for s in sketch]
                apart = apart.astype(np.float32)
                for number in range(int(begin[rows].min()), int(end[rows].max())):
                    use = np.flatnonzero((begin[rows] <= number) & (number < end[rows]))
                    if len(use):
                        hashes = _signs(apart[use] @ directions(dims, number, KEY_BITS))[:, 0] >> np.uint64(64 - KEY_BITS)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(label[rows][use]), pa.array(size[rows][use]), pa.array(np.full(len(use), number, np.int64)), pa.array(hashes.astype(np.int64)), pa.array(key[rows][use]),
                             pa.array([sketches[k] for k in use.tolist()], pa.binary()), pa.array(same[use])],
                            ["label", "size", "pass", "hash", "key", "sketch", "same"],
                        )

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place among the rows of its pass in this task, which come in order."""
    last, at = None, 0
    for batch in batches:
        group = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        places = np.empty(len(group), np.int64)
        cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1).tolist(), len(group)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            own = tuple(group[a].tolist())
            at = at if own == last else 0
            places[a:b] = at + np.arange(b - a)
            last, at = own, at + b - a
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], [*batch.schema.names, "place"])


def sketch_limit(threshold: float) -> int:
    """Differing sketch bits that a pair at the threshold exceeds by chance only (five standard deviations)."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + 5 * math.sqrt(SKETCH * p * (1 - p)))


def _windows(threshold: float, window: int, limit: int):
    """Candidates of a block (a, b, near) and what the block tells of misses (label, size, done, m0...)."""

    def run(table: pa.Table) -> pa.Table:
        position = table.column("position").to_numpy()
        order = np.argsort(position, kind="stable")
        position, key, same = position[order], table.column("key").to_numpy()[order], table.column("same").to_numpy()[order]
        hashes = table.column("hash").to_numpy()[order].astype(np.uint64)
        sketch = np.frombuffer(b"".join(table.column("sketch").take(pa.array(order)).to_pylist()), np.uint64).reshape(len(order), -1)
        own = position // BLOCK == table.column("block")[0].as_py()
        n = len(order)
        first, second, bits = [], [], []
        for d in range(1, min(window, n - 1) + 1):
            later = np.flatnonzero(own[d:])
            apart = np.bitwise_count(sketch[later + d] ^ sketch[later]).sum(axis=1, dtype=np.int64)
            hit = apart <= limit
            first.append(later[hit])
            second.append(later[hit] + d)
            bits.append(apart[hit])
        a, b, bits = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second, bits))
        near = np.zeros(len(a), bool)
        if len(a):
            best = np.lexsort((a, bits, b))
            near[best[np.concatenate([[True], b[best][1:] != b[best][:-1]])]] = True
        # bits that a partner has to share with a row to lie within the window, from the rows at its ends
        shared = np.full(n + window, -1.0)
        if n > window:
            differ = (hashes[window:] ^ hashes[:-window]).astype(np.float64)
            shared[window:n] = KEY_BITS - np.where(differ > 0, np.floor(np.log2(np.maximum(differ, 1))) + 1, 0)
        need = 1 + np.maximum(shared[:n], shared[window : n + window])
        chance = np.where(need > 0, same ** np.maximum(need, 0), 1.0)[own]
        done = table.column("end")[0].as_py()
        missed = [float(((1 - chance) ** (done * g)).sum()) for g in GRID]
        a, b = np.minimum(key[a], key[b]), np.maximum(key[a], key[b])
        pairs = len(a)
        out = {"label": [table.column("label")[0].as_py()] + [None] * pairs, "size": [table.column("size")[0].as_py()] + [None] * pairs, "rows": [int(own.sum())] + [None] * pairs}
        out = {k: pa.array(v, pa.int64()) for k, v in out.items()}
        out["a"], out["b"] = pa.array([None, *a.tolist()], pa.int64()), pa.array([None, *b.tolist()], pa.int64())
        out["near"] = pa.array([None, *near.tolist()], pa.bool_())
        return pa.table(out | {f"m{k}": pa.array([x] + [None] * pairs, pa.float64()) for k, x in enumerate(missed)})

    return run


_FOUND = "label long, size long, rows long, a long, b long, near boolean, " + ", ".join(f"m{k} double" for k in range(len(GRID)))


def _pass_rows(classes: DataFrame, means: DataFrame, plan: DataFrame, kind: str, threshold: float, window: int) -> DataFrame:
    """The candidates and measures of the passes begin..end-1 of every label in plan."""
    asked = plan.select("label", "size", "begin", "end").join(means.select("label", "size", "mean"), ["label", "size"])
    rows = classes.join(asked, ["label", "size"]).select("key", "label", "size", "begin", "end", "vector", "mean")
    hashed = rows.mapInArrow(_project(kind, threshold), "label long, size long, pass long, hash long, key long, sketch binary, same double")
    hashed = write_table(hashed, "passes")
    by = ["label", "size", "pass"]
    placed = hashed.repartitionByRange(*by, "hash", "key").sortWithinPartitions(*by, "hash", "key")
    placed = write_table(placed.mapInArrow(_number, "label long, size long, pass long, hash long, key long, sketch binary, same double, place long").withColumn("task", F.spark_partition_id()), "places")
    drop_table(hashed)
    counts = placed.groupBy(*by, "task").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(*by).orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    placed_at = placed.join(counts.withColumn("before", before).select(*by, "task", "before"), [*by, "task"]).withColumn("position", F.col("before") + F.col("place"))
    own, inside = F.floor(F.col("position") / BLOCK).cast("long"), F.col("position") % BLOCK
    blocks = F.array_compact(F.array(own, F.when(inside >= BLOCK - window, own + 1), F.when((inside < window) & (own > 0), own - 1)))
    dealt = placed_at.withColumn("block", F.explode(blocks)).join(plan.select("label", "size", "end"), ["label", "size"])
    dealt = dealt.repartition(*by, "block")  # or the join's partitioning by label would do for Spark
    found = dealt.groupBy(*by, "block").applyInArrow(_windows(threshold, window, sketch_limit(threshold)), _FOUND)
    found = write_table(found, "windows")
    drop_table(placed)
    return found


def _planned(plan: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """The labels whose measured misses ask for more passes, from where they stand; `exact` where all pairs cost less."""
    measured = found.where("rows is not null").groupBy("label", "size").agg(F.sum("rows").alias("rows"), *(F.sum(f"m{k}").alias(f"m{k}") for k in range(len(GRID))))
    enough = F.coalesce(*(F.when(F.col(f"m{k}") <= MISSED * F.col("rows"), F.ceil(F.col("end") * g).cast("long")) for k, g in enumerate(GRID)), F.col("n"))
    more = plan.join(measured, ["label", "size"]).select("label", "size", "n", F.col("end").alias("begin"), enough.alias("end")).where("end > begin")
    return more.withColumn("exact", 2 * window * F.col("end") >= F.col("n"))


def _verified(kind: str, threshold: float):
    """Keeps the pairs (a, b) whose vectors reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = np.zeros(batch.num_rows, bool)
            sizes = np.array([len(x) for x in batch.column(2).to_pylist()])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x, y = (_units(batch.column(k).take(pa.array(rows)).to_pylist(), kind) for k in (2, 3))
                keep[rows] = np.einsum("ij,ij->i", x, y) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    return run


def _links_of(pairs: DataFrame, classes: DataFrame, kind: str, threshold: float) -> DataFrame:
    one = classes.select(F.col("key").alias("a"), F.col("vector").alias("x"))
    two = classes.select(F.col("key").alias("b"), F.col("vector").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verified(kind, threshold), "a long, b long")


def _links(a: np.ndarray, b: np.ndarray, a_32: np.ndarray, b_32: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (of a, of b) of the pairs that reach the threshold."""
    slack = 2.0**-23 * (a.shape[1] + 8)
    near = a_32 @ b_32.T
    i, j = np.nonzero(near >= np.float32(threshold - slack))
    close = np.flatnonzero(near[i, j] < threshold + slack)
    drop = []
    for at in range(0, len(close), 65536):
        some = close[at : at + 65536]
        drop.append(some[np.einsum("ij,ij->i", a[i[some]], b[j[some]]) < threshold])
    return (np.delete(i, np.concatenate(drop)), np.delete(j, np.concatenate(drop))) if drop else (i, j)


def _unite(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Groups of all rows after the links (a, b), and which links it took: every round each group follows one link."""
    taken: list[int] = []
    live = np.arange(len(a))
    while len(live := live[group[a[live]] != group[b[live]]]):
        _, first = np.unique(group[a[live]], return_index=True)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for k in live[first].tolist():
            x, y = find(int(group[a[k]])), find(int(group[b[k]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                taken.append(k)
        to = np.arange(len(group))
        for x in parent:
            to[x] = find(x)
        group = to[group]
    return group, taken


def _cell(kind: str, threshold: float):
    """Link counts of a cell's classes (a, null, n) and, for whole labels, links that unite them (a, b, null)."""

    def run(table: pa.Table) -> pa.Table:
        low = table.column("low")[0].as_py()
        same = low == table.column("high")[0].as_py()
        g = table.column("g").to_numpy()
        order = np.argsort(g != low, kind="stable")  # the low group's rows first
        ids, copies = (table.column(c).to_numpy()[order] for c in ("key", "copies"))
        units = _units(table.column("vector").take(pa.array(order)).to_pylist(), kind)
        units_32 = units.astype(np.float32)
        n_low = int((g == low).sum())
        n, group, links = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        whole = table.column("whole")[0].as_py()
        for i in range(0, n_low, TILE):
            rows = slice(i, min(n_low, i + TILE))
            for j in range(i if same else n_low, len(ids), TILE):
                columns = slice(j, j + TILE)
                a, b = _links(units[rows], units[columns], units_32[rows], units_32[columns], threshold)
                if same and i == j:
                    ok = a < b
                    a, b = a[ok], b[ok]
                if not len(a):
                    continue
                a, b = a + i, b + j
                np.add.at(n, a, copies[b])
                np.add.at(n, b, copies[a])
                if whole:
                    group, taken = _unite(group, a, b)
                    links.append((ids[a[taken]], ids[b[taken]]))
        if same:
            n += copies
        a, b = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
        some = np.flatnonzero(n)
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[some], a]), pa.int64()),
                "b": pa.array([None] * len(some) + b.tolist(), pa.int64()),
                "n": pa.array(n[some].tolist() + [None] * len(a), pa.int64()),
            }
        )

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    column = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), column.alias("v"))
    rows = write_table(slim.mapInArrow(_valid(kind), "vec_id long, label long, digest binary, vector binary"), "vectors")
    classes = rows.where("digest is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = write_table(classes.withColumn("size", F.length("vector").cast("long")).withColumn("key", F.monotonically_increasing_id()), "classes")

    sums = classes.select("label", "vector").mapInArrow(_sums(kind), "label long, size long, n long, total binary")
    means = write_table(sums.groupBy("label", "size").applyInArrow(_add_sums, "label long, size long, n long, mean binary"), "means")
    plan = means.select("label", "size", "n", F.lit(0).cast("long").alias("begin"), _passes_column(F.col("n"), threshold, window).alias("end"))
    plan = write_table(plan.where("n > 1").withColumn("exact", F.lit(False)), "plan")
    exact = plan.where("exact").select("label", "size")
    pairs = spark.createDataFrame([], "a long, b long, near boolean")
    while not plan.isEmpty():  # each round at least takes some labels off or adds passes, up to the cost of all pairs
        found = _pass_rows(classes, means, plan, kind, threshold, window)
        pairs = pairs.unionByName(found.where("a is not null").select("a", "b", "near"))
        plan = write_table(_planned(plan, found, window), "plan")
        exact = exact.unionByName(plan.where("exact").select("label", "size"))
        plan = plan.where("not exact")

    pairs = write_table(pairs.groupBy("a", "b").agg(F.max("near").alias("near")), "pairs")
    links = write_table(_links_of(pairs.where("near").select("a", "b"), classes, kind, threshold), "links")
    component = write_table(connected_components(links), "components")
    ends = [component.select(F.col("vertex").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b")]
    others = pairs.where("not near").join(ends[0], "a", "left").join(ends[1], "b", "left")
    others = others.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    others = write_table(_links_of(others, classes, kind, threshold), "links")
    joined = write_table(connected_components(links.unionByName(others)), "components")
    for done in (pairs, links, others, component):
        drop_table(done)

    # members of the groups whose pairs are all compared: components, and labels whose passes don't suffice
    slim_classes = classes.select("key", "label", "size", "copies", "vector")
    whole = slim_classes.join(exact.distinct(), ["label", "size"], "left_semi").withColumn("whole", F.lit(True)).withColumn("owner", F.col("label"))
    parts = slim_classes.join(joined.withColumnRenamed("vertex", "key"), "key").join(exact.distinct(), ["label", "size"], "left_anti")
    parts = parts.withColumn("whole", F.lit(False)).withColumn("owner", F.col("component")).drop("component")
    members = whole.unionByName(parts)
    by = ["whole", "owner", "size"]
    rows_in = F.count("*")
    groups = members.groupBy(*by).agg(F.greatest(F.ceil(rows_in * F.col("size") / group_bytes), F.least(F.ceil(rows_in / GROUP_ROWS), F.lit(FEW_GROUPS))).alias("groups"))
    dealt = members.join(groups, by).withColumn("g", F.pmod(F.xxhash64("key"), F.col("groups")))
    dealt = dealt.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    cells = dealt.select(*by, F.least("g", "h").alias("low"), F.greatest("g", "h").alias("high"), "g", "key", "copies", "vector")
    cells = cells.repartition(*by, "low", "high")  # every cell a group of its own: the join's partitioning by owner isn't enough
    found = write_table(cells.groupBy(*by, "low", "high").applyInArrow(_cell(kind, threshold), "a long, b long, n long"), "cells")
    inside = connected_components(found.where("b is not null").select("a", "b"))
    component = write_table(inside.unionByName(joined.join(inside.select("vertex"), "vertex", "left_anti")), "components")
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))

    final = classes.select("key", "label", "digest", "copies", "least").join(component.withColumnRenamed("vertex", "key"), "key", "left").join(counts, "key", "left")
    final = final.select("label", "digest", "least", (F.coalesce("n", "copies") - 1).alias("n"), F.coalesce("component", "key").alias("component"))
    least = final.groupBy("component").agg(F.min("least").alias("least_id"))
    final = final.join(least, "component").select("label", "digest", "n", "least_id", F.lit(True).alias("linked"))
    out = rows.select("vec_id", "label", "digest").join(final, ["label", "digest"], "left")
    mine = F.when(F.col("linked"), F.col("least_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        mine.alias("component_id"),
        F.when(mine.isNull(), F.lit(True)).otherwise(F.coalesce(F.col("vec_id") == mine, F.lit(False))).alias("kept"),
    )


def op10_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
