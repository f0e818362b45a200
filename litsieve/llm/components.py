"""Connected components of an edge table: local forests, then alternating large-star and small-star steps.

Each task first replaces its edges by a spanning forest of stars, which needs no shuffle. Then every step is a grouped
minimum, a join and a distinct; tables between rounds are written to the shared folder, so an executor's loss costs one
round. Nothing is gathered by vertex and nothing comes to the driver but one flag a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.llm.common import drop_table, write_table

LOCAL_VERTICES = 1_000_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (vertex, least vertex known here) that connect what the task's edges connect; bounded memory."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def stars() -> pa.RecordBatch:
        rows = [(x, r) for x in parent if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > LOCAL_VERTICES:
            yield stars()
            parent = {}
    yield stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b): connects neighbours of each vertex to the least vertex in sight."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex either points to one other or is only pointed to: then components are told."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    sums = ends.groupBy("v").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sums.where("out > 1 or (out > 0 and into > 0)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """vertex, component (least vertex reachable) for every vertex of edges (a, b); vertices without edges don't appear.

    Loops, repeated edges and either direction are fine. Each round about halves distances, so rounds grow with the logarithm
    of the longest chain; exceeding max_rounds raises, as labels would not be final.
    """
    named = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    current = write_table(named.mapInArrow(_local_forest, "a long, b long").distinct(), "edges")
    for _ in range(max_rounds):
        if _are_stars(current):
            return current.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
        stepped = write_table(_star(_star(current, True), False), "edges")
        drop_table(current)
        current = stepped
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
