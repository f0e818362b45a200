"""Extension: citation snowballing over an edge table, hop by hop with a visited set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litsieve.session import shared_dir


def snowball(edges: DataFrame, seeds: DataFrame, hops: int, include: Column | None = None) -> DataFrame:
    """node, hop: every node first reached after at most `hops` steps along edges (src, dst) from seeds (node).

    `include` filters the nodes of each frontier before it is expanded (not the ones that are returned). Each hop is a join
    of the frontier with the edges and an anti-join with what was visited. Frontiers are checkpointed in the shared folder, so
    a hop's work is done once and its plan doesn't grow with the hops; an empty frontier ends the search.
    """
    shared_dir(seeds.sparkSession)
    visited = seeds.select("node").distinct().withColumn("hop", F.lit(0)).checkpoint()
    frontier = visited
    for hop in range(1, hops + 1):
        grow = frontier if include is None else frontier.where(include)
        reached = edges.join(grow.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = reached.join(visited.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited
