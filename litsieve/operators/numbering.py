"""Dense numbers for the rows of a distributed table, in the order of some columns, without a task that sees all rows.

Rows are dealt to tasks by ranges of the order, sorted there and written down with their task and their place in it. One count
for each task gives the offsets, so a row's number is its place and the rows of the tasks before.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litsieve.session import write_table

_PLACE = (1 << 33) - 1  # monotonically_increasing_id has the partition above these bits


def numbered(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "number") -> DataFrame:
    """df and the number of each row from 1, in the order of the columns `order` (nulls first) within each `group`.

    With groups also `<name>_size`, the rows of the group, and `<name>_start`, the rows of the groups before it, which tells
    groups apart. Equal rows meet in one task, so give an order with a unique last column where they may be many. Only counts
    come to the driver, one for each range; a group's counts, one for each range too, are summed in a window of their own.
    """
    if not order:
        raise ValueError("numbers need an order")
    spark, task, place = df.sparkSession, f"_{name}_task", f"_{name}_place"
    keys = [*group, *(c for c in order if c not in group)]
    ranged = df.repartitionByRange(*(F.col(f"`{c}`").asc_nulls_first() for c in keys)).sortWithinPartitions(*(F.col(f"`{c}`").asc_nulls_first() for c in keys))
    placed = write_table(ranged.withColumns({task: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))}), "numbered")
    counts = sorted((r[task], r["count"]) for r in placed.groupBy(task).count().collect())
    before = accumulate((n for _, n in counts), initial=0)
    offsets = spark.createDataFrame([(t, b) for (t, _), b in zip(counts, before, strict=False)], f"`{task}` int, _before long")
    if not group:
        return placed.join(F.broadcast(offsets), task).withColumn(name, (F.col("_before") + F.col(place) + 1).cast("long")).drop(task, place, "_before")
    pieces = placed.groupBy(*group, task).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_rows")).join(F.broadcast(offsets), task)
    own = Window.partitionBy(*group)  # at most a row for each range
    first, rows = F.min(F.col("_before") + F.col("_first")).over(own), F.sum("_rows").over(own)
    names = [f"_{name}_group{k}" for k in range(len(group))]
    pieces = pieces.select(F.col(task).alias("_task"), *(F.col(f"`{c}`").alias(g) for c, g in zip(group, names, strict=True)), "_before", first.cast("long").alias(f"{name}_start"), rows.cast("long").alias(f"{name}_size"))
    same = F.col(task) == F.col("_task")
    for c, g in zip(group, names, strict=True):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(g))
    number = F.col("_before") + F.col(place) + 1 - F.col(f"{name}_start")
    return placed.join(pieces, same).select(*(F.col(f"`{c}`") for c in df.columns), number.cast("long").alias(name), f"{name}_size", f"{name}_start")
