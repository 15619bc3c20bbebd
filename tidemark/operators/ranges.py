"""Ordered work over one long group shared by many tasks: exact places, blocks of rows with a halo, sums carried between blocks.

A window without a bound on its group is one sort in one task. Here the rows of a group get their place in the group's order
from ranges of the first order column, places are cut into blocks of a fixed number of rows, and each block also gets the rows
that stand beside it. What looks a few rows back or ahead is then a window over (group, block), and a running sum adds what
the blocks before hold. Columns that these functions add begin with an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

BROADCAST = 100_000
BLOCK = 65_536


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of a written table that has one row for a group; groups that it lacks are dropped, null keys meet.

    The table is broadcast when it holds at most BROADCAST rows (counted); beyond that it is a sort-merge join, in which a hot group is
    split by adaptive execution.
    """
    right = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    if table.count() <= BROADCAST:
        right = F.broadcast(right)
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(right, met).drop(*(f"_key_{k}" for k in keys))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int = 256) -> DataFrame:
    """rows with _place: the place from 0 in their group, ordered by `order` (nulls first).

    The first order column (numeric) is cut at approximate quantiles of each group, each range is sorted by itself, and the exact counts
    of the ranges before it are added. Rows that agree in the first order column and the group are sorted by one task. The order
    must be total for the places to be the same on a rerun.
    """
    first = F.col(order[0])
    shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    cuts = written(rows.groupBy(*keys).agg(F.percentile_approx(order[0], shares, 10_000).alias("_cuts")))
    ranged = attach(rows, cuts, keys).withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda x: x < first)), F.lit(0))).drop("_cuts")
    ranged = ranged.withColumn("_range", F.when(first.isNull(), -1).otherwise(F.col("_range")))
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = written(counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")))
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    placed = ranged.withColumn("_place", F.row_number().over(within) - 1)
    placed = attach(placed, before, [*keys, "_range"])
    return placed.withColumn("_place", F.col("_place") + F.col("_before")).drop("_before", "_range")


def blocks(rows: DataFrame, halo: int, size: int = BLOCK, place: str = "_place") -> DataFrame:
    """rows with _block and _own: each row in its block, and again, not owned, in the block beside it if within `halo` rows."""
    if halo > size:
        raise ValueError("a halo reaches no further than the next block")
    block, at = F.floor(F.col(place) / size), F.col(place) % size
    beside = F.array_compact(F.array(block, F.when((at < halo) & (block > 0), block - 1), F.when(at >= size - halo, block + 1)))
    return rows.withColumn("_home", block).withColumn("_block", F.explode(beside)).withColumn("_own", F.col("_block") == F.col("_home")).drop("_home")


def owned(rows: DataFrame) -> DataFrame:
    """The rows of `blocks` without their copies and without its columns."""
    return rows.where("_own").drop("_block", "_own", "_place")


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """rows (with _block, each once) with _sum: the sum of `value` up to and with the row, over the whole group."""
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = written(sums.select(*keys, "_block", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_carried")))
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_sum", F.sum("_value").over(within))
    return attach(out, before, [*keys, "_block"]).withColumn("_sum", F.col("_sum") + F.col("_carried")).drop("_value", "_carried")
