"""Exact order statistics of groups of any size: approximate quantiles narrow an open interval, exact counts say where a place lies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import written
from .ranges import attach

SMALL = 16_384
CELLS = 256


def _inside() -> Column:
    return F.coalesce(F.col("_v") > F.col("_lo"), F.lit(True)) & F.coalesce(F.col("_v") < F.col("_hi"), F.lit(True))


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, places: Callable[[Column], Column], small: int = SMALL) -> DataFrame:
    """keys, n, picked (array<double>): the values at `places` (an array of places from 0, made from n) of each sorted group.

    Null and NaN take no part; a group without other values has no row. A place's interval starts unbounded. Each round takes a
    grid of approximate quantiles of what is inside, two of them around the place, and counts exactly what is below, at, between and above
    these two: then the place's value is one of the two, or its interval shrinks to about three cells of the grid. Both ends are values and
    leave the interval, so that heavy ties end it rather than keep it open. Sketches and counts are aggregates with partial results of fixed
    size. An interval of at most `small` values is sorted as a list.
    """
    v = rows.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = v.groupBy(*keys).agg(F.count("*").alias("n"))
    state = written(
        sizes.select(*keys, "n", F.posexplode(places(F.col("n"))).alias("_w", "_k")).withColumns({"_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double"), "_below": F.lit(0).cast("long"), "_m": F.col("n"), "_at": F.lit(None).cast("double")})
    )
    shares = F.array(*(F.lit(i / CELLS) for i in range(CELLS + 1)))
    while not state.where((F.col("_at").isNull()) & (F.col("_m") > small)).isEmpty():
        wide = F.col("_at").isNull() & (F.col("_m") > small)
        inside = attach(v, state.where(wide), keys).where(_inside())
        grid = inside.groupBy(*keys, "_w").agg(F.percentile_approx("_v", shares, 10_000).alias("_grid"), *(F.first(c).alias(c) for c in ("_k", "_below", "_m", "_lo", "_hi")))
        cell = F.floor((F.col("_k") - F.col("_below")) * CELLS / F.col("_m")).cast("int")
        near = written(grid.withColumn("_cell", cell).select(*keys, "_w", "_lo", "_hi", F.get("_grid", F.greatest(F.lit(0), F.col("_cell") - 1)).alias("_a"), F.get("_grid", F.least(F.lit(CELLS), F.col("_cell") + 2)).alias("_b")))
        met = attach(v, near, keys).where(_inside())
        x = F.col("_v")
        counts = met.groupBy(*keys, "_w").agg(
            F.first("_a").alias("_a"), F.first("_b").alias("_b"), F.count_if(x < F.col("_a")).alias("_under"), F.count_if(x == F.col("_a")).alias("_at_a"),
            F.count_if((x > F.col("_a")) & (x < F.col("_b"))).alias("_between"), F.count_if((x == F.col("_b")) & (F.col("_b") > F.col("_a"))).alias("_at_b"),
        )
        both = state.where(wide).alias("s").join(counts.alias("c"), [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_w"]])
        e1 = F.col("_below") + F.col("_under")
        e2 = e1 + F.col("_at_a")
        e3 = e2 + F.col("_between")
        e4 = e3 + F.col("_at_b")
        k = F.col("_k")
        pick = lambda under, a, between, b, over: F.when(k < e1, under).when(k < e2, a).when(k < e3, between).when(k < e4, b).otherwise(over)
        none = F.lit(None).cast("double")
        moved = both.select(
            *(F.col(f"s.{c}").alias(c) for c in [*keys, "n", "_w", "_k"]), pick(F.col("_lo"), none, F.col("_a"), none, F.col("_b")).alias("_lo"), pick(F.col("_a"), none, F.col("_b"), none, F.col("_hi")).alias("_hi"),
            pick(F.col("_below"), F.col("_below"), e2, F.col("_below"), e4).alias("_below"), pick(F.col("_under"), F.lit(1), F.col("_between"), F.lit(1), F.col("_m") + F.col("_below") - e4).alias("_m"), pick(none, F.col("_a"), none, F.col("_b"), none).alias("_at"),
        )
        state = written(state.where(~wide).unionByName(moved))
    rest = state.where("_at IS NULL")
    got = attach(v, rest, keys).where(_inside()).groupBy(*keys, "_w").agg(F.first("n").alias("n"), F.get(F.array_sort(F.collect_list("_v")), F.first((F.col("_k") - F.col("_below")).cast("int"))).alias("_at"))
    done = state.where("_at IS NOT NULL").select(*keys, "_w", "n", "_at").unionByName(got.select(*keys, "_w", "n", "_at"))
    return done.groupBy(*keys).agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_w", "_at"))), lambda s: s["_at"]).alias("picked"))


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], small: int = SMALL) -> DataFrame:
    """keys, n, p (array<double>): exact percentiles of each group, linear between the two places around each fraction."""
    at = lambda n, f: F.lit(f) * (n - 1)
    got = order_statistics(rows, keys, value, lambda n: F.array(*(side(at(n, f)).cast("long") for f in fractions for side in (F.floor, F.ceil))), small)

    def between(i: int, f: float) -> Column:
        lo, hi, h = F.col("picked")[2 * i], F.col("picked")[2 * i + 1], at(F.col("n"), f)
        return F.when(lo == hi, lo).otherwise((F.ceil(h) - h) * lo + (h - F.floor(h)) * hi)

    return got.select(*keys, "n", F.array(*(between(i, f) for i, f in enumerate(fractions))).alias("p"))


def upper_medians(rows: DataFrame, keys: Sequence[str], value: str, small: int = SMALL) -> DataFrame:
    """keys, n, upper: the element at n // 2 of each sorted group."""
    got = order_statistics(rows, keys, value, lambda n: F.array(F.floor(n / 2).cast("long")), small)
    return got.select(*keys, "n", F.col("picked")[0].alias("upper"))
