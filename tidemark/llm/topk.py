"""Exact top-k search by integer inner product (operator 6).

Method: a vector-approximation file. Each component is quantised to one of 256 cells of its dimension's range; a scan of
the cells alone bounds every score from both sides. A first reading fetches the exact vectors with the highest bounds; its
kth score decides which others can still matter, and a second reading fetches just those, so the result is certain.

Distribution: the approximations (a byte a component) are dealt to shards of a fixed size; each block of queries visits
each shard, and a shard passes on only what its own kth lower bound leaves open. Shards and blocks are as large as a task
holds, as what moves is the cells once for each block and the queries once for each shard. Exact vectors move only for candidates.

Defined cases: rows that valid_rows leaves out take no part; equal quantised vectors are searched once and stand for their rows;
components saturate at plus or minus 2^63 - 1, scores are exact and saturate there too (equal ones tie); ties go to smaller
ids, null ids last; fewer candidates give fewer rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import across, best_groups, folded, matrix, number, query_vectors, ranked_rows, valid_rows

EVERY = 100
K = 10
SCALE = 1024
CELLS = 256
#: Rows of a shard, shards at least (so that several tasks share a small table), queries of a block.
SHARD, LEAST, BLOCK = 65536, 8, 16384
#: Bounds (queries by rows) held at once.
TILE = 1 << 22
#: Sums up to this are exact in double precision; bounds of larger ones are widened.
EXACT = 1 << 52
LARGEST = (1 << 63) - 1


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component, in double precision."""
    return rows.select("vec_id", F.transform("v", lambda x: F.greatest(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(-LARGEST))).alias("v"))


def ranges(vectors: DataFrame) -> DataFrame:
    """(dim, lo, hi): least and greatest component at each place, a row for each vector length."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo: dict[int, np.ndarray] = {}
        hi: dict[int, np.ndarray] = {}
        for b in batches:
            for v in b.column("v"):
                x = v.values.to_numpy()
                n = len(x)
                lo[n], hi[n] = np.minimum(lo.get(n, x), x), np.maximum(hi.get(n, x), x)
        dims = [(n, i, int(lo[n][i]), int(hi[n][i])) for n in lo for i in range(n)]
        yield pa.RecordBatch.from_pydict({"dim": [d[0] for d in dims], "i": [d[1] for d in dims], "lo": [d[2] for d in dims], "hi": [d[3] for d in dims]}, schema=pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())]))

    each = vectors.select("v").mapInArrow(partial, "dim int, i int, lo long, hi long")
    places = each.groupBy("dim", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return places.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("r")).select("dim", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))


class Grid:
    """The cells of each dimension: its least and greatest component and a cell's width. Differences are unsigned, so any long fits."""

    def __init__(self, lo: list[int], hi: list[int]):
        self.lo, self.hi = np.array(lo, dtype=np.int64), np.array(hi, dtype=np.int64)
        self.step = np.array([max(1, -(-(h - b + 1) // CELLS)) for b, h in zip(lo, hi, strict=True)], dtype=np.uint64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return ((x.view(np.uint64) - self.lo.view(np.uint64)) // self.step).astype(np.uint8)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest component of each cell, as doubles, and never inside it."""
        low = self.lo.view(np.uint64) + codes.astype(np.uint64) * self.step
        high = low + np.minimum(self.step - np.uint64(1), self.hi.view(np.uint64) - low)
        return low.view(np.int64).astype(np.float64), high.view(np.int64).astype(np.float64)


def bounds(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, rows): least and greatest possible score of each row, from the edges of its cells alone."""
    q = q.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    size = np.abs(q).sum(axis=1) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))
    slack = np.where(size < EXACT, 0, size * 1e-12)[:, None]
    return least - slack, most + slack


def inner(a: pa.Array, b: pa.Array) -> pa.Array:
    """Inner products of lists of longs, row by row: exact, then cut to the range of a long."""
    sizes = np.diff(a.offsets.to_numpy())
    x, y = a.flatten().to_numpy(), b.flatten().to_numpy()
    if not len(x):
        return pa.array(np.zeros(len(a), dtype=np.int64))
    starts = np.cumsum(sizes) - sizes
    safe = np.add.reduceat(np.abs(x.astype(np.float64) * y.astype(np.float64)), starts) < 1 << 62
    out = np.add.reduceat(x * y, starts)
    for i in np.flatnonzero(~safe):
        at = slice(starts[i], starts[i] + sizes[i])
        out[i] = max(-LARGEST, min(LARGEST, sum(s * t for s, t in zip(x[at].tolist(), y[at].tolist(), strict=True))))
    return pa.array(out)


def top_k(df: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row whose id `every` divides, among all other rows."""
    spark = df.sparkSession
    rows = materialize(quantised(valid_rows(df, key, vector), scale), "quantised")
    groups, (asked, queries) = folded(rows, k + 1), query_vectors(rows, every)
    counted = {"n": groups.count(), "q": queries.count()}
    shards, blocks = max(LEAST, -(-counted["n"] // SHARD)), max(1, -(-counted["q"] // BLOCK))
    grids = spark.sparkContext.broadcast({r["dim"]: Grid(r["lo"], r["hi"]) for r in ranges(rows).collect()})  # a few numbers a dimension
    discard(rows)

    @F.arrow_udf("binary")
    def cells(vs: pa.Array) -> pa.Array:
        return pa.array([grids.value[len(v)].codes(v.values.to_numpy()).tobytes() for v in vs], pa.binary())

    def scan(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "g": [], "low": [], "high": []}
        if len(left) and len(right):
            g, low_id = left["g"].to_numpy(), left["low"].to_numpy()
            low, high = grids.value[keys[0]].edges(np.frombuffer(b"".join(left["codes"]), dtype=np.uint8).reshape(len(g), -1))
            q, names = matrix(right["v"]), right["q"].to_numpy()
            tile = max(1, TILE // len(g))
            for a in range(0, len(q), tile):
                for name, least, most in zip(names[a : a + tile], *bounds(low, high, q[a : a + tile]), strict=True):
                    at = np.arange(len(g)) if len(g) <= k + 1 else np.flatnonzero(most >= np.partition(least, len(g) - k - 1)[len(g) - k - 1])
                    for column, x in zip(out, (np.full(len(at), name), g[at], low_id[at], most[at]), strict=True):
                        out[column].append(x)
        return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in out.items()})

    at = ["dim", "shard", "block"]
    approx = groups.select("g", "low", "dim", number(F.col("g"), shards).alias("shard"), cells("v").alias("codes"))
    visitors = queries.withColumn("block", number(F.col("q"), blocks))
    sides = across(approx, blocks, "block").groupBy(*at).cogroup(across(visitors, shards, "shard").groupBy(*at))
    found = materialize(sides.applyInPandas(scan, "q long, g long, low long, high double"), "candidates")
    exact = F.arrow_udf(inner, "long")

    def read(candidates: DataFrame) -> DataFrame:
        pairs = candidates.select("q", "g", "low").join(groups.select(F.col("g").alias("gg"), F.col("v").alias("gv")), F.col("g") == F.col("gg"))
        pairs = pairs.join(queries.select(F.col("q").alias("qq"), F.col("v").alias("qv")), F.col("q") == F.col("qq"))
        return pairs.select("q", "g", "low", exact("gv", "qv").alias("score"), (F.col("gv") == F.col("qv")).alias("same"))

    # The best k + 1 bounds of a query by a row number that each task limits before the shuffle: no query's candidates meet in one task.
    order = Window.partitionBy("q").orderBy(F.desc("high"), "g")
    first = materialize(read(found.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k + 1)), "first-reading")
    kth = first.groupBy(F.col("q").alias("kq")).agg(F.min("score").cast("double").alias("kth"))
    rest = found.join(kth, F.col("q") == F.col("kq")).where(F.col("high") >= F.col("kth")).join(first.select("q", "g"), ["q", "g"], "left_anti")
    return ranked_rows(best_groups(first.unionByName(read(rest)), k + 1), groups, asked, k)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.n <> v.n AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
