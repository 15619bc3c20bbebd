"""Embedding whitening (operator 11).

Method: one-sided Jacobi SVD of the centred vectors. Each task compresses the rows of its block to an upper triangle R by
QR (the centred block is never squared); triangles are stacked FAN at a time and compressed again in a tree until one is left.
Plane rotations make the columns of that R orthogonal in pairs; their lengths are the standard deviations, and the
accumulated rotations are the components, accurate to the last digits even for small ones.

Centring is exact: components become integers, n * x - S is computed in integers, and only the quotient by n is rounded.

A task holds one batch of vectors and one triangle of each length; a model is 16 components of a length. Vectors of unlike
lengths are whitened apart, in rounds of lengths whose triangles and models together stay under LENGTHS_MB.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import valid_rows

#: Triangles that are stacked at a level of the tree.
FAN = 8
#: Lengths are treated together as long as their triangles take at most so much memory.
LENGTHS_MB = 64
SCALE, SHIFT = 64, 1_000_000
LONG = (1 << 63) - 1
#: Scaled components are held within this.
WIDEST = float(1 << 62)
#: Rows that are centred and multiplied at once.
SLICE = 4096

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def lattice(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>, dim) of the vectors that take part: floor(64 c) + 1000000 of each component c as double.

    64 c is held within 2^62 either way, so that any finite component has a whole number.
    """
    scaled = lambda c: F.floor(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), c.cast("double") * SCALE))) + SHIFT
    return valid_rows(df, key, vector).select("vec_id", F.transform("v", scaled).alias("x"), F.size("v").alias("dim"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of each length among the vectors x of a batch, SLICE rows at most at once."""
    x = batch.column("x")
    sizes = np.diff(x.offsets.to_numpy())
    flat, starts = x.values.to_numpy(), x.offsets.to_numpy()[:-1]
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        for at in range(0, len(rows), SLICE):
            some = rows[at : at + SLICE]
            yield int(d), some, flat[starts[some][:, None] + np.arange(d)]


def _times_n(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: in longs where they hold it, else in Python's integers."""
    most = max(int(x.max()), -int(x.min()), 1)
    if n * most + max(map(abs, sums)) < LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[int, list[int]]] = {}
    for b in batches:
        for d, some, x in _by_length(b):
            n, s = total.get(d, (0, [0] * d))
            narrow = max(int(x.max()), -int(x.min()), 1) * len(some) < LONG
            total[d] = n + len(some), [a + int(c) for a, c in zip(s, x.sum(axis=0) if narrow else x.astype(object).sum(axis=0), strict=True)]
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(Decimal, s), pa.decimal128(38, 0))], names=["dim", "place", "n", "s"])


def _compress(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def _triangles(lengths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _by_length(b):
                n, sums = lengths.value[d]
                held[d] = _compress(held.get(d), _times_n(x, n, sums).astype(np.float64) / n / np.sqrt(n))
        block = TaskContext.get().partitionId()
        for d, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([block], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["dim", "block", "r"])

    return run


def _stack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    d, r = int(key[0]), None
    for raw in group.sort_values("block")["r"]:
        r = _compress(r, np.frombuffer(raw).reshape(-1, d))
    return pd.DataFrame({"dim": [d], "block": [key[1]], "r": [r.tobytes()]})


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, rotations): orthogonalises the columns of r by plane rotations; r @ rotations has columns of these lengths, falling.

    A sweep turns each pair of columns once, in rounds of disjoint pairs (as in a tournament), so that a round is a few matrix
    operations. It ends with a sweep in which no pair was further from orthogonal than rounding makes it.
    """
    d = r.shape[1]
    a, q = np.array(r, np.float64), np.eye(d)
    players = list(range(d + d % 2))
    half = len(players) // 2
    for _ in range(sweeps):
        turned = False
        for _ in range(max(1, len(players) - 1)):
            pairs = [(i, j) for i, j in zip(players[:half], players[: half - 1 : -1], strict=True) if i < d and j < d]
            players = [players[0], players[-1], *players[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            p, s = a[:, i], a[:, j]
            alpha, beta, gamma = (p * p).sum(axis=0), (s * s).sum(axis=0), (p * s).sum(axis=0)
            skew = np.abs(gamma) > 4 * np.finfo(float).eps * np.sqrt(alpha) * np.sqrt(beta)
            if not skew.any():
                continue
            turned = True
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=skew)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(skew, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            for m in (a, q):
                p, s = m[:, i], m[:, j]
                m[:, i], m[:, j] = c * p - c * t * s, c * t * p + c * s
        if not turned:
            break
    sizes = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], q[:, order]


def _components(most: int):
    def model(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        d = int(key[0])
        sizes, q = jacobi(np.frombuffer(group["r"].iloc[0]).reshape(-1, d))
        k = min(most, d)
        lead = np.abs(q[:, :k]).argmax(axis=0)
        q = q[:, :k] * np.where(q[lead, np.arange(k)] < 0, -1.0, 1.0)
        return pd.DataFrame({"dim": [d], "deviations": [sizes[:k]], "variance": [float((sizes**2).sum())], "none": [float(64 * d * np.finfo(float).eps * sizes[0])], "axes": [np.ascontiguousarray(q.T).tobytes()]})

    return model


class Model:
    """Means, components and standard deviations of the vectors of one length."""

    def __init__(self, n: int, sums: list[int], row):
        self.n, self.sums, d = n, sums, len(sums)
        self.deviations = np.array(row.deviations)
        self.axes = np.frombuffer(row.axes).reshape(-1, d)
        self.real = self.deviations > row.none  # the rest is nothing but rounding
        self.explained = self.deviations**2 / row.variance if row.variance else None
        self.error: float | None = None

    def whiten(self, times_n: np.ndarray) -> np.ndarray:
        """Coordinates in units of standard deviation; NaN along components without variance."""
        along = (times_n.astype(np.float64) / self.n) @ self.axes.T
        return np.divide(along, self.deviations, out=np.full_like(along, np.nan), where=self.real)


def _products(models):
    """Partial sums of the whitened coordinates (j = -1) and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for d, _, x in _by_length(b):
                m = models.value[d]
                w = m.whiten(_times_n(x, m.n, m.sums))
                one, two = held.get(d, (0.0, 0.0))
                held[d] = one + w.sum(axis=0), two + w.T @ w
        for d, (one, two) in held.items():
            k = len(one)
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * (k + len(i)), pa.int32()), pa.array([*range(k), *i], pa.int32()), pa.array([-1] * k + list(j), pa.int32()), pa.array(np.concatenate([one, two[i, j]]))],
                names=["dim", "i", "j", "s"],
            )

    return run


def _whitened(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, some, x in _by_length(b):
                m = models.value[d]
                times_n = _times_n(x, m.n, m.sums)
                k, rows = len(m.deviations), len(some)
                w = m.whiten(times_n).ravel()
                if times_n.dtype != object and d * int(np.abs(times_n).max()) ** 2 < LONG:
                    far = pa.array((times_n * times_n).sum(axis=1))
                else:
                    far = pa.array([v if v <= LONG else None for v in map(int, (times_n.astype(object) ** 2).sum(axis=1))], pa.int64())
                each = pa.array(np.repeat(np.arange(rows), k))
                share = pa.nulls(rows * k, pa.float64()) if m.explained is None else pa.array(np.tile(m.explained, rows))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(some)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n)), far.take(each), pa.array(w, mask=np.isnan(w)), share, pa.array([m.error] * (rows * k), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def _rounds(lengths: list[int]) -> list[list[int]]:
    """The lengths in groups whose triangles take at most LENGTHS_MB together; a longer one is alone."""
    out, room = [[]], LENGTHS_MB << 20
    for d in sorted(lengths):
        if out[-1] and 8 * (d * d + sum(e * e for e in out[-1])) > room:
            out.append([])
        out[-1].append(d)
    return out


def fit(distinct: DataFrame, most: int = 16) -> Iterator[dict[int, Model]]:
    """A model of each vector length among distinct vectors (x, dim), in rounds of lengths (one round, unless lengths vary widely)."""
    spark = distinct.sparkSession
    counts = {r.dim: r.n for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    for some in _rounds(list(counts)) if counts else []:
        rows = distinct.where(F.col("dim").isin(some)).select("x")
        parts = rows.mapInArrow(_sums, "dim int, place int, n long, s decimal(38,0)")
        sums: dict[int, list[int]] = {d: [0] * d for d in some}
        for r in parts.groupBy("dim", "place").agg(F.sum("s").alias("s")).collect():
            sums[r.dim][r.place] = int(r.s)
        lengths = spark.sparkContext.broadcast({d: (counts[d], sums[d]) for d in some})
        schema = "dim int, block int, r binary"
        level = materialize(rows.mapInArrow(_triangles(lengths), schema), "triangles")
        blocks = level.agg(F.max("block")).first()[0] + 1
        while blocks > 1:
            level = level.withColumn("block", F.floor(F.col("block") / FAN).cast("int")).groupBy("dim", "block").applyInPandas(_stack, schema)
            blocks = -(-blocks // FAN)
        shape = "dim int, deviations array<double>, variance double, none double, axes binary"
        models = {r.dim: Model(counts[r.dim], sums[r.dim], r) for r in level.groupBy("dim").applyInPandas(_components(most), shape).collect()}
        sent = spark.sparkContext.broadcast(models)
        products = rows.mapInArrow(_products(sent), "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect()
        value = {(r.dim, r.i, r.j): r.s for r in products}
        for d, m in models.items():
            mean = [value[d, i, -1] / m.n for i in range(len(m.real))]
            errors = [abs(value[d, i, j] / m.n - mean[i] * mean[j] - (i == j)) for i in np.flatnonzero(m.real) for j in np.flatnonzero(m.real) if i <= j]
            m.error = max(errors, default=None)
        yield models


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component up to `most`.

    Null and empty vectors and those with a null or non-finite component are left out. Repeated rows and null ids each get
    their rows; repeated vectors count once in the fit. Vectors of another length have a fit of their own. Along a component
    whose variance is nothing but rounding (fewer different vectors than components, constant ones) whitened is null, and
    identity_error leaves it out (null if there is none left); explained is null where there is no variance at all.
    deviation is null where the exact number does not fit a long. No vectors give no rows.
    """
    rows = lattice(df, key, vector)
    distinct = materialize(rows.select("x", "dim").distinct(), "lattice")
    out = df.sparkSession.createDataFrame([], OUT)
    for models in fit(distinct, most):
        sent = df.sparkSession.sparkContext.broadcast(models)
        out = out.unionByName(rows.where(F.col("dim").isin(list(models))).select("vec_id", "x").mapInArrow(_whitened(sent), OUT))
    return out
