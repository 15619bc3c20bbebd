"""Perceptual hash of raw frames: our own deterministic variant with block means and a cosine transform."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, GRID = 16, 64
WORDS = SIZE * SIZE // 64


def _cosines(n: int, m: int) -> np.ndarray:
    k, x = np.arange(m)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def block_means(gray: np.ndarray, n: int = GRID) -> np.ndarray:
    """Means over an n by n grid of (nearly) equal blocks; an image smaller than the grid repeats its pixels."""
    rows, cols = (np.arange(n + 1) * s // n for s in gray.shape)
    total = np.pad(gray.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    r0, c0 = rows[:-1], cols[:-1]
    r1, c1 = np.maximum(rows[1:], r0 + 1), np.maximum(cols[1:], c0 + 1)
    r1, c1 = np.minimum(r1, gray.shape[0]), np.minimum(c1, gray.shape[1])
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    return (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / area


def phash(rgb: bytes, width: int, height: int) -> list[int]:
    """256 bits as four signed words: low frequencies above their median."""
    x = np.frombuffer(rgb, dtype=np.uint8).reshape(height, width, 3).astype(np.float64)
    # Rounded, so that equal frequencies stay equal whatever the order of the sums.
    low = np.round(_cosines(GRID, SIZE) @ block_means(x @ np.array([0.299, 0.587, 0.114])) @ _cosines(GRID, SIZE).T, 6)
    bits = np.packbits((low > np.median(low)).ravel())
    return bits.view(">i8").astype(np.int64).tolist()


def frame_hash(rgb: Column, width: int = 160, height: int = 90) -> Column:
    """The hash words of raw RGB frames; null for null or short data."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(frames: pa.Array) -> pa.Array:
        return pa.array([phash(f.as_py(), width, height) if f.is_valid and len(f.as_py()) == width * height * 3 else None for f in frames], pa.list_(pa.int64()))

    return run(rgb)


def laplacian_variance(rgb: Column, width: int = 160, height: int = 90) -> Column:
    """Population variance of the four-neighbour Laplacian of the gray frame; null for null or short data."""

    @F.arrow_udf(T.DoubleType())
    def run(frames: pa.Array) -> pa.Array:
        out = []
        for f in frames:
            raw = f.as_py()
            if raw is None or len(raw) != width * height * 3:
                out.append(None)
                continue
            g = np.pad(np.frombuffer(raw, dtype=np.uint8).reshape(height, width, 3).astype(np.float64) @ np.array([0.299, 0.587, 0.114]), 1, mode="reflect")
            out.append(float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var()))
        return pa.array(out, pa.float64())

    return run(rgb)
