"""Quality scores (operator 9).

Method: statistics of a document (lengths, character classes, repetition) go through random Fourier features, which
approximate a Gaussian kernel; ridge regression on the labels is fitted by normal equations that partitions sum; an
isotonic fit maps its values to probabilities. The model learns from a bounded sample of labelled rows (SAMPLE, a
parameter) and is fixed in size, whatever the corpus. One row in CALIBRATION, by a hash of its statistics (so that copies stay
together), is kept from the ridge and calibrates it; if that leaves either without rows, both use all.

Defined cases: a null text counts as empty and scores like one; repeated rows each get a row; an empty table gives an empty
result; without labels every text scores one half.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, in_fold, labelled_sample, labelled_texts, materialize

SAMPLE = 20_000
FEATURES = 384
WIDTH = 0.15
RIDGE = 1e-3
SEED = 9
DIVISOR, HELD_OUT = 4, 2
#: Partitions that sum the normal equations; each sends one matrix of (FEATURES + 1)**2 numbers.
SUMS = 8
CELLS = 2000
CALIBRATION = 5
NAMES = ("chars", "words", "lines", "upper", "digit", "punct", "space", "other", "word_len", "word_len_sd", "distinct_words", "distinct_pairs", "top_word", "distinct_lines", "bang", "bar", "sign", "stop_end", "line_words", "long_word", "caps_words", "zip", "short_words", "symbol_words")

_KIND = np.full(256, 7, dtype=np.uint8)
_KIND[ord("A") : ord("Z") + 1] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def statistics(text: str) -> np.ndarray:
    """Numbers in about -10 to 10 that describe a text, in the order of NAMES; zeros for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(len(NAMES))
    n, m = len(raw), len(words)
    of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=of, minlength=8) / n
    lens = np.fromiter(map(len, words), dtype=np.float64, count=m)
    low = raw.lower().split()
    once = set(low)
    pairs = len(set(zip(low, low[1:], strict=False))) / max(1, m - 1)
    top = np.unique(np.fromiter(map(hash, low), dtype=np.int64, count=m), return_counts=True)[1].max() / m
    lines = [x for x in raw.split(b"\n") if x.strip()]
    caps = sum(w.isupper() and len(w) > 1 for w in words) / m
    symbol = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m
    squeezed = len(zlib.compress(raw, 1)) / n if n >= 200 else 0.5
    return np.array(
        [
            np.log1p(n) / 3, np.log1p(m) / 3, np.log1p(len(lines)), *(kind[[0, 2, 3, 4, 7]] * 5), lens.mean() / 5, lens.std() / 5,
            len(once) / m * 3, pairs * 3, top * 3, len(set(lines)) / len(lines) * 3,
            of[33] / m * 3, of[124] / m * 3, (of[35] + of[36] + of[37] + of[38] + of[42] + of[64] + of[61] + of[95]) / m * 2,
            sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), np.log1p(m / len(lines)), np.log1p(lens.max()), caps * 3, squeezed * 5,
            (lens <= 3).mean() * 3, symbol * 3,
        ]
    )


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t.as_py() or "").tolist() for t in texts], pa.list_(pa.float64()))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # ridge values, rising
    levels: np.ndarray  # probabilities at the knots, not falling

    def score(self, spark, text: Column) -> Column:
        """Probability of label 1 for each text; null counts as empty."""
        bound_batches(spark)
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            m = shared.value
            if not len(texts):
                return pa.array([], pa.float64())
            x = np.stack([statistics(t.as_py() or "") for t in texts])
            return pa.array(np.interp(fourier((x - m.mean) / m.scale) @ m.weights, m.knots, m.levels))

        return score(text)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant. Always the same directions."""
    r = np.random.default_rng(SEED)
    w, b = r.normal(0, WIDTH, (x.shape[1], FEATURES)), r.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.cos(np.clip(x, -8, 8) @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-falling sequence by weighted squares, by pooling adjacent violators."""
    level, weight, size = [], [], []
    for v, w in zip(values, weights, strict=True):
        level.append(v), weight.append(w), size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            w2 = weight[-2] + weight[-1]
            level[-2] = (level[-2] * weight[-2] + level[-1] * weight[-1]) / w2
            weight[-2], size[-2] = w2, size[-2] + size[-1]
            level.pop(), weight.pop(), size.pop()
    return np.repeat(level, size)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> QualityModel:
    """Learn from at most `sample` labelled rows outside the held-out fold; without any, every text scores one half."""
    bound_batches(docs.sparkSession)
    rows = labelled_texts(docs, labelled_sample(labels, "quality", DIVISOR, HELD_OUT, sample), text)
    stats = materialize(rows.select(_statistics("text").alias("x"), "y"), "quality-sample").withColumn("held", F.pmod(F.xxhash64("x"), F.lit(CALIBRATION)) == 0).repartition(SUMS)
    spark, k = stats.sparkSession, len(NAMES)
    moments = stats.agg(F.count("*").alias("n"), *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)))
    got = moments.first()
    if not got["n"]:
        return QualityModel(np.zeros(k), np.ones(k), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    kept = stats.where("held").count()
    to_fit, to_calibrate = (stats.where("NOT held"), stats.where("held")) if 0 < kept < got["n"] else (stats, stats)
    mean, scale = np.array([got[f"m{i}"] for i in range(k)]), np.array([max(got[f"s{i}"], 1e-3) for i in range(k)])

    def features(b: pa.RecordBatch) -> np.ndarray:
        return fourier((b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - mean) / scale)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for b in batches:
            if b.num_rows:
                z = features(b)
                total += z.T @ np.hstack([z, b.column("y").to_numpy().astype(float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    total = sum(np.frombuffer(r["m"]).reshape(FEATURES + 1, -1) for r in to_fit.mapInArrow(equations, "m binary").collect())
    penalty = np.diag(np.append(np.full(FEATURES, RIDGE * got["n"] / FEATURES), 0))
    weights = np.linalg.solve(total[:, :-1] + penalty + 1e-9 * np.eye(FEATURES + 1), total[:, -1])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, CELLS))
        for b in batches:
            if b.num_rows:
                at = np.clip(((features(b) @ weights + 0.5) / 2 * CELLS).astype(int), 0, CELLS - 1)
                y = b.column("y").to_numpy().astype(float)
                n += np.stack([np.bincount(at, minlength=CELLS), np.bincount(at, y, minlength=CELLS)])
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], names=["m"])

    n, ones = sum(np.frombuffer(r["m"]).reshape(2, -1) for r in to_calibrate.mapInArrow(cells, "m binary").collect())
    at = np.flatnonzero(n)
    levels = isotonic(ones[at] / n[at], n[at])
    return QualityModel(mean, scale, weights, (at + 0.5) / CELLS * 2 - 0.5, levels)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, sample)
    scored = docs.select("doc_id", in_fold(F.col("doc_id"), DIVISOR, HELD_OUT).alias("held_out"), model.score(docs.sparkSession, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
