"""Toxicity scores (operator 5).

Method: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios. The
ratios and the logistic weights are learnt from a bounded sample of labelled rows (SAMPLE, a parameter); every whole
text is then scored by adding up the weights of the n-grams that it holds. An n-gram counts once a text.

Two parameters of the fit leave features without weight: least_ratio (log-count ratios nearer to zero) and least_texts (n-grams
that fewer training texts hold). They shape the model; no text and no row is left out by them.

Defined cases: a null text counts as empty and scores like one; repeated rows each get a row; an empty table gives an empty
result; without labels of both classes every text scores the share of the toxic class (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_fold, labelled_sample, labelled_texts, materialize

BITS = 18
SIZES = (3, 4, 5)
SAMPLE = 20_000
#: Defaults of least_ratio and least_texts.
LEAST_RATIO = 0.4
LEAST_TEXTS = 5
DIVISOR, HELD_OUT = 5, 0


def ngrams(text: str, seen: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a text. seen: 2**BITS zero bytes of scratch, zero again afterwards."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    for n in SIZES:
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        seen[h >> np.uint64(64 - BITS)] = 1
    found = np.flatnonzero(seen)
    seen[found] = 0
    return found


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32, 2**BITS: logistic weight times log-count ratio
    bias: float

    def score(self, spark, text: Column) -> Column:
        """Probability of the toxic class for each text; null counts as empty."""
        bound_batches(spark)
        shared = spark.sparkContext.broadcast((self.weights, self.bias))

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            w, b = shared.value
            seen = np.zeros(1 << BITS, dtype=np.uint8)
            z = np.array([b + float(w[ngrams(t.as_py() or "", seen)].sum(dtype=np.float64)) for t in texts], dtype=np.float64)
            return pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score(text)


def _counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Texts of each class that hold a feature, summed across partitions (2**BITS rows at most), and the class sizes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << BITS, dtype=np.uint8), np.zeros((2, (1 << BITS) + 1), dtype=np.int64)
        for b in batches:
            for t, y in zip(b.column("text"), b.column("y").to_pylist(), strict=True):
                total[int(y > 0)][ngrams(t.as_py(), seen)] += 1
                total[int(y > 0)][-1] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["f", "n0", "n1"])

    rows = texts.mapInArrow(count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    n = np.zeros((2, (1 << BITS) + 1), dtype=np.int64)
    for k in (0, 1):
        n[k][rows.column("f").to_numpy()] = rows.column(f"n{k}").to_numpy()
    return n[0][:-1], n[1][:-1], int(n[0][-1]), int(n[1][-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", least_ratio: float = LEAST_RATIO, least_texts: int = LEAST_TEXTS) -> ToxicityModel:
    """Learn from at most `sample` labelled rows outside the held-out fold.

    Without rows of both classes every text scores the share of the toxic class there (0.5 without any).
    """
    bound_batches(docs.sparkSession)
    texts = materialize(labelled_texts(docs, labelled_sample(labels, "toxic", DIVISOR, HELD_OUT, sample), text), "toxicity-sample")
    n0, n1, rows0, rows1 = _counts(texts)
    if not rows0 or not rows1:
        share = rows1 / (rows0 + rows1) if rows0 + rows1 else 0.5
        return ToxicityModel(np.zeros(1 << BITS, dtype=np.float32), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -40, 40)))
    ratio = np.log((n1 + 1) / (n1.sum() + len(n1))) - np.log((n0 + 1) / (n0.sum() + len(n0)))
    ratio[(np.abs(ratio) < least_ratio) | (n0 + n1 < least_texts)] = 0
    kept = texts.sparkSession.sparkContext.broadcast(ratio != 0)

    @F.arrow_udf("binary")
    def features(ts: pa.Array) -> pa.Array:
        seen, use = np.zeros(1 << BITS, dtype=np.uint8), kept.value
        return pa.array([(f := ngrams(t.as_py(), seen))[use[f]].astype("<u4").tobytes() for t in ts], pa.binary())

    got = texts.select("y", features("text").alias("f")).toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    each = [np.frombuffer(f.as_py(), dtype="<u4") for f in got.column("f")]
    del got
    weights, bias = _fit(each, y, ratio)
    return ToxicityModel((weights * ratio).astype(np.float32), bias)


def _fit(each: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, rounds: int = 150, l2: float = 1e-5, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features by full-batch Adam; starts from the naive Bayes weights, damped."""
    lens = np.array([len(f) for f in each])
    ends, n = np.cumsum(lens), len(each)
    used, at = np.unique(np.concatenate([*each, np.zeros(0, dtype="<u4")]), return_inverse=True)
    each.clear()
    x = ratio[used].astype(np.float32)[at]
    p = np.append(np.full(len(used), 0.05), np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        sums = np.concatenate(([0.0], np.cumsum(x * p[at])))
        z = sums[ends] - sums[ends - lens] + p[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.bincount(at, x * np.repeat(e, lens), minlength=len(used)) / n + l2 * p[:-1], e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    w = np.zeros(len(ratio))
    w[used] = p[:-1]
    return w, float(p[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, sample)
    scored = docs.select("doc_id", "text").select("doc_id", in_fold(F.col("doc_id"), DIVISOR, HELD_OUT).alias("held_out"), model.score(docs.sparkSession, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that score under one half, all columns kept."""
    model, taken = train(docs, labels, sample), "toxicity"
    while taken in docs.columns:
        taken += "_"
    return docs.withColumn(taken, model.score(docs.sparkSession, F.col("text"))).where(F.col(taken) < 0.5).drop(taken)
