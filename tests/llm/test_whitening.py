"""Whitening against a plain eigendecomposition and exact integers."""

import math

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, dim int, n int"
WIDE = SCHEMA.replace("float", "double")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, e, 0, 1, 2, 3) for i, e in rows], schema)


def brute(rows, most=16):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of rows of one length."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in e] for _, e in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = lambda v: [n * a - s for a, s in zip(v, sums, strict=True)]
    c = np.array([centre(v) for v in fit], float) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for (i, _), v in zip(rows, x, strict=True):
        d = centre(v)
        for k in range(min(most, len(v))):
            out[i, k + 1] = (n, sum(a * a for a in d), float(np.array(d, float) / n @ q[:, k] / np.sqrt(e[k])), e[k] / e.sum())
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    signs = {}
    for r in got:
        n, far, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, far)
        assert math.isclose(r.explained, share, rel_tol=1e-9) and r.identity_error < 1e-9
        if abs(w) > 1e-3:
            signs.setdefault((n, r.component), set()).add(np.sign(w * r.whitened))
        assert math.isclose(abs(r.whitened), abs(w), rel_tol=1e-6, abs_tol=1e-6)
    assert all(len(s) == 1 for s in signs.values())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 20)) @ rng.normal(size=(20, 20)) / 4
    v[300:420] = v[5]
    return [(i, [float(np.float32(c)) for c in e]) for i, e in enumerate(v)]


def test_whiten(spark, rows):
    bad = [(9000, None), (9001, []), (9002, [1.0] * 19 + [None]), (9003, [float("nan")] * 20), (9004, [float("-inf")] * 20)]
    check(whitening.whiten(frame(spark, rows + bad)).collect(), brute(rows))
    check(whitening.whiten(frame(spark, rows), most=3).collect(), brute(rows, 3))


def test_a_tree_of_several_levels(spark, rows, monkeypatch):
    """Many blocks, stacked two at a time, give what one decomposition gives."""
    monkeypatch.setattr(whitening, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")
    try:
        check(whitening.whiten(frame(spark, rows)).collect(), brute(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(whitening.whiten(df).collect(), brute([(r.vec_id, r.embedding) for r in df.collect()]))


def test_lengths_apart_and_in_rounds(spark, rows, monkeypatch):
    mixed = rows[:100] + [(1000 + i, e[:7]) for i, e in rows[:80]] + [(2000 + i, e[:9]) for i, e in rows[:60]]
    want = brute(rows[:100]) | brute(mixed[100:180]) | brute(mixed[180:])
    check(whitening.whiten(frame(spark, mixed)).collect(), want)
    monkeypatch.setattr(whitening, "LENGTHS_MB", 0)
    assert whitening._rounds([20, 7, 9]) == [[7], [9], [20]]
    check(whitening.whiten(frame(spark, mixed)).collect(), want)


def test_no_variance(spark):
    """One different vector: nothing to whiten; few of them: only as many components as they span."""
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(got) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    got = whitening.whiten(frame(spark, line)).collect()
    assert {r.component for r in got if r.whitened is None} == {2, 3} and all(r.identity_error < 1e-12 for r in got)
    assert math.isclose(sum(r.whitened**2 for r in got if r.component == 1) / 9, 1, rel_tol=1e-9)


def test_huge_components(spark):
    """Exact integers beyond longs: the deviation is null where it doesn't fit, the rest stands."""
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [5.0, 3.0]), (4, [1e17, -7.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(frame(spark, rows, WIDE)).collect()}
    assert len(got) == 8 and all(r.deviation is None for r in got.values()) and math.isclose(got[1, 1].explained, 1.0)
    near = [(i, [2.0**40 + i, -(2.0**40) + i * i]) for i in range(6)]
    check(whitening.whiten(frame(spark, near, WIDE)).collect(), brute(near))


def test_repeated_rows_and_empty(spark, rows):
    twice = rows[:50] + rows[:50]
    got = whitening.whiten(frame(spark, twice)).collect()
    assert len(got) == 100 * 16
    check([r for n, r in enumerate(sorted(got, key=lambda r: (r.vec_id, r.component))) if n % 2], brute(rows[:50]))
    assert whitening.whiten(frame(spark, rows).where("false")).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0


@pytest.mark.parametrize("d", [1, 2, 5, 12])
def test_rotations_keep_small_deviations(d):
    """Columns of very unlike lengths: the small singular values are right to many digits."""
    rng = np.random.default_rng(d)
    u, v = np.linalg.qr(rng.normal(size=(30, d)))[0], np.linalg.qr(rng.normal(size=(d, d)))[0]
    true = 10.0 ** -np.arange(d)
    sizes, q = whitening.jacobi(np.linalg.qr(u * true @ v.T, mode="r"))
    assert np.allclose(sizes, true, rtol=1e-3) and np.allclose(sizes[:5], true[:5], rtol=1e-10)
    assert np.abs(q.T @ q - np.eye(d)).max() < 1e-13 and np.allclose(np.abs((q * v).sum(axis=0)), 1, atol=1e-3)
