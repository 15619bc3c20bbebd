"""The vector searches against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, v int, dim int, shard int"
WIDE = SCHEMA.replace("float", "double")
LARGEST = (1 << 63) - 1


def last(i):
    return (i is None, i or 0)


def exact_top(rows, k):
    """Integer inner products of all rows with each query row, in Python's integers."""
    whole = lambda x: max(-LARGEST, min(LARGEST, math.floor(1024.0 * x) if math.isfinite(1024.0 * x) else (LARGEST if x > 0 else -LARGEST)))
    ints = [(i, [whole(float(x)) for x in e]) for i, e in rows]
    out = []
    for n, (q, e) in enumerate(ints):
        if q is not None and q % 100 == 0:
            cut = lambda s: max(-LARGEST, min(LARGEST, s))
            best = sorted((-cut(sum(a * b for a, b in zip(e, x, strict=True))), last(i)) for m, (i, x) in enumerate(ints) if m != n and len(x) == len(e))[:k]
            out += [(q, r + 1, None if none else i, -s) for r, (s, (none, i)) in enumerate(best)]
    return sorted(out, key=str)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(420, 8))
    v[50:90] = v[50]
    v[100] = v[50]
    return [(i, [float(np.float32(x)) for x in e]) for i, e in enumerate(v)]


@pytest.fixture(scope="module")
def table(spark, rows):
    bad = [(900, None), (1000, []), (1100, [1.0] * 7 + [None]), (1200, [float("nan")] * 8), (1300, [float("inf")] * 8)]
    return spark.createDataFrame([(i, e, 0, 1, 2, 3) for i, e in rows + bad], SCHEMA)


def test_top_k(table, rows):
    assert answer(topk.top_k(table)) == exact_top(rows, 10)


def test_top_k_of_repeated_ids_null_ids_and_ties(spark):
    """Every row but the query's own is a candidate: unlike rows of one id, equal rows, rows without an id."""
    rows = [(0, [1.0, 1.0]), (7, [5.0, 2.0]), (7, [2.0, 2.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [3.0, -1.0]), (None, [4.0, 4.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0])]
    rows += [(200 + i, [1.0, 1.0]) for i in range(30)] + [(3, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, e, 0, 0, 0, 0) for i, e in rows], SCHEMA)
    assert answer(topk.top_k(df)) == exact_top(rows, 10)
    assert answer(topk.top_k(df, k=2)) == exact_top(rows, 2)


def test_top_k_of_huge_components(spark):
    rows = [(0, [1.0, -2.0]), (100, [1e30, 1.0]), (200, [-1e300, 1e300]), (1, [1e16, 3.0]), (2, [1e16, 4.0]), (3, [1e-300, 0.0]), (4, [1e30, 1e30]), (5, [4e15, -4e15]), (6, [-1e30, 5.0])]
    df = spark.createDataFrame([(i, e, 0, 0, 0, 0) for i, e in rows], WIDE)
    assert answer(topk.top_k(df)) == exact_top(rows, 10)
    assert answer(topk.top_k(df, k=3)) == exact_top(rows, 3)


def test_top_k_with_few_candidates_and_none(spark):
    few = [(0, [1.0, 2.0]), (100, [-1.0, 0.5]), (7, [0.0, 0.0])]
    df = spark.createDataFrame([(i, e, 0, 0, 0, 0) for i, e in few], SCHEMA)
    assert answer(topk.top_k(df)) == exact_top(few, 10)
    assert topk.top_k(df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 100")).count() == 0


@pytest.mark.parametrize("size", [1 << 9, 1 << 40, 1 << 62])
def test_bounds_hold(size):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.integers(-size, size, (30, 4)), np.full((1, 4), -LARGEST), np.full((1, 4), LARGEST)] if size > 1 << 50 else [rng.integers(-size, size, (30, 4))])
    grid = topk.Grid(x.min(axis=0).tolist(), x.max(axis=0).tolist())
    q = rng.integers(-size, size, (5, 4))
    low, high = topk.bounds(*grid.edges(grid.codes(x)), q)
    true = q.astype(object) @ x.astype(object).T
    assert (low <= true).all() and (true <= high).all()


def recall(got, ids, x, queries, k):
    """Checks ranks, order and scores of every query, and gives the share of the true neighbours that were found."""
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == sorted(queries)
    place, share = {i: n for n, i in enumerate(ids)}, []
    for q, found in by.items():
        found.sort()
        s = (x * x[place[q]]).sum(axis=1)
        assert [n for n, _, _ in found] == list(range(1, min(k, len(ids) - 1) + 1)) and all(i != q for _, i, _ in found)
        assert all(math.isclose(sc, s[place[i]], rel_tol=1e-12) for _, i, sc in found)
        assert [(-sc, i) for _, i, sc in found] == sorted((-sc, i) for _, i, sc in found)
        best = [i for i in np.array(ids)[np.lexsort((ids, -s))] if i != q][:k]
        share.append(len({i for _, i, _ in found} & set(best)) / len(best))
    return np.mean(share)


def test_ann_scores_and_ties(table, rows):
    x = np.array([e for _, e in rows])
    assert recall(ann.nearest(table).collect(), list(range(420)), x, [i for i in range(420) if i % 20 == 0], 20) >= 0.9


def looked_at(x, queries, look):
    """Share of different rows that the leaves of a query hold, on average; the forest that nearest fits, on the same rows."""
    most = np.abs(x).max()
    forest = ann.Forest(x, most, np.sqrt(((x / most) ** 2).sum(axis=1)).max(), len(x), 20, ann.TREES, ann.LEAF)
    at = forest.route(x)
    each = []
    for q in queries:
        seen = np.zeros(len(x), dtype=bool)
        for t, n, _ in forest.visits(x[q], ann.LEAF, look):
            seen |= at[t] == n
        each.append(seen.mean())
    return np.mean(each)


def test_ann_recall_far_below_a_full_scan(spark):
    """Clustered vectors, 20,000 rows: a query looks at a small share of them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 32))
    x = (centres[rng.integers(0, 400, 20_000)] + 0.35 * rng.normal(size=(20_000, 32))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, e, 0, 0, 0, 0) for i, e in enumerate(x.tolist())], SCHEMA)
    share = looked_at(x, range(0, 20_000, 400), 1700)
    assert share < 0.1
    assert recall(ann.nearest(df, every=200, look=1700).collect(), list(range(20_000)), x, range(0, 20_000, 200), 20) >= 0.9


def test_ann_recall_on_isotropic_vectors_with_trees_below_the_sample(spark):
    """Vectors without any structure: the hardest case. A small sample makes leaves large, so that trees go on below."""
    x = np.random.default_rng(6).normal(size=(12_000, 16)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, e, 0, 0, 0, 0) for i, e in enumerate(x.tolist())], SCHEMA)
    got = ann.nearest(df, every=200, look=7000).collect()
    assert recall(got, list(range(12_000)), x, range(0, 12_000, 200), 20) >= 0.9
    below = ann.nearest(df, every=400, look=7000, sample=200, leaf=8).collect()
    assert recall(below, list(range(12_000)), x, range(0, 12_000, 400), 20) >= 0.75


def test_ann_recall_at_the_defaults_is_measured_where_vectors_have_no_structure(spark):
    """Isotropic vectors of 64 components: the least number of rows would find 0.8 of the neighbours, so more are looked at."""
    n, every = 50_000, 500
    x = np.random.default_rng(16).normal(size=(n, 64)).astype(np.float32).astype(float)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), 64).cast(pa.list_(pa.float32()))}))
    found = recall(ann.nearest(df, every=every).collect(), list(range(n)), x, range(0, n, every), 20)
    print("recall", found)
    assert found >= 0.9


def test_rows_until_is_where_the_queue_takes_a_leaf_of_each():
    x = np.random.default_rng(9).normal(size=(3000, 8))
    most = np.abs(x).max()
    forest = ann.Forest(x, most, np.sqrt(((x / most) ** 2).sum(axis=1)).max(), len(x), 5, 4, 16)
    got = forest.rows_until(x[0], x[[0, 7, 900]])
    at = forest.route(x[[0, 7, 900]])
    for n, need in enumerate(got):
        seen = {(t, leaf) for t, leaf, _ in forest.visits(x[0], 16, need)}
        before = {(t, leaf) for t, leaf, _ in forest.visits(x[0], 16, need - 15)}
        assert any((t, at[t][n]) in seen for t in range(4)) and not any((t, at[t][n]) in before for t in range(4))


def test_the_queue_gives_leaves_in_order_of_probability():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 8))
    y = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((2000, 1))])
    trees = [ann.Tree(y, 20, rng) for _ in range(4)]
    queue, got = ann.Queue(trees, y[0], 0.5, 0.3), []
    while (one := queue.pop()) is not None:
        got.append(one)
    assert len(got) == sum(len(t.leaves) for t in trees) == len({(t, n) for _, t, n in got})
    assert [p for p, _, _ in got] == sorted((p for p, _, _ in got), reverse=True)
    assert sorted(np.concatenate(trees[0].leaves)) == list(range(2000))


def test_ann_of_repeated_ids_null_ids_and_extremes(spark):
    rows = [(0, [1.0, 1.0]), (7, [5.0, 2.0]), (7, [2.0, 2.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (None, [4.0, 4.0]), (8, [1.0, 1.0]), (9, [0.0, 0.0])] + [(100 + i, [1.0, 1.0]) for i in range(30)]
    df = spark.createDataFrame([(i, e, 0, 0, 0, 0) for i, e in rows], SCHEMA)
    live = [(i, e) for i, e in rows if any(e)]
    want = []
    for n, (q, e) in enumerate(live):
        if q is not None and q % 20 == 0:
            best = sorted((-(e[0] * x[0] + e[1] * x[1]), last(i)) for m, (i, x) in enumerate(live) if m != n)[:20]
            want += [(q, r + 1, None if none else i, -s) for r, (s, (none, i)) in enumerate(best)]
    assert answer(ann.nearest(df)) == sorted(want, key=str)
    tiny = spark.createDataFrame([(0, [1e-200, 1e-310], 0, 0, 0, 0), (1, [3e-200, 0.0], 0, 0, 0, 0), (2, [5e-324, 5e-324], 0, 0, 0, 0), (20, [1e200, -1e200], 0, 0, 0, 0), (3, [1.7e308, 1.7e308], 0, 0, 0, 0)], WIDE)
    got = ann.nearest(tiny).collect()
    assert len(got) == 8 and not any(math.isnan(r.score) for r in got)


def test_ann_leaves_out_zero_vectors_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 0, 0, 0, 0), (20, [0.0, 0.0], 0, 0, 0, 0), (7, [0.5, 0.0], 0, 0, 0, 0)], SCHEMA)
    assert [tuple(r) for r in ann.nearest(few).collect()] == [(0, 1, 7, 0.5)]
    assert ann.nearest(few.where("false")).count() == 0
