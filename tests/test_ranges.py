"""Ordered work in ranges and blocks against the plain windows and plain Python, on one long pair, with ties, nulls and extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranges, ranks, segments, signals, stats


def test_places_of_one_long_group(spark):
    rng = random.Random(3)
    rows = [(1, rng.choice([None, 1.0, 2.5, rng.random()]), i, "x") for i in range(3000)] + [(None, 0.5, 9000, "y"), (2, 7.0, 9001, "z")]
    df = spark.createDataFrame(rows, "g long, t double, id long, block string").repartition(5)
    got = {r["id"]: r["_place"] for r in ranges.numbered(df, ["g"], ["t", "id"], 16).collect()}
    want = {}
    for g in (1, 2, None):
        group = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: i for i, r in enumerate(group)}
    assert got == want


def test_one_pair_is_shared_by_many_tasks(spark):
    df = spark.range(1000).select(F.lit(1).alias("pair_id"), F.col("id").cast("double").alias("target_t"), "id")
    parts = ranges.blocks(ranges.numbered(df, ["pair_id"], ["target_t", "id"]), 3, 100)
    sizes = {r["_block"]: (r["n"], r["own"]) for r in parts.groupBy("_block").agg(F.count("*").alias("n"), F.count_if("_own").alias("own")).collect()}
    assert {b: own for b, (_, own) in sizes.items() if own} == dict.fromkeys(range(10), 100)
    assert max(n for n, _ in sizes.values()) == 106


def test_a_halo_beyond_the_next_block_is_refused(spark):
    with pytest.raises(ValueError):
        ranges.blocks(spark.range(1).withColumnRenamed("id", "_place"), 3, 2)


@pytest.mark.parametrize("size", [6, 50, 1000])
def test_despiking_in_blocks_equals_despiking(spark, size):
    rng = random.Random(size)
    rows = [(p, i, float(i // 2), rng.choice([0.0, 0.1, 0.1, 2.0, 3.0, None])) for p in (1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "pair_id long, id long, target_t double, offset double")
    want = stats.despike(df).collect()
    got = stats.despike_in_blocks(df, size=size)
    assert got.columns == stats.despike(df).columns
    assert sorted(got.collect(), key=repr) == sorted(want, key=repr)
    assert any(r["fixes"] for r in want)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_clusters_in_blocks_equal_clusters(spark, size):
    rng = random.Random(size)
    rows = [(p, i, rng.choice([None, 0.0, 0.35, rng.uniform(0, 40)])) for p in (1, 2) for i in range(150)]
    df = spark.createDataFrame(rows, "pair_id long, id long, offset double")
    key = lambda r: (r["pair_id"], r["id"])
    want = {key(r): r["cluster"] for r in stats.probe_clusters(df).collect()}
    assert {key(r): r["cluster"] for r in stats.probe_clusters_in_blocks(df, size=size).collect()} == want and max(want.values()) > 3


@pytest.mark.parametrize("size", [2, 9, 500])
def test_signals_in_blocks(spark, size):
    rng = random.Random(size)
    df = spark.createDataFrame([(m, i, float(rng.random() < 0.5)) for m in "ab" for i in range(120)], "media_id string, bin long, v double")
    rows = lambda x: sorted(map(tuple, x.select("media_id", "bin", "v").collect()))
    assert rows(signals.smoothed_in_blocks(df, size)) == rows(signals.smoothed(df))
    assert rows(signals.kernel_smoothed_in_blocks(df, size)) == rows(signals.kernel_smoothed(df))


@pytest.mark.parametrize("size", [1, 5, 100])
def test_tail_in_blocks(spark, size):
    rng = random.Random(size)
    rows = [(p, i // 2, i % 2, "target", 0.0, d, d) for p in (1, 2, 3) for i in range(40) for d in [round(rng.random(), 3)]]
    df = spark.createDataFrame(rows, "pair_id long, seg_no int, place int, kind string, target_start double, target_end double, duration double")
    durations = spark.createDataFrame([(1, 7.5), (2, 1000.0), (3, 0.0)], "pair_id long, primary_duration double")
    key = lambda x: sorted(tuple(round(c, 6) if isinstance(c, float) else c for c in r) for r in x.collect())
    assert key(segments.trim_tail_in_blocks(df, durations, size)) == key(segments.trim_tail(df, durations))


@pytest.mark.parametrize(
    "values",
    [
        [0.0] * 50 + [1.0] * 50,
        [float(i) for i in range(101)],
        [1e300, -1e300, float("inf"), float("-inf")] + [1.5] * 90 + [1.25] * 7,
        [3.0],
        [None, float("nan"), 2.0, 4.0],
        [random.Random(5).choice([0.1, 0.2, random.Random(i).gauss(0, 1e6)]) for i in range(700)],
    ],
)
@pytest.mark.parametrize("small", [1, 20, 10_000])
def test_percentiles_of_hard_groups(spark, values, small):
    df = spark.createDataFrame([(None, v) for v in values] + [("b", 7.0), ("c", None)], "g string, v double").repartition(3)
    clean = sorted(v for v in values if v is not None and v == v)
    at = lambda f: f * (len(clean) - 1)

    def want(f):
        lo, hi = clean[int(at(f))], clean[-int(-at(f) // 1)]
        return lo if lo == hi else (-(-at(f) // 1) - at(f)) * lo + (at(f) - at(f) // 1) * hi

    got = {r["g"]: r for r in ranks.percentiles(df, ["g"], "v", [0.0, 0.3, 0.5, 0.88, 1.0], small).collect()}
    assert set(got) == {None, "b"} and got[None]["n"] == len(clean) and got["b"]["p"] == [7.0] * 5
    assert got[None]["p"] == pytest.approx([want(f) for f in (0.0, 0.3, 0.5, 0.88, 1.0)], rel=1e-12)
    upper = {r["g"]: r["upper"] for r in ranks.upper_medians(df, ["g"], "v", small).collect()}
    assert upper == {None: clean[len(clean) // 2], "b": 7.0}


def _walkable(spark, rng, n, pairs=(1, 2), jump=0.1):
    rows = []
    for p in pairs:
        level = 0.0
        for i in range(n):
            level = rng.uniform(-20, 20) if rng.random() < jump else level
            far = rng.random() < 0.15
            rows.append((p, i, float(i // 2), round(level + (rng.uniform(-9, 9) if far else rng.uniform(-0.2, 0.2)), 3), rng.randrange(12), "x"))
    return spark.createDataFrame(rows, "pair_id long, id long, target_t double, offset double, hd int, grp string").repartition(3)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 5000])
def test_walk_in_blocks_equals_the_walk(spark, size):
    df = _walkable(spark, random.Random(size), 40 if size == 1 else 160)
    key = lambda x: sorted(map(tuple, x.collect()))
    want = segments.grouped_samples(df)
    got = segments.grouped_samples_in_blocks(df, size=size)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert key(got) == key(want) and want.agg(F.max("grp")).first()[0] > 3


def test_blocks_walked_again_are_few(spark):
    rng = random.Random(2)
    df = _walkable(spark, rng, 3000, (1,), 0.004)
    parts = ranges.blocks(ranges.numbered(df.where("hd <= 10"), ["pair_id"], ["target_t", "id"]), 1, 100)
    parts = parts.where("_own OR floor(_place / 100) < _block")
    _, walked = segments.mean_states(parts)
    assert walked[0] == parts.select("_block").distinct().count() >= 25
    assert len(walked) < walked[0] / 2 and sum(walked) <= 5 * walked[0]


def test_walk_of_pairs_without_id_and_samples_without_offset(spark):
    rows = [(None, 1, 0.0, 1.0, 0), (None, 2, 1.0, 1.1, 0), (None, 3, 2.0, None, 0), (None, 4, 3.0, 9.0, 0), (5, 1, 0.0, 2.0, None), (5, 2, 0.0, 2.0, 99)]
    df = spark.createDataFrame(rows, "pair_id long, id long, target_t double, offset double, hd int")
    got = [(r["pair_id"], r["id"], r["grp"]) for r in segments.grouped_samples_in_blocks(df, size=2).orderBy("id").collect()]
    assert got == [(None, 1, 0), (None, 2, 0), (None, 4, 1)]


def test_nothing_in_nothing_out(spark):
    assert segments.grouped_samples_in_blocks(spark.createDataFrame([], "pair_id long, id long, target_t double, offset double, hd int")).collect() == []
    empty = spark.createDataFrame([], "g string, v double")
    assert ranks.percentiles(empty, ["g"], "v", [0.5]).collect() == []
    assert stats.despike_in_blocks(spark.createDataFrame([], "pair_id long, id long, target_t double, offset double")).collect() == []
