"""Multi-index hashing against comparing all frames; correlation in blocks against the lag join."""

import numpy as np
import pytest

from tidemark.operators import hash_index, nearest, signals

FRAMES = "media_id string, frame_idx long, h0 long, h1 long"


def flip(word, bits):
    for b in bits:
        word ^= 1 << int(b)
    return word


def recordings(seed, n=400, targets=60):
    """A primary of n frames, a target whose frames are primary frames with up to nine bits flipped, and stretches of black."""
    rng = np.random.default_rng(seed)
    p = [(int(a), int(b)) for a, b in rng.integers(0, 2**32, (n, 2))]
    p[50:90] = [(0, 0)] * 40
    p[120] = p[7]
    t = []
    for i in range(targets):
        h = p[int(rng.integers(n))]
        bits = rng.choice(64, int(rng.integers(0, 10)), replace=False)
        t.append((flip(h[0], [b for b in bits if b < 32]), flip(h[1], [b - 32 for b in bits if b >= 32])))
    t[20:30] = [(0, 0)] * 10
    return [("p", i, *h) for i, h in enumerate(p)] + [("t", i, *h) for i, h in enumerate(t)]


def answer(df):
    return sorted(tuple(r) for r in df.select("pair_id", "ref_frame", "rank", "frame_idx", "hd").collect())


@pytest.mark.parametrize("worth, k", [(1.0, 3), (1e9, 1), (0.0, 2)])
def test_top_matches(spark, monkeypatch, worth, k):
    """By lookups as far as they are worth it, by lookups alone (the far matches need wide flips), and by comparing all."""
    monkeypatch.setattr(hash_index, "WORTH", worth)
    rows = recordings(k, 300 if worth == 1e9 else 400)
    if worth == 1e9:  # without a near match the lookups would have to flip half of a band
        monkeypatch.setattr(hash_index, "flips", lambda a, plain=hash_index.flips: plain(a) if a < 4 else pytest.fail("too far"))
    frames = spark.createDataFrame(rows, FRAMES)
    pairs = spark.createDataFrame([(1, "p", "t"), (2, "p", "t"), (3, "t", "t")], "pair_id long, primary_id string, target_id string")
    got, rounds = hash_index.top_matches_counted(pairs, frames, k)
    assert answer(got) == answer(nearest.top_matches_by_scan(pairs, frames, k))
    print(worth, rounds)
    if worth == 1e9:
        assert [a for a, _, _ in rounds] == list(range(len(rounds))) and sum(c for _, _, c in rounds) < 300 * 60 / 4
    if worth == 0.0:
        assert {a for a, _, _ in rounds} == {-1}


def test_signed_words_nulls_few_frames_and_empty(spark):
    rows = [("p", 0, -1, -(2**31)), ("p", 1, 5, None), ("p", 2, -1, -(2**31)), ("t", 0, -1, -(2**31)), ("t", 1, None, 3), ("t", 2, 0, 0)]
    frames = spark.createDataFrame(rows, FRAMES)
    pairs = spark.createDataFrame([(1, "p", "t")], "pair_id long, primary_id string, target_id string")
    got = answer(hash_index.top_matches(pairs, frames, 3))
    want = [(1, 0, 1, 0, 0), (1, 0, 2, 2, 0)]
    assert got[:2] == want and [r[:4] for r in got[2:]] == [(1, 2, 1, 0), (1, 2, 2, 2)]
    assert hash_index.top_matches(pairs.where("false"), frames, 3).count() == 0


@pytest.mark.parametrize("block, lags", [(16, 5), (16, 30), (64, 7)])
def test_correlation_in_blocks(spark, block, lags):
    """One pair over many blocks: the sums of the blocks are those of the whole."""
    rng = np.random.default_rng(block)
    rows = [(m, i, float(v)) for m, n in (("a", 500), ("b", 430), ("c", 3)) for i, v in enumerate(rng.normal(size=n)) if m != "b" or i % 7]
    signal = spark.createDataFrame(rows, "media_id string, bin long, v double")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "c", "a")], "pair_id long, primary_id string, target_id string")
    got = {(r.pair_id, r.lag): r.x for r in signals.correlate_long(pairs, signal, lags, block).collect()}
    want = {(r.pair_id, r.lag): r.x for r in signals.correlate(pairs, signal, lags).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_lookups_are_no_broadcast_and_compared_pairs_no_rows(spark, monkeypatch):
    """Bands and flips make many rows of a small table: they are shuffled; comparing all gives k rows a query and tile."""
    plans, plain = [], hash_index.written
    monkeypatch.setattr(hash_index, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    rows = recordings(5)
    frames = spark.createDataFrame(rows, FRAMES)
    pairs = spark.createDataFrame([(1, "p", "t"), (2, "t", "p")], "pair_id long, primary_id string, target_id string")
    want = answer(nearest.top_matches_by_scan(pairs, frames, 3))
    monkeypatch.setattr(hash_index, "WORTH", 1.0)
    assert answer(hash_index.top_matches(pairs, frames, 3)) == want
    met = [p for p in plans if "band" in p and "Join" in p]
    assert met and not any("BroadcastHashJoin [primary_id" in line and "band" in line for p in met for line in p.splitlines())
    plans.clear()
    monkeypatch.setattr(hash_index, "WORTH", 0.0)
    for name, size in (("Q_BLOCK", 16), ("H_BLOCK", 64), ("STEP", 5)):
        monkeypatch.setattr(hash_index, name, size, raising=False)
    assert answer(hash_index.top_matches(pairs, frames, 3)) == want
    assert any("FlatMapCoGroupsInPandas" in p for p in plans)
