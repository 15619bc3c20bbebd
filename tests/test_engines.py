"""The lazy chain of engines on planted recordings: what each stage sees, what it decides, and odd inputs."""

from dataclasses import replace

import numpy as np
import pytest

from tidemark.config import DEFAULT
from tidemark.operators import engines, flow

#: Frames of these recordings have nothing in common with their neighbours, so every frame is scanned.
CFG = replace(DEFAULT, content=40.0, threshold=4, coarse_step=1, refs_skip_start=20.0, refs_skip_end=10.0, dense_samples=10)
PAIRS = "pair_id long, primary_id string, target_id string"
FRAMES = "media_id string, frame_idx long, h0 long, h1 long, lap_var double"


def clip(words, name, first=0, detail=60.0):
    return [(name, i, int(h0), int(h1), detail) for i, (h0, h1) in enumerate(words[first:])]


@pytest.fixture(scope="module")
def words():
    return np.random.default_rng(11).integers(-(2**31), 2**31, (140, 2))


class Seen:
    """An engine that keeps the pairs it was given."""

    def __init__(self, solves, **values):
        self.solves, self.values, self.given = solves, values, []

    def __call__(self, pairs):
        from pyspark.sql import functions as F

        ids = sorted(r.pair_id for r in pairs.collect())
        self.given.append(ids)
        return pairs.where(F.col("pair_id").isin([i for i in ids if i in self.solves] or [-1])).select("pair_id", *(F.lit(v).alias(k) for k, v in self.values.items()))


def pairs_of(spark, n):
    return spark.createDataFrame([(i, "p", f"t{i}") for i in range(n)], PAIRS)


def test_a_stage_sees_what_is_open(spark):
    a, b, c, d = Seen({0, 2}, offset=1.0), Seen({1}, offset=2.0), Seen({3}, offset=3.0), Seen({4}, offset=4.0)
    got = engines.narrowed(pairs_of(spark, 4), [("a", a), ("b", b), ("c", c), ("d", d)])
    assert (a.given, b.given, c.given, d.given) == ([[0, 1, 2, 3]], [[1, 3]], [[3]], [])
    assert got.given == {"a": 4, "b": 2, "c": 1} and got.open.count() == 0
    assert sorted((r.pair_id, r.offset, r.stage) for r in got.rows.collect()) == [(0, 1.0, "a"), (1, 2.0, "b"), (2, 1.0, "a"), (3, 3.0, "c")]
    none = engines.narrowed(pairs_of(spark, 2).where("false"), [("a", a)])
    assert none.rows is None and none.given == {} and len(a.given) == 1


def test_search_runs_audio_and_cuts_where_they_are_needed(spark):
    visual = Seen({0, 1, 2}, hd=1, offset=5.0, confidence="high", stage="single")
    audio, cuts = Seen({0, 1, 3, 4}, offset=5.05, peak=0.6, confidence="high"), Seen({0, 2, 3, 5}, offset=9.0, peak=0.4, confidence="medium")
    got = engines.search(pairs_of(spark, 7), visual, audio, cuts, "fallback", "fallback")
    assert audio.given == [[0, 1, 2], [4, 6]]
    assert cuts.given == [[0, 1, 2], [3, 4, 5, 6]]
    assert got.given == {"visual": 7, "audio, verifying": 3, "cuts, verifying": 3, "cut": 4, "audio": 2}
    rows = {r.pair_id: r for r in got.decisions.collect()}
    assert {i: (r.source, r.hd, r.offset) for i, r in rows.items()} == {0: ("visual", 1, 5.0), 1: ("visual", 1, 5.0), 2: ("visual", 1, 5.0), 3: ("cut", -2, 9.0), 4: ("audio", -1, 5.05), 5: ("cut", -2, 9.0), 6: ("none", None, None)}
    assert [(rows[i].audio, rows[i].cut) for i in range(3)] == [("confirmed", "disagree"), ("confirmed", None), (None, "disagree")]
    assert rows[6].error == "No match found" and rows[3].error is None


def test_weak_fallbacks_and_modes(spark):
    visual = lambda: Seen({0}, hd=1, offset=5.0, confidence="low", stage="single")
    audio, cuts = Seen({0, 1, 2}, offset=8.0, peak=0.34, confidence="low"), Seen({0, 1}, offset=8.1, peak=0.29, confidence="low")
    got = {r.pair_id: r for r in engines.search(pairs_of(spark, 3), visual(), audio, cuts, "fallback", "fallback").decisions.collect()}
    assert [got[i].source for i in range(3)] == ["consensus", "none", "none"]
    assert got[0].hd == -3 and got[0].confidence == "high" and abs(got[0].offset - (0.34 * 8.0 + 0.29 * 8.1) / 0.63) < 1e-12
    audio, cuts = Seen({0, 1}, offset=8.0, peak=0.9, confidence="high"), Seen({0, 1}, offset=8.1, peak=0.9, confidence="high")
    got = {r.pair_id: r for r in engines.search(pairs_of(spark, 2), visual(), audio, cuts, "verify", "off").decisions.collect()}
    assert (got[0].source, got[0].audio, got[0].cut, got[1].source) == ("visual", "disagree", None, "none") and cuts.given == [] and audio.given == [[0]]
    with pytest.raises(ValueError):
        engines.search(pairs_of(spark, 1), visual(), None, None, "verify")
    with pytest.raises(ValueError):
        engines.VisualEngine(None, 1.0, references="sometimes")


def test_visual_engine_retries(spark, words):
    rng = np.random.default_rng(5)
    noise = rng.integers(-(2**31), 2**31, (140, 2))
    spoilt = np.vstack([noise[:100], words[106:]])  # where probes and the first reference look, nothing is in the primary
    rows = clip(words, "p") + clip(words, "t0", 6) + clip(spoilt, "t1") + clip(noise, "t2") + clip(words, "t4", 6, detail=10.0)
    frames = spark.createDataFrame(rows, FRAMES)
    pairs = spark.createDataFrame([(0, "p", "t0"), (1, "p", "t1"), (2, "p", "t2"), (4, "p", "t4"), (5, "p", "gone")], PAIRS)
    engine = engines.VisualEngine(frames, 1.0, 4, CFG)
    found = engine.search(pairs)
    got = {r.pair_id: r for r in found.rows.collect()}
    assert found.given == {"single": 5, "multi": 3}
    assert abs(got[0].offset - 6) < 0.5 and got[0].stage == "single" and got[0].hd == 0
    assert abs(got[1].offset - 6) < 0.5 and got[1].stage == "multi"
    assert 2 not in got and 5 not in got
    assert abs(got[4].offset - 6) < 0.5 and {r.pair_id for r in found.open.collect()} == {2, 5}
    assert engines.VisualEngine(frames, 1.0, 4, CFG, references="off")(pairs.where("pair_id = 1")).count() == 0
    always = engines.VisualEngine(frames, 1.0, 4, CFG, references="always").search(pairs.where("pair_id < 2"))
    assert always.given == {"multi": 2}
    assert engine(pairs.where("false")).count() == 0
    assert engine(pairs.where("false")).columns == engine(pairs.where("pair_id = 0")).columns


def test_a_match_well_before_a_trusted_anchor_is_searched_again(spark, words):
    """The same frame stands in the primary's own intro; around the anchor the earliest of two equal frames counts."""
    twice = words.copy()
    twice[5] = twice[66] = twice[60] = words[30]
    frames = spark.createDataFrame(clip(twice, "p") + clip(words, "t"), FRAMES)
    engine = engines.VisualEngine(frames, 1.0, 4, CFG)
    refs = spark.createDataFrame([(i, "p", 0, 30, 30.0, *map(int, words[30])) for i in range(4)], "pair_id long, primary_id string, ref_no int, ref_frame long, ref_t double, r0 long, r1 long")
    best = spark.createDataFrame([(i, 0, 30, 30.0, 0, 5, 0.0) for i in range(4)], "pair_id long, ref_no int, ref_frame long, ref_t double, hd long, frame_idx long, shift double")
    anchors = spark.createDataFrame([(0, 61.0, 31.5, 4.0, 64), (1, 61.0, 31.5, 4.5, 64), (2, 13.0, 31.5, 0.0, 64)], "pair_id long, primary_t double, target_t double, hd double, primary_frame long")
    got = {r.pair_id: (r.frame_idx, r.ref_t, r.hd) for r in engine._locked(refs, best, anchors).collect()}
    assert got == {0: (60, 30.0, 0), 1: (5, 30.0, 0), 2: (5, 30.0, 0), 3: (5, 30.0, 0)}
    strict = replace(engine, median_time=True)._locked(refs, best, anchors)
    assert {r.pair_id: r.ref_t for r in strict.collect()} == {0: 31.5, 1: 30.0, 2: 30.0, 3: 30.0}


def test_reference_stages(spark, words):
    """The anchor's frame, else the first detailed frame, else what the tiers give; each looks at what is left."""
    rows = clip(words, "p") + clip(words, "a", 6) + clip(words, "b", 0, detail=30.0) + clip(words, "c", 0, detail=1.0)
    frames = spark.createDataFrame(rows, FRAMES)
    pairs = spark.createDataFrame([(0, "p", "a"), (1, "p", "b"), (2, "p", "c")], PAIRS)
    engine = engines.VisualEngine(frames, 1.0, 4, CFG)
    anchors = engine.anchors(pairs)
    assert [r.pair_id for r in anchors.collect()] == [0]
    got = engine.reference(pairs, anchors)
    assert got.given == {"anchor": 3, "first content": 2, "tiers": 1}
    assert {r.pair_id: (r.stage, r.ref_frame) for r in got.rows.where("pair_id > 0").collect()} == {1: ("first content", 0), 2: ("tiers", 2)}
    plain = engine.reference(pairs, None)
    assert plain.given == {"tiers": 3} and {r.pair_id: r.ref_frame for r in plain.rows.collect()} == {0: 30, 1: 30, 2: 30}


def test_by_content_searches_each_pair_of_recordings_once(spark):
    inner = Seen({0, 1, 2, 3}, offset=1.5)
    contents = spark.createDataFrame([(10, "p"), (11, "p"), (20, "t"), (21, "t"), (22, "u")], "file_id long, media_id string")
    files = spark.createDataFrame([(0, 10, 20), (1, 11, 21), (2, 10, 22), (3, 11, 99)], "pair_id long, primary_id long, target_id long")
    got = engines.by_content(inner, contents)(files)
    assert sorted((r.pair_id, r.offset) for r in got.collect()) == [(0, 1.5), (1, 1.5), (2, 1.5)] and len(inner.given[0]) == 2


def test_batch_with_engines_from_frames_to_chunks(spark, words):
    """A hole in the target is found, cut at the dark interval, and filled."""
    holed = np.vstack([words[3:60], words[66:]])
    frames = spark.createDataFrame(clip(words, "p") + clip(holed, "t"), FRAMES)
    pairs = spark.createDataFrame([(1, "p", "t")], PAIRS)
    energy = spark.createDataFrame([(m, i, 0.1) for m in "pt" for i in range(140)], "media_id string, bin long, rms double")
    blacks = spark.createDataFrame([("p", 62.0, 64.0)], "media_id string, b_start double, b_end double")
    cfg = replace(CFG, dense_window=8.0, dense_samples=16)
    found = engines.search(pairs, engines.VisualEngine(frames, 1.0, 4, cfg)).decisions
    plans, chunks = flow.sync_recordings(pairs, found, frames, energy, blacks, 1.0, 1.0, cfg)
    assert plans.first().mode == "segmented"
    got = [(r.kind, round(r.target_start or 0), round(r.duration)) for r in chunks.orderBy("chunk_no").collect()]
    assert got[0] == ("filler", 0, 3) and got[1][0] == "target" and abs(sum(r[2] for r in got) - 140) <= 1


def test_search_reads_frames_and_sound_that_are_written_once(spark, sf, monkeypatch):
    """Every stage of the chain reads them; derived anew, each would number all vectors again."""
    from tidemark.plans import queries

    given = {}
    monkeypatch.setattr(queries.engines, "VisualEngine", lambda frames, *a, **k: given.update(frames=frames))
    monkeypatch.setattr(queries.engines, "AudioEngine", lambda energy, *a, **k: given.update(energy=energy))
    monkeypatch.setattr(queries.engines, "search", lambda *a, **k: None)
    queries._search(spark, sf)
    assert all(df.inputFiles() and all("tidemark-table" in f for f in df.inputFiles()) for df in given.values()) and len(given) == 2
