"""Properties and edge cases of the alignment operators, and the walkers against plain restatements."""

import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.functions.phash import block_means, phash
from tidemark.operators import nearest, pairing, sampling, segments, signals, stats, verify
from tidemark.sources import logs
from tidemark.streaming import live

steps = st.sampled_from([0.0, 0.05, 0.15, 0.2, 0.25, 0.3, 0.31, 0.5, 1.0, 1.2])


def spec_mean(rows):
    """Groups as lists of indexes, told over a list of groups and a pending sample."""
    groups, pending = [[0]] if rows else [], None
    for i in range(1, len(rows)):
        mean = sum(rows[j][0] for j in groups[-1]) / len(groups[-1])
        if round(abs(rows[i][0] - mean), 9) <= 0.3:
            groups[-1].append(i)
            pending = None
        elif pending is not None and round(abs(rows[i][0] - rows[pending][0]), 9) <= 0.2:
            groups.append([pending, i])
            pending = None
        else:
            pending = i
    if pending is not None and rows[pending][1] <= 4:
        groups.append([pending])
    return groups


def spec_median(rows):
    groups, pending = [[0]] if rows else [], None
    for i in range(1, len(rows)):
        have = sorted(rows[j][0] for j in groups[-1])
        if round(abs(rows[i][0] - have[len(have) // 2]), 9) <= 0.15:
            groups[-1].append(i)
            pending = None
        elif pending is not None and round(abs(rows[i][0] - rows[pending][0]), 9) <= 0.15:
            groups.append([pending, i])
            pending = None
        else:
            pending = i
    return groups


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(steps, st.integers(0, 8)), max_size=30))
def test_walkers(rows):
    for walk, spec in ((segments.walk_by_mean, spec_mean), (segments.walk_by_median, spec_median)):
        got, want = walk(rows), [-1] * len(rows)
        for g, members in enumerate(spec(rows)):
            for i in members:
                want[i] = g
        assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=15), st.lists(st.integers(0, 60), max_size=15))
def test_greedy_matches(p, s):
    p, s = [(t / 4, i) for i, t in enumerate(sorted(p))], [(t / 4, i) for i, t in enumerate(sorted(s))]
    used, want = set(), []
    for t, i in p:
        free = [(abs(u - t), u, j) for u, j in s if j not in used and abs(u - t) <= 1.0]
        if free:
            gap, _, j = min(free)
            used.add(j)
            want.append((i, j, gap))
    assert verify.greedy_matches(p, s, 1.0) == want


def test_greedy_pairs_takes_first_of_equal_scores():
    scores = [(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.9), (2, 2, 0.39), (3, 3, 0.0)]
    assert pairing.greedy_pairs(scores, 0.4) == [(1, 1, 0.5)]
    assert pairing.greedy_pairs([(1, 1, 0.0)], 0.0) == []


def test_segments_with_blacks_places_boundary(spark):
    rows = [(0, i, 10.0 * i, 0.0 if i < 10 else 1.0, 2) for i in range(20)] + [(1, i, 10.0 * i, 0.5, 2) for i in range(5)] + [(2, 0, 5.0, 0.1, 3)]
    samples = spark.createDataFrame(rows, "pair_id long, id long, target_t double, offset double, hd int")
    blacks = spark.createDataFrame([(0, 93.0, 95.0), (0, 97.0, 97.4)], "pair_id long, b_start double, b_end double")
    lengths = spark.createDataFrame([(0, 200.0), (1, 60.0), (2, 10.0)], "pair_id long, duration double")
    got = {(r.pair_id, r.seg_no): r for r in segments.segments_with_blacks(samples, blacks, lengths).collect()}
    assert (got[0, 0].target_start, got[0, 0].target_end, got[0, 0].phash_inliers) == (0.0, 94.0, 10)
    assert (got[0, 1].target_start, got[0, 1].target_end, got[0, 1].offset) == (93.0, 200.0, 1.0)
    assert (got[1, 0].target_end, got[1, 0].offset, got[1, 0].phash_inliers) == (60.0, 0.5, 0)
    assert (got[2, 0].target_end, got[2, 0].offset) == (10.0, 0.1)
    assert len(got) == 4


def test_first_single_merges_unless_a_black_blocks(spark):
    rows = [(p, 0, 0.0, 0.0, 1) for p in (0, 1)] + [(p, i, 10.0 * i, 0.2, 1) for p in (0, 1) for i in range(1, 4)]
    grouped = segments.grouped_samples(spark.createDataFrame(rows, "pair_id long, id long, target_t double, offset double, hd int"), segments.walk_by_median)
    blacks = spark.createDataFrame([(1, 4.0, 5.0)], "pair_id long, b_start double, b_end double")
    got = segments.merge_first_single(grouped, blacks).groupBy("pair_id").agg(F.countDistinct("grp").alias("n")).collect()
    assert {r.pair_id: r.n for r in got} == {0: 1, 1: 2}


def test_chunks_cover_at_most_the_primary(spark):
    rng = random.Random(1)
    rows, lengths = [], []
    for p in range(40):
        t = 0.0
        for k in range(rng.randint(1, 5)):
            end = t + rng.choice([0.5, 3.0, 20.0])
            rows.append((p, k, t, end, rng.choice([-8.0, -0.02, 0.0, 0.029, 0.03, 4.0])))
            t = end
        lengths.append((p, rng.choice([1.0, 10.0, 60.0])))
    seg = spark.createDataFrame(rows, "pair_id long, seg_no int, target_start double, target_end double, offset double")
    dur = spark.createDataFrame(lengths, "pair_id long, primary_duration double")
    for r in segments.playback_chunks(seg, dur).groupBy("pair_id").agg(F.sum("duration").alias("s")).join(dur, "pair_id").collect():
        assert r.s <= r.primary_duration + 2e-3


def test_planted_shift_is_found(spark):
    rng = np.random.default_rng(3)
    words = rng.integers(-(2**31), 2**31, (90, 2))
    rows = [("a", i, int(h0), int(h1)) for i, (h0, h1) in enumerate(words)] + [("b", i, int(h0), int(h1)) for i, (h0, h1) in enumerate(words[13:70])]
    frames = spark.createDataFrame(rows, "media_id string, frame_idx long, h0 long, h1 long")
    pairs = spark.createDataFrame([(1, "a", "b")], "pair_id long, primary_id string, target_id string")
    refs = spark.createDataFrame([("b", 0, 11), ("b", 1, 30)], "media_id string, ref_no long, frame_idx long")
    known = nearest.reference_rows(pairs, frames, refs, 24.0)
    got = {r.ref_no: r for r in nearest.single_offset(known, frames, 24.0, 12).collect()}
    assert (got[0].hd, got[0].confidence, got[0].frame_idx) == (0, "high", 24) and abs(got[0].offset - 13 / 24) < 1 / 24
    best = nearest.multi_offset(known, frames, 24.0, 12).first()
    assert (best.ref_no, best.frame_idx) == (0, 24)
    band = nearest.band_scan(known, frames, 24.0, 0.25, 16, 13 / 24 + 0.01).collect()
    assert {r.frame_idx for r in band} == {24, 43}


@pytest.mark.parametrize("shift", [-7, 0, 5])
def test_correlation_finds_shift_and_fft_agrees(spark, shift):
    rng = np.random.default_rng(5)
    base = rng.random(120) - 0.5
    rows = [("t", i, float(base[i])) for i in range(100)] + [("p", i, float(base[i - shift])) for i in range(100) if 0 <= i - shift < 120]
    signal = spark.createDataFrame(rows, "media_id string, bin long, v double")
    pairs = spark.createDataFrame([(1, "p", "t")], "pair_id long, primary_id string, target_id string")
    a = {r.lag: r.x for r in signals.correlate(pairs, signal, 12).collect()}
    b = {r.lag: r.x for r in signals.correlate_long(pairs, signal, 12).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    assert signals.best_lag(signals.correlate(pairs, signal, 12), 12, 0.02).first().lag == shift


def test_refined_segment_offset(spark):
    rng = np.random.default_rng(6)
    loud = rng.random(400) > 0.6
    rows = [("p", i, 1.0 if loud[i] else 0.01) for i in range(400)] + [("t", i, 1.0 if loud[i + 3] else 0.01) for i in range(390)]
    energy = spark.createDataFrame(rows, "media_id string, bin long, rms double")
    seg = spark.createDataFrame([(1, 0, "p", "t", 100.0, 300.0, 2.0), (1, 1, "p", "t", 0.0, 5.0, 2.0)], "pair_id long, seg_no int, primary_id string, target_id string, target_start double, target_end double, offset double")
    got = signals.refine_segments(seg, energy, 1.0).collect()
    assert [(r.seg_no, round(r.offset)) for r in got] == [(0, 3)]


def test_despike_mends_lone_spikes_only(spark):
    rows = [(1, i, float(i), x, 1) for i, x in enumerate([0.0, 0.1, 2.0, 0.1, 0.0, 1.0, 1.0, 0.0])]
    samples = spark.createDataFrame(rows, "pair_id long, id long, target_t double, offset double, hd int")
    got = [(r.offset, r.fixes) for r in stats.despike(samples).orderBy("id").collect()]
    assert [round(o, 6) for o, _ in got] == [0.0, 0.1, 0.1, 0.1, 0.0, 1.0, 1.0, 0.0] and [f for _, f in got] == [0, 0, 1, 0, 0, 0, 0, 0]


def test_medians_differ_for_even_counts(spark):
    s = spark.createDataFrame([(1, 0, 0.0, x, 1) for x in (0.0, 1.0, 2.0, 9.0)], "pair_id long, id long, target_t double, offset double, hd int")
    r = stats.medians(s).first()
    assert (r.median, r.upper) == (statistics.median([0.0, 1.0, 2.0, 9.0]), 2.0)


def test_times_of_short_and_empty_recordings(spark):
    media = spark.createDataFrame([("a", 0.0), ("b", 0.5), ("c", 10.0), ("d", 400.0)], "media_id string, duration double")
    even = sampling.even_times(media, 3).groupBy("media_id").count().collect()
    assert {r.media_id: r["count"] for r in even} == {"b": 3, "c": 3, "d": 3}
    assert sampling.probe_times(media).where("media_id = 'c'").first().t == 2.0
    assert {r.media_id for r in sampling.verify_windows(media).collect()} == {"d"}


def test_probe_documents(spark):
    docs = [
        ("a", '{"format":{"duration":"12.5"},"streams":[{"codec_type":"video","r_frame_rate":"24000/1001","nb_frames":"N/A","codec_name":"x"},{"codec_type":"video","r_frame_rate":"1/1"}]}'),
        ("b", '{"format":{},"streams":[{"codec_type":"video","r_frame_rate":"25/1","duration":"4","nb_frames":"99"},{"codec_type":"audio","codec_name":"aac"}]}'),
        ("c", '{"streams":[]}'), ("d", None), ("e", '{"streams":[{"codec_type":"video","r_frame_rate":"0/0"}]}'),
    ]
    got = {r.media_id: r for r in logs.probe_media(spark.createDataFrame(docs, "media_id string, doc string")).collect()}
    assert (got["a"].total_frames, got["a"].has_audio, got["a"].error) == (299, False, None)
    assert (got["b"].total_frames, got["b"].duration, got["b"].audio_codec) == (99, 4.0, "aac")
    assert (got["c"].error, got["d"].error, got["e"].error) == ("no video stream", "no video stream", "bad frame rate")


def test_names_and_text(spark):
    df = spark.createDataFrame([("/a/Show_01_target.x.MP4",), ("/a/B__C-d_PRIMARY.mkv",), ("/a/none",)], "path string")
    got = df.select(scalar.batch_name(F.col("path")).alias("b"), scalar.list_name(F.col("path")).alias("u"), scalar.is_video(F.col("path")).alias("v"), scalar.output_path(F.col("path")).alias("o")).collect()
    assert [(r.b, r.u, r.v) for r in got] == [("show_01.x", "show 01 x", True), ("b__c-d_primary", "b c d primary", True), ("none", "none", False)]
    assert [r.o for r in got] == ["/a/Show_01_target.x_synced.MP4", "/a/B__C-d_PRIMARY_synced.mkv", "/a/none_synced"]


def test_name_ratio_is_asymmetric(spark):
    r = spark.createDataFrame([("tide", "diet")], "a string, b string").select(pairing.name_ratio("a", "b").alias("x"), pairing.name_ratio("b", "a").alias("y")).first()
    assert (r.x, r.y) == (0.25, 0.5)


def test_phash_is_stable_under_brightness():
    rng = np.random.default_rng(8)
    img = (rng.random((90, 160, 3)) * 100).astype(np.uint8)
    a, b = phash(img.tobytes(), 160, 90), phash((img + 40).astype(np.uint8).tobytes(), 160, 90)
    assert len(a) == 4 and sum(int(x ^ y).bit_count() if x ^ y >= 0 else (64 - int(~(x ^ y)).bit_count()) for x, y in zip(a, b, strict=True)) <= 4
    assert np.allclose(block_means(np.full((90, 160), 7.0)), 7.0)


def test_streams(spark, sf, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).parquet(str(src))
    got = live.run_available(live.windowed_rms(stream, "1 day"), "rms", "complete", str(tmp_path / "c1"))
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).agg(F.sum("n")).first()[0]
    assert got.agg(F.sum("n")).first()[0] == want
    frames = spark.createDataFrame([("p", i, i * 7, 0) for i in range(20)], "media_id string, frame_idx long, h0 long, h1 long")
    frames.write.parquet(str(tmp_path / "fr"))
    refs = spark.createDataFrame([(1, "p", 63, 0)], "pair_id long, primary_id string, r0 long, r1 long")
    best = live.run_available(live.running_best(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "fr")), refs), "best", "complete", str(tmp_path / "c2")).first()
    assert (best.pair_id, best.hd, best.frame_idx) == (1, 0, 9)


def test_folder_scan(spark, tmp_path):
    for n in ("b.mkv", "a.MP4", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in pairing.scan_folder(spark, str(tmp_path)).collect()] == ["a.MP4", "b.mkv"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "pair_id long, id long, target_t double, offset double, hd int")
    blacks = spark.createDataFrame([], "pair_id long, b_start double, b_end double")
    lengths = spark.createDataFrame([], "pair_id long, duration double")
    assert segments.segments_with_blacks(none, blacks, lengths).count() == 0
    assert stats.segment_trigger(none).count() == 0
