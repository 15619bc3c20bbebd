"""Queries that have no SQL, against plain restatements on the smallest tables; planted cases for the compositions."""

import difflib
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions.scalar import batch_name, list_name
from tidemark.operators import engines, flow, pairing, verify
from tidemark.plans.queries import CATALOGUE, CLOCK
from tidemark.sources import adapters
from tidemark.sources.logs import pcm_windows


def folders(spark, sf, name, order):
    """Primaries and targets (id, name, path) of each folder, in the order of the walk."""
    rows = adapters.names(spark, sf).withColumn("name", name(F.col("path"))).collect()
    out = {}
    for r in sorted(rows, key=order):
        out.setdefault(r.folder, ([], []))[r.side == "target"].append((r.id, r.name, r.path))
    return out


def name_pairs(spark, sf):
    want = []
    for folder, (primaries, targets) in folders(spark, sf, batch_name, lambda r: (r.name, r.id)).items():
        free = list(targets)
        for p, name, _ in primaries:
            best, at = 0.0, None
            for t in free:
                score = difflib.SequenceMatcher(None, name, t[1]).ratio()
                if score > best:
                    best, at = score, t
            if at and best >= 0.4:
                free.remove(at)
                want.append((folder, p, at[0], round(best, 6)))
    return want


def test_name_ratio_pairing(spark, sf):
    got = [(r.folder, r.p_id, r.t_id, r.score) for r in CATALOGUE["name_ratio_pairing"](spark, sf).collect()]
    assert sorted(got) == sorted(name_pairs(spark, sf)) and got


def test_process_batch(spark, sf):
    engine = engines.VisualEngine(adapters.variant_frames(spark, sf), 1.0, CLOCK.threshold, CLOCK, references="off")
    slots = spark.createDataFrame([(100 * m + t, m, 100 + t) for m in (0, 1) for t in range(16)], "pair_id long, primary_id long, target_id long")
    offsets = {divmod(r.pair_id, 100): r for r in engine(slots).collect()}
    assert 0 < len(offsets) < 32
    paths = {r.id: r.path for r in adapters.names(spark, sf).collect()}
    want = []
    for folder, p, t, score in name_pairs(spark, sf):
        found = offsets.get((p // 2 % 2, t % 16))
        base, dot, ext = paths[t].rpartition(".")
        want.append((folder, p, t, score, *((round(found.offset, 6) + 0.0, found.hd, found.confidence, f"{base}_synced{dot}{ext}", None) if found else (None, None, None, None, "No match found"))))
    got = [tuple(r) for r in CATALOGUE["process_batch"](spark, sf).select("folder", "p_id", "t_id", "score", "offset", "hd", "confidence", "output", "error").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_autosort_review(spark, sf):
    want = []
    for folder, (primaries, targets) in folders(spark, sf, list_name, lambda r: r.id).items():
        free, rows = list(targets), []
        for p, name, path in primaries:
            scored = [(difflib.SequenceMatcher(None, name, t[1]).ratio(), t) for t in free]
            score, t = max(scored, key=lambda x: x[0]) if scored else (None, None)
            if t and not (score < 0.65 and path.endswith(".txt")):
                free.remove(t)
                rows.append((p, t[0], round(score, 6), score < 0.65))
            else:
                rows.append((p, None, None, None))
        rows += [(None, t[0], None, None) for t in free]
        want += [(folder, i + 1, *r) for i, r in enumerate(rows)]
    got = [(r.folder, r.place, r.p_id, r.t_id, r.score, r.needs_review) for r in CATALOGUE["autosort_review"](spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[3] is None for r in want) and any(r[2] is None for r in want)


def test_dense_refined_offset(spark, sf):
    media = {}
    for r in adapters.frames(spark, sf).orderBy("media_id", "frame_idx").collect():
        media.setdefault(r.media_id, []).append((r.h0, r.h1, r.lap_var))
    mask, want = (1 << 64) - 1, {}
    for pair in range(10):
        target, primary = media.get(pair), media.get((pair + 1) % 10)
        found = []
        d = len(target or ()) / 0.4
        lo = max(0.0, min(30.0, d - 1))
        hi = max(lo + 1, d - 60)
        for k in range(1, 9):
            at = round((lo + k * (hi - lo) / 9) * 0.4)
            if not target or not primary or not 0 <= at < len(target) or target[at][2] <= 30:
                continue
            t = at / 0.4
            first, last = max(0, int((t + pair - 10) * 0.4)), int((t + pair + 10) * 0.4)
            hd = {i: sum(((a ^ b) & mask).bit_count() for a, b in zip(primary[i][:2], target[at][:2], strict=True)) for i in range(first, min(last, len(primary) - 1) + 1)}
            if not hd or min(hd.values()) > 28:
                continue
            best = min(hd, key=lambda i: (hd[i], i))
            shift = 0.0
            if best - 1 in hd and best + 1 in hd:
                bend = hd[best + 1] - 2 * hd[best] + hd[best - 1]
                if abs(bend) > 1e-9 and abs(0.5 * (hd[best - 1] - hd[best + 1]) / bend) < 0.95:
                    shift = 0.5 * (hd[best - 1] - hd[best + 1]) / bend
            found.append(round((best + shift) / 0.4 - t, 9))
        middle = statistics.median(found) if found else float(pair)
        near = [x for x in found if round(abs(x - middle), 9) <= 0.1]
        want[pair] = statistics.median(near) if near else middle
    got = {r.pair_id: r.offset for r in CATALOGUE["dense_refined_offset"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_frame_hashes(spark, sf):
    w, h, n = 32, 18, 64
    rows = {r.item_id: r.text for r in adapters.read(spark, sf, "benchmark").select("item_id", "text").collect()}
    got = {r.doc_id: r for r in CATALOGUE["frame_hashes"](spark, sf).collect()}
    assert got.keys() == rows.keys()
    wave = [[math.cos(math.pi * (2 * x + 1) * k / (2 * n)) for x in range(n)] for k in range(16)]
    for item, text in rows.items():
        raw = (text.encode() * 200)[: w * h * 3]
        if len(raw) < w * h * 3:
            assert got[item].detail is None
            continue
        gray = [[0.299 * raw[3 * (y * w + x)] + 0.587 * raw[3 * (y * w + x) + 1] + 0.114 * raw[3 * (y * w + x) + 2] for x in range(w)] for y in range(h)]
        spans = [[(i * s // n, min(s, max(i * s // n + 1, (i + 1) * s // n))) for i in range(n)] for s in (h, w)]
        block = np.array([[np.mean([gray[y][x] for y in range(*a) for x in range(*b)]) for b in spans[1]] for a in spans[0]])
        low = np.round(np.einsum("ui,ij,vj->uv", wave, block, wave).ravel(), 6)
        bits = low > np.median(low)
        words = [int.from_bytes(np.packbits(bits[k : k + 64]).tobytes(), "big", signed=True) for k in range(0, 256, 64)]
        assert [int(x) for x in got[item].hash.split(",")] == words
        at = lambda y, x: gray[-y if y < 0 else 2 * h - 2 - y if y >= h else y][-x if x < 0 else 2 * w - 2 - x if x >= w else x]  # noqa: E731, B023
        lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * gray[y][x] for y in range(h) for x in range(w)]
        assert math.isclose(got[item].detail, statistics.pvariance(lap), rel_tol=1e-9, abs_tol=2e-6)


def test_vertex_is_flat_without_a_bend_or_a_neighbour(spark):
    from tidemark.functions.scalar import vertex_of_maximum

    rows = spark.createDataFrame([(3.0, 2.0, 1.0), (None, 2.0, 1.0), (1.0, 2.0, None), (1.0, 2.0, 1.5)], "a double, b double, c double")
    got = [r[0] for r in rows.select(vertex_of_maximum(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got[:3] == [0.0, 0.0, 0.0] and math.isclose(got[3], 1 / 6)


def test_pair_cuts_across_stretches(spark):
    rng = np.random.default_rng(9)
    sides = [[(k, i, float(t)) for k in range(3) for i, t in enumerate(np.round(rng.random(60) * 80, 2))] for _ in range(2)]
    p, s = (spark.createDataFrame(x, "pair_id long, id long, t double") for x in sides)
    want = set()
    for k in range(3):
        each = [sorted((t, i) for pair, i, t in x if pair == k) for x in sides]
        want |= {(k, *m) for m in verify.greedy_matches(*each, 1.0)}
    matches = verify.pair_cuts(p, s, 1.0)
    assert {(r.pair_id, r.p_id, r.s_id, r.gap) for r in matches.collect()} == want
    assert verify.cut_stretches(p, s, 1.0).agg(F.max("stretch")).first()[0] > 0
    drift = {(r.pair_id, r.p_id): r for r in verify.scene_drift(matches, 24.0).collect()}
    assert any(r.delta_ms < 0 for r in drift.values()) and all(math.isclose(r.delta_ms, (r.s_t - r.p_t) * 1000, abs_tol=1e-2) for r in drift.values())
    counts = {r.pair_id: r for r in verify.scene_counts(p, s, matches).collect()}
    for k in range(3):
        n = sum(m[0] == k for m in want)
        assert (counts[k].cuts_primary, counts[k].unmatched_primary, counts[k].unmatched_synced) == (60, 60 - n, 60 - n)


@pytest.fixture(scope="module")
def aligned(spark):
    """A pair with one offset, a pair whose offset jumps at a dark interval, a pair that nothing was found for."""
    pairs = spark.createDataFrame([(k, "p", "t") for k in (1, 2, 3)], "pair_id long, primary_id string, target_id string")
    found = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "pair_id long, offset double")
    rows = [(1, i, i * 10.0, 2.04, 3) for i in range(40)] + [(2, i, i * 10.0, 2.0 if i < 20 else 5.0, 3) for i in range(40)] + [(3, i, i * 10.0, 1.0, 3) for i in range(40)]
    samples = spark.createDataFrame(rows, "pair_id long, id long, target_t double, offset double, hd int")
    blacks = spark.createDataFrame([(2, 196.0, 197.0)], "pair_id long, b_start double, b_end double")
    durations = spark.createDataFrame([(k, 400.0, 405.0) for k in (1, 2, 3)], "pair_id long, duration double, primary_duration double")
    energy = spark.createDataFrame([("p", 0, 1.0)], "media_id string, bin long, rms double")
    return pairs, found, samples, blacks, energy, durations


def test_timeline_of_planted_offsets(spark, aligned):
    pairs, found, samples, blacks, energy, durations = aligned
    plans, chunks = flow.sync_timeline(*aligned, 1.0)
    got = {r.pair_id: (r.mode, r.offset, r.error) for r in plans.collect()}
    assert got == {1: ("single", 2.04, None), 2: ("segmented", None, None), 3: ("none", None, "No match found")}
    rows = sorted((r.pair_id, r.chunk_no, r.kind, r.target_start, r.target_end, r.duration) for r in chunks.fillna(-1.0).collect())
    # The dark interval's middle, 196.5 in the primary, is 194.5 in the target before the jump and 191.5 after it.
    assert {r[0] for r in rows} == {2} and [r[2] for r in rows] == ["filler", "target", "target"]
    assert math.isclose(rows[0][5], 2.0) and math.isclose(rows[1][4], 194.5) and math.isclose(rows[2][4], 400.0)
    assert math.isclose(sum(r[5] for r in rows), 405.0, abs_tol=0.01)
    plans, chunks = flow.sync_timeline(*aligned, 1.0, constant_only=True)
    assert {r.pair_id: r.mode for r in plans.collect()} == {1: "single", 2: "single", 3: "none"} and chunks.count() == 0


def test_verify_sync_of_planted_drift(spark):
    rng = np.random.default_rng(10)
    words = rng.integers(-(1 << 31), 1 << 31, (400, 2)).tolist()
    loud = (rng.random(420) > 0.6).tolist()
    frames = [("p", i, *map(int, words[i]), 99.0 if i % 5 else 1.0) for i in range(400)] + [("s", i, *map(int, words[i - 2]), 99.0) for i in range(2, 400) if not 100 <= i < 140]
    frames = spark.createDataFrame(frames, "media_id string, frame_idx long, h0 long, h1 long, lap_var double")
    energy = spark.createDataFrame([("p", i, 1.0 if loud[i] else 0.01) for i in range(400)] + [("s", i, 1.0 if loud[i - 1] else 0.01) for i in range(1, 200)], "media_id string, bin long, rms double")
    cuts = [spark.createDataFrame(x, "pair_id long, id long, t double") for x in ([(1, i, 20.0 * i) for i in range(10)], [(1, i, 20.0 * i - 0.5) for i in range(12)])]
    pairs = spark.createDataFrame([(1, "p", "s"), (2, "p", "none")], "pair_id long, primary_id string, target_id string")
    durations = spark.createDataFrame([(1, 400.0), (2, 400.0)], "pair_id long, duration double")
    from dataclasses import replace

    cfg = replace(DEFAULT, verify_samples=100, verify_window=5.0, verify_audio=65.0, verify_lag=2.0, verify_hd=10)
    got = {r.pair_id: r for r in flow.verify_sync(pairs, frames, energy, *cuts, durations, 1.0, 1.0, cfg).collect()}
    one, two = got[1], got[2]
    sampled = [int(5 + (i + 0.5) * 390 / 100) for i in range(100)]
    clear = [i for i in sampled if i % 5]
    hit = [i for i in clear if not 98 <= i < 138]
    assert (one.visual_n, one.visual_unreliable, one.visual_half) == (len(hit), len(clear) - len(hit), 0.0)
    assert abs(one.visual_ms - 2000) < 1000 and one.visual_n > 40
    # Windows of 65 s from 5 s: three are loud on both sides, of which the third ends beyond the synced sound.
    assert one.audio_n + one.audio_skipped == 6 and one.audio_n >= 2 and abs(one.audio_ms - 1000) < 500
    assert (one.scene_n, one.scene_ms, one.cuts_primary, one.cuts_synced, one.unmatched_primary, one.unmatched_synced) == (10, 500.0, 10, 12, 0, 2)
    assert (two.visual_n, two.audio_n, two.scene_n, two.visual_unreliable, two.n_issues) == (0, 0, 0, len(clear), 0)


def test_list_of_folders_and_odd_paths(spark):
    files = spark.createDataFrame([("primary", 1, "/a//b/../x.mkv"), ("primary", 2, "/a/x.mkv"), ("primary", 3, "/d/"), ("target", 4, "/gone.mkv"), ("target", 5, "./../r.mp4")], "side string, id long, path string")
    there = spark.createDataFrame([("/a/x.mkv",), ("/d/2.mp4",), ("/d/1.mp4",), ("/d/n.txt",), ("/d/e/3.mp4",), ("r.mp4",)], "path string")
    got = sorted((r.side, r.id, r.path) for r in pairing.ingest_list(files, there).collect())
    assert got == [("primary", 1, "/a/x.mkv"), ("primary", 3, "/d/1.mp4"), ("primary", 3, "/d/2.mp4"), ("target", 5, "r.mp4")]
    assert ("target", 4, "/gone.mkv") in {(r.side, r.id, r.path) for r in pairing.ingest_list(files).collect()}


def test_sample_windows_without_samples(spark):
    pcm = spark.createDataFrame([("m", i, i) for i in range(10)], "media_id string, sample_idx long, value int")
    w = spark.createDataFrame([("m", 0, 0.25, 1.0), ("m", 1, 5.0, 6.0), ("x", 2, 0.0, 1.0)], "media_id string, window_no long, w_start double, w_end double")
    got = {r.window_no: r for r in pcm_windows(pcm, w, rate=8).collect()}
    assert [x * 32768 for x in got[0].amps] == [2, 3, 4, 5, 6, 7] and got[1].n is None and got[2].amps is None
    with pytest.raises(Exception, match="no samples"):
        pcm_windows(pcm, w, rate=8, strict=True).collect()


def test_report_lines_round_doubles_not_their_decimals(spark):
    drift = spark.createDataFrame([(0, i, float(i), d) for i, d in enumerate((0.575, 1.275, 2.195, -0.575, 1.1275))], "pair_id long, id long, t double, delta_frames double")
    lines = [r.line for r in verify.report_lines(drift, 24.0).orderBy("line_no").collect()]
    assert [x.split(" ")[1] for x in lines[1:]] == ["+0.57", "+1.27", "+2.19", "-0.57", "+1.13"]
    one = verify.report_lines(drift.where("id = 4").withColumn("delta_frames", F.lit(0.5005)), 24.0).where("line_no = 0").first().line
    assert one == "samples 1, max 0.500 frames, mean 0.500 frames, within half a frame 0.0%"
