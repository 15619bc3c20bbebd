"""The catalogue: every operator as a query over the generic tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import phash, scalar
from ..operators import decide, engines, flow, hash_index, nearest, pairing, ranks, sampling, segments, signals, stats, verify
from ..operators.lineage import written
from ..sources import adapters as a
from ..sources import logs
from ..streaming import jobs

FPS = a.FPS
THRESHOLD = 24
CFG = replace(DEFAULT, verify_window=0.25, first_content_span=2.0)
HOUR = 3600.0
LAGS = 24
SPAN = 2_592_000.0

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}


def query(f: Query) -> Query:
    CATALOGUE[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def _refs(s: SparkSession, d: str, keep: Column) -> DataFrame:
    f = a.frames(s, d)
    refs = f.where(keep).select("media_id", F.col("frame_idx").alias("ref_no"), "frame_idx")
    return nearest.reference_rows(a.pair_table(s), f, refs, FPS)


def _media(s: SparkSession, d: str) -> DataFrame:
    """One recording for each user: its length is the span of its events."""
    e = a.events(s, d).groupBy(F.col("user_id").alias("media_id")).agg((F.max("t") - F.min("t")).alias("t"))
    return e.select("media_id", F.round(F.col("t") / 1000, 3).alias("duration")).withColumn("fps", F.lit(FPS)).withColumn("total_frames", (F.col("duration") * FPS).cast("long"))


# --- nearest neighbours


@query
def nn_single_ref(s, d):
    refs = _refs(s, d, F.col("frame_idx") == 10)
    best = nearest.coarse_scan(refs, a.frames(s, d), 1)
    out = best.join(refs.select("pair_id", "ref_t"), "pair_id")
    return rounded(out.select("pair_id", "hd", "frame_idx", (F.col("frame_idx") / FPS - F.col("ref_t")).alias("offset"), scalar.visual_band(F.col("hd"), THRESHOLD).alias("confidence")))


@query
def nn_coarse_fine(s, d):
    return rounded(nearest.single_offset(_refs(s, d, F.col("frame_idx") == 10), a.frames(s, d), FPS, THRESHOLD))


@query
def nn_multi_ref(s, d):
    return rounded(nearest.multi_offset(_refs(s, d, F.col("frame_idx").isin(3, 10, 17, 24, 31)), a.frames(s, d), FPS, THRESHOLD))


@query
def nn_relock(s, d):
    anchor = s.range(10).select(F.col("id").alias("pair_id"), (F.col("id") / 6.0).alias("anchor_t"), (F.col("id") * 4).alias("anchor_hd"))
    cfg = replace(DEFAULT, intro_guard=0.5)
    return rounded(nearest.single_offset(_refs(s, d, F.col("frame_idx") == 10), a.frames(s, d), FPS, THRESHOLD, cfg, anchor))


@query
def nn_band_dense(s, d):
    return rounded(nearest.band_scan(_refs(s, d, F.lit(True)), a.frames(s, d), FPS, 0.25, 28, 0.1))


@query
def verify_visual(s, d):
    return rounded(nearest.verify_visual(_refs(s, d, F.lit(True)), a.frames(s, d), FPS, CFG, 28))


@query
def hamming_pairs_topk(s, d):
    return rounded(hash_index.top_matches(a.pair_table(s), a.frames(s, d), 3))


@query
def frame_lookup(s, d):
    wanted = a.pair_table(s).select(F.col("pair_id").alias("media_id"), F.explode(F.array(F.lit(5).cast("long"), F.lit(100_000).cast("long"))).alias("frame_idx"))
    return nearest.frame_lookup(wanted, a.frames(s, d))


@query
def frame_range(s, d):
    return nearest.frame_range(a.frames(s, d), 7, 40, 6).select("media_id", "frame_idx", "h0", "h1")


# --- frame features and sampling


@query
def content_filter(s, d):
    return sampling.content_share(a.frames(s, d))


@query
def select_first_content(s, d):
    return rounded(sampling.first_content_frame(a.frames(s, d), FPS, CFG))


@query
def select_reference_tiers(s, d):
    return rounded(sampling.reference_frame(a.frames(s, d), 4.0, DEFAULT, 2.0))


@query
def select_n_refs(s, d):
    media = a.frames(s, d).groupBy("media_id").agg(F.count("*").alias("total_frames")).withColumn("fps", F.lit(2.0))
    cfg = replace(DEFAULT, refs_skip_start=2.0, refs_skip_end=3.0, refs_search=1.5)
    return rounded(sampling.reference_frames(media, a.frames(s, d), 4, cfg))


@query
def sample_times_even(s, d):
    return rounded(sampling.even_times(_media(s, d), 9))


@query
def sample_times_mid(s, d):
    return rounded(sampling.middle_times(_media(s, d), 20))


@query
def probe_times(s, d):
    return rounded(sampling.probe_times(_media(s, d).withColumn("duration", F.col("duration") % 120)))


@query
def verify_windows(s, d):
    return rounded(sampling.verify_windows(_media(s, d).withColumn("duration", F.col("duration") % 120)))


@query
def time_conversions(s, d):
    e = a.events(s, d).select("event_id", (F.col("value") - 20).alias("v"))
    fps = F.lit(23.976)
    return rounded(e.select("event_id", scalar.time_to_frame(F.col("v"), fps).alias("toward_zero"), scalar.time_to_frame_even(F.col("v"), fps).alias("half_even"), scalar.frame_to_time(F.col("event_id"), fps).alias("t"), scalar.frame_to_time(F.col("event_id"), F.lit(0.0)).alias("no_rate")))


@query
def timecode_format(s, d):
    return a.events(s, d).select("event_id", scalar.timecode(F.round(F.col("t") / 100 - 50, 3), F.lit(24.0)).alias("tc"))


# --- signals


def _energy(s: SparkSession, d: str) -> DataFrame:
    return signals.on_grid(signals.rms(a.energy(s, d)), a.BINS, "rms")


def _cuts(s: SparkSession, d: str) -> DataFrame:
    return a.events(s, d).select(F.col("event_type").alias("media_id"), "t")


@query
def rms_windows(s, d):
    return rounded(signals.rms(a.energy(s, d)))


@query
def vad_binary(s, d):
    return rounded(signals.activity(_energy(s, d)))


@query
def vad_smoothed(s, d):
    return rounded(signals.centred(signals.smoothed(signals.activity(_energy(s, d)))))


@query
def speech_ratio(s, d):
    return rounded(signals.speech_ratio(signals.activity(_energy(s, d))))


@query
def cut_histogram(s, d):
    return rounded(signals.cut_histogram(_cuts(s, d), a.BINS, HOUR))


@query
def cut_smoothed(s, d):
    return rounded(signals.cut_signal(_cuts(s, d), a.BINS, HOUR))


@query
def xcorr_lags(s, d):
    return rounded(signals.correlate(a.signal_pairs(s), signals.audio_signal(a.energy(s, d), a.BINS), LAGS))


@query
def xcorr_long(s, d):
    return signals.correlate_long(a.signal_pairs(s), signals.audio_signal(a.energy(s, d), a.BINS), LAGS).select("pair_id", F.col("lag").cast("long").alias("lag"), (F.round(F.round("x", 9), 4) + F.lit(0.0)).alias("x"))


@query
def xcorr_peak(s, d):
    return rounded(signals.best_lag(signals.correlate(a.signal_pairs(s), signals.audio_signal(a.energy(s, d), a.BINS), LAGS), LAGS, HOUR).drop("shift"))


@query
def audio_offset(s, d):
    return rounded(signals.offset_by_signal(a.signal_pairs(s), signals.audio_signal(a.energy(s, d), a.BINS), LAGS, HOUR, DEFAULT.audio_bands))


@query
def cut_offset(s, d):
    return rounded(signals.cut_offset(a.signal_pairs(s), _cuts(s, d), a.BINS, HOUR, LAGS))


@query
def segment_audio_refine(s, d):
    seg = a.signal_pairs(s).crossJoin(s.range(3).select(F.col("id").cast("int").alias("seg_no")))
    seg = seg.withColumns({"target_start": F.col("seg_no") * 200 * HOUR, "target_end": (F.col("seg_no") + 1) * 200 * HOUR, "offset": (F.col("pair_id") - 2) * HOUR})
    return rounded(signals.refine_segments(seg, signals.rms(a.energy(s, d)), HOUR, replace(DEFAULT, refine_peak=0.02)))


# --- statistics of samples


@query
def offset_spread(s, d):
    return rounded(stats.spread(a.samples(s, d)))


@query
def offset_medians(s, d):
    return rounded(stats.medians(a.samples(s, d)))


@query
def robust_median_offset(s, d):
    return rounded(stats.robust_offset(a.samples(s, d)))


@query
def trimmed_mean_stdev(s, d):
    return rounded(stats.trimmed(a.samples(s, d)))


@query
def despike_one_pass(s, d):
    return rounded(stats.despike(a.samples(s, d, True), 1).select("pair_id", "id", "offset", "fixes"))


@query
def despike_full(s, d):
    return rounded(stats.despike(a.samples(s, d, True)).groupBy("pair_id").agg(F.sum("offset").alias("total"), F.sum("fixes").alias("fixes")))


@query
def despike_blocks(s, d):
    return rounded(stats.despike_in_blocks(a.samples(s, d, True), size=1024).groupBy("pair_id").agg(F.sum("offset").alias("total"), F.sum("fixes").alias("fixes")))


@query
def offset_clusters_blocks(s, d):
    return rounded(stats.probe_clusters_in_blocks(_probes(s, d), size=1024).select("pair_id", "id", "cluster"))


@query
def vad_smoothed_blocks(s, d):
    return rounded(signals.centred(signals.smoothed_in_blocks(signals.activity_of_long(_energy(s, d), small=64), 128)))


@query
def playback_tail_trim_blocks(s, d):
    return rounded(segments.trim_tail_in_blocks(*_tail_chunks(s, d), size=1024))


@query
def percentiles_of_groups(s, d):
    """Percentiles and upper medians of prices: a third of all lines and more share a group."""
    lines = a.read(s, d, "lineitem")
    p = ranks.percentiles(lines, ["l_returnflag"], "l_extendedprice", [0.12, 0.5, 0.88], small=1024).select("l_returnflag", "n", F.col("p")[0].alias("p12"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p88"))
    return rounded(p.join(ranks.upper_medians(lines, ["l_returnflag"], "l_quantity", small=1024).select("l_returnflag", F.col("upper").alias("upper_quantity")), "l_returnflag"))


@query
def segment_trigger(s, d):
    return rounded(stats.segment_trigger(a.samples(s, d)))


def _probes(s: SparkSession, d: str) -> DataFrame:
    e = a.samples(s, d, True)
    return e.withColumn("primary_t", F.round(F.col("target_t") + F.col("offset"), 6)).select("pair_id", "id", "target_t", "primary_t", "offset", "hd")


@query
def offset_clusters(s, d):
    return rounded(stats.probe_clusters(_probes(s, d)).select("pair_id", "id", "cluster"))


@query
def anchor_choice(s, d):
    return rounded(stats.choose_anchor(stats.probe_clusters(_probes(s, d)), 12))


# --- segments


def _durations(s: SparkSession) -> DataFrame:
    return s.range(10).select(F.col("id").alias("pair_id"), F.lit(SPAN).alias("duration"))


def _segments(s: SparkSession, d: str) -> DataFrame:
    """The segments of ten pairs (100 to 109), and fixed ones with the edge cases of the planner: short gaps, overlaps that swallow a segment, tails."""
    rows = [
        (0, 0, 0.0, 100.0, 2.0), (0, 1, 100.0, 200.0, 2.029), (0, 2, 200.0, 300.0, 2.059), (1, 0, 0.0, 50.0, -5.0), (1, 1, 50.0, 60.0, -30.0), (1, 2, 60.0, 120.0, -29.0),
        (2, 0, 0.0, 3.0, -4.0), (2, 1, 3.0, 90.0, -4.0), (3, 0, 0.0, 80.0, 0.0), (3, 1, 80.0, 400.0, 0.5), (3, 2, 400.0, 450.0, 0.2), (4, 0, 0.0, 10.0, 0.01), (4, 1, 10.0, 20.0, 0.01),
    ]
    fixed = s.createDataFrame(rows, "pair_id long, seg_no int, target_start double, target_end double, offset double")
    found = segments.segments_with_blacks(a.samples(s, d), a.blacks(s, d), _durations(s))
    return fixed.unionByName(found.select(F.col("pair_id") + 100, "seg_no", F.round("target_start", 3), F.round("target_end", 3), F.round("offset", 3)).toDF(*fixed.columns))


def _primary(s: SparkSession, d: str) -> DataFrame:
    """The primary of one of the ten pairs ends with its last sample."""
    fixed = s.createDataFrame([(0, 302.05), (1, 80.0), (2, 1000.0), (3, 320.0), (4, 15.0)], "pair_id long, primary_duration double")
    return fixed.unionByName(a.samples(s, d).groupBy((F.col("pair_id") + 100).alias("pair_id")).agg(F.max("target_t").alias("primary_duration")))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return segments.playback_chunks(_segments(s, d), _primary(s, d))


def _graphs(s: SparkSession, d: str) -> DataFrame:
    media = _primary(s, d).select("pair_id", F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit("24000/1001").alias("fps_rational"))
    return decide.render_graph(_chunks(s, d), media)


@query
def segments_sample_walker(s, d):
    out = segments.segments_from_groups(segments.grouped_samples(a.samples(s, d)), _durations(s))
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("target_start", "target_end")}))


@query
def segments_sample_walker_blocks(s, d):
    out = segments.segments_from_groups(segments.grouped_samples_in_blocks(a.samples(s, d), size=256), _durations(s))
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("target_start", "target_end")}))


@query
def segments_cluster_walker(s, d):
    return rounded(segments.clusters(segments.merge_first_single(segments.grouped_samples(a.samples(s, d), segments.walk_by_median), a.blacks(s, d))))


@query
def segments_with_blacks(s, d):
    return rounded(segments.segments_with_blacks(a.samples(s, d), a.blacks(s, d), _durations(s)))


def _gaps(s: SparkSession) -> DataFrame:
    return s.range(10).select(F.col("id").alias("pair_id"), F.explode(F.sequence(F.lit(1), F.lit(30))).alias("gap_no")).select("pair_id", "gap_no", (F.col("gap_no") * 86000.0).alias("lo"), (F.col("gap_no") * 86000.0 + F.col("pair_id") * 2000.0 + 500.0).alias("hi"))


@query
def black_blocking_semi(s, d):
    return rounded(segments.blocking_gaps(_gaps(s), a.blacks(s, d)).select("pair_id", "gap_no"))


@query
def black_boundary_score(s, d):
    return rounded(segments.boundary_in_gaps(_gaps(s), a.blacks(s, d)))


@query
def playback_chunks(s, d):
    return rounded(_chunks(s, d))


@query
def render_script(s, d):
    return rounded(decide.render_script(_chunks(s, d)))


@query
def playback_tail_trim(s, d):
    return rounded(segments.trim_tail(*_tail_chunks(s, d)))


def _tail_chunks(s, d):
    e = a.events(s, d).where("event_type = 'error'").select((F.col("user_id") % 10).alias("pair_id"), F.col("event_id").cast("int").alias("seg_no"), F.lit(1).alias("place"), F.lit("target").alias("kind"), F.col("t").alias("target_start"), F.col("value").alias("duration"))
    e = e.withColumn("target_end", F.col("target_start") + F.col("duration"))
    return e, s.range(10).select(F.col("id").alias("pair_id"), (F.col("id") * 100.0 + 50).alias("primary_duration"))


# --- decisions


def _candidates(s: SparkSession, d: str) -> DataFrame:
    """Candidates of the engines from events; some are missing, some at the edges of the rules."""
    e = a.events(s, d)
    k = F.col("event_id") % 8
    v = F.when(k != 3, F.round(F.col("value") / 50, 3))
    return e.select(
        F.col("event_id").alias("pair_id"), v.alias("v_off"), F.when(k != 3, F.col("event_id") % 23).cast("int").alias("v_hd"), F.when(k != 5, F.round(F.col("value") / 50 + F.col("user_id") % 9 * 0.1, 3)).alias("a_off"),
        F.round(F.col("user_id") % 11 * 0.07, 2).alias("a_peak"), F.when(k != 6, F.round(F.col("value") / 50 + F.col("user_id") % 7 * 0.12, 3)).alias("c_off"), F.round(F.col("event_id") % 13 * 0.05, 2).alias("c_peak"),
    )


@query
def agreement_bands(s, d):
    return decide.agreement_bands(_candidates(s, d))


@query
def consensus_override(s, d):
    return rounded(decide.consensus(_candidates(s, d)))


@query
def fallback_cascade(s, d):
    return rounded(decide.fallback_cascade(_candidates(s, d)))


@query
def adjudicate_segments(s, d):
    c = _candidates(s, d).withColumn("seg_no", F.lit(0))
    seg = c.select("pair_id", "seg_no", F.coalesce("v_off", F.lit(0.0)).alias("offset"), (F.col("pair_id") % 6).cast("int").alias("phash_inliers"), F.round(F.col("pair_id") % 5 * 0.04, 2).alias("phash_stdev"))
    return rounded(decide.adjudicate(seg, c.select("pair_id", "seg_no", "a_off", "a_peak")))


def _edits(s, d):
    return decide.edit_plan(_candidates(s, d).where("a_off IS NOT NULL").select("pair_id", (F.col("a_off") - 0.5).alias("offset"), F.lit(1440.0).alias("primary_duration")))


def _previews(s, d):
    return decide.preview_plan(_media(s, d).select(F.col("media_id").alias("pair_id"), (F.col("duration") % 50).alias("primary_duration")))


@query
def edit_plan(s, d):
    return rounded(_edits(s, d))


@query
def edit_command(s, d):
    """Arguments by a line each; times to the millisecond, as their sixth digit may fall either side of a half."""
    plan = _edits(s, d).withColumns({c: F.round(c, 3) for c in ("seek", "pad", "delay_ms")})
    return decide.edit_command(plan, a.names(s, d).select(F.col("id").alias("pair_id"), "path")).select("pair_id", F.array_join("arguments", "\n").alias("lines"), "output")


@query
def preview_plan(s, d):
    return rounded(_previews(s, d))


@query
def preview_command(s, d):
    plan = _previews(s, d).withColumn("seek", F.round("seek", 3))
    files = a.names(s, d).select(F.col("id").alias("pair_id"), F.col("path").alias("primary_path"), F.concat(F.lit("/out"), "path").alias("synced_path"))
    return decide.preview_command(plan, files).select("pair_id", F.array_join("arguments", "\n").alias("lines"), "output")


@query
def render_graph(s, d):
    return rounded(_graphs(s, d))


@query
def render_command(s, d):
    """Arguments by a line each; the targets are the files numbered by their pair."""
    files = a.names(s, d).select(F.col("id").alias("pair_id"), "path")
    return decide.render_command(_graphs(s, d), files).select("pair_id", F.array_join("arguments", "\n").alias("lines"), "output")


@query
def batch_counts(s, d):
    f = decide.fallback_cascade(_candidates(s, d))
    return decide.batch_counts(f.withColumn("error", F.when(F.col("source") == "none", "No match found")))


@query
def intro_anchor(s, d):
    return rounded(flow.intro_anchor(a.pair_table(s), a.frames(s, d), 4.0, THRESHOLD, replace(DEFAULT, probes=(1.0, 2.0, 4.0, 6.0), content=40.0)))


@query
def dense_refined_offset(s, d):
    media = a.frames(s, d).groupBy("media_id").agg((F.count("*") / 0.4).alias("duration"))
    return rounded(flow.refine_visually(a.pair_table(s), a.frames(s, d), media, s.range(10).select(F.col("id").alias("pair_id"), (F.col("id") * 1.0).alias("offset")), 0.4, replace(DEFAULT, content=30.0), n=8, window=10.0, limit=28))


@query
def sync_pairs(s, d):
    visual = nearest.multi_offset(_refs(s, d, F.col("frame_idx").isin(3, 10, 17, 24, 31)), a.frames(s, d), FPS, 10)
    signal = audio_offset(s, d).select("pair_id", (F.col("offset") / HOUR).alias("offset"), "peak")
    cuts = cut_offset(s, d).select("pair_id", (F.col("offset") / HOUR).alias("offset"), (F.col("peak") * 4).alias("peak"))
    return rounded(flow.sync_pairs(a.pair_table(s), visual, signal, cuts))


#: Two recordings and their variants on one clock: a frame, a bin and a unit of time an hour.
CLOCK = replace(DEFAULT, content=40.0, threshold=6, refs_skip_start=40.0, refs_skip_end=20.0, multi_refs=4, dense_samples=24, dense_window=6.0, refine_min_bins=20)


def _search(s: SparkSession, d: str) -> engines.Search:
    # what several stages read is written once: its windows run over whole recordings
    visual = engines.VisualEngine(written(a.variant_frames(s, d)), 1.0, CLOCK.threshold, CLOCK)
    audio = engines.AudioEngine(written(signals.rms(a.variant_energy(s, d))), a.BINS, 1.0, CLOCK)
    cuts = engines.CutEngine(a.variant_cuts(s, d), a.BINS, 1.0, CLOCK)
    return engines.search(a.variant_pairs(s), visual, audio, cuts, "fallback", "fallback", CLOCK)


@query
def sync_search(s, d):
    """What the chain of engines decides on each pair of a recording and a variant."""
    return rounded(_search(s, d).decisions)


@query
def sync_from_frames(s, d):
    """From frames, energy, cuts and dark intervals to what is played."""
    found = _search(s, d).decisions
    plans, chunks = flow.sync_recordings(a.variant_pairs(s), found, a.variant_frames(s, d), signals.rms(a.variant_energy(s, d)), a.variant_blacks(s, d), 1.0, 1.0, CLOCK)
    return rounded(plans.join(chunks, "pair_id", "left"))


def _contents(s: SparkSession, d: str) -> DataFrame:
    """file_id, media_id: primaries hold one of the two recordings, targets a variant."""
    return a.names(s, d).select(F.col("id").alias("file_id"), F.when(F.col("side") == "primary", F.floor(F.col("id") / 2) % 2).otherwise(100 + F.col("id") % 16).cast("long").alias("media_id"))


@query
def process_batch(s, d):
    """The files of every folder paired by name, and each pair of recordings that they hold searched by its frames."""
    engine = engines.VisualEngine(written(a.variant_frames(s, d)), 1.0, CLOCK.threshold, CLOCK, references="off")
    return rounded(flow.run_batch(a.names(s, d), "folder", engines.by_content(engine, _contents(s, d)))[0])


# --- verification


@query
def cut_nearest_asof(s, d):
    return rounded(verify.nearest_cut(a.cuts(s, d, "click"), a.cuts(s, d, "view"), HOUR))


@query
def cut_mutual_nn(s, d):
    return rounded(verify.mutual_cuts(a.cuts(s, d, "click"), a.cuts(s, d, "view"), HOUR))


def _matches(s: SparkSession, d: str) -> DataFrame:
    return verify.pair_cuts(a.cuts(s, d, "click"), a.cuts(s, d, "view"), HOUR)


@query
def cut_greedy_pairing(s, d):
    return rounded(verify.scene_drift(_matches(s, d), FPS / HOUR))


@query
def scene_counts(s, d):
    return verify.scene_counts(a.cuts(s, d, "click"), a.cuts(s, d, "view"), _matches(s, d))


#: Windows of two days among hourly bins, five hours from either end.
WINDOWS = replace(DEFAULT, verify_edge=5 * HOUR, verify_audio=48 * HOUR, verify_lag=2 * HOUR, verify_peak=0.02)


@query
def audio_drift_windows(s, d):
    pairs = a.signal_pairs(s)
    media = pairs.select(F.col("pair_id").alias("media_id"), F.lit(a.BINS * HOUR).alias("duration"))
    windows = sampling.verify_windows(media, WINDOWS).withColumnRenamed("media_id", "pair_id").join(pairs, "pair_id")
    return rounded(signals.drift_windows(windows, signals.rms(a.energy(s, d)), HOUR, WINDOWS))


@query
def verify_sync(s, d):
    """Frames, energy and cuts on one clock: a frame and a bin an hour."""
    f, pairs = a.frames(s, d), a.pair_table(s)
    n = f.groupBy("media_id").agg(F.count("*").alias("n"))
    length = pairs.join(n.select(F.col("media_id").alias("primary_id"), F.col("n").alias("p")), "primary_id").join(n.select(F.col("media_id").alias("target_id"), F.col("n").alias("t")), "target_id")
    energy = signals.rms(a.events(s, d).select((F.col("user_id") % 10).alias("media_id"), F.floor(F.col("t") / HOUR).cast("long").alias("bin"), F.col("value").alias("amp")))
    cfg = replace(WINDOWS, verify_samples=40, verify_window=6 * HOUR, pair_cuts=HOUR, content=30.0)
    durations = length.select("pair_id", (F.least("p", "t") * HOUR).alias("duration"))
    return rounded(flow.verify_sync(pairs, f, energy, a.cuts(s, d, "click"), a.cuts(s, d, "view"), durations, 1 / HOUR, HOUR, cfg))


@query
def sync_timeline(s, d):
    """From what the search finds to what is played, for ten pairs of kinds of event."""
    kinds = a.signal_pairs(s).select(F.col("pair_id").alias("slot"), "primary_id", "target_id")
    pairs = s.range(10).select(F.col("id").alias("pair_id"), (F.col("id") % 5).alias("slot")).join(kinds, "slot").drop("slot")
    durations = _durations(s).withColumn("primary_duration", F.col("duration") - F.col("pair_id") * HOUR)
    cfg = replace(DEFAULT, refine_peak=0.02, refine_residual=2 * HOUR, audio_quality=0.05, audio_reach=3 * HOUR)
    plans, chunks = flow.sync_timeline(pairs, sync_pairs(s, d), a.samples(s, d), a.blacks(s, d), signals.rms(a.energy(s, d)), durations, HOUR, cfg)
    return rounded(plans.join(chunks, "pair_id", "left"))


@query
def drift_summary(s, d):
    return rounded(verify.drift_summary(a.drift(s, d), FPS))


@query
def drift_issues(s, d):
    e = a.events(s, d).select(F.col("event_id").alias("pair_id"), F.lit(FPS).alias("fps"), F.when(F.col("event_id") % 5 != 0, F.round("value", 2)).alias("visual_ms"), F.round(F.col("value") * 2, 2).alias("audio_ms"), F.when(F.col("event_id") % 3 != 0, F.round(F.col("value") + 7, 2)).alias("scene_ms"))
    return rounded(verify.drift_issues(e))


@query
def report_lines(s, d):
    return rounded(verify.report_lines(a.drift(s, d), FPS))


@query
def verification_report(s, d):
    visual = nearest.verify_visual(_refs(s, d, F.lit(True)), a.frames(s, d), FPS, CFG, 28).select("pair_id", "delta_frames")
    audio = audio_drift_windows(s, d).select("pair_id", (F.col("delta_ms") / 360_000).alias("delta_ms"))
    matches = _matches(s, d)
    counts = verify.scene_counts(a.cuts(s, d, "click"), a.cuts(s, d, "view"), matches)
    return rounded(verify.verification_report(visual, audio, verify.scene_drift(matches, 1 / HOUR), a.pair_table(s), FPS, (counts,)))


# --- names and files


@query
def name_normalize_batch(s, d):
    return a.names(s, d).select("id", scalar.batch_name(F.col("path")).alias("name"))


@query
def name_normalize_ui(s, d):
    return a.names(s, d).select("id", scalar.list_name(F.col("path")).alias("name"))


@query
def name_levenshtein_topk(s, d):
    return rounded(pairing.edit_distance_top(a.names(s, d), "folder", 2))


@query
def name_ratio_pairing(s, d):
    return rounded(pairing.pair_by_name(a.names(s, d), "folder"))


@query
def autosort_review(s, d):
    """The reviewer refuses what is offered to primaries that are text files."""
    files = a.names(s, d)
    refused = files.where("side = 'primary' AND path LIKE '%.txt'").select(F.col("id").alias("p_id"), F.lit(None).cast("long").alias("t_id"))
    return rounded(pairing.auto_sort(files, "folder", refused=refused))


@query
def pairs_zip(s, d):
    return rounded(pairing.zip_lists(a.names(s, d)))


@query
def pairs_leftover_anti(s, d):
    files = a.names(s, d)
    near = pairing.edit_distance_top(files, "folder", 1).where("distance <= 1").select("p_id", "t_id")
    return pairing.leftovers(files, near)


@query
def list_ingest(s, d):
    """Every file twice, and their folder, on the list of primaries."""
    files = a.names(s, d)
    folder = s.createDataFrame([("primary", -1, "/media/./x/..//")], "side string, id long, path string")
    given = files.select("side", "id", "path")
    return pairing.ingest_list(given.unionByName(given.withColumn("id", F.col("id") + 1_000_000)).unionByName(folder), files.select("path"))


@query
def extension_filter(s, d):
    return a.names(s, d).where(scalar.is_video(F.col("path"))).select("id", "path")


@query
def output_path(s, d):
    return a.names(s, d).select("id", scalar.output_path(F.col("path")).alias("out"))


def _probe_docs(s: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = a.events(s, d).withColumn("k", k)
    stream = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","width":"1920","height":"1080","r_frame_rate":"'), F.when(F.col("k") % 7 == 0, "0/0").when(F.col("k") % 2 == 0, "24000/1001").otherwise("25/1"), F.lit('","nb_frames":"'), F.when(F.col("k") % 3 == 0, "N/A").otherwise(F.col("k").cast("string")), F.lit('"}'))
    audio = F.when(F.col("k") % 5 != 0, ',{"codec_type":"audio","codec_name":"aac","sample_rate":"48000"}').otherwise("")
    doc = F.concat(F.lit('{"format":{'), F.when(F.col("k") % 11 != 0, F.concat(F.lit('"duration":"'), F.col("k").cast("string"), F.lit('.5"'))).otherwise(""), F.lit('},"streams":['), F.when(F.col("k") % 13 != 0, F.concat(stream, audio)).otherwise(""), F.lit("]}"))
    return e.select(F.col("event_id").alias("media_id"), doc.alias("doc"))


@query
def probe_json(s, d):
    return rounded(logs.probe_media(_probe_docs(s, d)))


@query
def media_summary(s, d):
    return logs.media_summary(logs.probe_media(_probe_docs(s, d)))


def _log(s: SparkSession, d: str) -> DataFrame:
    e = a.events(s, d)
    line = F.when(F.col("event_id") % 3 == 0, F.format_string("[showinfo] n:%d pts_time:%.3f pos:1", "event_id", "value")).when(F.col("event_id") % 3 == 1, F.format_string("black_start:%.3f black_end:%.3f black_duration:1", "value", F.col("value") + F.col("user_id") % 10 * 0.1)).otherwise("frame=  12 pts_time:x")
    return e.select(F.col("event_id").alias("media_id"), line.alias("line"))


@query
def cut_log_regex(s, d):
    return rounded(logs.cut_times(_log(s, d), 5.0))


@query
def black_log_regex(s, d):
    return rounded(logs.black_sections(_log(s, d)))


@query
def black_islands(s, d):
    return rounded(logs.blacks_from_frames(a.frames(s, d), 50.0, 8.0))


@query
def log_severity(s, d):
    e = a.events(s, d)
    k = F.col("event_id") % 6
    line = F.when(k == 0, "Error: no frames").when(k == 1, "Warning: far").when(k == 2, "Scan complete").when(k == 3, "=== pair ===").when(k == 4, "⚠ late").otherwise("an error inside")
    return e.select("event_id", scalar.severity(line).alias("level"))


@query
def progress_parse(s, d):
    e = a.events(s, d)
    line = F.when(F.col("event_id") % 2 == 0, F.format_string("fps=%d out_time_us=%d speed=1.5x", "user_id", F.col("event_id") * 1000)).otherwise(F.format_string("out_time_ms=%d", F.col("event_id") * 1000))
    return rounded(logs.progress(e.select(F.col("event_id").alias("id"), line.alias("line"), (F.col("user_id") % 3).cast("double").alias("duration"))))


def _job_lines(e: DataFrame) -> DataFrame:
    """Lines of encoders, a job a user, from the events of a table or a stream."""
    k, n = F.col("event_id") % 6, F.col("event_id")
    line = F.when(k == 0, F.format_string("out_time_us=%d", n * 1000)).when(k == 1, F.format_string("fps=%d", F.col("user_id") % 60)).when(k == 2, F.format_string("speed= %d.5x", n % 4)).when(k == 3, F.lit("progress=continue"))
    line = line.when((k == 4) & (n % 5 == 0), F.lit("progress=end")).when(k == 4, F.format_string("out_time_ms=%d", n * 1000)).when(F.col("user_id") % 3 == 0, F.format_string("disk %d is full", n)).otherwise(F.lit(""))
    return e.select(F.col("user_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), n.alias("line_no"), line.alias("line"), ((F.col("user_id") % 3) * 10.0).alias("duration"))


def _job_rows(states: DataFrame) -> DataFrame:
    return rounded(states.withColumn("at_s", a.seconds("at")).drop("at"))


@query
def job_progress(s, d):
    return _job_rows(jobs.job_states(_job_lines(a.read(s, d, "events")), 3 * 86400.0, 86400.0))


@query
def job_progress_stream(s, d):
    """The same from a stream of the events, to its end."""
    events = s.readStream.schema(a.read(s, d, "events").schema).parquet(f"{d}/events.parquet*")  # by a pattern, as a stream reads no single file
    return _job_rows(jobs.last_states(jobs.follow_jobs(_job_lines(events), 3 * 86400.0, 86400.0)))


@query
def pcm_window(s, d):
    pcm = a.events(s, d).select(F.col("event_type").alias("media_id"), F.col("event_id").alias("sample_idx"), F.round(F.col("value") * 10).cast("int").alias("value"))
    return rounded(logs.pcm_window(pcm, 0.01, 0.02))


@query
def pcm_windows(s, d):
    pcm = a.events(s, d).select(F.col("event_type").alias("media_id"), F.col("event_id").alias("sample_idx"), F.round(F.col("value") * 10).cast("int").alias("value"))
    w = a.signal_pairs(s).select(F.col("primary_id").alias("media_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("window_no"))
    start = F.when(F.col("window_no") == 2, 1e6).otherwise((F.col("window_no") + 1) * 0.0078125)
    w = w.withColumn("w_start", start).withColumn("w_end", F.col("w_start") + 0.0078125)
    return rounded(logs.pcm_windows(pcm, w).select("media_id", "window_no", "n", F.aggregate("amps", F.lit(0.0), lambda x, y: x + y).alias("total")))


@query
def frame_hashes(s, d):
    """Hash and detail of small synthetic frames: the bytes of a text as pixels."""
    docs = a.read(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.unhex(F.substring(F.repeat(F.hex(F.encode("text", "UTF-8")), 200), 1, 2 * 32 * 18 * 3)).alias("rgb"))
    return rounded(docs.select("doc_id", F.concat_ws(",", phash.frame_hash(F.col("rgb"), 32, 18).cast("array<string>")).alias("hash"), phash.laplacian_variance(F.col("rgb"), 32, 18).alias("detail")))
