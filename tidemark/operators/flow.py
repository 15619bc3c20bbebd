"""Compositions: the intro anchor, dense samples, and the whole search for many pairs at once."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalar import output_path, time_to_frame
from . import decide, nearest, pairing, sampling, segments, signals, stats, verify
from .lineage import written


class OffsetEngine(Protocol):
    """What finds offsets: a table of pairs (pair_id, primary_id, target_id) to a table (pair_id, offset, ...); no row, no offset."""

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


def intro_probes(pairs: DataFrame, frames: DataFrame, fps: float, cfg: Config = DEFAULT, coarse_step: int = 8) -> DataFrame:
    """pair_id, id, target_frame, primary_frame, target_t, primary_t, offset, hd: the match of each early probe of a target.

    A probe takes the detailed frame nearest to its time; its match in the primary is the best of a coarse and a fine scan,
    whatever its distance.
    """
    own = frames.join(pairs.select(F.col("target_id").alias("media_id")).distinct(), "media_id", "left_semi")
    media = own.groupBy("media_id").agg(F.count("*").alias("total_frames")).withColumn("duration", F.col("total_frames") / F.lit(fps))
    goals = sampling.probe_times(media, cfg).join(media.select("media_id", "total_frames"), "media_id")
    goal = F.greatest(F.lit(0).cast("long"), F.least(F.col("total_frames") - 1, F.bround(F.col("t") * fps).cast("long")))
    goals = goals.select("media_id", goal.alias("ref_no"), goal.alias("goal"), F.lit(max(1, int(fps // 2))).cast("long").alias("step"), F.lit(max(1, int(8 * fps)) - 1).cast("long").alias("reach"))
    found = sampling.near_content(goals, own, ["media_id", "ref_no"], cfg).where("found")
    refs = nearest.reference_rows(pairs, own, found.select("media_id", "ref_no", "frame_idx"), fps)
    best = nearest.fine_scan(refs, nearest.coarse_scan(refs, frames, coarse_step), frames, cfg.fine_window).join(refs.select("pair_id", "ref_no", "ref_frame", "ref_t"), ["pair_id", "ref_no"])
    primary = (F.col("frame_idx") + F.col("shift")) / F.lit(fps)
    return best.select("pair_id", F.col("ref_no").alias("id"), F.col("ref_frame").alias("target_frame"), F.col("frame_idx").alias("primary_frame"), F.col("ref_t").alias("target_t"), F.round(primary, 9).alias("primary_t"), F.round(primary - F.col("ref_t"), 9).alias("offset"), "hd")


def intro_anchor(pairs: DataFrame, frames: DataFrame, fps: float, threshold: int, cfg: Config = DEFAULT, coarse_step: int = 8) -> DataFrame:
    """pair_id, offset, primary_t, target_t, hd, n: where both recordings first share content, by the agreement of probes."""
    return stats.choose_anchor(stats.probe_clusters(intro_probes(pairs, frames, fps, cfg, coarse_step), cfg), threshold, cfg)


def dense_samples(pairs: DataFrame, frames: DataFrame, media: DataFrame, offsets: DataFrame, fps: float, cfg: Config = DEFAULT, n: int | None = None, window: float | None = None, limit: int | None = None) -> DataFrame:
    """pair_id, id, target_t, offset, hd: offsets of samples spread over the target, searched around each pair's offset."""
    n, window, limit = n or cfg.dense_samples, window or cfg.dense_window, cfg.dense_hd if limit is None else limit
    times = sampling.even_times(media, n)
    step = max(1, int(fps // 4))
    goals = times.select("media_id", F.col("sample_no").cast("long").alias("ref_no"), F.bround(F.col("t") * fps).cast("long").alias("goal"), F.lit(step).cast("long").alias("step"), F.lit(max(0, int(fps) - 1)).cast("long").alias("reach"))
    found = sampling.near_content(goals, frames, ["media_id", "ref_no"], cfg).where("found")
    refs = nearest.reference_rows(pairs, frames, found.select("media_id", "ref_no", "frame_idx"), fps).join(offsets.select("pair_id", F.col("offset").alias("coarse")), "pair_id")
    got = nearest.band_scan(refs, frames, fps, window, limit, F.col("coarse"))
    return got.select("pair_id", F.col("ref_no").alias("id"), F.col("ref_t").alias("target_t"), F.round("offset", 9).alias("offset"), F.col("hd").cast("int").alias("hd"))


def refine_visually(pairs: DataFrame, frames: DataFrame, media: DataFrame, offsets: DataFrame, fps: float, cfg: Config = DEFAULT, **kw) -> DataFrame:
    """pair_id, offset: the robust median of dense samples; the given offset where there are none."""
    better = stats.robust_offset(dense_samples(pairs, frames, media, offsets, fps, cfg, **kw), cfg).withColumnRenamed("offset", "better")
    return offsets.join(better, "pair_id", "left").select("pair_id", F.coalesce("better", "offset").alias("offset"))


def sync_pairs(pairs: DataFrame, visual: DataFrame, audio: DataFrame, cuts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, source, hd, offset, error: the decision for every pair from the engines' rows.

    visual: pair_id, offset, hd; audio and cuts: pair_id, offset, peak. A pair that no engine solves keeps its row, with an error.
    """
    c = pairs.select("pair_id")
    for rows, names in ((visual, {"offset": "v_off", "hd": "v_hd"}), (audio, {"offset": "a_off", "peak": "a_peak"}), (cuts, {"offset": "c_off", "peak": "c_peak"})):
        c = c.join(rows.select("pair_id", *(F.col(a).alias(b) for a, b in names.items())), "pair_id", "left")
    return decide.fallback_cascade(c, cfg).withColumn("error", F.when(F.col("source") == "none", "No match found"))


def segment_offsets(pairs: DataFrame, samples: DataFrame, blacks: DataFrame, energy: DataFrame, durations: DataFrame, bin_s: float, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, seg_no, target_start, target_end, offset, source, reason: segments with the offset that visual and audio settle on.

    samples: judged samples; durations: pair_id, duration (of the target). Pairs without a dark interval are cut by their
    samples alone.
    """
    dark = blacks.where(F.round(F.col("b_end") - F.col("b_start"), 9) >= cfg.black_min)
    some = dark.select("pair_id").distinct()
    cut = segments.segments_with_blacks(samples.join(some, "pair_id", "left_semi"), dark, durations, cfg)
    plain = segments.segments_from_groups(segments.grouped_samples(samples.join(some, "pair_id", "left_anti"), cfg=cfg), durations)
    plain = plain.withColumns({"phash_inliers": F.lit(0), "phash_stdev": F.lit(0.0)})
    segs = written(cut.unionByName(plain))
    heard = signals.refine_segments(segs.join(pairs, "pair_id"), energy, bin_s, cfg, residual=max(1, round(cfg.refine_residual / bin_s)))
    settled = decide.adjudicate(segs, heard.select("pair_id", "seg_no", F.col("offset").alias("a_off"), F.col("peak").alias("a_peak")), cfg)
    return segs.select("pair_id", "seg_no", "target_start", "target_end").join(settled, ["pair_id", "seg_no"])


def sync_timeline(pairs: DataFrame, found: DataFrame, samples: DataFrame, blacks: DataFrame, energy: DataFrame, durations: DataFrame, bin_s: float, cfg: Config = DEFAULT, constant_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(plans, chunks) of every pair from what the search found to what is played.

    found: pair_id, offset (null: nothing found) as sync_pairs gives it; samples: dense samples; durations: pair_id, duration
    (target), primary_duration; energy: media_id, bin, rms. plans: pair_id, mode, offset, error; mode is 'segmented' where the
    offset changes over time (then chunks has the pair's playback chunks, and the offset is null), 'single' with the median of
    the samples, or what was found without any, and 'none' where nothing was found. constant_only keeps to single offsets.
    What several steps read (offsets found, judged samples, segments) is written.
    """
    found = written(found.select("pair_id", "offset"))
    judged = written(stats.judged_samples(samples.join(found.where("offset IS NOT NULL").select("pair_id"), "pair_id", "left_semi"), cfg))
    verdict = stats.triggered(judged, cfg).select("pair_id", "segmented", F.col("offset").alias("better"))
    if constant_only:
        verdict = stats.robust_offset(judged, cfg).select("pair_id", F.lit(False).alias("segmented"), F.col("offset").alias("better"))
    verdict = written(verdict)
    rows = found.select("pair_id", "offset").join(verdict, "pair_id", "left")
    many = F.coalesce("segmented", F.lit(False))
    mode = F.when(F.col("offset").isNull(), "none").when(many, "segmented").otherwise("single")
    plans = rows.select("pair_id", mode.alias("mode"), F.when(~many, F.coalesce("better", "offset")).alias("offset"), F.when(F.col("offset").isNull(), "No match found").alias("error"))
    changing = judged.join(verdict.where("segmented").select("pair_id"), "pair_id", "left_semi").drop("despiked")
    settled = segment_offsets(pairs, changing, blacks, energy, durations, bin_s, cfg)
    return plans, segments.playback_chunks(settled, durations.select("pair_id", "primary_duration"), cfg)


def sync_recordings(pairs: DataFrame, found: DataFrame, frames: DataFrame, energy: DataFrame, blacks: DataFrame, fps: float, bin_s: float, cfg: Config = DEFAULT, constant_only: bool = False, **dense) -> tuple[DataFrame, DataFrame]:
    """(plans, chunks) of sync_timeline from tables of recordings and what the search decided (pair_id, offset).

    frames: media_id, frame_idx, h0, h1, lap_var; energy: media_id, bin, rms; blacks: media_id, b_start, b_end. Dense samples are
    searched around the decided offset of each pair, only for pairs that have one.
    """
    solved = written(found.where("offset IS NOT NULL").select("pair_id", "offset"))
    open_ = pairs.join(solved.select("pair_id"), "pair_id", "left_semi")
    length = frames.groupBy("media_id").agg((F.count("*") / F.lit(fps)).alias("duration"))
    samples = dense_samples(open_, frames, length, solved, fps, cfg, **dense)
    of = lambda side, name: length.select(F.col("media_id").alias(f"{side}_id"), F.col("duration").alias(name))
    durations = pairs.join(of("target", "duration"), "target_id").join(of("primary", "primary_duration"), "primary_id").select("pair_id", "duration", "primary_duration")
    dark = pairs.select("pair_id", F.col("primary_id").alias("media_id")).join(blacks, "media_id").select("pair_id", "b_start", "b_end")
    return sync_timeline(pairs, found, samples, dark, energy, written(durations), bin_s, cfg, constant_only)


def verify_sync(pairs: DataFrame, frames: DataFrame, energy: DataFrame, primary_cuts: DataFrame, synced_cuts: DataFrame, durations: DataFrame, fps: float, bin_s: float, cfg: Config = DEFAULT) -> DataFrame:
    """The verification report of aligned pairs: pictures at midpoints, sound by windows, scene cuts paired greedily.

    pairs: pair_id, primary_id, target_id (the synced recording); durations: pair_id, duration, the shorter of the two. A
    moment without detail in the primary is no sample; one without a near enough picture is counted as unreliable, a window
    without a clear peak as skipped.
    """
    length = durations.select(F.col("pair_id").alias("media_id"), "duration")
    times = sampling.middle_times(length, cfg.verify_samples, cfg).select(F.col("media_id").alias("pair_id"), "sample_no", time_to_frame(F.col("t"), F.lit(fps)).alias("frame_idx"))
    swapped = pairs.select("pair_id", F.col("target_id").alias("primary_id"), F.col("primary_id").alias("target_id"))
    wanted = times.join(pairs.select("pair_id", F.col("primary_id").alias("media_id")), "pair_id")
    seen = wanted.join(frames, ["media_id", "frame_idx"], "left")
    clear = seen.where(F.coalesce(F.col("lap_var") > cfg.content, F.lit(True)))
    refs = clear.where("h0 IS NOT NULL").join(swapped.select("pair_id", "primary_id"), "pair_id")
    refs = refs.select("pair_id", "primary_id", F.col("sample_no").alias("ref_no"), F.col("frame_idx").alias("ref_frame"), (F.col("frame_idx") / F.lit(fps)).alias("ref_t"), F.col("h0").alias("r0"), F.col("h1").alias("r1"))
    visual = nearest.verify_visual(refs, frames, fps, cfg)
    windows = sampling.verify_windows(length, cfg).withColumnRenamed("media_id", "pair_id").join(pairs, "pair_id")
    audio = signals.drift_windows(windows, energy, bin_s, cfg)
    matches = verify.pair_cuts(primary_cuts, synced_cuts, cfg.pair_cuts)
    counts = (verify.unmet(clear, visual, "visual_unreliable"), verify.unmet(windows, audio, "audio_skipped"), verify.scene_counts(primary_cuts, synced_cuts, matches))
    return verify.verification_report(visual, audio, verify.scene_drift(matches, fps), pairs, fps, counts)


def run_batch(files: DataFrame, group: str, engine: OffsetEngine, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(results, leftovers) of all folders at once: files (group, side, id, path) are paired by name and each pair searched.

    results: group, p_id, t_id, score, what the engine gives (its pair_id is the primary's id), output (the path to write) and
    error, null for success. leftovers: side, id of the files in no pair.
    """
    paired = pairing.pair_by_name(files, group, cfg.similar)
    found = engine(paired.select(F.col("p_id").alias("pair_id"), F.col("p_id").alias("primary_id"), F.col("t_id").alias("target_id")))
    to = files.where("side = 'target'").select(F.col("id").alias("t_id"), output_path(F.col("path")).alias("output"))
    rows = paired.join(found.withColumnRenamed("pair_id", "p_id"), "p_id", "left").join(to, "t_id")
    extra = [c for c in found.columns if c != "pair_id"]
    lost = F.col("offset").isNull()
    results = rows.select(group, "p_id", "t_id", "score", *extra, F.when(~lost, F.col("output")).alias("output"), F.when(lost, "No match found").alias("error"))
    return results, pairing.leftovers(files, paired)


def start_tagged(spark: SparkSession, tag: str) -> None:
    """Name the jobs that this thread starts from now on, so that cancel can stop them from any thread."""
    spark.sparkContext.addJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the running jobs of a tag; later jobs of the tag are not stopped. A session's own tags can't serve: another thread does not see them."""
    spark.sparkContext.cancelJobsWithTag(tag)
