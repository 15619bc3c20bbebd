"""Nearest-neighbour scans over frame hashes.

All scans work on many pairs at once. A pair's references are few (a parameter), its frames many: references are matched to
frames by an equi-join on the recording (and, for bands, on a bucket of time), never by comparing all recordings.
Ties: the least distance, then the earliest frame, everywhere by the minimum of a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalar import hamming, vertex_of_minimum, visual_band


def distance() -> Column:
    """Distance between a row's reference words r0, r1 and its frame words h0, h1."""
    return hamming([(F.col("r0"), F.col("h0")), (F.col("r1"), F.col("h1"))])


def reference_rows(pairs: DataFrame, frames: DataFrame, refs: DataFrame, fps: float) -> DataFrame:
    """pair_id, primary_id, ref_no, ref_frame, ref_t, r0, r1 from pairs and refs (media_id, ref_no, frame_idx)."""
    target = frames.select(F.col("media_id").alias("target_id"), F.col("frame_idx").alias("ref_frame"), F.col("h0").alias("r0"), F.col("h1").alias("r1"))
    wanted = pairs.join(refs.select(F.col("media_id").alias("target_id"), "ref_no", F.col("frame_idx").alias("ref_frame")), "target_id")
    return wanted.join(target, ["target_id", "ref_frame"]).select("pair_id", "primary_id", "ref_no", "ref_frame", (F.col("ref_frame") / F.lit(fps)).alias("ref_t"), "r0", "r1")


def coarse_scan(refs: DataFrame, frames: DataFrame, step: int) -> DataFrame:
    """pair_id, ref_no, hd, frame_idx: the nearest primary frame on the stride for each reference."""
    primary = frames.where(F.col("frame_idx") % step == 0).select(F.col("media_id").alias("primary_id"), "frame_idx", "h0", "h1")
    each = refs.join(primary, "primary_id").select("pair_id", "ref_no", F.struct(distance().alias("hd"), "frame_idx").alias("m"))
    return each.groupBy("pair_id", "ref_no").agg(F.min("m").alias("m")).select("pair_id", "ref_no", "m.hd", "m.frame_idx")


def fine_scan(refs: DataFrame, coarse: DataFrame, frames: DataFrame, window: int) -> DataFrame:
    """coarse improved by every frame within `window`, if one is strictly nearer; with the sub-frame shift.

    The frames of a window are named one by one, so the lookup is an equi-join on (recording, frame).
    """
    near = refs.join(coarse, ["pair_id", "ref_no"]).withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("frame_idx") - window), F.col("frame_idx") + window)))
    primary = frames.select(F.col("media_id").alias("primary_id"), F.col("frame_idx").alias("at"), "h0", "h1")
    keys = ["pair_id", "ref_no"]
    each = near.join(primary, ["primary_id", "at"]).select(*keys, "hd", "frame_idx", F.struct(distance().alias("d"), "at").alias("m"))
    seen = each.groupBy(*keys, "hd", "frame_idx").agg(F.collect_list("m").alias("seen")).withColumn("m", F.array_min("seen"))
    best = seen.select(*keys, F.least("hd", "m.d").alias("hd"), F.when(F.col("m.d") < F.col("hd"), F.col("m.at")).otherwise(F.col("frame_idx")).alias("frame_idx"), "seen")
    return with_shift(best)


def with_shift(best: DataFrame) -> DataFrame:
    """best (hd, frame_idx, seen, ...) with shift for seen: the vertex through the distances of the frames on both sides.

    seen holds the distances within a window around a match, an array as long as the window at most.
    """
    beside = lambda k: F.get(F.filter("seen", lambda x: x["at"] == F.col("frame_idx") + k), F.lit(0))["d"]
    return best.withColumn("shift", vertex_of_minimum(beside(-1), F.col("hd"), beside(1))).drop("seen")


def single_offset(refs: DataFrame, frames: DataFrame, fps: float, threshold: int, cfg: Config = DEFAULT, anchor: DataFrame | None = None) -> DataFrame:
    """pair_id, ref_no, hd, frame_idx, offset, confidence: coarse scan, fine scan, sub-frame shift.

    A pair whose coarse distance exceeds twice the threshold has no row. anchor (pair_id, anchor_t, anchor_hd): where the
    match lies well before a trusted anchor, the search is done again around the anchor.
    """
    coarse = coarse_scan(refs, frames, cfg.coarse_step).where(F.col("hd") <= cfg.reject_factor * threshold)
    fine = fine_scan(refs, coarse, frames, cfg.fine_window)
    if anchor is not None:
        early = fine.join(anchor, "pair_id").where(((F.col("frame_idx") + F.col("shift")) / fps < F.col("anchor_t") - cfg.intro_guard) & (F.col("anchor_hd") <= threshold))
        start = early.select("pair_id", "ref_no", F.lit(999).cast("long").alias("hd"), F.bround(F.col("anchor_t") * fps).cast("long").alias("frame_idx"))
        again = fine_scan(refs, start, frames, cfg.fine_window).select("pair_id", "ref_no", F.struct("hd", "frame_idx", "shift").alias("again"))
        best = F.coalesce("again", F.struct("hd", "frame_idx", "shift"))
        fine = fine.join(again, ["pair_id", "ref_no"], "left").select("pair_id", "ref_no", best.alias("b")).select("pair_id", "ref_no", "b.*")
    offset = (F.col("frame_idx") + F.col("shift")) / F.lit(fps) - F.col("ref_t")
    return fine.join(refs.select("pair_id", "ref_no", "ref_t"), ["pair_id", "ref_no"]).select("pair_id", "ref_no", "hd", "frame_idx", offset.alias("offset"), visual_band(F.col("hd"), threshold).alias("confidence"))


def multi_match(refs: DataFrame, frames: DataFrame, threshold: int, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, ref_no, hd, frame_idx, shift: the reference with the least distance, the earliest on ties, after a fine scan.

    A pair whose distance exceeds twice the threshold after that has no row.
    """
    coarse = coarse_scan(refs, frames, cfg.coarse_step)
    winner = coarse.groupBy("pair_id").agg(F.min(F.struct("hd", "ref_no", "frame_idx")).alias("m")).select("pair_id", "m.ref_no", "m.hd", "m.frame_idx")
    return fine_scan(refs, winner, frames, cfg.fine_window).where(F.col("hd") <= cfg.reject_factor * threshold)


def multi_offset(refs: DataFrame, frames: DataFrame, fps: float, threshold: int, cfg: Config = DEFAULT) -> DataFrame:
    """As single_offset for the reference that multi_match chooses."""
    fine = multi_match(refs, frames, threshold, cfg)
    offset = (F.col("frame_idx") + F.col("shift")) / F.lit(fps) - F.col("ref_t")
    return fine.join(refs.select("pair_id", "ref_no", "ref_t"), ["pair_id", "ref_no"]).select("pair_id", "ref_no", "hd", "frame_idx", offset.alias("offset"), visual_band(F.col("hd"), threshold).alias("confidence"))


def band_scan(refs: DataFrame, frames: DataFrame, fps: float, window: float, limit: int, coarse_offset: float | Column = 0.0, half_even: bool = False) -> DataFrame:
    """pair_id, ref_no, ref_t, hd, frame_idx, shift, offset: the nearest primary frame within a window of the predicted time.

    The band becomes an equi-join: frames carry the number of their window-wide bucket, a reference looks into the buckets
    that its band touches, and an exact filter follows. References whose best distance exceeds the limit have no row.
    """
    width = max(1, int(2 * window * fps))
    to_frame = (lambda c: F.bround(c).cast("long")) if half_even else (lambda c: c.cast("long"))
    predicted = F.col("ref_t") + coarse_offset
    if half_even:
        reach = int(round(window * fps))
        lo, hi = to_frame(predicted * fps) - reach, to_frame(predicted * fps) + reach
    else:
        lo, hi = to_frame((predicted - window) * fps), to_frame((predicted + window) * fps)
    wanted = refs.withColumn("lo", F.greatest(F.lit(0).cast("long"), lo)).withColumn("hi", hi).where("hi >= lo")
    wanted = wanted.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    primary = frames.select(F.col("media_id").alias("primary_id"), F.col("frame_idx").alias("at"), "h0", "h1", F.floor(F.col("frame_idx") / width).alias("bucket"))
    keys = ["pair_id", "ref_no", "ref_t"]
    each = wanted.join(primary, ["primary_id", "bucket"]).where(F.col("at").between(F.col("lo"), F.col("hi"))).select(*keys, F.struct(distance().alias("d"), "at").alias("m"))
    seen = each.groupBy(*keys).agg(F.collect_list("m").alias("seen")).withColumn("m", F.array_min("seen"))
    best = seen.select(*keys, F.col("m.d").alias("hd"), F.col("m.at").alias("frame_idx"), "seen").where(F.col("hd") <= limit)
    return with_shift(best).withColumn("offset", (F.col("frame_idx") + F.col("shift")) / F.lit(fps) - F.col("ref_t"))


def top_matches_by_scan(pairs: DataFrame, frames: DataFrame, k: int) -> DataFrame:
    """pair_id, ref_frame, rank, frame_idx, hd: the k nearest primary frames of every target frame, by all frames of a pair.

    hash_index.top_matches gives the same without comparing all.
    """
    from pyspark.sql import Window

    target = frames.select(F.col("media_id").alias("target_id"), F.col("frame_idx").alias("ref_frame"), F.col("h0").alias("r0"), F.col("h1").alias("r1"))
    primary = frames.select(F.col("media_id").alias("primary_id"), "frame_idx", "h0", "h1")
    each = pairs.join(target, "target_id").join(primary, "primary_id").select("pair_id", "ref_frame", "frame_idx", distance().alias("hd"))
    rank = F.row_number().over(Window.partitionBy("pair_id", "ref_frame").orderBy("hd", "frame_idx"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("pair_id", "ref_frame", "rank", "frame_idx", "hd")


def frame_lookup(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """wanted (media_id, frame_idx, ...) with the frame's words; null where there is no such frame."""
    return wanted.join(frames.select("media_id", "frame_idx", "h0", "h1"), ["media_id", "frame_idx"], "left")


def frame_range(frames: DataFrame, start: int, end: int, step: int) -> DataFrame:
    """Frames of the half-open range on the stride from its start; the range reaches the file scan."""
    return frames.where((F.col("frame_idx") >= start) & (F.col("frame_idx") < end)).where((F.col("frame_idx") - start) % step == 0)


def verify_visual(refs: DataFrame, frames: DataFrame, fps: float, cfg: Config = DEFAULT, limit: int | None = None) -> DataFrame:
    """pair_id, ref_no, ref_t, hd, delta_frames, delta_ms: what is left of the offset after alignment."""
    found = band_scan(refs, frames, fps, cfg.verify_window, cfg.verify_hd if limit is None else limit, half_even=True)
    delta = F.col("frame_idx") + F.col("shift") - F.col("ref_t") * fps
    return found.select("pair_id", "ref_no", "ref_t", "hd", delta.alias("delta_frames"), (delta / fps * 1000).alias("delta_ms"))
