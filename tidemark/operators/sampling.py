"""Choice of frames and sample times. Every function takes tables of many recordings and keys its result by recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def content_share(frames: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """media_id, n_frames, n_content, n_relaxed: frames with enough detail."""
    return frames.groupBy("media_id").agg(F.count("*").alias("n_frames"), F.count_if(F.col("lap_var") > cfg.content).alias("n_content"), F.count_if(F.col("lap_var") > cfg.content_relaxed).alias("n_relaxed"))


def _first_of(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the least (tier, place) of each key; rows without a tier do not count."""
    return ranked.where("tier IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("tier", "place", "frame_idx")).alias("m")).select(*keys, F.col("m.tier").alias("tier"), F.col("m.frame_idx").alias("frame_idx"))


def first_content_frame(frames: DataFrame, fps: float, cfg: Config = DEFAULT) -> DataFrame:
    """media_id, tier, frame_idx: the first detailed frame on the half-second stride, else the first fairly detailed one."""
    stride = max(1, int(fps // 2))
    tier = F.when((F.col("frame_idx") % stride == 0) & (F.col("lap_var") > cfg.content), 1).when(F.col("lap_var") > cfg.content_relaxed, 2)
    return _first_of(frames.where(F.col("frame_idx") < int(cfg.first_content_span * fps)).select("media_id", "frame_idx", tier.alias("tier"), F.col("frame_idx").alias("place")), ["media_id"])


def reference_frame(frames: DataFrame, fps: float, cfg: Config = DEFAULT, skip: float | None = None) -> DataFrame:
    """media_id, tier, frame_idx: behind the skipped start, by the second, then frame by frame, then the start itself."""
    skip = cfg.reference_skip if skip is None else skip
    total = F.max("frame_idx").over(Window.partitionBy("media_id")) + 1
    start = F.least(F.lit(int(skip * fps)), F.greatest(F.lit(0), total - int(10 * fps))).cast("long")
    gone = F.col("frame_idx") - F.col("start")
    step = max(1, int(fps))
    tier = (
        F.when((gone % step == 0) & (gone < int(cfg.reference_tiers[0] * fps)) & (F.col("lap_var") > cfg.content), 1)
        .when((gone < int(cfg.reference_tiers[1] * fps)) & (F.col("lap_var") > cfg.content_relaxed), 2)
        .when(gone == 0, 3)
    )
    rows = frames.select("media_id", "frame_idx", "lap_var", start.alias("start")).where(gone >= 0)
    return _first_of(rows.select("media_id", "frame_idx", tier.alias("tier"), F.col("frame_idx").alias("place")), ["media_id"])


def reference_targets(media: DataFrame, n: int, cfg: Config = DEFAULT) -> DataFrame:
    """media_id, ref_no, goal, step, reach: n evenly spaced frames between the skipped start and end, from media_id, total_frames, fps.

    reach is the last frame on either side that is tried; the search ends before refs_search seconds.
    """
    lo = F.least((cfg.refs_skip_start * F.col("fps")).cast("long"), F.greatest(F.lit(0), F.col("total_frames") - 1))
    hi = F.greatest(F.col("lo") + 1, F.col("total_frames") - (cfg.refs_skip_end * F.col("fps")).cast("long"))
    rows = media.where("total_frames > 0 AND fps > 0").withColumn("lo", lo).withColumn("hi", hi)
    goal = F.least(F.col("total_frames") - 1, (F.col("lo") + F.col("ref_no") * (F.col("hi") - F.col("lo")) / F.lit(n + 1)).cast("long"))
    return rows.withColumn("ref_no", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("media_id", "ref_no", goal.alias("goal"), F.greatest(F.lit(1), F.floor(F.col("fps") / 2)).cast("long").alias("step"), ((cfg.refs_search * F.col("fps")).cast("long") - 1).alias("reach"))


def near_content(goals: DataFrame, frames: DataFrame, keys: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """keys, goal, frame_idx, found: the detailed frame nearest to each goal on its step, later before earlier; else the goal.

    goals has the keys with media_id among them, goal, step and reach (in frames).
    """
    best = _tries(goals, frames, cfg).groupBy(*keys).agg(F.min(F.struct("k", (-F.col("sign")).alias("s"), "frame_idx")).alias("m"))
    return goals.select(*keys, "goal").join(best, keys, "left").select(*keys, "goal", F.coalesce("m.frame_idx", "goal").alias("frame_idx"), F.col("m").isNotNull().alias("found"))


def _tries(goals: DataFrame, frames: DataFrame, cfg: Config) -> DataFrame:
    """goals with k, sign, frame_idx of each detailed frame on the step within reach; an equi-join on (media_id, frame_idx)."""
    tries = goals.where("reach >= 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("reach") / F.col("step")).cast("long")))).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).where((F.col("k") > 0) | (F.col("sign") > 0))
    tries = tries.withColumn("frame_idx", F.col("goal") + F.col("sign") * F.col("k") * F.col("step"))
    good = frames.where(F.col("lap_var") > cfg.content).select("media_id", "frame_idx")
    return tries.join(good, ["media_id", "frame_idx"], "left_semi")


def reference_frames(media: DataFrame, frames: DataFrame, n: int, cfg: Config = DEFAULT) -> DataFrame:
    """media_id, ref_no, goal, frame_idx, found: n reference frames in order, each taking what no earlier one has taken.

    A reference takes the nearest free detailed frame (as near_content), else its goal; one whose goal is taken too has no
    row. A recording has n goals with a search window each, so its candidates are few and are walked as one array.
    """
    goals = reference_targets(media, n, cfg)
    found = _tries(goals, frames, cfg).groupBy("media_id", "ref_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (-F.col("sign")).alias("s"), "frame_idx"))), lambda x: x["frame_idx"]).alias("near"))
    each = goals.join(found, ["media_id", "ref_no"], "left").select("media_id", F.struct("ref_no", "goal", F.coalesce("near", F.array().cast("array<long>")).alias("near")).alias("g"))
    kind = "array<struct<ref_no:int,goal:bigint,frame_idx:bigint,found:boolean>>"

    def take(have: Column, g: Column) -> Column:
        free = F.filter(g["near"], lambda x: ~F.exists(have, lambda h: h["frame_idx"] == x))
        one = F.struct(g["ref_no"].alias("ref_no"), g["goal"].alias("goal"), F.coalesce(F.get(free, F.lit(0)), g["goal"]).alias("frame_idx"), (F.size(free) > 0).alias("found"))
        lost = (F.size(free) == 0) & F.exists(have, lambda h: h["frame_idx"] == g["goal"])
        return F.when(lost, have).otherwise(F.concat(have, F.array(one)).cast(kind))

    walked = each.groupBy("media_id").agg(F.array_sort(F.collect_list("g")).alias("gs")).select("media_id", F.explode(F.aggregate("gs", F.array().cast(kind), take)).alias("r"))
    return walked.select("media_id", "r.*")


def even_times(media: DataFrame, n: int) -> DataFrame:
    """media_id, sample_no, t: n samples spread evenly over what is left without the first half minute and the last minute."""
    lo = F.greatest(F.lit(0.0), F.least(F.lit(30.0), F.col("duration") - 1))
    hi = F.greatest(F.col("lo") + 1, F.col("duration") - 60)
    rows = media.where("duration > 0").withColumn("lo", lo).withColumn("hi", hi).withColumn("sample_no", F.explode(F.sequence(F.lit(1), F.lit(max(1, n)))))
    t = F.col("lo") + F.col("sample_no") * (F.col("hi") - F.col("lo")) / F.lit(n + 1) if n > 1 else F.col("lo")
    return rows.select("media_id", "sample_no", t.alias("t"))


def middle_times(media: DataFrame, n: int, cfg: Config = DEFAULT) -> DataFrame:
    """media_id, sample_no, t: midpoints of n equal parts; the edges are kept for short recordings."""
    edge = F.when(F.col("duration") <= 2 * cfg.verify_edge + 1, F.lit(0.0)).otherwise(F.lit(cfg.verify_edge))
    rows = media.where("duration > 0").withColumn("edge", edge).withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select("media_id", "sample_no", (F.col("edge") + (F.col("sample_no") + 0.5) * (F.col("duration") - 2 * F.col("edge")) / F.lit(n)).alias("t"))


def probe_times(media: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """media_id, t: the fixed probe times well inside; a short recording gets one of its own."""
    times = F.filter(F.array(*map(F.lit, cfg.probes)), lambda t: t < F.col("duration") - 5)
    short = F.array(F.least(F.lit(5.0), F.col("duration") * 0.1))
    return media.select("media_id", F.explode(F.when(F.size(times) > 0, times).otherwise(short)).alias("t"))


def verify_windows(media: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """media_id, window_no, w_start, w_end: consecutive windows between the edges; none if not one fits."""
    edge = F.when(F.col("duration") <= 2 * cfg.verify_edge + 1, F.lit(0.0)).otherwise(F.lit(cfg.verify_edge))
    rows = media.withColumn("edge", edge).withColumn("span", F.col("duration") - 2 * F.col("edge")).where(F.col("span") >= cfg.verify_audio)
    rows = rows.withColumn("window_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.col("span") / cfg.verify_audio).cast("int")) - 1)))
    start: Column = F.col("edge") + F.col("window_no") * cfg.verify_audio
    return rows.select("media_id", "window_no", start.alias("w_start"), (start + cfg.verify_audio).alias("w_end"))
