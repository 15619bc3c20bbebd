"""Statistics of offset samples (pair_id, id, target_t, offset, hd), spikes, and clusters of probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .ranges import BLOCK, blocks, numbered, owned, running_sum


def upper_median(values: str) -> Column:
    """The element at n // 2 of the sorted values (an aggregate): from above, the first that covers half of them."""
    return F.expr(f"percentile_disc(0.5D) WITHIN GROUP (ORDER BY {values} DESC)")


def spread(samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, n, spread, robust: range, and range between two exact percentiles (the plain range under three samples)."""
    out = samples.groupBy("pair_id").agg(F.count("*").alias("n"), (F.max("offset") - F.min("offset")).alias("spread"), F.expr(f"percentile(offset, array({cfg.robust[0]}D, {cfg.robust[1]}D))").alias("p"))
    return out.select("pair_id", "n", "spread", F.when(F.col("n") < 3, F.col("spread")).otherwise(F.greatest(F.lit(0.0), F.col("p")[1] - F.col("p")[0])).alias("robust"))


def medians(samples: DataFrame) -> DataFrame:
    """pair_id, median, upper: the true median and the upper one."""
    return samples.groupBy("pair_id").agg(F.median("offset").alias("median"), upper_median("offset").alias("upper"))


def _near_median(samples: DataFrame, reach: float) -> DataFrame:
    mid = samples.groupBy("pair_id").agg(F.median("offset").alias("med"))
    return samples.join(mid, "pair_id").withColumn("near", F.round(F.abs(F.col("offset") - F.col("med")), 9) <= reach)


def robust_offset(samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, offset: the median of the samples near the median."""
    kept = _near_median(samples, cfg.max_deviation).groupBy("pair_id").agg(F.median(F.when(F.col("near"), F.col("offset"))).alias("m"), F.first("med").alias("med"))
    return kept.select("pair_id", F.coalesce("m", "med").alias("offset"))


def trimmed(samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, inliers, mean, stdev: of the samples near the median, by population."""
    kept = _near_median(samples, cfg.cluster_tolerance).where("near")
    return kept.groupBy("pair_id").agg(F.count("*").alias("inliers"), F.avg("offset").alias("mean"), F.stddev_pop("offset").alias("stdev"))


def despike(samples: DataFrame, passes: int | None = None, cfg: Config = DEFAULT, by: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """samples with the offsets of lone spikes replaced by the mean of their neighbours, and fixes: the passes that changed a row.

    A pass reads what the pass before left. One that changes nothing is a fixed point, so a fixed number needs no loop.
    """
    w = Window.partitionBy(*by).orderBy("target_t", "id")
    out = samples.withColumn("fixes", F.lit(0))
    for _ in range(cfg.passes if passes is None else passes):
        out = out.withColumns({"before": F.lag("offset").over(w), "after": F.lead("offset").over(w)})
        lone = (F.round(F.abs(F.col("before") - F.col("after")), 9) <= cfg.agree) & (F.round(F.abs(F.col("offset") - F.col("before")), 9) > cfg.spike) & (F.round(F.abs(F.col("offset") - F.col("after")), 9) > cfg.spike)
        lone = F.coalesce(lone, F.lit(False))
        out = out.withColumns({"offset": F.when(lone, (F.col("before") + F.col("after")) / 2).otherwise(F.col("offset")), "fixes": F.col("fixes") + lone.cast("int")}).drop("before", "after")
    return out


def despike_in_blocks(samples: DataFrame, passes: int | None = None, cfg: Config = DEFAULT, size: int = BLOCK) -> DataFrame:
    """despike of pairs of any number of samples: a pass reads one row to either side, so a halo of as many rows as passes is enough.

    All passes run over (pair, block) after one shuffle; the rows of the halo, wrong from the outer end inwards, are dropped.
    """
    n = cfg.passes if passes is None else passes
    parts = blocks(numbered(samples, ["pair_id"], ["target_t", "id"]), n, size)
    return owned(despike(parts, n, cfg, ("pair_id", "_block")))


def judged_samples(samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """samples (pair_id, id, target_t, offset, hd) with despiked: pairs of enough and widely spread samples lose their lone spikes."""
    raw = spread(samples, cfg).select("pair_id", ((F.col("n") >= 8) & (F.round("spread", 9) > 0.45)).alias("despiked"))
    cleaned = despike(samples, cfg=cfg).select("pair_id", F.col("id").alias("c_id"), F.col("offset").alias("c_offset"))
    used = samples.join(raw, "pair_id").join(cleaned.withColumnRenamed("pair_id", "c_pair"), (F.col("pair_id") == F.col("c_pair")) & (F.col("id") == F.col("c_id")))
    return used.select("pair_id", "id", "target_t", F.when(F.col("despiked"), F.col("c_offset")).otherwise(F.col("offset")).alias("offset"), "hd", "despiked")


def segment_trigger(samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, n, despiked, spread, segmented, offset: whether the offset changes over time, and the single offset if not."""
    return triggered(judged_samples(samples, cfg), cfg)


def triggered(used: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """segment_trigger of samples that are judged already."""
    wide = spread(used, cfg).select("pair_id", "n", F.when(F.col("n") >= 4, F.col("robust")).otherwise(F.col("spread")).alias("spread"))
    segmented = F.round("spread", 9) > cfg.trigger
    out = wide.join(used.groupBy("pair_id").agg(F.first("despiked").alias("despiked")), "pair_id").join(robust_offset(used, cfg), "pair_id")
    return out.select("pair_id", "n", "despiked", "spread", segmented.alias("segmented"), F.when(~segmented, F.col("offset")).alias("offset"))


def probe_clusters(probes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """probes (pair_id, id, target_t, primary_t, offset, hd) with cluster: single linkage along the sorted offsets."""
    w = Window.partitionBy("pair_id").orderBy("offset", "id")
    jump = F.coalesce(F.round(F.col("offset") - F.lag("offset").over(w), 9) > cfg.probe_tolerance, F.lit(False))
    return probes.withColumn("jump", jump.cast("int")).withColumn("cluster", F.sum("jump").over(w).cast("int")).drop("jump")


def probe_clusters_in_blocks(probes: DataFrame, cfg: Config = DEFAULT, size: int = BLOCK) -> DataFrame:
    """probe_clusters of pairs of any number of probes: over distinct offsets in blocks, with the jumps of earlier blocks carried on.

    Equal offsets share a cluster, and so do all null offsets (the first cluster).
    """
    distinct = probes.select("pair_id", "offset").distinct()
    parts = blocks(numbered(distinct, ["pair_id"], ["offset"]), 1, size)
    before = F.lag("offset").over(Window.partitionBy("pair_id", "_block").orderBy("_place"))
    jumps = parts.withColumn("_jump", F.coalesce(F.round(F.col("offset") - before, 9) > cfg.probe_tolerance, F.lit(False)).cast("int")).where("_own")
    summed = running_sum(jumps, ["pair_id"], ["_place"], F.col("_jump"))
    found = summed.select(F.col("pair_id").alias("_pair"), F.col("offset").alias("_offset"), F.col("_sum").cast("int").alias("cluster"))
    return probes.join(found, F.col("pair_id").eqNullSafe(F.col("_pair")) & F.col("offset").eqNullSafe(F.col("_offset"))).drop("_pair", "_offset")


def _best_cluster(clustered: DataFrame, threshold: int, cfg: Config) -> DataFrame:
    """pair_id, cluster, n and the medians of the cluster that choose_anchor describes."""
    g = clustered.groupBy("pair_id", "cluster").agg(F.count("*").alias("n"), F.median("hd").alias("med_hd"), F.min("hd").alias("min_hd"), F.median("primary_t").alias("med_p"), F.median("target_t").alias("med_t"), F.median("offset").alias("med_o"))
    pair = Window.partitionBy("pair_id")
    g = g.withColumn("most", F.max("n").over(pair)).withColumn("lone", F.row_number().over(pair.orderBy(F.desc("n"), "cluster")))
    viable = g.where((F.col("n") >= 2) | ((F.col("most") < 2) & (F.col("lone") == 1)))
    viable = viable.withColumn("place", F.row_number().over(pair.orderBy(F.desc("n"), "med_hd", F.desc("med_p"), "med_o")))
    viable = viable.withColumn("best_hd", F.min(F.when(F.col("place") == 1, F.col("min_hd"))).over(pair))
    tied = viable.where(F.col("min_hd") <= F.col("best_hd") + cfg.probe_margin)
    last = tied.withColumn("late", F.row_number().over(pair.orderBy(F.desc("med_p"), "cluster"))).where("late = 1")
    return last.where(F.col("med_hd") <= 2 * threshold)


def choose_anchor(clustered: DataFrame, threshold: int, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, offset, primary_t, target_t, hd, n: the anchor of the best cluster, none if its distances are too high.

    Best: two probes at least (else the largest), then most probes, least median distance, latest in the primary. Among
    clusters whose least distance is near the best one's, the latest in the primary wins.
    """
    return _best_cluster(clustered, threshold, cfg).select("pair_id", F.col("med_o").alias("offset"), F.col("med_p").alias("primary_t"), F.col("med_t").alias("target_t"), F.col("med_hd").alias("hd"), "n")


def anchor_frames(clustered: DataFrame, threshold: int, cfg: Config = DEFAULT) -> DataFrame:
    """choose_anchor with primary_frame and target_frame: those of the cluster's nearest probe (ties: least offset, first probe).

    The probes also have target_frame and primary_frame.
    """
    best = _best_cluster(clustered, threshold, cfg)
    probes = clustered.join(best.select("pair_id", "cluster"), ["pair_id", "cluster"], "left_semi")
    nearest = probes.groupBy("pair_id").agg(F.min(F.struct("hd", "offset", "id", "target_frame", "primary_frame")).alias("m"))
    return choose_anchor(clustered, threshold, cfg).join(nearest, "pair_id").select("pair_id", "offset", "primary_t", "target_t", "hd", "n", "m.target_frame", "m.primary_frame")
