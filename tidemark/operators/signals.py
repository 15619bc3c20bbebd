"""Signals on a grid of bins: energy, activity, cuts, and cross-correlation with bounded lags.

A signal is a table (media_id, bin, v) with a row for every bin. Windows run within a recording; correlation joins bins by
lag, keyed by pair, so that many pairs share the cluster. For long signals `correlate_long` uses one FFT a pair instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalar import peak_band, vertex_of_maximum
from .lineage import written
from .ranges import BLOCK, attach, blocks
from .ranks import SMALL, percentiles


def rms(pcm: DataFrame, full: int | None = None) -> DataFrame:
    """media_id, bin, rms of amplitudes (media_id, bin, amp); full: drop bins with another number of values."""
    out = pcm.groupBy("media_id", "bin").agg(F.sqrt(F.avg(F.col("amp") * F.col("amp")) + 1e-12).alias("rms"), F.count("*").alias("n"))
    return (out.where(F.col("n") == full) if full else out).drop("n")


def on_grid(values: DataFrame, bins: int, column: str, fill: float = 0.0) -> DataFrame:
    """A row for each of `bins` bins of each recording that has any value."""
    grid = values.select("media_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return grid.join(values, ["media_id", "bin"], "left").withColumn(column, F.coalesce(column, F.lit(fill)))


def activity(energy: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """media_id, bin, v (0 or 1): log energy above a threshold between two exact percentiles of the recording."""
    rows = energy.withColumn("level", F.log10(F.col("rms") + 1e-6))
    cut = rows.groupBy("media_id").agg(F.expr(f"percentile(level, array({cfg.low_pct}D, {cfg.high_pct}D))").alias("p"))
    limit = F.col("p")[0] + cfg.mix * (F.col("p")[1] - F.col("p")[0])
    return rows.join(cut, "media_id").select("media_id", "bin", (F.round("level", 9) > F.round(limit, 9)).cast("double").alias("v"))


def _by_bin(*more: str) -> Window:
    return Window.partitionBy("media_id", *more).orderBy("bin")


def smoothed(signal: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Holes of one bin filled, then blips of one bin removed; the end bins stay."""
    w = _by_bin(*by)

    def both(value: float) -> Column:
        return (F.lag("v").over(w) == value) & (F.lead("v").over(w) == value)

    filled = signal.withColumn("v", F.when((F.col("v") == 0) & both(1.0), 1.0).otherwise(F.col("v")))
    return filled.withColumn("v", F.when((F.col("v") == 1) & both(0.0), 0.0).otherwise(F.col("v")))


def smoothed_in_blocks(signal: DataFrame, size: int = BLOCK) -> DataFrame:
    """smoothed of recordings of any length: both steps look one bin to either side, so blocks of bins need a halo of two."""
    return smoothed(blocks(signal, 2, size, "bin"), ("_block",)).where("_own").drop("_block", "_own")


def kernel_smoothed_in_blocks(signal: DataFrame, size: int = BLOCK) -> DataFrame:
    """kernel_smoothed of recordings of any length, in blocks of bins."""
    return kernel_smoothed(blocks(signal, 2, size, "bin"), ("_block",)).where("_own").drop("_block", "_own")


def activity_of_long(energy: DataFrame, cfg: Config = DEFAULT, small: int = SMALL) -> DataFrame:
    """activity of recordings of any length: the two percentiles are found by narrowing instead of in one buffer a recording."""
    rows = energy.withColumn("level", F.log10(F.col("rms") + 1e-6))
    cut = written(percentiles(rows, ["media_id"], "level", [cfg.low_pct, cfg.high_pct], small).withColumnsRenamed({"n": "_n", "p": "_p"}))
    limit = F.col("_p")[0] + cfg.mix * (F.col("_p")[1] - F.col("_p")[0])
    return attach(rows, cut, ["media_id"]).select("media_id", "bin", (F.round("level", 9) > F.round(limit, 9)).cast("double").alias("v"))


def centred(signal: DataFrame) -> DataFrame:
    return signal.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("media_id")))


def speech_ratio(signal: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """media_id, ratio, ok: share of active bins, and whether it is enough."""
    out = signal.groupBy("media_id").agg(F.avg((F.col("v") > 0).cast("double")).alias("ratio"))
    return out.withColumn("ok", F.col("ratio") >= cfg.speech)


def cut_histogram(cuts: DataFrame, bins: int, bin_s: float) -> DataFrame:
    """media_id, bin, v: 1 where a cut falls (to the nearest bin, halves to even), 0 elsewhere."""
    at = cuts.select("media_id", F.bround(F.col("t") / bin_s).cast("long").alias("bin")).where(F.col("bin").between(0, bins - 1)).distinct()
    return on_grid(at.withColumn("v", F.lit(1.0)), bins, "v")


def kernel_smoothed(signal: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A five-bin kernel, zeros beyond the ends."""
    w = _by_bin(*by)
    terms = [(F.lag("v", 2), 0.25), (F.lag("v", 1), 0.5), (F.lead("v", 1), 0.5), (F.lead("v", 2), 0.25)]
    total = F.col("v")
    for f, k in terms:
        total = total + k * F.coalesce(f.over(w), F.lit(0.0))
    return signal.withColumn("v", total / 2.5)


def correlate(pairs: DataFrame, signal: DataFrame, lags: int) -> DataFrame:
    """pair_id, lag, x: sum over t of primary[t + lag] * target[t], for lags up to one beyond `lags` on both sides."""
    target = signal.where("v <> 0").select(F.col("media_id").alias("target_id"), F.col("bin").alias("tb"), F.col("v").alias("tv"))
    primary = signal.where("v <> 0").select(F.col("media_id").alias("primary_id"), F.col("bin").alias("pb"), F.col("v").alias("pv"))
    spread = pairs.join(target, "target_id").withColumn("lag", F.explode(F.sequence(F.lit(-lags - 1), F.lit(lags + 1)))).withColumn("pb", F.col("tb") + F.col("lag"))
    products = spread.join(primary, ["primary_id", "pb"]).groupBy("pair_id", "lag").agg(F.sum(F.col("pv") * F.col("tv")).alias("x"))
    every = pairs.select("pair_id").withColumn("lag", F.explode(F.sequence(F.lit(-lags - 1), F.lit(lags + 1))))
    return every.join(products, ["pair_id", "lag"], "left").select("pair_id", "lag", F.coalesce("x", F.lit(0.0)).alias("x"))


def correlate_long(pairs: DataFrame, signal: DataFrame, lags: int, block: int = 8192) -> DataFrame:
    """correlate by FFT in blocks, for signals whose bins times lags would be too many rows.

    The target is cut into blocks of bins (at least as long as the lags reach); a block meets the primary's bins that its lags
    touch, which neighbouring blocks share. Each block's sums by lag come from one transform of its own, and the sums of a pair's blocks
    are added. So a pair, however long, is shared by many tasks, and a task holds about three blocks of bins.
    """
    reach = lags + 1
    block = max(block, 2 * reach)
    own = F.expr(f"floor(bin / {block})")
    target = pairs.select("pair_id", F.col("target_id").alias("media_id")).join(signal, "media_id").select("pair_id", own.alias("block"), F.lit(1).alias("side"), "bin", "v")
    primary = pairs.select("pair_id", F.col("primary_id").alias("media_id")).join(signal, "media_id")
    touched = F.sequence(F.expr(f"floor((bin - {reach}) / {block})"), F.expr(f"floor((bin + {reach}) / {block})"))
    primary = primary.select("pair_id", F.explode(touched).alias("block"), F.lit(0).alias("side"), "bin", "v")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[1]) * block
        t, p = np.zeros(block), np.zeros(block + 2 * reach)
        for side, out, start in ((1, t, first), (0, p, first - reach)):
            rows = pdf[pdf["side"] == side]
            out[rows["bin"].to_numpy() - start] = rows["v"].to_numpy()
        size = 1 << (len(p) - 1).bit_length()
        full = np.fft.irfft(np.fft.rfft(p, size) * np.conj(np.fft.rfft(t, size)), size)
        return pd.DataFrame({"pair_id": key[0], "lag": np.arange(-reach, reach + 1), "x": full[: 2 * reach + 1]})

    parts = target.unionByName(primary).groupBy("pair_id", "block").applyInPandas(run, "pair_id long, lag int, x double")
    return parts.groupBy("pair_id", "lag").agg(F.sum("x").alias("x"))


def best_lag(corr: DataFrame, lags: int, bin_s: float, digits: int = 9) -> DataFrame:
    """pair_id, lag, x, shift, offset: the first greatest value within the bound; neighbours beyond the bound count for the vertex."""
    corr = corr.withColumn("x", F.round("x", digits))
    peak = corr.where(F.abs("lag") <= lags).groupBy("pair_id").agg(F.min(F.struct((-F.col("x")).alias("nx"), "lag")).alias("m")).select("pair_id", F.col("m.lag").alias("at"))
    around = corr.join(peak, "pair_id").groupBy("pair_id", "at").agg(*(F.max(F.when(F.col("lag") == F.col("at") + d, F.col("x"))).alias(n) for d, n in ((-1, "before"), (0, "x"), (1, "after"))))
    shift = vertex_of_maximum(F.col("before"), F.col("x"), F.col("after"))
    return around.select("pair_id", F.col("at").alias("lag"), "x", shift.alias("shift")).withColumn("offset", (F.col("lag") + F.col("shift")) * F.lit(bin_s))


def offset_by_signal(pairs: DataFrame, signal: DataFrame, lags: int, bin_s: float, bands: tuple[float, float]) -> DataFrame:
    """pair_id, lag, offset, peak, confidence from centred signals; the peak is the integer one over the norms."""
    power = signal.groupBy("media_id").agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    best = best_lag(correlate(pairs, signal, lags), lags, bin_s)
    rows = best.join(pairs, "pair_id").join(power.select(F.col("media_id").alias("primary_id"), F.col("e").alias("pe")), "primary_id").join(power.select(F.col("media_id").alias("target_id"), F.col("e").alias("te")), "target_id")
    peak = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x") / (F.sqrt(F.col("pe") * F.col("te")) + 1e-12))), 9)
    return rows.withColumn("peak", peak).select("pair_id", "lag", "offset", "peak", peak_band(F.col("peak"), bands).alias("confidence"))


def audio_signal(pcm: DataFrame, bins: int, cfg: Config = DEFAULT) -> DataFrame:
    """Amplitudes to a centred activity signal."""
    return centred(smoothed(activity(on_grid(rms(pcm), bins, "rms"), cfg)))


def cut_signal(cuts: DataFrame, bins: int, bin_s: float) -> DataFrame:
    """Cuts to a centred, smoothed signal."""
    return centred(kernel_smoothed(cut_histogram(cuts, bins, bin_s)))


def cut_offset(pairs: DataFrame, cuts: DataFrame, bins: int, bin_s: float, lags: int, cfg: Config = DEFAULT) -> DataFrame:
    """offset_by_signal on cuts; pairs with too few cuts on a side have no row."""
    enough = cuts.groupBy("media_id").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.min_cuts)
    ok = pairs.join(enough.select(F.col("media_id").alias("primary_id")), "primary_id", "left_semi").join(enough.select(F.col("media_id").alias("target_id")), "target_id", "left_semi")
    return offset_by_signal(ok, cut_signal(cuts, bins, bin_s), lags, bin_s, cfg.cut_bands)


def window_offsets(windows: DataFrame, energy: DataFrame, bin_s: float, lags: int, cfg: Config = DEFAULT) -> DataFrame:
    """name, offset, peak: the lag between the activity of the two sides of each window; no row where a side is too still.

    windows: name (unique), primary_id, target_id, primary_b0, target_b0 (first bins), nb (bins). energy: media_id, bin, rms.
    The activity threshold is taken anew within each window.
    """
    side_id = {side: F.concat_ws(":", "name", F.lit(side)) for side in ("primary", "target")}
    look = energy.select("media_id", F.col("bin").alias("eb"), "rms")
    parts = []
    for side, name in side_id.items():
        grid = windows.select(name.alias("side_id"), F.col(f"{side}_id").alias("media_id"), F.col(f"{side}_b0").alias("b0"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("bin"))
        rows = grid.withColumn("eb", F.col("b0") + F.col("bin")).join(look, ["media_id", "eb"], "left")
        parts.append(rows.select(F.col("side_id").alias("media_id"), "bin", F.coalesce("rms", F.lit(1e-6)).alias("rms")))
    active = smoothed(activity(parts[0].unionByName(parts[1]), cfg))
    loud = active.groupBy("media_id").agg(F.avg("v").alias("share")).where(F.col("share") >= cfg.speech).select("media_id")
    signal = written(centred(active).join(loud, "media_id", "left_semi"))
    ids = windows.select(F.col("name").alias("pair_id"), side_id["primary"].alias("primary_id"), side_id["target"].alias("target_id"))
    return offset_by_signal(ids, signal, lags, bin_s, cfg.audio_bands).select(F.col("pair_id").alias("name"), "offset", "peak")


def refine_segments(segments: DataFrame, energy: DataFrame, bin_s: float, cfg: Config = DEFAULT, min_length: float | None = None, min_bins: int | None = None, residual: int = 2) -> DataFrame:
    """pair_id, seg_no, offset, peak: the audio offset of each segment, searched around its own.

    segments: pair_id, seg_no, primary_id, target_id, target_start, target_end, offset. energy: media_id, bin, rms. Windows that
    are too short or too still, and low peaks, have no row.
    """
    min_length, min_bins = cfg.refine_min_length if min_length is None else min_length, cfg.refine_min_bins if min_bins is None else min_bins
    shift = F.greatest(F.lit(0.0), -(F.col("target_start") + F.col("offset")))
    seg = segments.withColumn("t0", F.col("target_start") + shift).withColumn("t1", F.col("target_end")).where(F.col("t1") - F.col("t0") >= min_length)
    seg = seg.withColumn("nb", F.floor((F.col("t1") - F.col("t0")) / bin_s).cast("long")).where(F.col("nb") >= min_bins)
    first = {"target_b0": F.floor(F.col("t0") / bin_s).cast("long"), "primary_b0": F.bround((F.col("t0") + F.col("offset")) / bin_s).cast("long")}
    seg = seg.withColumns(first | {"name": F.concat_ws(":", "pair_id", "seg_no")})
    found = window_offsets(seg, energy, bin_s, residual, cfg).where(F.col("peak") >= cfg.refine_peak)
    return seg.join(found.select("name", F.col("offset").alias("residual"), "peak"), "name").select("pair_id", "seg_no", (F.col("offset") + F.col("residual")).alias("offset"), "peak")


def drift_windows(windows: DataFrame, energy: DataFrame, bin_s: float, cfg: Config = DEFAULT, min_length: float = 5.0) -> DataFrame:
    """pair_id, window_no, w_start, w_end, delta_ms, peak: what is left of the offset in each window of an aligned pair.

    windows: pair_id, window_no, primary_id, target_id, w_start, w_end, the same times on both sides. Windows that are too
    short, too still on a side or without a clear peak within the greatest lag have no row.
    """
    w = windows.where(F.col("w_end") - F.col("w_start") >= min_length)
    b0 = F.floor(F.col("w_start") / bin_s).cast("long")
    w = w.withColumns({"name": F.concat_ws(":", "pair_id", "window_no"), "primary_b0": b0, "target_b0": b0, "nb": F.floor((F.col("w_end") - F.col("w_start")) / bin_s).cast("long")}).where("nb > 0")
    found = window_offsets(w, energy, bin_s, max(1, round(cfg.verify_lag / bin_s)), cfg).where(F.col("peak") >= cfg.verify_peak)
    return w.join(found, "name").select("pair_id", "window_no", "w_start", "w_end", (F.col("offset") * 1000).alias("delta_ms"), "peak")
