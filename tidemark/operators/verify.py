"""What is left after alignment: cut pairing, drift summaries, issues and report lines."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalar import audio_limit_ms, shown, timecode, visual_limit_ms


def near_cuts(primary: DataFrame, synced: DataFrame, tolerance: float) -> DataFrame:
    """pair_id, p_id, p_t, s_id, s_t, gap of all cuts within the tolerance: an equi-join on buckets of its width."""
    p = primary.select("pair_id", F.col("id").alias("p_id"), F.col("t").alias("p_t")).withColumn("b", F.explode(F.expr(f"sequence(cast(floor(p_t / {tolerance}) as bigint) - 1, cast(floor(p_t / {tolerance}) as bigint) + 1)")))
    s = synced.select("pair_id", F.col("id").alias("s_id"), F.col("t").alias("s_t"), F.floor(F.col("t") / tolerance).cast("long").alias("b"))
    return p.join(s, ["pair_id", "b"]).withColumn("gap", F.round(F.abs(F.col("p_t") - F.col("s_t")), 6)).where(F.col("gap") <= tolerance).drop("b")


def nearest_cut(primary: DataFrame, synced: DataFrame, tolerance: float) -> DataFrame:
    """pair_id, p_id, s_id, gap: the nearest cut of each primary cut, the earlier on ties; cuts may be shared."""
    return near_cuts(primary, synced, tolerance).groupBy("pair_id", "p_id").agg(F.min(F.struct("gap", "s_t", "s_id")).alias("m")).select("pair_id", "p_id", F.col("m.s_id").alias("s_id"), F.col("m.gap").alias("gap"))


def mutual_cuts(primary: DataFrame, synced: DataFrame, tolerance: float) -> DataFrame:
    """pair_id, p_id, s_id, gap: cuts that are each other's nearest."""
    near = near_cuts(primary, synced, tolerance)
    a = F.row_number().over(Window.partitionBy("pair_id", "p_id").orderBy("gap", "s_t", "s_id"))
    b = F.row_number().over(Window.partitionBy("pair_id", "s_id").orderBy("gap", "p_t", "p_id"))
    return near.withColumns({"a": a, "b": b}).where("a = 1 AND b = 1").select("pair_id", "p_id", "s_id", "gap")


def greedy_matches(p: list[tuple[float, int]], s: list[tuple[float, int]], tolerance: float) -> list[tuple[int, int, float]]:
    """Each primary cut in order takes the nearest cut not yet taken, the earlier on ties, within the tolerance."""
    times, taken, out = [t for t, _ in s], set(), []
    for t, i in p:
        best = None
        for k in range(bisect.bisect_left(times, t - tolerance - 1e-6), bisect.bisect_right(times, t + tolerance + 1e-6)):
            gap = round(abs(times[k] - t), 6)
            if k not in taken and gap <= tolerance and (best is None or gap < best[1]):
                best = (k, gap)
        if best:
            taken.add(best[0])
            out.append((i, s[best[0]][1], best[1]))
    return out


def cut_stretches(primary: DataFrame, synced: DataFrame, tolerance: float) -> DataFrame:
    """pair_id, stretch, side (0 primary, 1 synced), id, t: a stretch ends where the next cut is beyond the tolerance, so no match crosses."""
    both = primary.select("pair_id", F.lit(0).alias("side"), "id", "t").unionByName(synced.select("pair_id", F.lit(1).alias("side"), "id", "t"))
    w = Window.partitionBy("pair_id").orderBy("t", "side", "id")
    far = F.coalesce(F.col("t") - F.lag("t").over(w) > tolerance + 1e-6, F.lit(False)).cast("int")
    return both.where("t IS NOT NULL").withColumn("far", far).withColumn("stretch", F.sum("far").over(w)).drop("far")


def pair_cuts(primary: DataFrame, synced: DataFrame, tolerance: float = DEFAULT.pair_cuts) -> DataFrame:
    """pair_id, p_id, s_id, p_t, s_t, gap: the greedy one-to-one pairing, walked a stretch of cuts at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = [sorted(zip(x["t"], x["id"], strict=True)) for x in (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1])]
        rows = greedy_matches(*([(t, i) for i, (t, _) in enumerate(x)] for x in side), tolerance)
        p, s = [side[0][r[0]] for r in rows], [side[1][r[1]] for r in rows]
        columns = {"p_id": [x[1] for x in p], "s_id": [x[1] for x in s], "p_t": [x[0] for x in p], "s_t": [x[0] for x in s], "gap": [r[2] for r in rows]}
        return pd.DataFrame({"pair_id": pdf["pair_id"].iloc[0], **columns})

    out = "pair_id long, p_id long, s_id long, p_t double, s_t double, gap double"
    whole = Window.partitionBy("pair_id", "stretch")
    both = cut_stretches(primary, synced, tolerance).withColumn("sides", F.max("side").over(whole) - F.min("side").over(whole)).where("sides = 1")
    return both.groupBy("pair_id", "stretch").applyInPandas(run, out)


def scene_drift(matches: DataFrame, fps: float) -> DataFrame:
    """matches of pair_cuts with delta_frames and delta_ms: how much later the synced cut comes, negative if earlier."""
    late = F.round(F.col("s_t") - F.col("p_t"), 6)
    return matches.withColumns({"delta_frames": late * fps, "delta_ms": late * 1000})


def scene_counts(primary: DataFrame, synced: DataFrame, matches: DataFrame) -> DataFrame:
    """pair_id, cuts_primary, cuts_synced, unmatched_primary, unmatched_synced of every pair with a cut."""
    one, none = F.lit(1), F.lit(0)
    rows = primary.select("pair_id", one.alias("p"), none.alias("s"), none.alias("m")).unionByName(synced.select("pair_id", none.alias("p"), one.alias("s"), none.alias("m")))
    rows = rows.unionByName(matches.select("pair_id", none.alias("p"), none.alias("s"), one.alias("m")))
    g = rows.groupBy("pair_id").agg(F.sum("p").alias("cuts_primary"), F.sum("s").alias("cuts_synced"), F.sum("m").alias("m"))
    return g.select("pair_id", "cuts_primary", "cuts_synced", (F.col("cuts_primary") - F.col("m")).alias("unmatched_primary"), (F.col("cuts_synced") - F.col("m")).alias("unmatched_synced"))


def unmet(wanted: DataFrame, met: DataFrame, column: str) -> DataFrame:
    """pair_id and, under the given name, how many of a pair's wanted rows (references, windows) have no row in met."""
    rows = wanted.select("pair_id", F.lit(1).alias("n")).unionByName(met.select("pair_id", F.lit(-1).alias("n")))
    return rows.groupBy("pair_id").agg(F.sum("n").alias(column))


def drift_summary(drift: DataFrame, fps: float) -> DataFrame:
    """pair_id, n, max_frames, mean_frames, max_ms, within_half from pair_id, delta_frames."""
    size = F.abs("delta_frames")
    return drift.groupBy("pair_id").agg(F.count("*").alias("n"), F.max(size).alias("max_frames"), F.avg(size).alias("mean_frames"), (F.max(size) * 1000 / fps).alias("max_ms"), F.avg((size <= 0.5).cast("double")).alias("within_half"))


def drift_issues(summaries: DataFrame) -> DataFrame:
    """pair_id, n_issues, issues from pair_id, fps and the greatest drift of each kind in ms (null without samples)."""
    limit, audio = visual_limit_ms(F.col("fps")), audio_limit_ms(F.col("fps"))
    kinds = (("visual_ms", "visual", limit), ("audio_ms", "audio", audio), ("scene_ms", "scene-cut", limit))
    found = F.array_compact(F.array(*(F.when(F.col(c) > lim, F.format_string(f"{name} max %.2f ms (thr %.2f ms)", shown(F.col(c), 2), shown(lim, 2))) for c, name, lim in kinds)))
    return summaries.select("pair_id", F.size(found).alias("n_issues"), F.array_join(found, "; ").alias("issues"))


def report_lines(drift: DataFrame, fps: float, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, line_no, line: a summary line for each pair, then one for each moment over half a frame, in time order."""
    limit = 500.0 / fps
    s = drift_summary(drift, fps)
    head = s.select("pair_id", F.lit(0).alias("o"), F.lit(-1.0).alias("t"), F.lit(-1).cast("long").alias("id"), F.format_string("samples %d, max %.3f frames, mean %.3f frames, within half a frame %.1f%%", F.col("n"), shown(F.col("max_frames"), 3), shown(F.col("mean_frames"), 3), shown(F.col("within_half") * 100, 1)).alias("line"))
    over = drift.where(F.round(F.abs(F.col("delta_frames")) * 1000 / fps, 6) > round(limit, 6))
    body = over.select("pair_id", F.lit(1).alias("o"), "t", "id", F.concat_ws(" ", timecode(F.col("t"), F.lit(fps)), F.format_string("%+.2f", shown(F.col("delta_frames"), 2))).alias("line"))
    w = Window.partitionBy("pair_id").orderBy("o", "t", "id")
    return head.unionByName(body).select("pair_id", (F.row_number().over(w) - 1).alias("line_no"), "line")


def write_report(lines: DataFrame, path: str) -> None:
    """Text files, one folder for each pair, lines in order."""
    lines.repartition("pair_id").sortWithinPartitions("pair_id", "line_no").select("pair_id", F.col("line").alias("value")).write.partitionBy("pair_id").mode("overwrite").text(path)


def verification_report(visual: DataFrame, audio: DataFrame, scene: DataFrame, pairs: DataFrame, fps: float, counts: tuple[DataFrame, ...] = ()) -> DataFrame:
    """One row a pair: counts and greatest drifts of the three checks (0 without samples) and the issues.

    visual: verify_visual; audio: signals.drift_windows; scene: scene_drift; counts: tables keyed by pair whose columns (what
    the checks left out) join the report, 0 where a pair has no row.
    """
    v = drift_summary(visual, fps).select("pair_id", F.col("n").alias("visual_n"), F.col("max_ms").alias("visual_ms"), F.col("within_half").alias("visual_half"))
    a = audio.groupBy("pair_id").agg(F.count("*").alias("audio_n"), F.max(F.abs("delta_ms")).alias("audio_ms"))
    s = drift_summary(scene, fps).select("pair_id", F.col("n").alias("scene_n"), F.col("max_ms").alias("scene_ms"))
    rows = pairs.select("pair_id").withColumn("fps", F.lit(fps))
    for part in (v, a, s, *counts):
        rows = rows.join(part, "pair_id", "left")
    out = rows.join(drift_issues(rows), "pair_id")
    whole = [c for c in out.columns if c.endswith("_n") and c != "n_issues"] + [c for t in counts for c in t.columns if c != "pair_id"]
    return out.na.fill(0, whole).na.fill(0.0, [c for c in out.columns if c.endswith(("_ms", "_half"))]).drop("fps")
