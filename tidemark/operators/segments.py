"""Segments of constant offset: walkers along time, boundaries at dark intervals, playback chunks.

The walkers carry state from sample to sample, so each runs once over a pair's samples in order (a pair has some dozens, at
most some thousands); the one by mean also walks a pair's blocks in parallel (`grouped_samples_in_blocks`). Everything else is
windows and joins keyed by pair.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .lineage import written
from .ranges import BLOCK, attach, blocks, numbered, running_sum
from .stats import upper_median

SAMPLE_TYPES = "pair_id long, id long, target_t double, offset double, hd int, grp int"


#: Seconds of a bucket of time in which gaps meet dark intervals.
BUCKET = 3600.0


def walk_by_mean(rows: list[tuple[float, int]], cfg: Config = DEFAULT) -> list[int]:
    """Group of each (offset, hd) in time order, -1 for those dropped: groups follow their running mean.

    A far sample waits; a second that agrees with it opens a group with both, another one takes its place, and a near one
    clears it. One that waits at the end is a group of its own if its distance is low.
    """
    out, group, total, count, waiting = [-1] * len(rows), 0, 0.0, 0, None
    for i, (offset, _) in enumerate(rows):
        if not count or round(abs(offset - total / count), 9) <= cfg.new_delta:
            out[i], total, count, waiting = group, total + offset, count + 1, None
        elif waiting is not None and round(abs(offset - rows[waiting][0]), 9) <= cfg.jump:
            group += 1
            out[waiting] = out[i] = group
            total, count, waiting = rows[waiting][0] + offset, 2, None
        else:
            waiting = i
    if waiting is not None and rows[waiting][1] <= cfg.solo_hd:
        out[waiting] = group + 1
    return out


def walk_by_median(rows: list[tuple[float, int]], cfg: Config = DEFAULT) -> list[int]:
    """As walk_by_mean around the upper median, with one tolerance; one that waits at the end is dropped."""
    import bisect

    out, group, have, waiting = [-1] * len(rows), 0, [], None
    for i, (offset, _) in enumerate(rows):
        if not have or round(abs(offset - have[len(have) // 2]), 9) <= cfg.cluster_tolerance:
            out[i], waiting = group, None
            bisect.insort(have, offset)
        elif waiting is not None and round(abs(offset - rows[waiting][0]), 9) <= cfg.cluster_tolerance:
            group += 1
            out[waiting] = out[i] = group
            have, waiting = sorted([rows[waiting][0], offset]), None
        else:
            waiting = i
    return out


def grouped_samples(samples: DataFrame, walker=walk_by_mean, cfg: Config = DEFAULT) -> DataFrame:
    """The usable samples that belong to a group, with grp (from 0, in time order)."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["target_t", "id"])
        pdf["grp"] = walker(list(zip(pdf["offset"], pdf["hd"], strict=True)), cfg)
        return pdf[pdf["grp"] >= 0]

    return samples.where(F.col("hd") <= cfg.max_hd).select("pair_id", "id", "target_t", "offset", "hd").groupBy("pair_id").applyInPandas(walk, SAMPLE_TYPES)


def walk_block(rows: list[float], before: float | None, total: float, count: int, waits: bool, cfg: Config = DEFAULT) -> tuple[list[int], bool, int, float, int, bool]:
    """One block of walk_by_mean from the state at its start: the sum and count of the group so far, and whether `before`, the row before, waits.

    Gives the group of each row, counted from the one at the start (-1 for none), whether the row before went into the block's first
    new group, the number of new groups, the sum and count of the rows that the block adds to the group at its end, and whether its last
    row waits. A row waits at most until the next one, so one row before the block is all that is needed.
    """
    out, opened, group, added, n, last = [-1] * len(rows), False, 0, 0.0, 0, before
    for i, offset in enumerate(rows):
        if not count + n or round(abs(offset - (total + added) / (count + n)), 9) <= cfg.new_delta:
            out[i], added, n, waits = group, added + offset, n + 1, False
        elif waits and round(abs(offset - last), 9) <= cfg.jump:
            group += 1
            out[i] = group
            if i:
                out[i - 1] = group
            else:
                opened = True
            total, count, added, n, waits = 0.0, 0, last + offset, 2, False
        else:
            waits = True
        last = offset
    return out, opened, group, added, n, waits


def _entries(effects: DataFrame) -> DataFrame:
    """The state at the start of each block, from what the blocks before it did: pair_id, _block, e_total, e_count, e_waits, e_base, last."""
    pair = Window.partitionBy("pair_id").orderBy("_block")
    since = effects.withColumn("fresh", F.sum(F.when(F.col("opens") > 0, 1).otherwise(0)).over(pair))
    run = Window.partitionBy("pair_id", "fresh").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    ends = since.withColumns({"total": F.sum("added").over(run), "count": F.sum("n").over(run), "base": F.sum("opens").over(pair)})
    lag = lambda c, none: F.coalesce(F.lag(c).over(pair), F.lit(none))
    state = {"e_total": lag("total", 0.0), "e_count": lag("count", 0), "e_waits": lag("waits", False), "e_base": lag("base", 0), "last": F.lead("_block").over(pair).isNull()}
    return ends.select("pair_id", "_block", *(c.alias(k) for k, c in state.items()))


def mean_states(parts: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, list[int]]:
    """(states, walked): the state of walk_by_mean at the start of each block of `parts` and how many blocks each round walked.

    All blocks are walked from a guess (no group yet), what each adds is summed over the blocks before it, and those whose state at the start
    differs from the one they were walked from are walked again, until none does. Each round settles at least the first unsettled
    block of every pair; a block whose decisions do not hang on the guess is settled by the second. Only one row a block is kept between rounds.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, first = pdf.sort_values("_place"), pdf.iloc[0]
        own = pdf["_own"].to_numpy()
        lead = None if own[0] else float(pdf["offset"].iloc[0])
        _, _, opens, added, n, waits = walk_block(pdf["offset"][own].tolist(), lead, first["e_total"], first["e_count"], first["e_waits"], cfg)
        return pd.DataFrame([(first["pair_id"], first["_block"], opens, added, n, waits)], columns=["pair_id", "_block", "opens", "added", "n", "waits"])

    kind = parts.schema["pair_id"].dataType.simpleString()
    did = f"pair_id {kind}, _block long, opens long, added double, n long, waits boolean"
    guess = parts.where("_own").select("pair_id", "_block").distinct().select("*", F.lit(0.0).alias("e_total"), F.lit(0).cast("long").alias("e_count"), F.lit(False).alias("e_waits"))
    todo, effects, used, walked = written(guess), None, None, []
    states = _entries(parts.sparkSession.createDataFrame([], did))
    fields = ["e_total", "e_count", "e_waits"]
    while (left := todo.count()) > 0:
        walked.append(left)
        fresh = attach(parts, todo, ["pair_id", "_block"]).groupBy("pair_id", "_block").applyInPandas(walk, did)
        fresh = written(fresh)
        at = lambda a, b: a["pair_id"].eqNullSafe(b["pair_id"]) & (a["_block"] == b["_block"])
        effects = fresh if effects is None else written(effects.join(fresh, at(effects, fresh), "left_anti").unionByName(fresh))
        used = todo if used is None else written(used.join(todo, at(used, todo), "left_anti").unionByName(todo))
        states = written(_entries(effects))
        old = used.select(F.col("pair_id").alias("u_pair"), F.col("_block").alias("u_block"), *(F.col(c).alias(f"u_{c}") for c in fields))
        other = F.lit(False)
        for c in fields:
            other = other | ~F.col(c).eqNullSafe(F.col(f"u_{c}"))
        met = states.join(old, F.col("pair_id").eqNullSafe(F.col("u_pair")) & (F.col("_block") == F.col("u_block")))
        todo = written(met.where(other).select("pair_id", "_block", *fields))
    return states, walked


def grouped_samples_in_blocks(samples: DataFrame, cfg: Config = DEFAULT, size: int = BLOCK) -> DataFrame:
    """grouped_samples with walk_by_mean, of pairs of any number of samples: their blocks are walked side by side.

    The sum of a group is added up by blocks, so its mean may differ from the plain walk's in the last bits, far below the nine digits that are compared.
    Samples without an offset take no part. Rows that tie in target_t and id may fall in either order.
    """
    usable = samples.where((F.col("hd") <= cfg.max_hd) & F.col("offset").isNotNull()).select("pair_id", "id", "target_t", "offset", "hd")
    placed = numbered(usable, ["pair_id"], ["target_t", "id"])
    # a block needs the row before it and not the one after
    parts = written(blocks(placed, 1, size).where(F.col("_own") | (F.floor(F.col("_place") / size) < F.col("_block"))))
    states, _ = mean_states(parts, cfg)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place").reset_index(drop=True)
        own, first = pdf["_own"].to_numpy(), pdf.iloc[0]
        lead = None if own[0] else float(pdf["offset"].iloc[0])
        out, opened, opens, _, _, waits = walk_block(pdf["offset"][own].tolist(), lead, first["e_total"], first["e_count"], first["e_waits"], cfg)
        if first["last"] and waits and pdf["hd"].iloc[-1] <= cfg.solo_hd:
            out[-1] = opens + 1
        pdf["grp"] = ([] if own[0] else [1 if opened else -1]) + out
        pdf = pdf[pdf["grp"] >= 0]
        return pdf.assign(grp=pdf["grp"] + int(first["e_base"]))[["pair_id", "id", "target_t", "offset", "hd", "grp"]]

    return attach(parts, states, ["pair_id", "_block"]).groupBy("pair_id", "_block").applyInPandas(walk, SAMPLE_TYPES)


def segments_from_groups(grouped: DataFrame, durations: DataFrame) -> DataFrame:
    """pair_id, seg_no, target_start, target_end, offset: bounds midway between groups; durations: pair_id, duration."""
    g = grouped.groupBy("pair_id", "grp").agg(F.avg("offset").alias("offset"), F.min("target_t").alias("first_t"), F.max("target_t").alias("last_t"))
    w = Window.partitionBy("pair_id").orderBy("grp")
    start = F.coalesce((F.lag("last_t").over(w) + F.col("first_t")) / 2, F.lit(0.0))
    end = F.coalesce((F.col("last_t") + F.lead("first_t").over(w)) / 2, F.col("duration"))
    return g.join(durations, "pair_id").select("pair_id", F.col("grp").cast("int").alias("seg_no"), start.alias("target_start"), end.alias("target_end"), "offset")


def clusters(grouped: DataFrame) -> DataFrame:
    """pair_id, grp, n, upper, first_p, last_p: of groups, in primary time."""
    p = grouped.withColumn("p", F.col("target_t") + F.col("offset"))
    return p.groupBy("pair_id", "grp").agg(F.count("*").alias("n"), upper_median("offset").alias("upper"), F.min("p").alias("first_p"), F.max("p").alias("last_p"))


def _within(gaps: DataFrame, points: DataFrame, bucket: float, how: str) -> DataFrame:
    """gaps (pair_id, lo, hi, ...) joined to points (b_pair, mid, ...) strictly inside: an equi-join on buckets of time."""
    first, last = F.floor(F.col("lo") / bucket).cast("long"), F.floor(F.col("hi") / bucket).cast("long")
    spread = gaps.where("lo < hi").withColumn("g_bucket", F.explode(F.sequence(first, last)))
    placed = points.withColumn("b_bucket", F.floor(F.col("mid") / bucket).cast("long"))
    inside = (F.col("pair_id") == F.col("b_pair")) & (F.col("g_bucket") == F.col("b_bucket")) & (F.col("lo") < F.col("mid")) & (F.col("mid") < F.col("hi"))
    return spread.join(placed, inside, how).drop("g_bucket", "b_bucket")


def blocking_gaps(gaps: DataFrame, blacks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The gaps (pair_id, lo, hi, ...) that hold the middle of a long enough dark interval."""
    mid = (F.col("b_start") + F.col("b_end")) / 2
    long_ = blacks.where(F.round(F.col("b_end") - F.col("b_start"), 9) >= cfg.blocking).select(F.col("pair_id").alias("b_pair"), mid.alias("mid"))
    return _within(gaps, long_, BUCKET, "left_semi").distinct()


def merge_first_single(grouped: DataFrame, blacks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A first group of one sample joins the next if their offsets are near and no long dark interval lies between.

    Only the first group can have one sample (later ones open with two), so one step is all there is.
    """
    w = Window.partitionBy("pair_id").orderBy("grp")
    c = clusters(grouped).withColumns({"next_n": F.lead("n").over(w), "next_upper": F.lead("upper").over(w), "hi": F.lead("first_p").over(w)}).withColumn("lo", F.col("last_p"))
    near = c.where((F.col("grp") == 0) & (F.col("n") == 1) & (F.col("next_n") >= 2) & (F.round(F.abs(F.col("upper") - F.col("next_upper")), 9) <= cfg.merge))
    ok = near.join(blocking_gaps(near, blacks, cfg).select("pair_id"), "pair_id", "left_anti").select(F.col("pair_id").alias("m_pair"), F.lit(True).alias("merge"))
    moved = F.when(F.coalesce("merge", F.lit(False)) & (F.col("grp") == 0), 1).otherwise(F.col("grp"))
    return grouped.join(ok, F.col("pair_id") == F.col("m_pair"), "left").withColumn("grp", moved).drop("m_pair", "merge")


def boundary_in_gaps(gaps: DataFrame, blacks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """gaps (pair_id, gap_no, lo, hi) with boundary: the middle of the best dark interval within, else of the gap.

    An interval scores its length times its distance to the nearest other one of the pair, the distance held to a range.
    """
    w = Window.partitionBy("pair_id").orderBy("b_start", "b_end")
    apart = F.least(F.coalesce(F.col("b_start") - F.lag("b_end").over(w), F.lit(cfg.isolation[1])), F.coalesce(F.lead("b_start").over(w) - F.col("b_end"), F.lit(cfg.isolation[1])))
    score = F.round((F.col("b_end") - F.col("b_start")) * F.greatest(F.lit(cfg.isolation[0]), F.least(F.lit(cfg.isolation[1]), apart)), 9)
    scored = blacks.select(F.col("pair_id").alias("b_pair"), "b_start", ((F.col("b_start") + F.col("b_end")) / 2).alias("mid"), score.alias("score"))
    inside = _within(gaps, scored, BUCKET, "inner")
    best = inside.groupBy("pair_id", "gap_no").agg(F.min(F.struct((-F.col("score")).alias("s"), "b_start", "mid")).alias("m"))
    return gaps.join(best, ["pair_id", "gap_no"], "left").select("pair_id", "gap_no", "lo", "hi", F.coalesce("m.mid", (F.col("lo") + F.col("hi")) / 2).alias("boundary"))


def segments_with_blacks(samples: DataFrame, blacks: DataFrame, durations: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, seg_no, target_start, target_end, offset, phash_inliers, phash_stdev: clusters with boundaries at dark intervals.

    A pair with one cluster gets one segment over its length, without statistics; one with fewer than two usable samples, or
    without a segment left, falls back on the walker by mean. The groups are read several times and so are written.
    """
    raw = written(grouped_samples(samples, walk_by_median, cfg))
    grouped = written(merge_first_single(raw, blacks, cfg))
    pair = Window.partitionBy("pair_id")
    w = pair.orderBy("grp")
    c = clusters(grouped).withColumns({"hi": F.lead("first_p").over(w), "k": F.count("*").over(pair), "no": F.row_number().over(w)})
    gaps = c.where("hi IS NOT NULL").select("pair_id", F.col("no").alias("gap_no"), F.col("last_p").alias("lo"), "hi")
    bounds = boundary_in_gaps(gaps, blacks, cfg).select("pair_id", "gap_no", "boundary")
    med = grouped.groupBy("pair_id", "grp").agg(F.median("offset").alias("med"))
    near = grouped.join(med, ["pair_id", "grp"]).where(F.round(F.abs(F.col("offset") - F.col("med")), 9) <= cfg.cluster_tolerance)
    stats = near.groupBy("pair_id", "grp").agg(F.avg("offset").alias("offset"), F.count("*").cast("int").alias("phash_inliers"), F.stddev_pop("offset").alias("phash_stdev"))
    many = c.where("k > 1").join(stats, ["pair_id", "grp"]).join(durations, "pair_id")
    many = many.join(bounds.withColumnRenamed("gap_no", "no"), ["pair_id", "no"], "left").withColumn("before", F.lag("boundary").over(pair.orderBy("no")))
    start = F.when(F.col("no") == 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("before") - F.col("offset")))
    end = F.least(F.col("duration"), F.when(F.col("no") == F.col("k"), F.col("duration")).otherwise(F.greatest(F.col("target_start") + 0.001, F.col("boundary") - F.col("offset"))))
    columns = ["pair_id", "target_start", "target_end", "offset", "phash_inliers", "phash_stdev"]
    many = many.withColumn("target_start", start).withColumn("target_end", end).where("target_end > target_start").select(*columns)
    usable = samples.where(F.col("hd") <= cfg.max_hd)
    enough = usable.groupBy("pair_id").agg(F.count("*").alias("u"), F.median("offset").alias("med")).where("u >= 2")
    lone = c.where((F.col("k") == 1) & (F.col("no") == 1)).select("pair_id").join(enough, "pair_id").join(durations, "pair_id")
    inner = usable.join(lone.select("pair_id", "med"), "pair_id").where(F.round(F.abs(F.col("offset") - F.col("med")), 9) <= cfg.cluster_tolerance).groupBy("pair_id").agg(F.avg("offset").alias("offset"))
    one = lone.join(inner, "pair_id", "left").select("pair_id", F.lit(0.0).alias("target_start"), F.col("duration").alias("target_end"), F.coalesce("offset", F.lit(0.0)).alias("offset"), F.lit(0).alias("phash_inliers"), F.lit(0.0).alias("phash_stdev"))
    done = many.unionByName(one)
    rest = samples.join(done.select("pair_id").distinct(), "pair_id", "left_anti")
    back = segments_from_groups(grouped_samples(rest, walk_by_mean, cfg), durations).select("pair_id", "target_start", "target_end", "offset", F.lit(0).alias("phash_inliers"), F.lit(0.0).alias("phash_stdev"))
    out = done.unionByName(back)
    return out.withColumn("seg_no", F.row_number().over(pair.orderBy("target_start", "target_end")) - 1).select("pair_id", "seg_no", *columns[1:])


def playback_chunks(segments: DataFrame, durations: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, chunk_no, kind, target_start, target_end, duration: what to play, from segments and pair_id, primary_duration.

    Fillers stand for gaps in the primary's time; overlaps move a segment's start; the tail beyond the primary is cut. A
    short result is not padded.
    """
    w = Window.partitionBy("pair_id").orderBy("seg_no")
    p0, before = F.col("target_start") + F.col("offset"), F.lag(F.col("target_end") + F.col("offset")).over(w)
    gap = F.round(F.when(before.isNull(), p0).otherwise(p0 - before), 9)
    s = segments.withColumn("first", before.isNull()).withColumn("gap", gap)
    filler = F.when(F.col("first") & (F.col("gap") > 0), F.col("gap")).when(~F.col("first") & (F.col("gap") >= cfg.min_filler), F.col("gap"))
    cut = F.when((F.col("gap") < 0) & (F.col("first") | (F.col("gap") < -1e-6)), -F.col("gap")).otherwise(0.0)
    s = s.withColumn("filler", filler).withColumn("start", F.col("target_start") + cut)
    none = F.lit(None).cast("double")
    kind = "struct<place:int,kind:string,target_start:double,target_end:double,duration:double>"
    parts = F.array_compact(
        F.array(
            F.when(F.col("filler").isNotNull(), F.struct(F.lit(0).alias("place"), F.lit("filler").alias("kind"), none.alias("target_start"), none.alias("target_end"), F.col("filler").alias("duration"))).cast(kind),
            F.when(F.col("target_end") > F.col("start"), F.struct(F.lit(1).alias("place"), F.lit("target").alias("kind"), F.col("start").alias("target_start"), F.col("target_end").alias("target_end"), (F.col("target_end") - F.col("start")).alias("duration"))).cast(kind),
        )
    )
    return trim_tail(s.select("pair_id", "seg_no", F.explode(parts).alias("c")).select("pair_id", "seg_no", "c.*"), durations)


def trim_tail(chunks: DataFrame, durations: DataFrame) -> DataFrame:
    """Chunks (pair_id, seg_no, place, ...) cut where their running length passes the primary's."""
    w = Window.partitionBy("pair_id").orderBy("seg_no", "place")
    end = F.round(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9)
    c = chunks.withColumn("e", end).join(durations, "pair_id").withColumn("b", F.col("e") - F.col("duration"))
    over = F.col("e") > F.col("primary_duration") + 1e-3
    less = F.when(over, F.col("e") - F.col("primary_duration")).otherwise(0.0)
    kept = c.where(~(over & (F.col("b") >= F.col("primary_duration") - 1e-3))).withColumn("less", less)
    return kept.select("pair_id", (F.row_number().over(w) - 1).alias("chunk_no"), "kind", "target_start", (F.col("target_end") - F.col("less")).alias("target_end"), (F.col("duration") - F.col("less")).alias("duration"))


def trim_tail_in_blocks(chunks: DataFrame, durations: DataFrame, size: int = BLOCK) -> DataFrame:
    """trim_tail of pairs of any number of chunks: lengths and numbers are carried from block to block."""
    parts = blocks(numbered(chunks, ["pair_id"], ["seg_no", "place"]), 0, size)
    c = running_sum(parts, ["pair_id"], ["_place"], F.col("duration")).withColumn("e", F.round("_sum", 9)).drop("_sum").join(durations, "pair_id").withColumn("b", F.col("e") - F.col("duration"))
    over = F.col("e") > F.col("primary_duration") + 1e-3
    less = F.when(over, F.col("e") - F.col("primary_duration")).otherwise(0.0)
    kept = running_sum(c.where(~(over & (F.col("b") >= F.col("primary_duration") - 1e-3))).withColumn("less", less), ["pair_id"], ["_place"], F.lit(1))
    return kept.select("pair_id", (F.col("_sum") - 1).alias("chunk_no"), "kind", "target_start", (F.col("target_end") - F.col("less")).alias("target_end"), (F.col("duration") - F.col("less")).alias("duration"))
