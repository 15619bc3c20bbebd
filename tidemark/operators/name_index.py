"""Greedy pairing by name without scoring all pairs.

The ratio of two names is at most 2 * common / (length + length), where common counts the characters that both hold. Counts of
characters (in CELLS cells; sharing a cell only raises the bound) give that bound for a block of primaries against a block of
targets in a few array operations. Candidates are then scored in the order of their bounds until the best is certain: until no
bound that is left exceeds it. What a tile has scored by then, and its greatest bound left, goes on.

The walk takes the primaries of a group in order. Each takes the best target that is free among those that are certain. Where all of
these are taken, the walk of that group halts, and its primaries from there on are searched again among the targets that are
free, with more scores each. So every round pairs at least one primary of each open group, most take all, and the result is
that of the walk over all scores.

Groups that fit one tile, as most folders do, need no rounds: a task walks many of them, and scores each primary only against the targets
that are still free, until the best is certain.

A tile holds P_BLOCK primaries and T_BLOCK targets at most; the walk of a group is one task, over a few narrow rows a primary.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import batch_name, list_name
from .lineage import written

CELLS = 64
P_BLOCK, T_BLOCK = 256, 8192
#: Scores that a primary gets in a tile, and by how much that grows with a round.
SCORES, GROWTH = 8, 4
#: Names of small groups that are walked in one call, on average.
BATCH = 4096


def placed_names(files: DataFrame, group: str, ui: bool = False) -> DataFrame:
    """group, side, id, name, place (from 1, per side): in order of the name, or of the id for lists of a user."""
    named = files.withColumn("name", list_name(F.col("path")) if ui else batch_name(F.col("path")))
    order = ["id"] if ui else ["name", "id"]
    return named.select(group, "side", "id", "name", F.row_number().over(Window.partitionBy(group, "side").orderBy(*order)).alias("place"))


def character_counts(names: list[str]) -> np.ndarray:
    """How many characters of each name fall in each cell."""
    out = np.zeros((len(names), CELLS), np.int32)
    codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32) % CELLS
    np.add.at(out, (np.repeat(np.arange(len(names)), [len(n) for n in names]), codes), 1)
    return out


def best_first(primary: str, bounds: np.ndarray, names: list[str], places: np.ndarray, scores: int, least: float | None) -> tuple[list[tuple[int, float]], tuple[int, float] | None, int]:
    """((target's index, score), ...) of what was scored, (place, bound) of the first target left or none, and the number of scores.

    Targets are scored by falling bound, then place, until the best beats all bounds left and `scores` are done. Below least, or at zero
    with a least, there is nothing to take.
    """
    order = np.lexsort((places, -bounds))
    if least is not None:
        order = order[(bounds[order] >= least) & (bounds[order] > 0)]
    match, done, best, out = difflib.SequenceMatcher(None), 0, None, []
    for k in order:
        if done >= scores and best is not None and best > (bounds[k], -places[k]):
            return out, (int(places[k]), float(bounds[k])), done
        match.set_seqs(primary, names[k])
        score, done = match.ratio(), done + 1
        if least is None or (score >= least and score > 0):
            out.append((int(k), score))
            best = max(best or (-1.0, 0), (score, -places[k]))
    return out, None, done


def _score_tile(group: str, scores: int, least: float | None):
    def run(key: tuple, p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        names, places = list(t["t_name"]), t["t_place"].to_numpy()
        have, lengths = character_counts(names), t["t_name"].str.len().to_numpy()
        rows, calls = [], 0
        for name, place, counts in zip(p["name"], p["place"], character_counts(list(p["name"])), strict=True):
            common = np.minimum(have, counts).sum(axis=1)
            both = lengths + len(name)
            bounds = np.where(both > 0, 2.0 * common / np.maximum(both, 1), 1.0)
            found, left, n = best_first(name, bounds, names, places, scores, least)
            calls += n
            rows += [(place, int(places[k]), s, False) for k, s in found]
            if left:
                rows.append((place, left[0], left[1], True))
        out = pd.DataFrame(rows, columns=["p_place", "t_place", "score", "bound"])
        out.insert(0, group, key[0])
        out["calls"] = calls if len(out) else 0
        return out

    return run


def _apart(df: DataFrame) -> DataFrame:
    """df with every column named t_...: what is cogrouped with columns of one table needs its own."""
    return df.select(*(F.col(c).alias(f"t_{c}") for c in df.columns))


def _tiles(primaries: DataFrame, targets: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with pb and tb: each primary once for each block of its group's targets, each target for each of primaries."""
    p, t = primaries.withColumn("pb", F.expr(f"(place - 1) div {P_BLOCK}")), targets.withColumn("tb", F.expr(f"(place - 1) div {T_BLOCK}"))
    pbs, tbs = p.select(group, "pb").distinct(), t.select(group, "tb").distinct()
    return p.join(tbs, group), _apart(t.join(pbs, group))


def certain_candidates(primaries: DataFrame, targets: DataFrame, group: str, scores: int, least: float | None) -> DataFrame:
    """group, p_place, t_place, score, bound, calls: scored targets of each primary; with bound, the first target left and its bound.

    primaries, targets: group, place, name. calls: ratios computed in the row's tile.
    """
    p, t = _tiles(primaries, targets, group)
    schema = f"{group} {primaries.schema[group].dataType.simpleString()}, p_place int, t_place int, score double, bound boolean, calls long"
    return p.groupBy(group, "pb", "tb").cogroup(t.groupBy(f"t_{group}", "t_pb", "t_tb")).applyInPandas(_score_tile(group, scores, least), schema)


def walk(rows: list[tuple[int, int, float, bool]], primaries: list[int], refused: frozenset[tuple[int, int]] = frozenset(), limit: float = 0.0) -> list[tuple[int, int | None, float | None]]:
    """(primary, target or none, score) for the primaries in order, up to the first whose certain targets are all taken.

    rows: (primary, target, score, bound). A score is certain if it beats every bound left of that primary, by place on ties.
    A primary whose best scores below the limit and was refused takes none; target 0 stands for any.
    """
    by: dict[int, list[tuple[float, int]]] = {}
    left: dict[int, tuple[float, int]] = {}
    for p, t, s, bound in rows:
        if bound:
            left[p] = min(left.get(p, (1.0, 0)), (-s, t))
        else:
            by.setdefault(p, []).append((-s, t))
    taken, out = set(), []
    for p in primaries:
        stop = left.get(p)
        best = min((x for x in by.get(p, ()) if x[1] not in taken and (stop is None or x < stop)), default=None)
        if best is None and stop is not None:
            break
        if best is None or (-best[0] < limit and ((p, best[1]) in refused or (p, 0) in refused)):
            out.append((p, None, None))
        else:
            taken.add(best[1])
            out.append((p, best[1], -best[0]))
    return out


def walk_names(primaries: list[tuple[int, str]], targets: list[tuple[int, str]], least: float | None, refused: frozenset[tuple[int, int]] = frozenset(), limit: float = 0.0) -> list[tuple[int, int, float]]:
    """(primary, target, score) of a whole walk over (place, name) of a small group, both in order of place; as `walk` over all scores."""
    names, places = [n for _, n in targets], np.array([t for t, _ in targets], np.int64)
    have, lengths = character_counts(names), np.array([len(n) for n in names])
    free, out = np.ones(len(names), bool), []
    for (place, name), counts in zip(primaries, character_counts([n for _, n in primaries]), strict=True):
        at = np.flatnonzero(free)
        both = lengths[at] + len(name)
        bounds = np.where(both > 0, 2.0 * np.minimum(have[at], counts).sum(axis=1) / np.maximum(both, 1), 1.0)
        found, _, _ = best_first(name, bounds, [names[i] for i in at], places[at], 0, least)
        if not found:
            continue
        k, score = min(found, key=lambda x: (-x[1], places[at[x[0]]]))
        target = int(places[at[k]])
        if score < limit and ((place, target) in refused or (place, 0) in refused):
            continue
        free[at[k]] = False
        out.append((place, target, score))
    return out


def _walk_small(rows: DataFrame, group: str, batches: int, least: float | None, limit: float) -> DataFrame:
    """group, p_place, t_place, score of small groups. rows: group, side ('primary', 'target', 'no' for what is refused), place, name, other."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, g in pdf.groupby(group, sort=False):
            of = {side: sorted(zip(x["place"], x["name"], strict=True)) for side, x in g[g["side"] != "no"].groupby("side")}
            no = g[g["side"] == "no"]
            got = walk_names(of.get("primary", []), of.get("target", []), least, frozenset(zip(no["place"], no["other"], strict=True)), limit)
            out += [(key, *x) for x in got]
        return pd.DataFrame(out, columns=[group, "p_place", "t_place", "score"])

    dealt = rows.withColumn("batch", F.pmod(F.xxhash64(group), F.lit(batches)))
    # a given number of partitions, as names are small to read and long to compare
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch")
    return dealt.groupBy("batch").applyInPandas(lambda pdf: run(pdf), f"{group} {rows.schema[group].dataType.simpleString()}, p_place int, t_place int, score double")


def greedy_pairs_by_index(files: DataFrame, group: str, least: float | None, ui: bool = False, refused: DataFrame | None = None, limit: float = 0.0) -> DataFrame:
    """group, p_id, t_id, score: each primary in order takes the best target left, the first on ties.

    With least, a pair must score at least that and above zero. refused (p_id, t_id, null for any): a primary takes none if its
    best is among them and scores below the limit. Null names take no part. Small groups are walked whole; the others run a few jobs a round, and most are done in the first.
    """
    names = written(placed_names(files, group, ui).where("name IS NOT NULL"))
    primaries, targets = names.where("side = 'primary'"), names.where("side = 'target'")
    sizes = written(names.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_if(F.col("side") == "primary").alias("ps"), F.count_if(F.col("side") == "target").alias("ts")).where("ps > 0"))
    fits = (F.col("ps") <= P_BLOCK) & (F.col("ts") <= T_BLOCK)
    small, large = sizes.where(fits).select(group), sizes.where(~fits).select(group)
    barred = None
    if refused is not None:
        of = lambda df, side: df.select(group, F.col("id").alias(f"{side}_id"), F.col("place").alias(f"{side}_place"))
        pairs = refused.select("p_id", "t_id").distinct().join(of(primaries, "p"), "p_id").join(of(targets, "t"), [group, "t_id"], "left")
        barred = written(pairs.where("t_id IS NULL OR t_place IS NOT NULL").select(group, "p_place", F.coalesce("t_place", F.lit(0)).alias("t_place")))
    kind = files.schema[group].dataType.simpleString()

    def run(key: tuple, found: pd.DataFrame, open_: pd.DataFrame) -> pd.DataFrame:
        no = found["no"]
        rows = list(zip(found["p_place"][~no], found["t_place"][~no], found["score"][~no], found["bound"][~no], strict=True))
        got = walk(rows, sorted(open_["t_place"]), frozenset(zip(found["p_place"][no], found["t_place"][no], strict=True)), limit)
        out = pd.DataFrame(got, columns=["p_place", "t_place", "score"])
        out.insert(0, group, key[0])
        return out.astype({"t_place": "Int32"})

    n = sizes.where(fits).agg(F.sum(F.col("ps") + F.col("ts"))).first()[0] or 0
    rows = names.join(small, group, "left_semi").select(group, "side", "place", "name", F.lit(0).alias("other"))
    if barred is not None:
        rows = rows.unionByName(barred.join(small, group, "left_semi").select(group, F.lit("no").alias("side"), F.col("p_place").alias("place"), F.lit("").alias("name"), F.col("t_place").alias("other")))
        barred = barred.join(large, group, "left_semi")
    out, scores = written(_walk_small(rows, group, max(1, -(-n // BATCH)), least, limit)), SCORES
    open_, free = (side.join(large, group, "left_semi").select(group, "place", "name") for side in (primaries, targets))
    while not open_.isEmpty():
        found = certain_candidates(open_, free, group, scores, least).select(group, "p_place", "t_place", "score", "bound", F.lit(False).alias("no"))
        if barred is not None:
            found = found.unionByName(barred.select(group, "p_place", "t_place", F.lit(0.0).alias("score"), F.lit(False).alias("bound"), F.lit(True).alias("no")))
        done = written(found.groupBy(group).cogroup(_apart(open_).groupBy(f"t_{group}")).applyInPandas(run, f"{group} {kind}, p_place int, t_place int, score double"))
        out = out.unionByName(done)
        open_ = written(open_.join(done.select(group, F.col("p_place").alias("place")), [group, "place"], "left_anti"))
        free = written(free.join(done.where("t_place IS NOT NULL").select(group, F.col("t_place").alias("place")), [group, "place"], "left_anti"))
        scores *= GROWTH
    p = primaries.select(group, F.col("place").alias("p_place"), F.col("id").alias("p_id"))
    t = targets.select(group, F.col("place").alias("t_place"), F.col("id").alias("t_id"))
    return out.where("t_place IS NOT NULL").join(p, [group, "p_place"]).join(t, [group, "t_place"]).select(group, "p_id", "t_id", "score")
