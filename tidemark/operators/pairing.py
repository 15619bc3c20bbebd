"""Pairing files by name, and positional lists."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..functions.scalar import batch_name, is_video, list_name
from .lineage import written
from .name_index import greedy_pairs_by_index


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters as Python's difflib finds it; the order of the two matters."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def scan_folder(spark, path: str) -> DataFrame:
    """path of the video files of one folder, sorted; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path")
    return files.where(is_video(F.col("path"))).orderBy("path")


def normal_path(path: Column) -> Column:
    """The path without empty and '.' steps, '..' taken back; only the text is looked at."""
    def step(steps: Column, x: Column) -> Column:
        up = F.when(F.size(steps) > 0, F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0)))).otherwise(steps)
        return F.when(x.isin("", "."), steps).when(x == "..", up).otherwise(F.array_append(steps, x))

    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(steps, "/"))


def ingest_list(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """side, id, path: the first of equal paths (id is the order of arrival), videos only, paths normalised.

    With existing (path), what does not exist is left out, and a path that is a folder stands for the files in it, by name.
    """
    files = files.select("side", "id", normal_path(F.col("path")).alias("path"))
    if existing is not None:
        there = existing.select(normal_path(F.col("path")).alias("e_path")).distinct().withColumn("e_folder", F.regexp_extract("e_path", r"^(.*)/[^/]*$", 1))
        within = files.join(there, F.col("path") == F.col("e_folder")).select("side", "id", F.col("e_path").alias("path"))
        files = files.join(there, F.col("path") == F.col("e_path"), "left_semi").unionByName(within)
    first = F.row_number().over(Window.partitionBy("side", "path").orderBy("id"))
    return files.where(is_video(F.col("path"))).withColumn("n", first).where("n = 1").drop("n")


def zip_lists(files: DataFrame) -> DataFrame:
    """place, primary, target: the nth of each side, as far as both go; blank rows drop out afterwards."""
    w = Window.partitionBy("side").orderBy("id")
    placed = files.withColumn("place", F.row_number().over(w))
    p = placed.where("side = 'primary'").select("place", F.col("path").alias("primary"))
    t = placed.where("side = 'target'").select("place", F.col("path").alias("target"))
    return p.join(t, "place").where("primary <> '' AND target <> ''")


def greedy_pairs(scores: list[tuple[int, int, float]], least: float, refused: frozenset[tuple[int, int]] | None = None) -> list[tuple[int, int, float]]:
    """(primary place, target place, score) rows: each primary in order takes the best target left, the first on ties.

    A pair must score above zero and at least `least`; a primary whose best is lower takes none. With refused, there is no
    least score: a primary takes its best unless that pair was refused, and then none.
    """
    by: dict[int, list[tuple[float, int]]] = {}
    for p, t, s in scores:
        by.setdefault(p, []).append((-s, t))
    taken, out = set(), []
    for p in sorted(by):
        best = min((x for x in by[p] if x[1] not in taken), default=None)
        if best and ((p, best[1]) not in refused if refused is not None else -best[0] > 0 and -best[0] >= least):
            taken.add(best[1])
            out.append((p, best[1], -best[0]))
    return out


def scored_names(files: DataFrame, group: str, ui: bool = False) -> DataFrame:
    """group, p_id, p_place, t_id, t_place, score of all pairs within a group (a folder pair)."""
    name = list_name(F.col("path")) if ui else batch_name(F.col("path"))
    named = files.withColumn("name", name)
    order = ["id"] if ui else ["name", "id"]
    placed = named.withColumn("place", F.row_number().over(Window.partitionBy(group, "side").orderBy(*order)))
    p = placed.where("side = 'primary'").select(group, F.col("id").alias("p_id"), F.col("place").alias("p_place"), F.col("name").alias("p_name"))
    t = placed.where("side = 'target'").select(group, F.col("id").alias("t_id"), F.col("place").alias("t_place"), F.col("name").alias("t_name"))
    return p.join(t, group).select(group, "p_id", "p_place", "t_id", "t_place", name_ratio("p_name", "t_name").alias("score"))


def pair_by_all_scores(files: DataFrame, group: str, least: float = DEFAULT.similar, ui: bool = False) -> DataFrame:
    """pair_by_name over the scores of all pairs of a group: quadratic, for small groups and as a check."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, t = dict(zip(pdf["p_place"], pdf["p_id"], strict=True)), dict(zip(pdf["t_place"], pdf["t_id"], strict=True))
        rows = greedy_pairs(list(zip(pdf["p_place"], pdf["t_place"], pdf["score"], strict=True)), least)
        return pd.DataFrame({group: pdf[group].iloc[0], "p_id": [p[r[0]] for r in rows], "t_id": [t[r[1]] for r in rows], "score": [r[2] for r in rows]})

    return scored_names(files, group, ui).groupBy(group).applyInPandas(run, f"{group} {files.schema[group].dataType.simpleString()}, p_id long, t_id long, score double")


def pair_by_name(files: DataFrame, group: str, least: float = DEFAULT.similar, ui: bool = False) -> DataFrame:
    """group, p_id, t_id, score: greedy pairs in each group (the lists of one folder pair), scored in the order of their bounds."""
    return greedy_pairs_by_index(files, group, least, ui)


def auto_sort(files: DataFrame, group: str, cfg: Config = DEFAULT, refused: DataFrame | None = None) -> DataFrame:
    """group, place, p_id, t_id, score, needs_review: the target list put beside the primary list of each group.

    Each primary in order takes the best target left. Pairs below the automatic limit need a review; those the reviewer
    refused (refused: p_id, t_id; a null t_id refuses whatever the primary is offered) leave the primary's place empty and the
    target free for later ones. Targets left over follow below, without a primary.
    """
    used = written(greedy_pairs_by_index(files, group, None, ui=True, refused=refused, limit=cfg.similar_ui))
    left = files.where("side = 'primary'").select(group, F.col("id").alias("p_id")).join(used.select("p_id", "t_id", "score"), "p_id", "left").select(group, F.lit(0).alias("below"), "p_id", "t_id", "score")
    free = files.where("side = 'target'").select(group, F.col("id").alias("t_id")).join(used.select("t_id"), "t_id", "left_anti")
    rows = left.unionByName(free.select(group, F.lit(1).alias("below"), F.lit(None).cast("long").alias("p_id"), "t_id", F.lit(None).cast("double").alias("score")))
    place = F.row_number().over(Window.partitionBy(group).orderBy("below", F.coalesce("p_id", "t_id")))
    return rows.select(group, place.alias("place"), "p_id", "t_id", "score", (F.col("score") < cfg.similar_ui).alias("needs_review"))


def leftovers(files: DataFrame, paired: DataFrame) -> DataFrame:
    """side, id of the files in no pair."""
    used = paired.select(F.explode(F.array("p_id", "t_id")).alias("id"))
    return files.join(used, "id", "left_anti").select("side", "id")


#: Targets that lie in one array of edit_distance_top.
TILE = 256


def edit_distance_top(files: DataFrame, group: str, k: int) -> DataFrame:
    """group, p_id, rank, t_id, distance: the k targets nearest by edits of the normalised names.

    A primary meets arrays of at most about TILE targets and keeps k of each, so that the pairs of a group are neither rows nor sorted.
    """
    named = files.withColumn("name", batch_name(F.col("path")))
    p = named.where("side = 'primary'").select(group, F.col("id").alias("p_id"), F.col("name").alias("p_name"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("id"))
    t = named.where("side = 'target'").select(group, "id", "name", F.floor((place - 1) / TILE).alias("tile"))
    tiles = t.groupBy(group, "tile").agg(F.collect_list(F.struct(F.col("id").alias("t_id"), "name")).alias("targets"))
    near = F.transform("targets", lambda x: F.struct(F.levenshtein("p_name", x["name"]).alias("distance"), x["t_id"].alias("t_id")))
    # a broadcast of all names would pass through the driver
    each = p.join(tiles.hint("merge"), group).select(group, "p_id", F.explode(F.slice(F.array_sort(near), 1, k)).alias("s")).select(group, "p_id", "s.t_id", "s.distance")
    rank = F.row_number().over(Window.partitionBy(group, "p_id").orderBy("distance", "t_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(group, "p_id", "rank", "t_id", "distance")
