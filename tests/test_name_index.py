"""Pairing by name in bound order against the scores of all pairs."""

import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import name_index, pairing

FILES = "folder long, side string, id long, path string"


def table(spark, names):
    return spark.createDataFrame([(f, side, i, f"/x/{name}.mkv") for i, (f, side, name) in enumerate(names)], FILES)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.text("abcdé日 ", max_size=9), st.lists(st.text("abcdé日 ", max_size=9), min_size=1, max_size=12), st.integers(1, 4), st.sampled_from([None, 0.4, 0.9]))
def test_what_is_certain_is_the_best(primary, names, scores, least):
    have = np.array(name_index.character_counts(names))
    both = np.array([len(n) + len(primary) for n in names])
    bounds = np.where(both > 0, 2.0 * np.minimum(have, name_index.character_counts([primary])).sum(axis=1) / np.maximum(both, 1), 1.0)
    true = [difflib.SequenceMatcher(None, primary, n).ratio() for n in names]
    assert all(b >= t for b, t in zip(bounds, true, strict=True))
    places = np.arange(1, len(names) + 1)
    found, left, calls = name_index.best_first(primary, bounds, names, places, scores, least)
    want = sorted((-t, k) for k, t in enumerate(true) if least is None or (t >= least and t > 0))
    sure = sorted((-s, k) for k, s in found if left is None or (-s, places[k]) < (-left[1], left[0]))
    assert sure == want[: len(sure)] and (sure or not want) and calls <= len(names)
    assert left is not None or len(sure) == len(want)


def test_walk_halts_where_all_certain_targets_are_taken():
    rows_ = [(1, 1, 0.9, False), (1, 3, 0.5, True), (2, 1, 0.8, False), (2, 2, 0.4, False), (2, 3, 0.6, True), (3, 2, 0.7, False)]
    assert name_index.walk(rows_, [1, 2, 3]) == [(1, 1, 0.9)]
    assert name_index.walk(rows_[:1] + rows_[2:4] + rows_[5:], [1, 2, 3, 4]) == [(1, 1, 0.9), (2, 2, 0.4), (3, None, None), (4, None, None)]
    assert name_index.walk([(1, 1, 0.5, False), (2, 1, 0.9, False)], [1, 2], frozenset({(1, 0), (2, 1)}), 0.65) == [(1, None, None), (2, 1, 0.9)]
    assert name_index.walk([(1, 2, 0.8, False), (1, 1, 0.8, True)], [1]) == [], "an earlier target may yet score the same"


@pytest.mark.parametrize("block", [3, 8192])
@pytest.mark.parametrize("ui", [False, True])
def test_equal_to_all_scores(spark, monkeypatch, block, ui):
    monkeypatch.setattr(name_index, "P_BLOCK", block)
    monkeypatch.setattr(name_index, "T_BLOCK", block + 1)
    monkeypatch.setattr(name_index, "SCORES", 1)
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    names = [(f, rng.choice(["primary", "target"]), f"{word()}_{word()} {rng.randint(1, 3)}") for f in range(4) for _ in range(30)]
    names += [(9, side, "same") for side in ["primary"] * 12 + ["target"] * 9] + [(10, "primary", "alone"), (11, "target", "alone"), (12, "primary", ""), (12, "target", "")]
    files = table(spark, names)
    want = rows(pairing.pair_by_all_scores(files, "folder", ui=ui), "folder", "p_id", "t_id", "score")
    assert rows(pairing.pair_by_name(files, "folder", ui=ui), "folder", "p_id", "t_id", "score") == want and want


def test_few_ratios_in_a_large_folder(spark):
    """Far fewer ratios than pairs: episodes of a folder of 4,000 files."""
    rng = random.Random(3)
    title = [" ".join(rng.choice(["harbour", "winter", "glass", "river", "stone", "lark", "ember", "north"]) for _ in range(3)) for _ in range(2000)]
    names = [(0, "primary", f"{t} {i:04d}_primary") for i, t in enumerate(title)] + [(0, "target", f"{t}.{i:04d}_target") for i, t in enumerate(title)]
    files = table(spark, names)
    placed = name_index.placed_names(files, "folder")
    found = name_index.certain_candidates(placed.where("side = 'primary'"), placed.where("side = 'target'"), "folder", name_index.SCORES, 0.4)
    ratios = found.selectExpr("(p_place - 1) div 256 AS tile", "calls").distinct().groupBy().sum("calls").first()[0]
    print(f"{ratios} ratios for {2000 * 2000} pairs")
    assert ratios < 0.1 * 2000 * 2000
    got = {(r.p_id, r.t_id) for r in pairing.pair_by_name(files, "folder").collect()}
    assert len(got) == 2000


def test_refusals(spark):
    files = table(spark, [(0, "primary", "north river"), (0, "primary", "north stone"), (0, "target", "north stane"), (0, "target", "xyz")])
    plain = {(r.p_id, r.t_id) for r in pairing.auto_sort(files, "folder").collect()}
    any_ = spark.createDataFrame([(0, None)], "p_id long, t_id long")
    one = spark.createDataFrame([(0, 2), (1, 2), (77, 3)], "p_id long, t_id long")
    assert plain == {(0, 2), (1, 3)}
    assert {(r.p_id, r.t_id) for r in pairing.auto_sort(files, "folder", refused=any_).collect()} == {(0, None), (1, 2), (None, 3)}
    assert {(r.p_id, r.t_id) for r in pairing.auto_sort(files, "folder", refused=one).collect()} == {(0, None), (1, 2), (None, 3)}


def test_null_names_and_empty(spark):
    files = spark.createDataFrame([(0, "primary", 1, None), (0, "primary", 2, "/a/b.mkv"), (0, "target", 3, "/a/b.mkv"), (None, "target", 4, "/a/b.mkv")], FILES)
    assert rows(pairing.pair_by_name(files, "folder"), "p_id", "t_id", "score") == [(2, 3, 1.0)]
    assert pairing.pair_by_name(files.where("false"), "folder").count() == 0


def test_nearest_edits_by_arrays_of_targets(spark, monkeypatch):
    """Pairs are no rows of a sort; ties, missing names and several arrays of targets as by comparing all."""
    rng = np.random.default_rng(4)
    rows = [(i % 2, "primary" if i % 3 else "target", i, None if i % 41 == 0 else "/m/" + "".join(rng.choice(list("ab"), 3)) + ".mp4") for i in range(120)]
    files = spark.createDataFrame(rows, "folder long, side string, id long, path string")
    named = files.withColumn("name", pairing.batch_name(F.col("path")))
    p, t = (named.where(f"side = '{s}'").select("folder", F.col("id").alias(f"{s[0]}_id"), F.col("name").alias(f"{s[0]}_name")) for s in ("primary", "target"))
    every = p.join(t, "folder").withColumn("distance", F.levenshtein("p_name", "t_name"))
    rank = F.row_number().over(Window.partitionBy("folder", "p_id").orderBy("distance", "t_id"))
    want = sorted(tuple(r) for r in every.withColumn("rank", rank).where("rank <= 3").select("folder", "p_id", "rank", "t_id", "distance").collect())
    assert sorted(tuple(r) for r in pairing.edit_distance_top(files, "folder", 3).collect()) == want
    monkeypatch.setattr(pairing, "TILE", 4, raising=False)
    got = pairing.edit_distance_top(files, "folder", 3)
    assert sorted(tuple(r) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "BroadcastHashJoin" not in plan


def test_small_groups_are_walked_without_rounds(spark, monkeypatch):
    rng = random.Random(6)
    files = table(spark, [(f, side, "".join(rng.choices("abc_", k=5))) for f in range(4) for side in ("primary", "target") for _ in range(7 + f)])
    want = rows(pairing.pair_by_all_scores(files, "folder", 0.4), "folder", "p_id", "t_id", "score")
    monkeypatch.setattr(name_index, "certain_candidates", lambda *a: pytest.fail("no rounds"))
    assert rows(pairing.pair_by_name(files, "folder", 0.4), "folder", "p_id", "t_id", "score") == want
