"""Exact deduplication against brute force."""

import hashlib

import pytest

from tidemark.llm import exactdup

from .conftest import SCHEMA


def brute(rows, keep=max):
    """(doc_id, keep_id, group_size, sha256) of each row; who stays is compared on its own, as rows equal in id and text are alike."""
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    best = {t: keep((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return sorted(((i, best[t or ""], len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def check(rows, got, keep=max):
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows, keep)
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len({t for _, t in kept}) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("which", ["documents", "odd"])
@pytest.mark.parametrize("parts", [1, 70])
def test_exact_duplicates(request, which, parts):
    df = request.getfixturevalue(which).repartition(parts)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = exactdup.exact_duplicates(df).collect()
    check(rows, got)
    check(rows, exactdup.exact_duplicates(df, keep="smallest").collect(), min)
    kept = exactdup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text or "") for r in kept.select("doc_id", "text").collect()))) == sorted(map(str, {(i, t or "") for i, t in rows if any(g.kept and g.doc_id == i and g.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for g in got)}))


def test_a_hot_text_null_ids_and_repeated_rows(spark):
    rows = [(i % 40 or None, "hot") for i in range(900)] + [(None, "x"), (None, "x"), (3, "y"), (3, "y"), (3, "Y"), (4, "y "), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA).repartition(30)
    check(rows, exactdup.exact_duplicates(df).collect())
    assert sorted(map(str, ((r.doc_id, r.text) for r in exactdup.drop_exact_duplicates(df).collect()))) == sorted(map(str, [(39, "hot"), (None, "x"), (3, "y"), (3, "Y"), (4, "y "), (6, "")]))


def test_merging_holds_one_entry_back_between_batches(spark):
    """Groups that go on over several batches are one entry."""
    df = spark.createDataFrame([(i, f"t{i % 3}", None, None, 0) for i in range(400)], SCHEMA).repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check([(i, f"t{i % 3}") for i in range(400)], exactdup.exact_duplicates(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_other_kinds_of_keys_and_empty(spark, none):
    df = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t"), ("c", None)], "name string, body string")
    got = exactdup.exact_duplicates(df, "name", "body").collect()
    assert sorted(map(str, ((r.name, r.keep_id, r.group_size, r.kept) for r in got))) == sorted(map(str, [("b", "b", 3, True), ("a", "b", 3, False), (None, "b", 3, False), ("c", "c", 1, True)]))
    assert exactdup.exact_duplicates(none).count() == 0 and exactdup.drop_exact_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        exactdup.exact_duplicates(none, keep="middle")
