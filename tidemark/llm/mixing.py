"""Mixing sources to target weights (operator 4), with DataFrame functions only.

Method: each document gets a hash-random key; within its source documents stand in the order of their keys; distributed
prefix sums of the sizes place each document; the source is cut at its exact budget, after whole epochs if the budget
exceeds the source.

The order is cut into ranges of keys (the first digits of the hash, RANGES to a source). Sums by range are small, and
windows over them give what lies before a range; a window within a range gives the rest. So a source that holds a third
of all rows is still shared by many tasks. The key is a function of the row, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Hex digits of the key that name a range: 16**3 ranges to a source.
DIGITS = 3


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    The weights repeat over the sources in code-point order, null last. A target stops at `most` times its source; what it
    leaves is shared by the others by weight. The level at which this settles is found by prefix sums over the sources in
    the order in which they stop, so it takes one pass.
    """
    one = Window.partitionBy(F.lit(0))
    place = F.row_number().over(one.orderBy(F.col("source").isNull(), "source")) - 1
    ws = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("place", place).withColumn("w", ws[(F.col("place") % len(weights)).cast("int")].cast("double"))
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("stop", F.col("cap") / F.col("w"))
    order = one.orderBy("stop", "place")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum(share * F.col("source_size")).over(one) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(behind)
    rows = rows.withColumn("level", level).withColumn("free", F.col("level") <= F.col("stop"))
    # The first source in this order that does not stop sets the level for all behind it.
    final = F.min(F.when(F.col("free"), F.struct("stop", "place", "level"))).over(one)["level"]
    rows = rows.withColumn("final", final)
    return rows.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w"))).alias("target"))


def place_in_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, digits: int = DIGITS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, k0, k1, ... for the columns keep) of each row.

    taken: words of the row in the mix, repeats counted; the sum over a source is its target rounded to a whole number.
    Repeated rows share a key and stand in any order among themselves. Documents without words take nothing.
    """
    # A written source value and a mark for null, so that joins by source need no null-safe form.
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        words(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("h"),
        *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)),
    ).withColumn("part", F.substring("h", 1, digits))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    wanted = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    before = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("before", before)
    plan = placed.join(wanted.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("ps"), F.col("part").alias("pp"), "before", "source_size", "target")
    budget = F.round("target").cast("long")
    start = F.col("before") + F.coalesce(F.sum("size").over(Window.partitionBy("source", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    located = rows.join(plan, F.col("source").eqNullSafe(F.col("ps")) & (F.col("part") == F.col("pp"))).withColumn("start", start).withColumn("budget", budget)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("budget") - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    taken = (epochs * F.col("size") + cut).cast("long")
    return located.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(f"k{i}" for i in range(len(keep))))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return place_in_mix(docs)


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mixed documents, all columns kept: a row for each epoch that takes a document, none for what is not taken.

    The document at which a source's budget ends is cut behind the last word taken. Documents without words are dropped.
    """
    names = docs.columns
    out = place_in_mix(docs, text, keep=tuple(names))
    at = names.index(text)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = out.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    left = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    first = F.regexp_substr(F.col(f"k{at}"), F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), left.cast("string"), F.lit("}+")))
    cut = F.when(left < F.col("size"), first).otherwise(F.col(f"k{at}"))
    return rows.select(*(cut.alias(c) if i == at else F.col(f"k{i}").alias(c) for i, c in enumerate(names)))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS stop FROM w
), m AS (
  SELECT *, (sum(1.5::DOUBLE * source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY stop, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY stop, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l
), f AS (
  SELECT *, (SELECT level FROM m WHERE level <= stop ORDER BY stop, place LIMIT 1) AS final FROM m
), t AS (
  SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target FROM f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END::BIGINT AS taken
FROM p
"""
