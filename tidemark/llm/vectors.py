"""What the two vector searches share: valid rows, equal vectors folded, query vectors, and the way back to rows.

A search works on distinct vectors. Of the rows with one vector only the `most` smallest ids can be among a query's best,
as ties go to smaller ids; so a vector keeps those, however many rows hold it. Queries with one vector are searched once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def valid_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id long, v) of the rows that take part; v is array<float> if the column is, else array<double>.

    Left out: null or empty vectors, vectors with a null or non-finite component. Repeated ids and null ids are rows like
    others (a null id is never a query and the largest in ties). Vectors only meet others of their own length.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)


def folded(rows: DataFrame, most: int) -> DataFrame:
    """(g, v, dim, low, ids): the distinct vectors, written, with the `most` smallest ids of each (all, if fewer)."""
    order = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    each = few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id"))).alias("x"))
    ids = F.col("x.vec_id")
    return materialize(each.select(F.monotonically_increasing_id().alias("g"), "v", F.size("v").alias("dim"), F.coalesce(ids[0], F.lit((1 << 63) - 1)).alias("low"), ids.alias("ids")), "vectors")


def query_vectors(rows: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """((vec_id, q) of each query row, (q, v, dim) of the distinct query vectors), both written."""
    asked = rows.where(F.col("vec_id") % every == 0)
    distinct = materialize(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("q"), "v", F.size("v").alias("dim")), "queries")
    each = asked.join(distinct.select("q", F.col("v").alias("qv")), F.col("v") == F.col("qv")).select("vec_id", "q")
    return materialize(each, "query-rows"), distinct


def best_groups(found: DataFrame, most: int) -> DataFrame:
    """The `most` best (score, then smallest id) of the vectors (q, g, low, score, same) found for each query vector.

    A vector may be found several times. Each task passes on at most `most` vectors of a query.
    """
    order = Window.partitionBy("q").orderBy(F.desc("score"), "low", "g")
    return found.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= most).drop("n").dropDuplicates(["q", "g"])


def ranked_rows(found: DataFrame, groups: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query row, its own row left out.

    found: (q, g, low, score, same) with the k + 1 best vectors of each query vector; same: whether g is that very vector.
    """
    rows = found.join(groups.select(F.col("g").alias("gg"), "ids"), F.col("g") == F.col("gg")).select("q", "score", "same", F.explode("ids").alias("id"))
    entry = F.struct((-F.col("score")).alias("order"), F.col("id").isNull().alias("last"), "id", "score", "same")
    best = rows.groupBy(F.col("q").alias("bq")).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("best"))
    each = asked.join(best, F.col("q") == F.col("bq"))
    own = F.array_position(F.transform("best", lambda x: x["same"] & x["id"].eqNullSafe(F.col("vec_id"))), True)
    others = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("own")), 1, k)
    out = each.withColumn("own", own).select("vec_id", F.posexplode(others).alias("n", "x"))
    return out.select(F.col("vec_id").alias("query_id"), (F.col("n") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def number(key: Column, n: int) -> Column:
    """A shard or block in 0..n-1, even over any ids."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def across(df: DataFrame, n: int, name: str) -> DataFrame:
    """df once for each of n shards or blocks of the other side."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of an array column as a matrix of long or double."""
    x = np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))
    return x if x.dtype == np.int64 else x.astype(np.float64)
