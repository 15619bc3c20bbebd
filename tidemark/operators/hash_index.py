"""The k nearest frames of every frame by multi-index hashing: exact, without comparing all frames of a pair.

The 64 bits of a hash are cut into BANDS bands. Two hashes within distance BANDS * (a + 1) - 1 agree in some band up to a bits. So
round a looks up, in each band, the values that differ from the query's in exactly a bits (an equi-join on recording, band
and value); after it every hash within that distance is known, and queries whose kth match is within it are done. The
others, and only those, go into the next round. Where the lookups of a round would cost more than comparing, the open queries
of the recording are compared with all its different hashes instead: in tiles of Q_BLOCK queries and H_BLOCK hashes, each of which
gives k rows a query, so that the compared pairs are never rows. That is quadratic in the length of a recording, but of bounded memory.

A written table looks small to the planner before its bands and flips are exploded, hence the hints: such rows must be
shuffled, as a broadcast would gather them on the driver.

Equal hashes are folded first: a recording has each different hash once, with its k earliest frames, and each different query
hash is searched once. So long stretches of black, with one hash on both sides, are one lookup.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hamming
from .lineage import written

BANDS, WIDTH = 4, 16
#: A round is looked up while its lookups are at most so many times the different hashes of a recording: a lookup is a row of a shuffle,
#: a comparison a step of an array operation.
WORTH = 1 / 32
#: Queries and hashes of a tile, and how many of its queries are compared at a time.
Q_BLOCK, H_BLOCK, STEP = 2048, 8192, 128


def flips(a: int) -> list[int]:
    """All values of a band with exactly a bits set."""
    return [sum(1 << i for i in bits) for bits in combinations(range(WIDTH), a)]


def _bands(h0: str, h1: str) -> Column:
    """The bands of a hash of two 32-bit words, which may be held as signed numbers."""
    part = lambda h, shift: F.shiftright(F.col(h), shift).bitwiseAND(F.lit(0xFFFF)).cast("int")
    return F.array(part(h0, 16), part(h0, 0), part(h1, 16), part(h1, 0))


def _distance() -> Column:
    return hamming([(F.col("r0"), F.col("h0")), (F.col("r1"), F.col("h1"))])


def folded_hashes(frames: DataFrame, k: int) -> DataFrame:
    """media_id, h0, h1, low, at: the different hashes of each recording with their k earliest frames, low the first; written."""
    order = F.row_number().over(Window.partitionBy("media_id", "h0", "h1").orderBy("frame_idx"))
    few = frames.where("h0 IS NOT NULL AND h1 IS NOT NULL").select("media_id", "h0", "h1", "frame_idx").withColumn("n", order).where(F.col("n") <= k)
    return written(few.groupBy("media_id", "h0", "h1").agg(F.min("frame_idx").alias("low"), F.array_sort(F.collect_list("frame_idx")).alias("at")))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest different hashes (primary_id, r0, r1, h0, h1, low, hd) of each query; ties: the earlier first frame."""
    order = Window.partitionBy("primary_id", "r0", "r1").orderBy("hd", "low")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def _compare_tile(k: int, columns: list[str]):
    def run(key: tuple, q: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        h = h.sort_values("h_low", ignore_index=True)
        words = lambda df, c: df[c].to_numpy(np.int64).view(np.uint64)
        r0, r1, h0, h1 = words(q, "r0"), words(q, "r1"), words(h, "h_h0"), words(h, "h_h1")
        n, at = min(k, len(h)), []
        for i in range(0, len(q), STEP):
            part = slice(i, i + STEP)
            hd = np.bitwise_count(r0[part, None] ^ h0).astype(np.int64) + np.bitwise_count(r1[part, None] ^ h1)
            at.append(np.partition(hd * len(h) + np.arange(len(h)), n - 1, axis=1)[:, :n])  # the distance, then the place
        hd, place = np.divmod(np.concatenate(at).ravel() if at and n else np.zeros(0, np.int64), max(len(h), 1))
        of = np.repeat(np.arange(len(q)), n)
        values = {"primary_id": key[0], "r0": q["r0"].to_numpy()[of], "r1": q["r1"].to_numpy()[of], "h0": h["h_h0"].to_numpy()[place], "h1": h["h_h1"].to_numpy()[place], "low": h["h_low"].to_numpy()[place], "hd": hd}
        return pd.DataFrame({c: values[c] for c in columns})

    return run


def _compared(scanned: DataFrame, counts: DataFrame, hashes: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """The k nearest of all hashes of its recording for each query. scanned has size; counts: primary_id, size, queries."""
    spark = scanned.sparkSession
    blocks = lambda n, block: F.ceil(F.col(n) / block)
    deal = lambda a, b, n: F.pmod(F.xxhash64(a, b), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    c = counts.select("primary_id", blocks("queries", Q_BLOCK).alias("qbs"), blocks("size", H_BLOCK).alias("hbs"))
    q = scanned.join(c, "primary_id").select("primary_id", "r0", "r1", deal("r0", "r1", F.col("qbs")).alias("qb"), every(F.col("hbs")).alias("hb"))
    h = hashes.withColumnRenamed("media_id", "primary_id").join(c, "primary_id")
    h = h.select(F.col("primary_id").alias("h_primary"), F.col("h0").alias("h_h0"), F.col("h1").alias("h_h1"), F.col("low").alias("h_low"), deal("h0", "h1", F.col("hbs")).alias("h_hb"), every(F.col("qbs")).alias("h_qb"))
    # a given number of partitions, as tiles are small to read and long to compare
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q, h = q.repartition(n, "primary_id", "qb", "hb"), h.repartition(n, "h_primary", "h_qb", "h_hb")
    kinds = dict(scanned.dtypes) | {f: t for f, t in hashes.dtypes if f in ("h0", "h1", "low")} | {"hd": "bigint"}
    tiles = q.groupBy("primary_id", "qb", "hb").cogroup(h.groupBy("h_primary", "h_qb", "h_hb"))
    return _best(tiles.applyInPandas(_compare_tile(k, columns), ", ".join(f"{f} {kinds[f]}" for f in columns)), k).select(*columns)


def nearest_hashes(queries: DataFrame, hashes: DataFrame, k: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(primary_id, r0, r1, h0, h1, hd, low of the k nearest hashes of each query, rounds).

    queries: primary_id, r0, r1, all different. rounds: (radius in a band, queries looked up, candidates compared) of each round;
    a radius of -1 stands for comparing with all hashes.
    """
    sizes = hashes.groupBy(F.col("media_id").alias("primary_id")).agg(F.count("*").alias("size"))
    open_ = written(queries.join(sizes, "primary_id"))
    index = written(hashes.select(F.col("media_id").alias("primary_id"), "h0", "h1", "low", F.posexplode(_bands("h0", "h1")).alias("band", "value")))
    known = open_.where("false").select("primary_id", "r0", "r1", F.lit(0).cast("long").alias("h0"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("hd"))
    columns, keys, done, rounds = known.columns, ["primary_id", "r0", "r1"], [], []
    for a in range(WIDTH + 1):
        masks = flips(a)
        worth = F.lit(float(BANDS * len(masks))) <= F.col("size") * F.lit(WORTH)
        scanned = open_.where(~worth)
        counts = written(scanned.groupBy("primary_id").agg(F.first("size").alias("size"), F.count("*").alias("queries")))
        n, pairs = counts.agg(F.sum("queries"), F.sum(F.col("queries") * F.col("size"))).first()
        if n:
            done.append(written(_compared(scanned, counts, hashes, k, columns)))
            rounds.append((-1, n, pairs))
        open_ = written(open_.where(worth))
        n = open_.count()
        if not n:
            break
        looked = open_.select(*keys, F.posexplode(_bands("r0", "r1")).alias("band", "own"))
        flipped = queries.sparkSession.createDataFrame([(m,) for m in masks], "mask int")
        looked = looked.crossJoin(F.broadcast(flipped)).select(*keys, "band", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        met = written(looked.join(index.hint("merge"), ["primary_id", "band", "value"]).select(*keys, "h0", "h1", "low").distinct().withColumn("hd", _distance().cast("long")).select(*columns))
        rounds.append((a, n, met.count()))
        known = written(_best(known.join(open_.select(*keys), keys, "left_semi").unionByName(met).dropDuplicates([*keys, "h0", "h1"]), k).select(*columns))
        # sure: k matches, or all hashes there are, within what the rounds so far have covered
        state = known.where(F.col("hd") <= BANDS * (a + 1) - 1).groupBy(*keys).agg(F.count("*").alias("near"))
        sure = written(open_.join(state, keys).where((F.col("near") >= k) | (F.col("near") >= F.col("size"))).select(*keys))
        done.append(known.join(sure, keys, "left_semi"))
        open_ = written(open_.join(sure, keys, "left_anti"))
    out = known.where("false")
    for part in done:
        out = out.unionByName(part)
    return out, rounds


def top_matches(pairs: DataFrame, frames: DataFrame, k: int) -> DataFrame:
    """pair_id, ref_frame, rank, frame_idx, hd: the k nearest primary frames of every target frame, the earlier on ties.

    Frames without a hash take no part. Runs a few jobs a round.
    """
    return top_matches_counted(pairs, frames, k)[0]


def top_matches_counted(pairs: DataFrame, frames: DataFrame, k: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """top_matches, and the rounds as nearest_hashes gives them."""
    hashes = folded_hashes(frames, k)
    asked = hashes.select(F.col("media_id").alias("target_id"), F.col("h0").alias("r0"), F.col("h1").alias("r1"))
    queries = pairs.select("primary_id", "target_id").distinct().join(asked, "target_id").select("primary_id", "r0", "r1").distinct()
    best, rounds = nearest_hashes(queries, hashes, k)
    at = hashes.select(F.col("media_id").alias("primary_id"), "h0", "h1", "at")
    entries = best.join(at, ["primary_id", "h0", "h1"]).select("primary_id", "r0", "r1", "hd", F.explode("at").alias("frame_idx"))
    order = F.row_number().over(Window.partitionBy("primary_id", "r0", "r1").orderBy("hd", "frame_idx"))
    ranked = written(entries.withColumn("rank", order).where(F.col("rank") <= k))
    target = frames.select(F.col("media_id").alias("target_id"), F.col("frame_idx").alias("ref_frame"), F.col("h0").alias("r0"), F.col("h1").alias("r1"))
    each = pairs.join(target, "target_id").select("pair_id", "primary_id", "ref_frame", "r0", "r1")
    return each.join(ranked, ["primary_id", "r0", "r1"]).select("pair_id", "ref_frame", "rank", "frame_idx", F.col("hd").cast("int").alias("hd")), rounds
