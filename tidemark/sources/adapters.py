"""Alignment tables derived from the generic tables of a data set, for queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import second_difference_variance, sign_word

EPOCH = "2024-01-01"
FPS = 24.0
BINS = 720
FOREVER = 1_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    """Seconds since the epoch of the data set; the column has no time zone."""
    at = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp_ntz").cast("timestamp"))
    return at / F.lit(1e6)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, frame_idx, t, h0, h1, lap_var: the vectors of a label are the frames of a recording."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("media_id"), "vec_id", F.col("embedding"))
    idx = (F.row_number().over(Window.partitionBy("media_id").orderBy("vec_id")) - 1).cast("long")
    hashed = e.select("media_id", idx.alias("frame_idx"), sign_word("embedding", 0).alias("h0"), sign_word("embedding", 32).alias("h1"), F.round(second_difference_variance("embedding"), 6).alias("lap_var"))
    return hashed.withColumn("t", F.col("frame_idx") / F.lit(FPS))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", seconds().alias("t"), "user_id", "event_type", "value", "props")


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, bin, amp: raw values in bins of one hour."""
    e = events(spark, sf_dir)
    return e.select(F.col("event_type").alias("media_id"), F.floor(F.col("t") / 3600).cast("long").alias("bin"), F.col("value").alias("amp"))


def cuts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """pair_id, id, t of one kind of event; a user is a pair."""
    e = events(spark, sf_dir).where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("pair_id"), F.col("event_id").alias("id"), "t")


def samples(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    """pair_id, id, target_t, offset, hd: dense offset samples of ten pairs."""
    offset = F.col("value") / 100 if noisy else F.floor(F.col("t") / 864000) * 0.4 + F.col("value") / 10000
    e = events(spark, sf_dir)
    return e.select((F.col("user_id") % 10).alias("pair_id"), F.col("event_id").alias("id"), F.col("t").alias("target_t"), F.round(offset, 6).alias("offset"), (F.col("event_id") % 17).cast("int").alias("hd"))


def blacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, b_start, b_end: dark intervals of ten primaries."""
    e = events(spark, sf_dir).where("event_type = 'error'")
    return e.select((F.col("user_id") % 10).alias("pair_id"), F.col("event_id").alias("id"), F.col("t").alias("b_start"), (F.col("t") + F.col("value") / 100).alias("b_end"))


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, id, t, delta_frames at 24 frames a second."""
    e = events(spark, sf_dir)
    return e.select((F.col("user_id") % 10).alias("pair_id"), F.col("event_id").alias("id"), "t", F.round(F.col("value") / 100 - 0.5, 6).alias("delta_frames"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folder, side, id, path: part names as the two sides of the file lists of many folders."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    path = F.concat(F.lit("/media/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 3 == 0, "_primary").when(F.col("p_partkey") % 3 == 1, "_PRIMARY").otherwise("_cam1"), F.when(F.col("p_partkey") % 5 == 0, ".txt").when(F.col("p_partkey") % 2 == 0, ".MKV").otherwise(".mp4"))
    return p.select(F.floor(F.col("p_partkey") / 40).cast("long").alias("folder"), F.when(F.col("p_partkey") % 2 == 0, "primary").otherwise("target").alias("side"), F.col("p_partkey").alias("id"), path.alias("path"))


#: How each variant of a recording is put together: variant, stream, from the other recording, first and last hour, hour in the variant.
EDITS = (
    (0, "frames", 0, 7, FOREVER, 0), (0, "sound", 0, 7, FOREVER, 0), (0, "cuts", 0, 7, FOREVER, 0),
    (1, "frames", 0, 3, 100, 0), (1, "frames", 0, 104, FOREVER, 97), (1, "sound", 0, 3, 100, 0), (1, "sound", 0, 104, FOREVER, 97), (1, "cuts", 0, 3, 100, 0), (1, "cuts", 0, 104, FOREVER, 97),
    (2, "frames", 1, 40, 52, 0), (2, "frames", 0, 0, FOREVER, 12), (2, "sound", 1, 40, 52, 0), (2, "sound", 0, 0, FOREVER, 12), (2, "cuts", 1, 40, 52, 0), (2, "cuts", 0, 0, FOREVER, 12),
    (3, "spoilt", 0, 5, FOREVER, 0), (3, "sound", 0, 5, FOREVER, 0), (3, "cuts", 0, 5, FOREVER, 0),
    (4, "spoilt", 0, 9, FOREVER, 0), (4, "sound", 0, 9, FOREVER, 0),
    (5, "spoilt", 0, 4, 34, 0), (5, "frames", 0, 34, FOREVER, 30), (5, "sound", 0, 4, FOREVER, 0), (5, "cuts", 0, 4, FOREVER, 0),
    (6, "frames", 0, 29, FOREVER, 0), (6, "sound", 0, 9, FOREVER, 0), (6, "cuts", 0, 9, FOREVER, 0),
    (7, "spoilt", 0, 2, FOREVER, 0),
)


def edits(spark: SparkSession, *streams: str) -> DataFrame:
    """media_id, stream, source_id, from_t, to_t, at: the pieces of the variants of two recordings, eight of each.

    0: without its first hours; 1: with a hole as well; 2: behind hours of the other one; 3 and 4: with spoilt pictures, 4
    without cuts as well; 5: with a spoilt start; 6: with pictures that run ahead of sound and cuts; 7: with spoilt pictures only.
    """
    rows = [(100 + 8 * m + v, stream, 1 - m if other else m, a, b, at) for m in (0, 1) for v, stream, other, a, b, at in EDITS if stream in streams]
    return spark.createDataFrame(rows, "media_id long, stream string, source_id long, from_t long, to_t long, at long")


def variant_pairs(spark: SparkSession) -> DataFrame:
    """pair_id, primary_id, target_id: each recording (0, 1) with its variants."""
    return spark.range(16).select(F.col("id").alias("pair_id"), F.floor(F.col("id") / 8).cast("long").alias("primary_id"), (F.col("id") + 100).alias("target_id"))


def _with_variants(source: DataFrame, pieces: DataFrame, place: str) -> DataFrame:
    """source (media_id, ...) and its rows in the pieces of the variants, moved along `place`."""
    columns = source.columns
    piece = pieces.withColumnRenamed("media_id", "variant_id")
    moved = source.join(F.broadcast(piece), (F.col("media_id") == F.col("source_id")) & (F.col(place) >= F.col("from_t")) & (F.col(place) < F.col("to_t")))
    moved = moved.withColumn("media_id", F.col("variant_id")).withColumn(place, F.col("at") + (F.col(place) - F.col("from_t")))
    return source.withColumn("stream", F.lit("own")).select(*columns, "stream").unionByName(moved.select(*columns, "stream"))


def variant_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, frame_idx, h0, h1, lap_var, a frame an hour: two recordings of all vectors, even and odd labels, and their variants."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "embeddings").select((F.col("label") % 2).cast("long").alias("media_id"), "vec_id", "embedding")
    idx = (F.row_number().over(Window.partitionBy("media_id").orderBy("vec_id")) - 1).cast("long")
    own = e.select("media_id", idx.alias("frame_idx"), sign_word("embedding", 0).alias("h0"), sign_word("embedding", 32).alias("h1"), F.round(second_difference_variance("embedding"), 6).alias("lap_var"))
    every = _with_variants(own, edits(spark, "frames", "spoilt"), "frame_idx")
    spoilt = F.col("stream") == "spoilt"
    h0, h1 = F.when(spoilt, F.col("h1").bitwiseXOR(F.lit(0xAAAAAAAA))).otherwise(F.col("h0")), F.when(spoilt, F.col("h0").bitwiseXOR(F.lit(0x55555555))).otherwise(F.col("h1"))
    return every.select("media_id", "frame_idx", h0.alias("h0"), h1.alias("h1"), "lap_var")


def variant_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, bin, amp by the hour, of the two recordings and their variants."""
    e = events(spark, sf_dir).select((F.col("user_id") % 2).alias("media_id"), F.floor(F.col("t") / 3600).cast("long").alias("bin"), F.col("value").alias("amp"))
    return _with_variants(e, edits(spark, "sound"), "bin").drop("stream")


def variant_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, t in hours, of the two recordings and their variants."""
    e = events(spark, sf_dir).where("event_type = 'click'").select((F.col("user_id") % 2).alias("media_id"), (F.col("t") / 3600).alias("t"))
    return _with_variants(e, edits(spark, "cuts"), "t").drop("stream")


def variant_blacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, b_start, b_end in hours: dark intervals of the two recordings."""
    e = events(spark, sf_dir).where("event_type = 'error'")
    return e.select((F.col("user_id") % 2).alias("media_id"), (F.col("t") / 3600).alias("b_start"), (F.col("t") / 3600 + F.col("value") / 100).alias("b_end"))


def pair_table(spark: SparkSession, media: int = 10) -> DataFrame:
    return spark.range(media).select(F.col("id").alias("pair_id"), ((F.col("id") + 1) % media).alias("primary_id"), F.col("id").alias("target_id"))


def signal_pairs(spark: SparkSession) -> DataFrame:
    """pair_id, primary_id, target_id over the five kinds of event."""
    kinds = ("click", "error", "purchase", "signup", "view")
    return spark.createDataFrame([(i, k, kinds[(i + 1) % 5]) for i, k in enumerate(kinds)], "pair_id long, primary_id string, target_id string")
