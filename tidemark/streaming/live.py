"""Streaming forms: energy of a live signal by event time, and the best match so far of each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hamming


def windowed_rms(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """event_type, w_start, rms, n over tumbling windows of event time (columns ts, event_type, value).

    With append output a window comes out once the watermark has passed it; later rows of it are dropped.
    """
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.sqrt(F.avg(F.col("value") * F.col("value")) + 1e-12).alias("rms"), F.count("*").alias("n"))
    return out.select("event_type", F.col("w.start").alias("w_start"), "rms", "n")


def running_best(frames: DataFrame, refs: DataFrame) -> DataFrame:
    """pair_id, hd, frame_idx: the nearest frame so far of each pair's reference (stream-static join, complete output).

    frames: a stream of media_id, frame_idx, h0, h1; refs: a static table pair_id, primary_id, r0, r1. The state is one row a pair.
    """
    each = frames.join(refs, frames["media_id"] == refs["primary_id"]).select("pair_id", F.struct(hamming([(F.col("r0"), F.col("h0")), (F.col("r1"), F.col("h1"))]).alias("hd"), "frame_idx").alias("m"))
    return each.groupBy("pair_id").agg(F.min("m").alias("m")).select("pair_id", "m.hd", "m.frame_idx")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all rows that are there and give the result as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
