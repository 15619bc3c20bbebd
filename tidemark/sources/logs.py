"""Tables from what external tools print: probe documents, cut logs, dark-interval logs, progress lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalar import rational
from ..schemas import PROBE


def _number(text: Column, kind: str) -> Column:
    return text.try_cast(kind)


def probe_media(docs: DataFrame) -> DataFrame:
    """media_id, duration, fps, fps_rational, total_frames, width, height, has_audio, codec_name, audio_codec, audio_sample_rate, error.

    docs: media_id, doc (JSON). The first video and the first audio stream count; the duration comes from the container, else
    from the video stream; frames are estimated where they are not given. Documents without video get an error.
    """
    p = docs.select("media_id", F.from_json("doc", PROBE).alias("d"))
    first = lambda kind: F.get(F.filter("d.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    p = p.withColumn("v", first("video")).withColumn("a", first("audio"))
    duration = F.coalesce(F.nullif(_number(F.col("d.format.duration"), "double"), F.lit(0.0)), _number(F.col("v.duration"), "double"), F.lit(0.0))
    p = p.withColumn("duration", duration).withColumn("fps", rational(F.col("v.r_frame_rate")))
    frames = F.coalesce(F.nullif(_number(F.col("v.nb_frames"), "long"), F.lit(0).cast("long")), (F.col("duration") * F.col("fps")).cast("long"))
    error = F.when(F.col("v").isNull(), "no video stream").when(F.col("fps").isNull(), "bad frame rate")
    return p.select(
        "media_id", "duration", "fps", F.col("v.r_frame_rate").alias("fps_rational"), frames.alias("total_frames"), _number(F.col("v.width"), "int").alias("width"), _number(F.col("v.height"), "int").alias("height"),
        F.col("a").isNotNull().alias("has_audio"), F.col("v.codec_name").alias("codec_name"), F.col("a.codec_name").alias("audio_codec"), _number(F.col("a.sample_rate"), "int").alias("audio_sample_rate"), error.alias("error"),
    )


def media_summary(media: DataFrame) -> DataFrame:
    """media_id, line: one line about each recording."""
    audio = F.when(F.col("has_audio"), F.coalesce("audio_codec", F.lit("unknown"))).otherwise("none")
    line = F.concat(F.format_string("%.2fs | %.3f fps | %dx%d | ", F.round("duration", 2), F.round("fps", 3), "width", "height"), F.coalesce("codec_name", F.lit("unknown")), F.format_string(" | %d frames | audio: ", "total_frames"), audio)
    return media.where("error IS NULL").select("media_id", line.alias("line"))


def cut_times(log: DataFrame, skip: float = 0.0) -> DataFrame:
    """media_id, t of the lines (media_id, line) that carry a time stamp; skip is added back."""
    t = F.nullif(F.regexp_extract("line", r"pts_time:([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    return log.select("media_id", (t + skip).alias("t")).where("t IS NOT NULL")


def cuts_from_scores(scores: DataFrame, limit: float = 0.30) -> DataFrame:
    """media_id, t of the frames whose scene score is above the limit."""
    return scores.where(F.col("score") > limit).select("media_id", "t")


def black_sections(log: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """media_id, b_start, b_end of the logged dark intervals that are long enough."""
    part = lambda name: F.nullif(F.regexp_extract("line", rf"{name}:\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    out = log.select("media_id", part("black_start").alias("b_start"), part("black_end").alias("b_end"))
    return out.where(F.round(F.col("b_end") - F.col("b_start"), 9) >= cfg.black_min)


def blacks_from_frames(frames: DataFrame, dark: float, fps: float, cfg: Config = DEFAULT) -> DataFrame:
    """Dark intervals from frame features: runs of consecutive frames with less detail than `dark`."""
    from pyspark.sql import Window

    w = Window.partitionBy("media_id").orderBy("frame_idx")
    low = frames.where(F.col("lap_var") < dark).select("media_id", "frame_idx").withColumn("run", F.col("frame_idx") - F.row_number().over(w))
    runs = low.groupBy("media_id", "run").agg((F.min("frame_idx") / F.lit(fps)).alias("b_start"), ((F.max("frame_idx") + 1) / F.lit(fps)).alias("b_end"))
    return runs.where(F.round(F.col("b_end") - F.col("b_start"), 9) >= cfg.black_min).select("media_id", "b_start", "b_end")


def progress(lines: DataFrame, length: str = "duration") -> DataFrame:
    """id, done_s, share, fps, speed from lines 'key=value ...'; times are in microseconds under either of two keys."""
    get = lambda name, pat: F.nullif(F.regexp_extract("line", rf"\b{name}=\s*({pat})", 1), F.lit(""))
    micros = F.coalesce(get("out_time_us", "[0-9]+"), get("out_time_ms", "[0-9]+")).try_cast("double") / 1e6
    return lines.select("id", micros.alias("done_s"), F.least(F.lit(1.0), micros / F.nullif(F.col(length), F.lit(0.0))).alias("share"), get("fps", "[0-9.]+").try_cast("double").alias("fps"), get("speed", "[0-9.]+").try_cast("double").alias("speed"))


def pcm_window(pcm: DataFrame, start: float, length: float, rate: int = DEFAULT.sample_rate) -> DataFrame:
    """media_id, sample_idx, amp (-1 to 1) of a time window of 16-bit samples; the range reaches the file scan."""
    first, last = int(start * rate), int((start + length) * rate)
    return pcm.where((F.col("sample_idx") >= first) & (F.col("sample_idx") < last)).select("media_id", "sample_idx", (F.col("value") / F.lit(32768.0)).alias("amp"))


def pcm_windows(pcm: DataFrame, windows: DataFrame, rate: int = DEFAULT.sample_rate, strict: bool = False) -> DataFrame:
    """windows (media_id, window_no, w_start, w_end) with n and amps, the samples in order; both null where there are none.

    Samples meet windows by second. strict raises an error at a window without samples instead.
    """
    first, last = (F.col("w_start") * rate).cast("long"), (F.col("w_end") * rate).cast("long")
    w = windows.withColumns({"lo": first, "hi": last})
    spread = w.where("hi > lo").withColumn("sec", F.explode(F.sequence(F.floor(F.col("lo") / rate), F.floor((F.col("hi") - 1) / rate))))
    rows = pcm.select("media_id", F.floor(F.col("sample_idx") / rate).alias("sec"), "sample_idx", (F.col("value") / F.lit(32768.0)).alias("amp"))
    inside = spread.join(rows, ["media_id", "sec"]).where("sample_idx >= lo AND sample_idx < hi")
    got = inside.groupBy("media_id", "window_no").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("sample_idx", "amp"))).alias("s"))
    out = w.join(got, ["media_id", "window_no"], "left").select(*windows.columns, "n", F.transform("s", lambda x: x["amp"]).alias("amps"))
    return out.withColumn("n", F.coalesce("n", F.raise_error(F.lit("no samples in the window")).cast("long"))) if strict else out
