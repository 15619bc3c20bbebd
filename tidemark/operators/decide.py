"""Decisions between engines, edit plans and commands: projections over joined candidate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalar import agreement, output_path


def agreement_bands(candidates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, audio, cut: how the audio and the cut offset agree with the visual one; null where either is missing."""
    def band(other):
        return F.when(F.col("v_off").isNotNull() & F.col(other).isNotNull(), agreement(F.round(F.col(other) - F.col("v_off"), 9), cfg))

    return candidates.select("pair_id", band("a_off").alias("audio"), band("c_off").alias("cut"))


def consensus(candidates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, overridden, offset: audio and cuts together against the visual offset, weighted by their peaks."""
    apart = lambda a, b: F.round(F.abs(F.col(a) - F.col(b)), 9)
    over = F.coalesce((apart("a_off", "c_off") <= cfg.consensus_agree) & (apart("a_off", "v_off") > cfg.consensus_apart) & (apart("c_off", "v_off") > cfg.consensus_apart), F.lit(False))
    wa, wc = F.greatest(F.lit(0.0), F.col("a_peak")), F.greatest(F.lit(0.0), F.col("c_peak"))
    mean = F.when(wa + wc > 1e-6, (wa * F.col("a_off") + wc * F.col("c_off")) / F.when(wa + wc > 1e-6, wa + wc)).otherwise((F.col("a_off") + F.col("c_off")) / 2)
    return candidates.select("pair_id", over.alias("overridden"), F.when(over, mean).otherwise(F.col("v_off")).alias("offset"))


def fallback_cascade(candidates: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, source, hd, offset: consensus over visual, then cuts, then audio; 'none' where nothing is good enough.

    hd keeps the markers of the other sources: -3 consensus, -2 cuts, -1 audio.
    """
    c = candidates.join(consensus(candidates, cfg), "pair_id")
    source = F.when(F.col("overridden"), "consensus").when(F.col("v_off").isNotNull(), "visual").when(F.coalesce(F.col("c_peak") >= cfg.cut_fallback, F.lit(False)) & F.col("c_off").isNotNull(), "cut").when(F.coalesce(F.col("a_peak") >= cfg.audio_fallback, F.lit(False)) & F.col("a_off").isNotNull(), "audio").otherwise("none")
    c = c.withColumn("source", source)
    hd = F.when(F.col("source") == "consensus", -3).when(F.col("source") == "cut", -2).when(F.col("source") == "audio", -1).when(F.col("source") == "visual", F.col("v_hd"))
    offset = F.when(F.col("source").isin("consensus", "visual"), F.col("offset")).when(F.col("source") == "cut", F.col("c_off")).when(F.col("source") == "audio", F.col("a_off"))
    return c.select("pair_id", "source", hd.cast("int").alias("hd"), offset.alias("offset"))


def adjudicate(segments: DataFrame, audio: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """pair_id, seg_no, source, reason, offset: each segment's own offset or the audio one (pair_id, seg_no, a_off, a_peak)."""
    s = segments.join(audio, ["pair_id", "seg_no"], "left")
    delta = F.round(F.abs(F.col("a_off") - F.col("offset")), 9)
    trusted = (F.col("phash_inliers") >= cfg.inliers) & (F.col("phash_stdev") <= cfg.stdev)
    good = F.coalesce((F.col("a_peak") >= cfg.audio_quality) & (delta <= cfg.audio_reach), F.lit(False))
    reason = F.when(F.col("a_off").isNull(), "no audio").when(trusted & (delta <= cfg.near), "agree").when(trusted & good, "audio differs").when(trusted, "audio weak").when(good, "untrusted visual").otherwise("nothing better")
    source = F.when(F.col("reason").isin("audio differs", "untrusted visual"), "audio").otherwise("visual")
    return s.withColumn("reason", reason).withColumn("source", source).select("pair_id", "seg_no", "source", "reason", F.when(F.col("source") == "audio", F.col("a_off")).otherwise(F.col("offset")).alias("offset"))


def edit_plan(results: DataFrame) -> DataFrame:
    """pair_id, action, seek, pad, delay_ms, length: trim for a negative offset, else pad; from pair_id, offset, primary_duration."""
    neg = F.col("offset") < 0
    return results.select("pair_id", F.when(neg, "trim").otherwise("pad").alias("action"), F.when(neg, -F.col("offset")).otherwise(0.0).alias("seek"), F.when(neg, 0.0).otherwise(F.col("offset")).alias("pad"), F.when(neg, 0.0).otherwise(F.col("offset") * 1000).alias("delay_ms"), F.col("primary_duration").alias("length"))


def preview_plan(results: DataFrame, length: float = 5.0, seek: float = 30.0) -> DataFrame:
    """pair_id, seek, length, width, height of a difference preview."""
    return results.select("pair_id", F.least(F.lit(seek), F.greatest(F.lit(0.0), F.col("primary_duration") - length - 1)).alias("seek"), F.lit(length).alias("length"), F.lit(854).alias("width"), F.lit(480).alias("height"))


def render_script(chunks: DataFrame) -> DataFrame:
    """pair_id, n_parts, script: the chunks worth rendering, in order, one part each."""
    worth = chunks.where(((F.col("kind") == "filler") & (F.col("duration") >= 0.030)) | ((F.col("kind") == "target") & (F.col("duration") >= 0.001)))
    part = F.when(F.col("kind") == "filler", F.format_string("black:%.3f", F.col("duration"))).otherwise(F.format_string("play:%.3f-%.3f", F.col("target_start"), F.col("target_end")))
    return worth.groupBy("pair_id").agg(F.count("*").alias("n_parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", part.alias("p")))), lambda x: x["p"]), ";").alias("script"))


def render_graph(chunks: DataFrame, media: DataFrame, sample_rate: int = 48000) -> DataFrame:
    """pair_id, n_parts, graph: the filter graph that plays the chunks worth rendering one after another.

    media: pair_id, width, height, fps_rational of the primary. Each part starts at time zero at the primary's size and rate, with
    stereo sound of one sample rate; fillers are black and silent. Both joined streams start at time zero again, as joining
    leaves a first time above zero, which some editors reject.
    """
    c = chunks.where(((F.col("kind") == "filler") & (F.col("duration") >= 0.030)) | ((F.col("kind") == "target") & (F.col("duration") >= 0.001))).join(media, "pair_id")
    i = (F.row_number().over(Window.partitionBy("pair_id").orderBy("chunk_no")) - 1).cast("string")
    span = F.format_string("start=%.6f:end=%.6f", "target_start", "target_end")
    size = F.concat_ws(":", "width", "height")
    play = F.concat(F.lit("[0:v]trim="), span, F.lit(",setpts=PTS-STARTPTS,scale="), size, F.lit(":force_original_aspect_ratio=decrease,pad="), size, F.lit(":(ow-iw)/2:(oh-ih)/2,setsar=1,fps="), F.col("fps_rational"), F.lit("[v"), F.col("i"), F.lit("];[0:a]atrim="), span, F.lit(f",asetpts=PTS-STARTPTS,aresample={sample_rate},aformat=channel_layouts=stereo[a"), F.col("i"), F.lit("]"))
    length = F.format_string("%.6f", "duration")
    fill = F.concat(F.lit("color=c=black:s="), F.concat_ws("x", "width", "height"), F.lit(":r="), F.col("fps_rational"), F.lit(":d="), length, F.lit(",setsar=1[v"), F.col("i"), F.lit(f"];anullsrc=r={sample_rate}:cl=stereo,atrim=duration="), length, F.lit("[a"), F.col("i"), F.lit("]"))
    parts = c.withColumn("i", i).select("pair_id", "chunk_no", "i", F.when(F.col("kind") == "filler", fill).otherwise(play).alias("part"))
    g = parts.groupBy("pair_id").agg(F.count("*").alias("n_parts"), F.array_sort(F.collect_list(F.struct("chunk_no", "i", "part"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["part"]), ";")
    inputs = F.array_join(F.transform("p", lambda x: F.concat(F.lit("[v"), x["i"], F.lit("][a"), x["i"], F.lit("]"))), "")
    return g.select("pair_id", "n_parts", F.concat(joined, F.lit(";"), inputs, F.lit("concat=n="), F.col("n_parts").cast("string"), F.lit(":v=1:a=1[vj][aj];[vj]setpts=PTS-STARTPTS[v];[aj]asetpts=PTS-STARTPTS[a]")).alias("graph"))


#: How the joined streams are encoded, so that editing programs open the file.
ENCODING = (
    "-c:v libx264 -crf 18 -preset veryfast -pix_fmt yuv420p -profile:v high -level 4.0 -x264-params keyint=48:min-keyint=48:no-scenecut=1:open-gop=0 -bf 2 -refs 3"
    " -color_primaries bt709 -color_trc bt709 -colorspace bt709 -color_range tv -fps_mode cfr"
    " -c:a aac -b:a 192k -ar 48000 -ac 2 -profile:a aac_low -movflags +faststart -avoid_negative_ts make_zero -f mp4"
)


def render_command(graphs: DataFrame, files: DataFrame) -> DataFrame:
    """pair_id, arguments, output: the encoder's arguments for each graph (pair_id, graph), one element an argument.

    files: pair_id, path of the target. The output stands beside it and is an MP4 whatever the target is. A pair without a file
    or a graph has no row.
    """
    out = F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit("_synced.mp4"))
    rows = graphs.join(files.select("pair_id", "path").where("path IS NOT NULL"), "pair_id").withColumn("output", out)
    given = F.array(F.lit("-y"), F.lit("-i"), F.col("path"), F.lit("-filter_complex"), F.col("graph"), F.lit("-map"), F.lit("[v]"), F.lit("-map"), F.lit("[a]"))
    return rows.select("pair_id", F.concat(given, F.split(F.lit(ENCODING), " "), F.array("output")).alias("arguments"), "output")


def batch_counts(results: DataFrame) -> DataFrame:
    """succeeded, failed over results with an error column."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def edit_command(plan: DataFrame, files: DataFrame) -> DataFrame:
    """pair_id, arguments, output: the encoder's arguments of each edit plan, for a target that only moves as a whole.

    files: pair_id, path of the target. Trimming seeks before the input; padding repeats the first picture and delays every sound channel by
    the same time, in fractions of a millisecond, so that picture and sound stay together. A pair without a file has no row.
    """
    rows = plan.join(files.select("pair_id", "path").where("path IS NOT NULL"), "pair_id").withColumn("output", output_path(F.col("path")))
    delay = F.format_string("%.6f", "delay_ms")
    trim = F.array(F.lit("-y"), F.lit("-ss"), F.format_string("%.6f", "seek"), F.lit("-i"), F.col("path"))
    pad = F.array(F.lit("-y"), F.lit("-i"), F.col("path"), F.lit("-vf"), F.concat(F.lit("tpad=start_duration="), F.format_string("%.6f", "pad"), F.lit(":start_mode=clone")), F.lit("-af"), F.concat(F.lit("adelay="), delay, F.lit("|"), delay, F.lit(":all=1")))
    ends = F.array(F.lit("-t"), F.format_string("%.6f", "length"), F.col("output"))
    return rows.select("pair_id", F.concat(F.when(F.col("action") == "trim", trim).otherwise(pad), ends).alias("arguments"), "output")


def preview_command(plan: DataFrame, files: DataFrame) -> DataFrame:
    """pair_id, arguments, output: the arguments of a difference preview, black where the two recordings agree.

    files: pair_id, primary_path, synced_path. Both are fitted into the plan's size, so that recordings of unlike sizes can be compared.
    """
    rows = plan.join(files.select("pair_id", "primary_path", "synced_path").where("primary_path IS NOT NULL AND synced_path IS NOT NULL"), "pair_id")
    size = F.concat_ws(":", "width", "height")
    fit = lambda i, out: F.concat(F.lit(f"[{i}:v]scale="), size, F.lit(":force_original_aspect_ratio=decrease,pad="), size, F.lit(f":(ow-iw)/2:(oh-ih)/2,setsar=1[{out}];"))
    output = F.concat(F.regexp_replace("synced_path", r"\.[^./]*$", ""), F.lit("_diff_preview"), F.regexp_extract("synced_path", r"(\.[^./]*)$", 1))
    at = F.format_string("%.6f", "seek")
    parts = [F.lit("-y"), F.lit("-ss"), at, F.lit("-i"), F.col("primary_path"), F.lit("-ss"), at, F.lit("-i"), F.col("synced_path"), F.lit("-filter_complex")]
    graph = F.concat(fit(0, "a"), fit(1, "b"), F.lit("[a][b]blend=all_mode=difference[v]"))
    ends = [graph, F.lit("-map"), F.lit("[v]"), F.lit("-t"), F.format_string("%.6f", "length"), F.lit("-an"), F.col("output")]
    return rows.withColumn("output", output).select("pair_id", F.array(*parts, *ends).alias("arguments"), "output")
