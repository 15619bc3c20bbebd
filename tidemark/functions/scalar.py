"""Column functions: hashes, sub-sample peaks, bands, time conversions, names, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

# Suffixes that batch names drop wherever they stand, and the extensions of video files.
SUFFIXES = ("_primary", "_anchor", "_cam1", "_cam2", "_target", "_synced")
EXTENSIONS = (".mp4", ".mkv", ".mov", ".avi", ".mxf", ".ts", ".webm", ".flv", ".wmv")


def sign_word(vector: str, first: int, bits: int = 32) -> Column:
    """The signs of `bits` components from place `first` (from 0), the first as the highest bit."""
    places = F.sequence(F.lit(first), F.lit(first + bits - 1))
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a * 2 + F.when(F.get(F.col(vector), i) > 0, 1).otherwise(0))


def hamming(pairs: list[tuple[Column, Column]]) -> Column:
    """Differing bits over pairs of hash words."""
    out = F.lit(0).cast("long")
    for a, b in pairs:
        out = out + F.bit_count(a.bitwiseXOR(b))
    return out


def second_difference_variance(vector: str, scale: float = 500.0) -> Column:
    """Population variance of the second differences of a vector, scaled: how much detail it has."""
    v = F.col(vector).cast("array<double>")
    n = F.size(v) - 2

    def step(acc: Column, i: Column) -> Column:
        x = F.get(v, i) - 2 * F.get(v, i + 1) + F.get(v, i + 2)
        return F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    variance = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["q"] / n - (acc["s"] / n) * (acc["s"] / n))
    return F.when(n >= 1, F.greatest(F.lit(0.0), variance) * scale)


def vertex_of_minimum(before: Column, at: Column, after: Column, cfg: Config = DEFAULT) -> Column:
    """Sub-frame shift of a minimum; 0 without both neighbours, on a flat or far vertex."""
    bend = after - 2 * at + before
    shift = 0.5 * (before - after) / F.when(F.abs(bend) > cfg.curvature, bend)
    return F.coalesce(F.when(F.abs(shift) < cfg.reach, shift), F.lit(0.0))


def vertex_of_maximum(before: Column, at: Column, after: Column) -> Column:
    """Sub-bin shift of a maximum, held within a bin; 0 without both neighbours or on a flat vertex."""
    bend = before - 2 * at + after
    curved = F.abs(bend) >= 1e-12
    shift = 0.5 * (before - after) / F.when(curved, bend)
    # The bounds stay within the case: greatest and least pass over nulls.
    return F.when(curved, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shift))).otherwise(F.lit(0.0))


def visual_band(hd: Column, threshold: int) -> Column:
    return F.when(hd <= threshold // 3, "high").when(hd <= threshold, "medium").otherwise("low")


def peak_band(peak: Column, bands: tuple[float, float]) -> Column:
    return F.when(peak >= bands[0], "high").when(peak >= bands[1], "medium").otherwise("low")


def frame_to_time(frame: Column, fps: Column) -> Column:
    return F.coalesce(frame / F.when(fps > 0, fps), F.lit(0.0))


def time_to_frame(t: Column, fps: Column) -> Column:
    """Toward zero, as a stored conversion does."""
    return (t * fps).cast("long")


def time_to_frame_even(t: Column, fps: Column) -> Column:
    """To the nearest, halves to even, as the samplers do."""
    return F.bround(t * fps).cast("long")


def rational(text: Column) -> Column:
    """'24000/1001' as a number; null without a denominator other than zero."""
    parts = F.split(text, "/")
    return F.expr("1D") * F.call_function("try_divide", F.get(parts, F.lit(0)).cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).cast("double"))


def shown(c: Column, places: int) -> Column:
    """c rounded as a double for printing: what is stored just below a half goes down, although its shortest decimal ends in 5."""
    scale = float(10**places)
    return F.round(c * scale) / scale


def timecode(t: Column, fps: Column) -> Column:
    """H:MM:SS:FF at the rounded frame rate, '-' before negative times."""
    rate = F.greatest(F.bround(fps), F.lit(1.0)).cast("long")
    frames = F.bround(F.abs(t) * rate).cast("long")
    seconds = F.floor(frames / rate)
    text = F.format_string("%d:%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60, frames % rate)
    return F.concat(F.when((t < 0) & (frames > 0), "-").otherwise(""), text)


def batch_name(path: Column) -> Column:
    """Base name without extension and suffixes, then lower case and trimmed. Suffixes go before case is folded."""
    out = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    for s in SUFFIXES:
        out = F.replace(out, F.lit(s), F.lit(""))
    return F.trim(F.lower(out))


def list_name(path: Column) -> Column:
    """batch_name with separators and runs of blanks as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(batch_name(path), "[_.-]", " "), r"\s+", " "))


def is_video(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$")


def output_path(path: Column, suffix: str = "_synced") -> Column:
    return F.concat(F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.lit(suffix), F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 2))


def severity(message: Column) -> Column:
    """Level of a log line by how it starts and what it holds; null for an empty line."""
    m = F.lower(message)
    level = F.when(m.startswith("error") | m.startswith("\u2716"), "error").when(m.startswith("warning") | message.contains("\u26a0"), "warning").when(message.contains("===") | m.contains("complete"), "success").otherwise("info")
    return F.when(message != "", level)


def visual_limit_ms(fps: Column) -> Column:
    return 500.0 / F.greatest(fps, F.lit(1e-6))


def audio_limit_ms(fps: Column) -> Column:
    return F.greatest(1000.0 / F.greatest(fps, F.lit(1e-6)), F.lit(20.0))


def agreement(delta: Column, cfg: Config = DEFAULT) -> Column:
    return F.when(F.abs(delta) <= cfg.confirm, "confirmed").when(F.abs(delta) <= cfg.borderline, "borderline").otherwise("disagree")
