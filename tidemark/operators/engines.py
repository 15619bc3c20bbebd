"""Engines that find the offsets of pairs, and the lazy chain in which each sees only the pairs that are still open.

An engine takes pairs (pair_id, primary_id, target_id) and gives a row for each pair that it solves. A chain hands all pairs
to its first engine, writes what that finds, and hands on the rest (an anti-join, written as well); when none is left, the
other engines never run. So what an engine scans is bounded by the pairs that need it: its inputs are narrowed to their
recordings by joins. The written tables also cut the plan between the stages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalar import visual_band
from . import decide, nearest, sampling, signals, stats
from .lineage import written

Engine = Callable[[DataFrame], DataFrame]


@dataclass
class Narrowed:
    """rows: what the stages found, with the name of the stage; open: pairs that no stage solved; given: pairs each stage saw."""

    rows: DataFrame | None
    open: DataFrame
    given: dict[str, int] = field(default_factory=dict)


def narrowed(pairs: DataFrame, stages: list[tuple[str, Engine]], key: str = "pair_id") -> Narrowed:
    """Each stage on the pairs that those before it left open; rows is null where no stage ran, as there were no pairs.

    The rows of all stages need the same columns. Runs a job a stage, as what one finds decides on the next.
    """
    out = Narrowed(None, written(pairs))
    for name, engine in stages:
        n = out.open.count()
        if not n:
            break
        out.given[name] = n
        rows = written(engine(out.open).withColumn("stage", F.lit(name)))
        out.rows = rows if out.rows is None else out.rows.unionByName(rows)
        out.open = written(out.open.join(rows.select(key), key, "left_anti"))
    return out


def of_recordings(table: DataFrame, pairs: DataFrame, *sides: str) -> DataFrame:
    """The rows (media_id, ...) of the recordings on the given sides (primary_id, target_id) of the pairs."""
    wanted = pairs.select(F.explode(F.array(*sides)).alias("media_id")).distinct()
    return table.join(wanted, "media_id", "left_semi")


@dataclass(frozen=True)
class VisualEngine:
    """Offsets by frame hashes: a single reference, and several where that fails.

    frames: media_id, frame_idx, h0, h1, lap_var. references: 'retry' (several references for the pairs that one did not
    solve), 'always' (several from the start) or 'off'. intro: look for the first shared content first, take the reference there, and
    search around it again where a match lies well before it. An offset found again counts from the time of its reference
    frame; median_time counts it from the median time of the anchor's probes instead, which is off by as much as they lie apart.
    """

    frames: DataFrame
    fps: float
    threshold: int = DEFAULT.threshold
    cfg: Config = DEFAULT
    intro: bool = True
    references: str = "retry"
    median_time: bool = False

    def __post_init__(self):
        if self.references not in ("off", "retry", "always"):
            raise ValueError("references must be 'off', 'retry' or 'always'")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """pair_id, ref_frame, frame_idx, hd, offset, confidence, stage."""
        found = self.search(pairs).rows
        return self._none(pairs) if found is None else found

    def search(self, pairs: DataFrame) -> Narrowed:
        one, several = ("single", self.single), ("multi", self.several)
        return narrowed(pairs, {"off": [one], "retry": [one, several], "always": [several]}[self.references])

    def _none(self, pairs: DataFrame) -> DataFrame:
        return self._result(pairs.where("false").select("pair_id", *(F.lit(0).cast(t).alias(c) for c, t in (("ref_frame", "long"), ("frame_idx", "long"), ("hd", "long"), ("shift", "double"), ("ref_t", "double"))))).withColumn("stage", F.lit(""))

    def _result(self, found: DataFrame) -> DataFrame:
        offset = (F.col("frame_idx") + F.col("shift")) / F.lit(self.fps) - F.col("ref_t")
        return found.select("pair_id", "ref_frame", "frame_idx", F.col("hd").cast("long").alias("hd"), offset.alias("offset"), visual_band(F.col("hd"), self.threshold).alias("confidence"))

    def anchors(self, pairs: DataFrame) -> DataFrame:
        """pair_id, offset, primary_t, target_t, hd, n, target_frame, primary_frame, written."""
        from .flow import intro_probes

        probes = written(intro_probes(pairs, self.frames, self.fps, self.cfg, max(self.cfg.coarse_step, 8)))
        return written(stats.anchor_frames(stats.probe_clusters(probes, self.cfg), self.threshold, self.cfg))

    def reference(self, pairs: DataFrame, anchors: DataFrame | None) -> Narrowed:
        """pair_id, ref_frame, stage: at the anchor, else the first detailed frame, else by tiers behind the skipped start."""

        def chosen(pick: Callable[[DataFrame], DataFrame]) -> Engine:
            def engine(open_: DataFrame) -> DataFrame:
                rows = pick(of_recordings(self.frames, open_, "target_id")).select(F.col("media_id").alias("target_id"), F.col("frame_idx").alias("ref_frame"))
                return open_.join(rows, "target_id").select("pair_id", "ref_frame")

            return engine

        skip = 2.0 if anchors is not None else self.cfg.reference_skip
        stages: list[tuple[str, Engine]] = [("tiers", chosen(lambda f: sampling.reference_frame(f, self.fps, self.cfg, skip)))]
        if anchors is not None:
            at_anchor = anchors.select("pair_id", F.col("target_frame").alias("ref_frame"))
            stages = [("anchor", lambda open_: open_.join(at_anchor, "pair_id").select("pair_id", "ref_frame")), ("first content", chosen(lambda f: sampling.first_content_frame(f, self.fps, self.cfg))), *stages]
        return narrowed(pairs, stages)

    def single(self, pairs: DataFrame) -> DataFrame:
        """One reference a pair. No row where the coarse distance exceeds twice the threshold."""
        anchors = self.anchors(pairs) if self.intro else None
        picked = self.reference(pairs, anchors).rows
        if picked is None:
            return self._none(pairs).drop("stage")
        words = self.frames.select(F.col("media_id").alias("target_id"), F.col("frame_idx").alias("ref_frame"), F.col("h0").alias("r0"), F.col("h1").alias("r1"))
        refs = pairs.join(picked, "pair_id").join(words, ["target_id", "ref_frame"])
        refs = written(refs.select("pair_id", "primary_id", F.lit(0).alias("ref_no"), "ref_frame", (F.col("ref_frame") / F.lit(self.fps)).alias("ref_t"), "r0", "r1"))
        coarse = nearest.coarse_scan(refs, self.frames, self.cfg.coarse_step).where(F.col("hd") <= self.cfg.reject_factor * self.threshold)
        fine = nearest.fine_scan(refs, coarse, self.frames, self.cfg.fine_window)
        best = written(fine.join(refs.select("pair_id", "ref_frame", "ref_t"), "pair_id").select("pair_id", "ref_no", "ref_frame", "ref_t", "hd", "frame_idx", "shift"))
        return self._result(best if anchors is None else self._locked(refs, best, anchors))

    def _locked(self, refs: DataFrame, best: DataFrame, anchors: DataFrame) -> DataFrame:
        """best, with the pairs whose match lies well before a trusted anchor searched again around it."""
        a = anchors.where(F.col("hd") <= self.threshold).select("pair_id", "primary_t", "target_t", "primary_frame")
        early = best.join(a, "pair_id").where((F.col("frame_idx") + F.col("shift")) / F.lit(self.fps) < F.col("primary_t") - self.cfg.intro_guard)
        early = written(early.select("pair_id", "ref_no", "ref_frame", F.col("target_t" if self.median_time else "ref_t").alias("ref_t"), "primary_frame"))
        start = early.select("pair_id", "ref_no", F.lit(999).cast("long").alias("hd"), F.col("primary_frame").alias("frame_idx"))
        again = nearest.fine_scan(refs, start, self.frames, self.cfg.fine_window)
        again = again.join(early.select("pair_id", "ref_frame", "ref_t"), "pair_id").select("pair_id", "ref_no", "ref_frame", "ref_t", "hd", "frame_idx", "shift")
        return best.join(early.select("pair_id"), "pair_id", "left_anti").unionByName(again)

    def several(self, pairs: DataFrame) -> DataFrame:
        """Several references a pair; the nearest match counts, and is rejected beyond twice the threshold."""
        frames = of_recordings(self.frames, pairs, "target_id")
        media = frames.groupBy("media_id").agg(F.count("*").alias("total_frames")).withColumn("fps", F.lit(self.fps))
        picked = sampling.reference_frames(media, frames, self.cfg.multi_refs, self.cfg)
        refs = written(nearest.reference_rows(pairs, frames, picked, self.fps))
        won = nearest.multi_match(refs, self.frames, self.threshold, self.cfg)
        return self._result(won.join(refs.select("pair_id", "ref_no", "ref_frame", "ref_t"), ["pair_id", "ref_no"]))


@dataclass(frozen=True)
class AudioEngine:
    """Offsets by the correlation of activity. energy: media_id, bin, rms; bins: length of the grid; bin_s: seconds a bin."""

    energy: DataFrame
    bins: int
    bin_s: float = DEFAULT.bin_s
    cfg: Config = DEFAULT

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """pair_id, lag, offset, peak, confidence; no row for a pair with a side without any energy."""
        own = signals.on_grid(of_recordings(self.energy, pairs, "primary_id", "target_id"), self.bins, "rms")
        signal = written(signals.centred(signals.smoothed(signals.activity(own, self.cfg))))
        return signals.offset_by_signal(pairs, signal, int(self.cfg.max_lag / self.bin_s), self.bin_s, self.cfg.audio_bands)


@dataclass(frozen=True)
class CutEngine:
    """Offsets by the correlation of scene cuts. cuts: media_id, t; bins: length of the grid; bin_s: seconds a bin."""

    cuts: DataFrame
    bins: int
    bin_s: float = DEFAULT.bin_s
    cfg: Config = DEFAULT

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """pair_id, lag, offset, peak, confidence; no row for a pair with too few cuts on a side."""
        own = written(of_recordings(self.cuts, pairs, "primary_id", "target_id"))
        return signals.cut_offset(pairs, own, self.bins, self.bin_s, int(self.cfg.max_lag / self.bin_s), self.cfg)


@dataclass
class Search:
    """decisions: a row for each pair; given: how many pairs each engine saw, in the order in which they ran."""

    decisions: DataFrame
    given: dict[str, int]


def search(pairs: DataFrame, visual: Engine, audio: Engine | None = None, cuts: Engine | None = None, audio_mode: str = "off", cut_mode: str = "off", cfg: Config = DEFAULT) -> Search:
    """Decide on every pair: visual first, checked by the other engines; these alone where it finds nothing.

    audio_mode, cut_mode: 'off', 'verify' (only pairs that visual solved) or 'fallback' (also those that it did not: cuts, then audio for
    what is still open). decisions: pair_id, source (visual, consensus, cut, audio, none), stage (of the visual engine), hd
    (with the markers of fallback_cascade), offset, confidence, audio, cut (how these agree with visual, null where not
    compared), error (null for success). Audio and cuts together overrule visual as in consensus, with confidence high.
    """
    for mode, engine in ((audio_mode, audio), (cut_mode, cuts)):
        if mode not in ("off", "verify", "fallback") or (mode != "off" and engine is None):
            raise ValueError("a mode is 'off', 'verify' or 'fallback', and needs its engine unless off")
    pairs = pairs.select("pair_id", "primary_id", "target_id")
    first = narrowed(pairs, [("visual", lambda p: visual(p).withColumnRenamed("stage", "step"))])
    given, out = dict(first.given), []
    if first.rows is not None:
        found = first.rows.select("pair_id", F.col("step").alias("stage"), F.col("hd").cast("int").alias("v_hd"), F.col("offset").alias("v_off"), "confidence")
        solved = written(pairs.join(found.select("pair_id"), "pair_id", "left_semi"))
        n = solved.count()
        for mode, engine, name in ((audio_mode, audio, "a"), (cut_mode, cuts, "c")):
            empty = solved.where("false").select("pair_id", *(F.lit(None).cast("double").alias(f"{name}_{c}") for c in ("off", "peak")))
            if mode != "off" and n:
                given[{"a": "audio, verifying", "c": "cuts, verifying"}[name]] = n
                empty = engine(solved).select("pair_id", F.col("offset").alias(f"{name}_off"), F.col("peak").alias(f"{name}_peak"))
            found = found.join(empty, "pair_id", "left")
        found = written(found)
        bands = decide.agreement_bands(found, cfg)
        rows = found.join(decide.consensus(found, cfg), "pair_id").join(bands, "pair_id")
        over = F.col("overridden")
        out.append(rows.select("pair_id", F.when(over, "consensus").otherwise("visual").alias("source"), "stage", F.when(over, -3).otherwise(F.col("v_hd")).alias("hd"), "offset", F.when(over, "high").otherwise(F.col("confidence")).alias("confidence"), "audio", "cut"))
    stages: list[tuple[str, Engine]] = []
    if cut_mode == "fallback":
        stages.append(("cut", lambda p: cuts(p).where(F.col("peak") >= cfg.cut_fallback)))
    if audio_mode == "fallback":
        stages.append(("audio", lambda p: audio(p).where(F.col("peak") >= cfg.audio_fallback)))
    rest = narrowed(first.open, stages)
    given |= rest.given
    nothing: Column = F.lit(None).cast("string")
    if rest.rows is not None:
        marker = F.when(F.col("stage") == "cut", -2).otherwise(-1)
        out.append(rest.rows.select("pair_id", F.col("stage").alias("source"), nothing.alias("stage"), marker.alias("hd"), "offset", "confidence", nothing.alias("audio"), nothing.alias("cut")))
    out.append(rest.open.select("pair_id", F.lit("none").alias("source"), nothing.alias("stage"), F.lit(None).cast("int").alias("hd"), F.lit(None).cast("double").alias("offset"), nothing.alias("confidence"), nothing.alias("audio"), nothing.alias("cut")))
    decided = out[0]
    for more in out[1:]:
        decided = decided.unionByName(more)
    return Search(decided.withColumn("error", F.when(F.col("source") == "none", "No match found")), given)


def by_content(engine: Engine, contents: DataFrame) -> Engine:
    """An engine for files of which several may hold one recording: each pair of recordings is searched once.

    contents: file_id, media_id. The engine that results takes pairs of files; a file without a recording solves nothing.
    """

    def run(pairs: DataFrame) -> DataFrame:
        for side in ("primary", "target"):
            pairs = pairs.withColumnRenamed(f"{side}_id", f"{side}_file").join(contents.select(F.col("file_id").alias(f"{side}_file"), F.col("media_id").alias(f"{side}_id")), f"{side}_file")
        files = written(pairs.select("pair_id", "primary_id", "target_id"))
        slots = written(files.groupBy("primary_id", "target_id").agg(F.min("pair_id").alias("slot")))
        found = engine(slots.select(F.col("slot").alias("pair_id"), "primary_id", "target_id")).withColumnRenamed("pair_id", "slot")
        return files.join(slots, ["primary_id", "target_id"]).join(found, "slot").drop("slot", "primary_id", "target_id")

    return run
