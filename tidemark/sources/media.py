"""Media files as tables: a data source whose partitions are (file, window), each read by one run of an external decoder.

    media.register(spark)
    frames = spark.read.format("tidemark_media").options(path="/media", kind="frames", fps=24, end=1200).load()

| kind | rows |
|---|---|
| frames | media_id, frame_idx, t, rgb: raw pictures of one size |
| pcm | media_id, sample_idx, value: 16-bit mono samples |
| cuts, blacks | media_id, line: what the decoder logs, for `logs.cut_times` and `logs.black_sections` |
| probe | media_id, doc: the probe's JSON, for `logs.probe_media` |

media_id is the path. Every row has error, null for data. A file that can't be read gives one row with its error and nulls, or ends the query
with option strict=true. Options: path (a folder, read with its subfolders, or a file), extensions, fps, width, height, rate, start and end
(seconds; without end a file is read to its end), window (seconds a partition, where an end is known), limit (seconds a run), tools (a folder with the
decoder, else the search path).

Conditions on media_id (=, IN) choose files before any is opened; conditions on frame_idx or sample_idx (=, <, <=, >, >=) narrow what is decoded.
Such a condition also drops error rows, as null meets no condition. Executors must see the files under the same path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from ..config import DEFAULT
from .tools import Tool, ToolError

BATCH = 4_000_000
VIDEO = ".avi,.mkv,.mov,.mp4,.m4v,.ts,.webm"

ROWS = {
    "frames": "frame_idx long, t double, rgb binary",
    "pcm": "sample_idx long, value short",
    "cuts": "line string",
    "blacks": "line string",
    "probe": "doc string",
}
ARROW = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "short": pa.int16(), "string": pa.string()}


@dataclass
class Window(ds.InputPartition):
    """Frames or samples [first, last) of a file; last is None where it is read to its end."""

    path: str
    first: int
    last: int | None
    lead: bool


class MediaReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind = options["kind"]
        self.root = options["path"]
        self.extensions = tuple(x.strip().lower() for x in options.get("extensions", VIDEO).split(","))
        self.strict = options.get("strict", "false").lower() == "true"
        self.fps = float(options.get("fps", 0))
        self.size = int(options.get("width", 160)), int(options.get("height", 90))
        self.rate = int(options.get("rate", DEFAULT.sample_rate))
        self.start, self.end = float(options.get("start", 0)), float(options["end"]) if "end" in options else None
        self.window = float(options.get("window", 300))
        self.limit = float(options["limit"]) if "limit" in options else None
        self.tools = options.get("tools")
        self.index, self.per_second = {"frames": ("frame_idx", self.fps), "pcm": ("sample_idx", float(self.rate))}.get(self.kind, (None, 0.0))
        if self.kind == "frames" and self.fps <= 0:
            raise ValueError("frames need the option fps")
        if self.window <= 0:
            raise ValueError("window must be above zero")
        self.low, self.high = round(self.start * self.per_second), None if self.end is None else round(self.end * self.per_second)
        self.chosen: set[str] | None = None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if not self._narrowed(f):
                yield f

    def _narrowed(self, f: ds.Filter) -> bool:
        """Whether the filter is met by reading less, so that nothing is left to test."""
        column = getattr(f, "attribute", None)
        if column == ("media_id",) and isinstance(f, (ds.EqualTo, ds.In)):
            wanted = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
            self.chosen = wanted if self.chosen is None else self.chosen & wanted
            return True
        if self.index and column == (self.index,):
            low = {ds.GreaterThan: 1, ds.GreaterThanOrEqual: 0, ds.EqualTo: 0}.get(type(f))
            high = {ds.LessThan: 0, ds.LessThanOrEqual: 1, ds.EqualTo: 1}.get(type(f))
            if low is not None:
                self.low = max(self.low, f.value + low)
            if high is not None:
                self.high = f.value + high if self.high is None else min(self.high, f.value + high)
        return False  # tested again, as it also drops the rows of errors

    def _files(self) -> list[str]:
        if os.path.isfile(self.root):
            found = [self.root]
        elif os.path.isdir(self.root):
            found = [os.path.join(at, n) for at, _, names in os.walk(self.root) for n in names if n.lower().endswith(self.extensions)]
        else:
            raise FileNotFoundError(self.root)
        return sorted(f for f in found if self.chosen is None or f in self.chosen)

    def partitions(self) -> list[Window]:
        if not self.index or self.high is None:
            return [Window(f, self.low, self.high, True) for f in self._files()]
        step = max(1, ceil(self.window * self.per_second))
        return [Window(f, at, min(at + step, self.high), at == self.low) for f in self._files() for at in range(self.low, self.high, step)]

    def read(self, part: Window) -> Iterator[pa.RecordBatch]:
        if part is None or part.path is None:  # no file is left to read
            return
        try:
            yield from getattr(self, f"_{self.kind}")(part)
        except (ToolError, FileNotFoundError) as e:
            if self.strict:
                raise
            yield self._batch(part.path, {}, 1, f"{type(e).__name__}: {e}")

    def _batch(self, path: str, columns: dict[str, object], n: int, error: str | None = None) -> pa.RecordBatch:
        kinds = [c.split() for c in ROWS[self.kind].split(", ")]
        arrays = [pa.array(columns[c], ARROW[t]) if c in columns else pa.nulls(n, ARROW[t]) for c, t in kinds]
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *arrays, pa.array([error] * n, pa.string())], ["media_id", *(c for c, _ in kinds), "error"])

    def _pieces(self, part: Window, arguments: list[str], unit: int) -> Iterator[tuple[int, bytes]]:
        """(index, bytes) of about BATCH bytes of whole units; a broken unit at the end is dropped. A file without any is an error."""
        at, some = part.first, max(1, BATCH // unit) * unit
        with Tool("ffmpeg", arguments, limit=self.limit, folder=self.tools) as tool:
            while data := tool.stdout.read(some):
                whole = len(data) - len(data) % unit
                if whole:
                    yield at, data[:whole]
                at += whole // unit
            tool.finish()
        if part.lead and at == part.first:
            raise ToolError("no data")

    def _seek(self, part: Window) -> list[str]:
        return ["-hide_banner", "-loglevel", "error", "-nostdin", "-ss", f"{part.first / self.per_second:.6f}", "-i", part.path]

    def _frames(self, part: Window) -> Iterator[pa.RecordBatch]:
        (w, h), unit = self.size, self.size[0] * self.size[1] * 3
        count = [] if part.last is None else ["-frames:v", str(part.last - part.first)]
        for at, data in self._pieces(part, [*self._seek(part), "-vf", f"scale={w}:{h}", *count, "-f", "rawvideo", "-pix_fmt", "rgb24", "pipe:1"], unit):
            n = len(data) // unit
            yield self._batch(part.path, {"frame_idx": range(at, at + n), "t": [i / self.fps for i in range(at, at + n)], "rgb": [data[i * unit : (i + 1) * unit] for i in range(n)]}, n)

    def _pcm(self, part: Window) -> Iterator[pa.RecordBatch]:
        length = [] if part.last is None else ["-t", f"{(part.last - part.first) / self.per_second:.6f}"]
        for at, data in self._pieces(part, [*self._seek(part), *length, "-vn", "-ac", "1", "-ar", str(self.rate), "-f", "s16le", "pipe:1"], 2):
            n = len(data) // 2
            keep = n if part.last is None else min(n, part.last - at)
            if keep > 0:
                values = pa.Array.from_buffers(pa.int16(), n, [None, pa.py_buffer(data)]).slice(0, keep)
                yield self._batch(part.path, {"sample_idx": range(at, at + keep), "value": values}, keep)

    def _log(self, part: Window, arguments: list[str], mark: str) -> Iterator[pa.RecordBatch]:
        with Tool("ffmpeg", ["-hide_banner", "-nostdin", *arguments, "-an", "-sn", "-f", "null", "-"], "stderr", self.limit, self.tools) as tool:
            for line in tool.lines():
                if mark in line:
                    yield self._batch(part.path, {"line": [line]}, 1)
            tool.finish()

    def _cuts(self, part: Window) -> Iterator[pa.RecordBatch]:
        length = [] if self.end is None else ["-t", f"{self.end - self.start:.3f}"]
        return self._log(part, ["-ss", f"{self.start:.3f}", "-i", part.path, *length, "-filter:v", "select='gt(scene,0.3)',showinfo"], "pts_time:")

    def _blacks(self, part: Window) -> Iterator[pa.RecordBatch]:
        return self._log(part, ["-i", part.path, "-vf", f"blackdetect=d={DEFAULT.black_min:.2f}:pix_th=0.10:pic_th=0.98"], "black_start")

    def _probe(self, part: Window) -> Iterator[pa.RecordBatch]:
        with Tool("ffprobe", ["-v", "error", "-print_format", "json", "-show_format", "-show_streams", part.path], limit=self.limit, folder=self.tools) as tool:
            doc = tool.stdout.read().decode(errors="replace")
            tool.finish()
        yield self._batch(part.path, {"doc": [doc]}, 1)


class MediaSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_media"

    def schema(self) -> str:
        kind = self.options.get("kind")
        if kind not in ROWS:
            raise ValueError(f"kind must be one of {', '.join(ROWS)}")
        return f"media_id string, {ROWS[kind]}, error string"

    def reader(self, schema: T.StructType) -> MediaReader:
        return MediaReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it see filters (spark.sql.python.filterPushdown.enabled)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MediaSource)
