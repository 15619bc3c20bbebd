"""Media files as tables and edit plans carried out, with stub tools in place of the decoder and the encoder."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.phash import frame_hash
from tidemark.operators import decide, flow
from tidemark.sources import encode, logs, media
from tidemark.sources.binaries import find_binary
from tidemark.sources.tools import Tool, ToolError

# A file of the stub is text: its number of seconds, or a word that says how the run ends. Frames are 4 x 2 at 10 a second, filled with their number.
STUB = """#!/usr/bin/env python3
import os, struct, sys, time
a = sys.argv[1:]
get = lambda k, d=None: a[a.index(k) + 1] if k in a else d
path = get("-i") or a[-1]
open(os.path.join(os.path.dirname(__file__), "runs"), "a").write(" ".join(a) + "\\n")
body = open(path).read().strip()
if body == "broken":
    sys.stderr.write("moov atom not found\\n"); sys.exit(1)
if body == "slow":
    time.sleep(60)
if "-show_format" in a:
    print('{"format": {"duration": "%s"}, "streams": [{"codec_type": "video", "r_frame_rate": "10/1"}]}' % body); sys.exit(0)
at = float(get("-ss", "0"))
if "rawvideo" in a:
    first, total = round(at * 10), round(float(body) * 10)
    last = min(total, first + int(get("-frames:v", "1000000")))
    for i in range(first, last):
        sys.stdout.buffer.write(bytes([i % 256]) * 24)
    sys.stdout.buffer.write(b"xy")
elif "s16le" in a:
    first, total = round(at * 100), round(float(body) * 100)
    last = min(total, first + round(float(get("-t", "100000")) * 100))
    sys.stdout.buffer.write(b"".join(struct.pack("<h", i - 50) for i in range(first, last)))
elif any("showinfo" in x for x in a):
    sys.stderr.write("frame=1\\n[showinfo] n:0 pts:1 pts_time:1.5 x\\n[showinfo] n:1 pts_time:3 x\\n")
elif any("blackdetect" in x for x in a):
    sys.stderr.write("[blackdetect] black_start:1.0 black_end:1.5 black_duration:0.5\\n[blackdetect] black_start:3 black_end:3.1 black_duration:0.1\\n")
else:
    open(a[-1], "w").write("half")
    if body == "fails late":
        sys.stderr.write("no space\\n"); sys.exit(2)
    open(a[-1], "w").write("whole " + body)
"""


@pytest.fixture
def tools(tmp_path):
    at = tmp_path / "tools"
    at.mkdir()
    for name in ("ffmpeg", "ffprobe"):
        (at / name).write_text(STUB)
        (at / name).chmod(0o755)
    return at


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "media"
    (at / "deep").mkdir(parents=True)
    for name, body in {"a.mkv": "3", "deep/b.MP4": "2.5", "c.mp4": "broken", "notes.txt": "9"}.items():
        (at / name).write_text(body)
    return at


@pytest.fixture
def load(spark, folder, tools):
    media.register(spark)
    return lambda kind, **o: spark.read.format("tidemark_media").options(path=str(folder), kind=kind, tools=str(tools), width=4, height=2, fps=10, rate=100, **o).load()


def runs(tools):
    at = tools / "runs"
    return at.read_text().splitlines() if at.exists() else []


@pytest.mark.parametrize("window", [0.7, 1, 100])
def test_frames_do_not_depend_on_the_window(load, folder, window):
    rows = load("frames", end=20, window=window).collect()
    good = sorted((r["media_id"], r["frame_idx"], r["t"], bytes(r["rgb"])) for r in rows if r["error"] is None)
    assert good == sorted((str(folder / n), i, i / 10, bytes([i]) * 24) for n, k in (("a.mkv", 30), ("deep/b.MP4", 25)) for i in range(k))
    bad = [r for r in rows if r["error"] is not None]
    assert {r["media_id"] for r in bad} == {str(folder / "c.mp4")} and all("moov atom" in r["error"] and r["rgb"] is None for r in bad)


def test_conditions_choose_files_and_narrow_the_decoding(load, folder, tools):
    df = load("frames", end=20, window=1).where((F.col("media_id") == str(folder / "a.mkv")) & (F.col("frame_idx") >= 12) & (F.col("frame_idx") < 15) & (F.col("frame_idx") % 2 == 0))
    assert [r["frame_idx"] for r in df.collect()] == [12, 14]
    (run,) = runs(tools)
    assert "-ss 1.200000" in run and "-frames:v 3" in run
    assert load("frames", end=20).where("media_id = 'elsewhere'").collect() == [] and load("frames").where("frame_idx > 5 AND frame_idx < 3").collect() == []
    assert load("frames").where("frame_idx = 7").where(F.col("media_id").isin(str(folder / "a.mkv"))).select("t").collect() == [(0.7,)]
    assert load("frames").where("frame_idx = 3000").collect() == []


def test_open_end_skip_and_hash(load, folder):
    df = load("frames", start=1).where("error IS NULL")
    assert df.groupBy("media_id").agg(F.min("frame_idx"), F.count("*")).orderBy("media_id").collect() == [(str(folder / "a.mkv"), 10, 20), (str(folder / "deep/b.MP4"), 10, 15)]
    assert df.select(F.size(frame_hash(F.col("rgb"), 4, 2)).alias("n")).distinct().collect() == [(4,)]


@pytest.mark.parametrize("window", [0.33, 50])
def test_samples(load, folder, window):
    rows = load("pcm", start=1, end=2.2, window=window).where("error IS NULL").collect()
    assert sorted((r["media_id"], r["sample_idx"], r["value"]) for r in rows) == sorted((str(folder / n), i, i - 50) for n in ("a.mkv", "deep/b.MP4") for i in range(100, 220))


def test_logs_and_probes_meet_their_parsers(load, folder):
    a = str(folder / "a.mkv")
    assert sorted(logs.cut_times(load("cuts").where(F.col("media_id") == a), 5.0).collect()) == [(a, 6.5), (a, 8.0)]
    assert logs.black_sections(load("blacks").where(F.col("media_id") == a)).collect() == [(a, 1.0, 1.5)]
    probes = {r["media_id"]: r for r in logs.probe_media(load("probe")).collect()}
    assert probes[a]["duration"] == 3.0 and probes[a]["total_frames"] == 30 and probes[str(folder / "c.mp4")]["error"] == "no video stream"


def test_strict_ends_the_query_and_an_empty_file_is_an_error(load, folder):
    with pytest.raises(Exception, match="moov atom"):
        load("frames", strict="true").collect()
    (folder / "c.mp4").write_text("0")
    (row,) = load("pcm", strict="false").where("error IS NOT NULL").collect()
    assert row["media_id"] == str(folder / "c.mp4") and "no data" in row["error"]


def test_a_slow_file_is_stopped(load, folder):
    (folder / "c.mp4").write_text("slow")
    begun = time.time()
    (row,) = load("blacks", limit=2).where("error IS NOT NULL").collect()
    assert "time limit" in row["error"] and time.time() - begun < 30


def test_options_that_make_no_sense(spark, load, folder):
    for kind, options in (("sound", {}), ("frames", {"window": 0}), ("pcm", {"path": "/nowhere"})):
        with pytest.raises(Exception):
            load(kind, **options) if "path" not in options else spark.read.format("tidemark_media").options(kind=kind, **options).load().collect()
            load(kind, **options).collect()


def test_binaries(tools, monkeypatch):
    find_binary.cache_clear()
    assert find_binary("ffmpeg", str(tools)) == str(tools / "ffmpeg")
    with pytest.raises(FileNotFoundError):
        find_binary("no-such-tool")
    monkeypatch.setenv("PATH", f"{tools}{os.pathsep}{os.environ['PATH']}")
    find_binary.cache_clear()
    assert find_binary("ffprobe") == str(tools / "ffprobe")
    find_binary.cache_clear()
    with pytest.raises(ToolError, match="exit code 3"), Tool("sh", ["-c", "exit 3"]) as t:
        t.finish()


@pytest.fixture
def jobs(spark, tmp_path):
    def make(bodies):
        at = tmp_path / "out"
        at.mkdir(exist_ok=True)
        for i, body in enumerate(bodies):
            (at / f"t{i}.mp4").write_text(body)
        files = spark.createDataFrame([(i, str(at / f"t{i}.mp4")) for i in range(len(bodies))], "pair_id long, path string")
        plan = decide.edit_plan(spark.createDataFrame([(i, (-1) ** i * 1.5, 60.0) for i in range(len(bodies))], "pair_id long, offset double, primary_duration double"))
        return at, decide.edit_command(plan, files)

    return make


def test_each_row_makes_a_whole_file_or_none(jobs, tools, tmp_path):
    at, commands = jobs(["one", "broken", "three", "fails late"])
    report = {r["pair_id"]: r for r in encode.encode(commands, str(tmp_path / "r"), tools=str(tools)).collect()}
    assert [report[i]["status"] for i in range(4)] == ["done", "failed", "done", "failed"]
    assert "moov atom" in report[1]["error"] and "no space" in report[3]["error"]
    assert sorted(p.name for p in at.iterdir()) == ["t0.mp4", "t0_synced.mp4", "t1.mp4", "t2.mp4", "t2_synced.mp4", "t3.mp4"]
    assert (at / "t0_synced.mp4").read_text() == "whole one"


def test_a_rerun_does_what_is_missing(jobs, tools, tmp_path):
    at, commands = jobs(["one", "broken"])
    encode.encode(commands, str(tmp_path / "r1"), tools=str(tools))
    (at / "t1.mp4").write_text("mended")
    before = len(runs(tools))
    report = encode.encode(commands, str(tmp_path / "r2"), tools=str(tools)).orderBy("pair_id").collect()
    assert [r["status"] for r in report] == ["skipped", "done"] and len(runs(tools)) == before + 1
    assert (at / "t1_synced.mp4").read_text() == "whole mended"


def test_a_strict_job_leaves_nothing(jobs, tools, tmp_path):
    at, commands = jobs(["one", "two", "three", "fails late"])
    with pytest.raises(Exception, match="no space"):
        encode.encode(commands.coalesce(1), str(tmp_path / "r"), strict=True, tools=str(tools))
    assert sorted(p.name for p in at.iterdir()) == ["t0.mp4", "t1.mp4", "t2.mp4", "t3.mp4"]
    assert list((tmp_path / "r").iterdir()) == []


def test_two_rows_for_one_output_and_rows_without_one(spark, jobs, tools, tmp_path):
    at, commands = jobs(["one"])
    odd = spark.createDataFrame([(8, ["-y"], None), (9, None, str(at / "x.mp4"))], "pair_id long, arguments array<string>, output string")
    report = encode.encode(commands.union(commands).union(odd), str(tmp_path / "r"), tools=str(tools))
    assert sorted((r["pair_id"], r["status"]) for r in report.collect()) == [(0, "done"), (0, "skipped"), (8, "failed"), (9, "failed")]
    assert encode.encode(commands.where("false"), str(tmp_path / "none"), tools=str(tools)).count() == 0


def test_cancelling_by_tag(spark):
    ended = []

    def work():
        flow.start_tagged(spark, "to-stop")
        try:
            ended.append(spark.range(10**12).select(F.max(F.xxhash64("id"))).collect())
        except Exception as e:
            ended.append(e)

    t = threading.Thread(target=work, daemon=True)
    t.start()
    for _ in range(20):
        time.sleep(0.5)
        flow.cancel(spark, "to-stop")
        if ended:
            break
    t.join(20)
    assert isinstance(ended[0], Exception) and "cancel" in str(ended[0]).lower()
    assert spark.range(3).count() == 3
