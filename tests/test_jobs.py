"""Progress of many encoders: items by their latest line, silence by the watermark, late starts, the stream against the table."""

import datetime as dt
import random

from tidemark.streaming import jobs

SCHEMA = "job_id string, at timestamp, line_no long, line string, duration double, host string"


def when(s):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)


def states(df):
    return {r["job_id"]: r for r in df.collect()}


def test_items_of_a_job(spark):
    rows = [
        ("a", when(1), 1, "out_time_us=2000000", 10.0, "h"), ("a", when(1), 2, "speed=  2.0x", 10.0, "h"), ("a", when(1), 3, "fps=24.5", 10.0, "h"),
        ("a", when(2), None, "N/A", 10.0, "h"), ("a", when(0), 9, "out_time_us=9000000", 10.0, "h"), ("a", when(3), 1, None, 10.0, None),
        ("b", when(1), 1, "progress=end", None, "h"), ("b", when(2), 1, "out_time_ms=1000000", None, "h"),
        ("c", when(1), 1, "out_time_us=99000000", 10.0, "h"), ("c", when(1), 2, "progress=end", 10.0, "h"), ("c", when(1), 3, "speed=0.0x", 10.0, "h"), ("c", when(2), 4, "bitrate=1kb", 0.0, "h"),
        (None, when(1), 1, "fps=1", 1.0, "h"), ("d", None, 1, "fps=1", 1.0, "h"), ("e", when(1), 1, "out_time_us=x", 1.0, "h"), ("e", when(1), 2, "speed=N/A", 1.0, "h"),
    ]
    got = states(jobs.job_states(spark.createDataFrame(rows, SCHEMA), 60, 0))
    assert set(got) == {"a", "b", "c", "e"}
    assert (got["a"].done_s, got["a"].share, got["a"].remaining_s, got["a"].fps, got["a"].message, got["a"].status, got["a"].n_lines) == (2.0, 0.2, 4.0, 24.5, "N/A", "running", 6)
    assert (got["b"].done_s, got["b"].share, got["b"].status) == (1.0, None, "running")
    assert (got["c"].status, got["c"].share, got["c"].remaining_s) == ("ended", None, None)
    assert (got["e"].done_s, got["e"].speed, got["e"].remaining_s, got["e"].message) == (None, None, None, None)
    assert jobs.job_states(spark.createDataFrame([], SCHEMA), 60, 0).collect() == []


def follow(spark, folder, batches, silence, late):
    """Each batch in a file of its own, read in that order one at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return jobs.follow_jobs(lines, silence, late)


def test_stream_equals_the_table_whatever_the_order(spark, tmp_path):
    rng = random.Random(4)
    said = ["out_time_us={}", "fps={}", "speed= {}x", "progress=continue", "progress=end", "odd {}", "", None, "bitrate={}"]
    rows = [(rng.choice("abcdefgh"), when(rng.random() * 50), i, (rng.choice(said) or "").format(rng.randrange(10**7)), rng.choice([None, 5.0]), "h") for i in range(300)]
    batches = [rows[:100], rows[100:130], rows[130:]]
    got = states(jobs.last_states(follow(spark, str(tmp_path / "in"), batches, 600, 600)))
    want = states(jobs.job_states(spark.createDataFrame(rows, SCHEMA), 600, 600))
    assert got == want and len({r.status for r in want.values()}) > 1


def test_silence_and_waking(spark, tmp_path):
    batches = [
        [("a", when(0), 1, "out_time_us=1000000", 10.0, "h"), ("b", when(0), 1, "progress=end", 10.0, "h"), ("c", when(0), 1, "fps=3", 10.0, "h")],
        [("x", when(100), 1, "fps=9", 10.0, "h")],
        [("x", when(101), 2, "fps=9", 10.0, "h")],  # its watermark is that of the batch before
        [("x", when(102), 3, "fps=9", 10.0, "h"), ("a", when(100), 2, "speed=3x", 10.0, "h"), ("b", when(100), 2, "fps=7", 10.0, "h")],
    ]
    stream, seen = follow(spark, str(tmp_path / "in"), batches, 30, 5), []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: seen.append({(r.job_id, r.status) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    every = [x for s in seen for x in sorted(s)]
    assert every.index(("a", "running")) < every.index(("a", "silent"))
    assert ("c", "silent") in every and ("b", "silent") not in every
    # the state of b went when it had been silent, so it starts anew and no longer counts as ended
    assert every.count(("a", "running")) == 2 and every.count(("b", "ended")) == 1 == every.count(("b", "running"))


def test_calls_grow_with_groups_not_with_jobs(spark, tmp_path):
    """F8: 500 jobs are held in the default number of groups at most, and in as few as are asked for."""
    rows = [(f"j{i % 500}", when(i), i, f"out_time_us={i}", 10.0, "h") for i in range(1000)]
    want = states(jobs.job_states(spark.createDataFrame(rows, SCHEMA), 600, 600))
    for n in (3, jobs.GROUPS):
        lines = spark.createDataFrame(rows, SCHEMA)
        lines.write.parquet(f"{tmp_path}/in{n}/0")
        stream, got = jobs.follow_jobs(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in{n}/*"), 600, 600, n), {}
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: got.update(states(df))).option("checkpointLocation", f"{tmp_path}/c{n}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= min(n, 499) and got == want


def test_jobs_of_one_group_keep_their_own_time(spark, tmp_path):
    batches = [
        [("a", when(0), 1, "fps=1", 10.0, "h"), ("b", when(0), 1, "progress=end", 10.0, "h")],
        [("x", when(100), 2**53 + 1, "fps=2", 10.0, "h")],
        [("x", when(100), 2**53, "fps=3", 10.0, "h"), ("x", when(100), None, "fps=4", 10.0, "h")],
        [("x", when(100), 2**53 + 1, "speed=1x", 10.0, "h")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream, seen = jobs.follow_jobs(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), 30, 5, 1), []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: seen.append({(r.job_id, r.status, r.fps, r.n_lines) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen[0] == {("a", "running", 1.0, 1), ("b", "ended", None, 1)} and seen[1] == {("x", "running", 2.0, 1)}
    # a falls silent in a batch that tells of x, the ended b goes without a row, and x keeps the line of the largest number
    assert seen[2] == {("a", "silent", 1.0, 1), ("x", "running", 2.0, 3)}
    assert seen[3] == {("x", "running", 2.0, 4)} and not any(seen[4:])
