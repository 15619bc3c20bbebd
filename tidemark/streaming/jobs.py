"""Progress of many encoders at once: the last known position, speed and remaining time of each job, and which jobs fell silent.

Lines: job_id string, at timestamp, line_no long, line, duration (seconds, may be null). What holds of a job is for each item the value
of its latest line by (at, line_no), so lines may arrive in any order. The stream keeps jobs by groups of a hash, each group's items as
columns: a batch costs a call of Python for each group, not for each job. A line without a job or a time is no line of any job.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lineage import shared_dir

ITEMS = {"done_s": "double", "fps": "double", "speed": "double", "ended": "boolean", "message": "string", "duration": "double"}
COLUMNS = ["job_id", "at", "done_s", "share", "fps", "speed", "remaining_s", "status", "message", "n_lines"]

GROUPS = 1024
NEVER, ENDLESS = -(2**63), 2**63 - 1
# what a group holds of its jobs, with the value before any line; c_at and c_no are the place of the line that told c
HELD = {"job_id": ("string", None), "at_us": ("long", NEVER), "n_lines": ("long", 0), "due_ms": ("long", ENDLESS)}
HELD |= {k: v for c, kind in ITEMS.items() for k, v in {c: (kind, np.nan if kind == "double" else None), f"{c}_at": ("long", NEVER), f"{c}_no": ("long", NEVER)}.items()}
DTYPES = {"string": object, "boolean": object, "long": np.int64, "double": np.float64}


def parsed(lines: DataFrame) -> DataFrame:
    """job_id, at, line_no, at_us and the items that a line tells; others are null.

    Both position keys count microseconds. A marker of the end holds until a later position or marker of going on; a line that is no
    key with a value is a message.
    """
    number = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).try_cast("double")
    end, more = F.col("line").rlike(r"^progress=end\s*$"), F.col("line").rlike(r"^(progress=continue|out_time_(us|ms)=[0-9]+)\s*$")
    said = F.when((F.trim("line") != "") & ~F.col("line").rlike(r"^\s*\w+="), F.trim("line"))
    rows = lines.where("job_id IS NOT NULL AND at IS NOT NULL")
    told = {"done_s": number(r"^out_time_(?:us|ms)=([0-9]+)") / 1e6, "fps": number(r"^fps=\s*([0-9.]+)"), "speed": number(r"^speed=\s*([0-9.]+)x"), "ended": F.when(end, True).when(more, False), "message": said, "duration": F.col("duration").cast("double")}
    return rows.select("job_id", "at", "line_no", F.unix_micros("at").alias("at_us"), *(told[c].alias(c) for c in ITEMS))


def _shown(df: DataFrame) -> DataFrame:
    """COLUMNS from the items, at_us, n_lines and silent."""
    # greatest and least pass over nulls, hence the conditions
    share = F.when((F.col("duration") > 0) & F.col("done_s").isNotNull(), F.least(F.lit(1.0), F.col("done_s") / F.col("duration")))
    rest = F.col("duration") - F.col("done_s")
    left = F.when(rest.isNotNull(), F.greatest(F.lit(0.0), rest))
    status = F.when(F.coalesce("ended", F.lit(False)), "ended").when(F.col("silent"), "silent").otherwise("running")
    more = {"at": F.timestamp_micros("at_us"), "share": share, "remaining_s": F.when(F.col("speed") > 0, left / F.col("speed")), "status": status}
    return df.withColumns(more).select(*COLUMNS)


def job_states(lines: DataFrame, silence: float, late: float) -> DataFrame:
    """The state of each job after all lines: what `follow_jobs` ends with when no line came too late.

    A job is silent when its last line is more than `silence` seconds before the latest line of all less `late`.
    """
    order = F.struct("at_us", "line_no")
    rows = parsed(lines)
    latest = rows.groupBy("job_id").agg(F.max("at_us").alias("at_us"), F.count("*").alias("n_lines"), *(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in ITEMS))
    mark = rows.agg(F.max("at_us").alias("newest"))
    ms = lambda c: F.floor(F.col(c) / 1000)
    gone = ms("at_us") + int(silence * 1000) < ms("newest") - int(late * 1000)
    return _shown(latest.join(F.broadcast(mark)).withColumn("silent", gone))


def _with_lines(held: dict[str, np.ndarray], lines: pd.DataFrame) -> dict[str, np.ndarray]:
    """The columns of a group with what lines tell; of lines at one place the one that came last holds."""
    lines = lines.sort_values(["at_us", "line_no"], kind="stable", ignore_index=True)
    code, ids = pd.factorize(np.concatenate([held["job_id"], lines["job_id"].to_numpy(object)]))
    old, n = len(held["job_id"]), len(ids)  # those held come first and are distinct, so they keep their places
    job = code[old:]
    held = {c: np.concatenate([v, np.full(n - old, HELD[c][1], v.dtype)]) for c, v in held.items()} | {"job_id": ids}
    at, no = lines["at_us"].to_numpy(), lines["line_no"].to_numpy()
    np.maximum.at(held["at_us"], job, at)
    held["n_lines"] += np.bincount(job, minlength=n)
    for c in ITEMS:
        told, last = np.flatnonzero(lines[c].notna()), np.full(n, -1)
        last[job[told]] = told  # the last of a job stays
        to = np.flatnonzero(last >= 0)
        line, was_at, was_no = last[to], held[f"{c}_at"][to], held[f"{c}_no"][to]
        newer = (at[line] > was_at) | ((at[line] == was_at) & (no[line] >= was_no))
        to, line = to[newer], line[newer]
        held[c][to], held[f"{c}_at"][to], held[f"{c}_no"][to] = lines[c].to_numpy(held[c].dtype)[line], at[line], no[line]
    return held


def follow_jobs(lines: DataFrame, silence: float, late: float, groups: int = GROUPS) -> DataFrame:
    """A stream (update mode) of job states: a row for each job that a batch told of, and one when a job falls silent.

    A job is silent when the watermark (`late` seconds behind the newest line) passes its last line by `silence`; a new line makes it run again.
    The state of a job that ended goes at that time, without a row.
    A group of jobs is read and written whole when a batch tells of one of them or one falls silent: with many millions of jobs take more
    `groups`. A stream must be restarted with the same number.
    """
    wait = int(silence * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else [[]] * len(HELD)
        held = {c: np.array(v, DTYPES[kind]) for (c, (kind, _)), v in zip(HELD.items(), kept)}
        before = held["n_lines"]
        for pdf in batches:
            if len(pdf):
                held = _with_lines(held, pdf)
        mark = state.getCurrentWatermarkMs()
        told = held["n_lines"] != np.concatenate([before, np.zeros(len(held["n_lines"]) - len(before), np.int64)])
        held["due_ms"][told] = np.maximum(held["at_us"][told] // 1000 + wait, mark + 1)
        silent = held["due_ms"] < mark
        held["due_ms"][silent] = ENDLESS
        gone = silent & held["ended"].astype(bool)
        left = {c: v[~gone] for c, v in held.items()}
        if len(left["job_id"]):
            state.update(tuple(v.tolist() for v in left.values()))
            due = int(left["due_ms"].min())
            if due < ENDLESS:
                state.setTimeoutTimestamp(due)
        elif state.exists:
            state.remove()
        said = told | (silent & ~gone)
        yield pd.DataFrame({"job_id": held["job_id"], "at_us": held["at_us"], "n_lines": held["n_lines"], "silent": silent, **{c: held[c] for c in ITEMS}})[said]

    kept = ", ".join(f"{c} array<{kind}>" for c, (kind, _) in HELD.items())
    out = "job_id string, at_us long, n_lines long, silent boolean, " + ", ".join(f"{c} {kind}" for c, kind in ITEMS.items())
    # sub-second parts of `late` are kept: the watermark counts in milliseconds
    timed = parsed(lines).withWatermark("at", f"{int(late * 1000)} milliseconds")
    # a missing number comes first, as in job_states; with none missing, pandas keeps whole numbers
    timed = timed.withColumns({"line_no": F.coalesce("line_no", F.lit(NEVER)), "job_group": F.pmod(F.xxhash64("job_id"), F.lit(groups))})
    return _shown(timed.groupBy("job_group").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.EventTimeTimeout))


def last_states(stream: DataFrame) -> DataFrame:
    """Run a stream of job states over all lines that are there; the last row of each job.

    Each batch is a folder of its own that a rerun of the batch overwrites, so a restart repeats no row.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/tidemark-jobs-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{stream.schema.simpleString()[7:-1].replace(':', ' ')}, batch long").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*COLUMNS[1:]), "batch").alias("s")).select("job_id", "s.*")
