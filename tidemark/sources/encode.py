"""Edit plans carried out: a data sink that runs the encoder once a row and leaves whole files or none.

Rows: pair_id, arguments (array<string>, the last of which is the output), output. Each file is made under a name of its own beside the output
and renamed when the encoder ended well, so that a reader never sees part of one, and two attempts of a task never write one file. A row
whose output is there already is skipped, hence a rerun does only what is missing. Executors must see the folders under the same path.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from .tools import Tool, ToolError

REPORT = "pair_id long, output string, status string, error string"


@dataclass
class Done(ds.WriterCommitMessage):
    """What a task sends back: the part of the report that it wrote, and how many rows failed."""

    report: str
    failed: int


class EncodeWriter(ds.DataSourceWriter):
    """Options: report (a folder that all executors share), strict (true: a failing row ends the job), limit (seconds a row), tools (a folder with the encoder)."""

    def __init__(self, options: dict[str, str]):
        self.report = options["report"]
        self.strict = options.get("strict", "false").lower() == "true"
        self.limit = float(options["limit"]) if "limit" in options else None
        self.tools = options.get("tools")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Done:
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}"
        os.makedirs(self.report, exist_ok=True)
        path = os.path.join(self.report, f".{self.job}-{attempt}.json")
        failed = 0
        with open(path, "w", encoding="utf-8") as out:
            for row in iterator:
                status, error = self._encode(row, attempt)
                failed += status == "failed"
                out.write(json.dumps({"pair_id": row["pair_id"], "output": row["output"], "status": status, "error": error}) + "\n")
                out.flush()  # what is made is known to abort
                if error and self.strict:
                    raise ToolError(error)
        return Done(path, failed)

    def _encode(self, row: Row, attempt: str) -> tuple[str, str | None]:
        output = row["output"]
        if not output or not row["arguments"] or row["arguments"][-1] != output:
            return "failed", "the last argument must be the output"
        if os.path.exists(output):
            return "skipped", None
        folder, name = os.path.split(output)
        stem, extension = os.path.splitext(name)
        part = os.path.join(folder, f".{stem}.{self.job}-{attempt}{extension}")
        try:
            with Tool("ffmpeg", [*row["arguments"][:-1], part], "stderr", self.limit, self.tools) as tool:
                for _ in tool.lines():
                    pass
                tool.finish()
            os.replace(part, output)
            return "done", None
        except (ToolError, OSError) as e:
            return "failed", f"{type(e).__name__}: {e}"
        finally:
            if os.path.exists(part):
                os.remove(part)

    def _rows(self, paths: list[str]) -> Iterator[dict]:
        for path in paths:
            with open(path, encoding="utf-8") as f:
                for line in f:
                    if line.endswith("\n"):
                        yield json.loads(line)

    def _sweep(self, rows: Iterator[dict], remove_done: bool) -> None:
        """Remove what lost attempts of this job left beside the outputs, and the outputs too if the job is given up."""
        folders = set()
        for r in rows:
            if r["output"]:
                folders.add(os.path.dirname(r["output"]))
            if remove_done and r["status"] == "done" and os.path.exists(r["output"]):
                os.remove(r["output"])
        for folder in folders:
            for left in glob.glob(os.path.join(glob.escape(folder), f".*.{self.job}-*")):
                os.remove(left)

    def commit(self, messages: list[Done | None]) -> None:
        """Show the report's parts; parts of attempts that did not count go, their files stay as they are whole."""
        kept = [m.report for m in messages if m]
        self._sweep(self._rows(kept), False)
        for path in kept:
            os.replace(path, os.path.join(self.report, os.path.basename(path)[1:]))
        for left in glob.glob(os.path.join(glob.escape(self.report), f".{self.job}-*.json")):
            os.remove(left)

    def abort(self, messages: list[Done | None]) -> None:
        """Remove every file that the job made, also by tasks that sent no message, and its report."""
        parts = glob.glob(os.path.join(glob.escape(self.report), f".{self.job}-*.json"))
        self._sweep(self._rows(parts), True)
        for path in parts:
            os.remove(path)


class EncodeSink(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_encode"

    def schema(self) -> str:
        return "pair_id long, arguments array<string>, output string"

    def writer(self, schema: T.StructType, overwrite: bool) -> EncodeWriter:
        if overwrite:
            raise ValueError("files that are there are kept: use mode append")
        return EncodeWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EncodeSink)


def encode(commands: DataFrame, report: str, strict: bool = False, limit: float | None = None, tools: str | None = None) -> DataFrame:
    """Run commands (pair_id, arguments, output) and return the report: pair_id, output, status (done, skipped, failed), error.

    Rows are dealt out by output, so that one output is made by one task and a second row for it is skipped. report is a new folder;
    one that holds earlier reports gives these too.
    """
    spark = commands.sparkSession
    register(spark)
    options = {"report": report, "strict": str(strict).lower(), "limit": limit, "tools": tools}
    rows = commands.select("pair_id", "arguments", "output").repartition("output")
    rows.write.format("tidemark_encode").mode("append").options(**{k: v for k, v in options.items() if v is not None}).save()
    return spark.read.schema(REPORT).json(report)
