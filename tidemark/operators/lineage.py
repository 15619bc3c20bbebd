"""Cutting the lineage of tables that several later steps read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share.

    Where none is named, a local session gets a temporary folder; on a cluster that is an error, as executors share no disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tidemark-"))
        at = _own[0]
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder as Parquet; what follows reads it from there.

    The table survives lost executors and stays until the folder is cleared. Its name begins with tidemark-.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
