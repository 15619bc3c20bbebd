"""What the operators of this subpackage share: input columns, shared tables, folds.

Conventions that hold for every operator here unless its docstring says otherwise:

* a null text counts as an empty text; texts are processed whole, however long;
* an operator selects the columns it needs first, so extra input columns may have any name;
* repeated rows each get a result; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]++"
#: Bytes of texts that Spark hands to Python at once.
BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir.

    Where none is named, a local session (one machine, as in tests) gets a temporary one; on a cluster that is an error, as
    each executor would write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tidemark-"))
        at = _own[0]
    return at.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for the length of a block; what was there before comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffles of the writing query are removed with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empty the tables that materialize wrote and that nothing reads any more."""
    for df in tables:
        df.sparkSession.createDataFrame([], "gone int").write.mode("overwrite").parquet(df.written_to)


def bound_batches(spark: SparkSession) -> None:
    """Hand texts to Python at most BATCH bytes at a time, as each batch is held on both sides; a lower setting stays.

    Queries are planned when they run, so this holds for the session.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def in_fold(doc_id: Column, divisor: int, value: int) -> Column:
    """True if the id falls in the held-out fold; a null id never does."""
    return F.coalesce(remainder(doc_id, divisor) == value, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, divisor: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, y) of at most `rows` training labels, the ones with the smallest hash of the id.

    Null ids and null labels are left out; of repeated ids the largest label counts. The bound on
    the rows makes the result small enough to broadcast, whatever the size of the table.
    """
    train = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~in_fold(F.col("doc_id"), divisor, held_out))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    return train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, sample: DataFrame, text: str) -> DataFrame:
    """(text, y) of the sampled documents; the sample is bounded, so it is broadcast.

    Of rows that repeat an id the smallest text counts, so that there are no more texts than labels in the sample.
    """
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")
