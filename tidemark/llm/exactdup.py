"""Exact deduplication (operator 12).

Method: tree-merge of sorted digest runs. Every task reads its rows and makes a run: entries (digest, identifier, rows) in
digest order, one for each text. Runs are then exchanged between nodes in rounds, as along the edges of a hypercube: in
round r a node keeps the entries whose r-th digit of the digest is its own and gets those of the FAN - 1 nodes that
differ from it in that digit only. What arrives is put in order and merged; of entries with one digest, verified by all 32 bytes
of it and by the length of the text, the preferred identifier and the sum of the rows stay. After as many rounds as a node
number has digits every digest is at one node.

So no node ever holds more than its share of the different digests, and a text that a third of all rows hold enters each
round once a node. Rows, with their texts long left behind, meet the merged entries in one join by digest, of which only the
texts that occur more than once take part; Spark splits that join where a digest is hot.

Two texts count as equal if SHA-256 and length in bytes agree; no unlike texts with one SHA-256 are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Nodes that exchange runs in a round, the node itself included.
FAN = 8

ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW same AS (PARTITION BY t)
"""


def _digests(rows: DataFrame) -> DataFrame:
    """(row, id, digest, bytes) of each (row, id, t), written: the only reading of the texts."""
    return materialize(rows.select("row", "id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("bytes")), "digests")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ordered entries (node, digest, bytes, id, row, n) the first of each (node, digest, bytes), with the sum of n.

    The last group of a batch may go on in the next one and is held back, so a task holds one batch and one entry.
    """
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        new = np.ones(b.num_rows, bool)
        if b.num_rows > 1:
            unlike = [pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)) for c in (b.column(name) for name in ("node", "digest", "bytes"))]
            new[1:] = pc.or_(pc.or_(unlike[0], unlike[1]), unlike[2]).to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(new)
        first = b.take(pa.array(heads))
        sums = pa.array(np.add.reduceat(b.column("n").to_numpy(), heads), pa.int64())
        first = pa.RecordBatch.from_arrays([sums if name == "n" else first.column(name) for name in first.schema.names], schema=b.schema)
        held = first.slice(len(heads) - 1)
        yield first.slice(0, len(heads) - 1)
    if held is not None:
        yield held


def _merged(entries: DataFrame, largest: bool) -> DataFrame:
    """The runs of each node, merged; the order puts the identifier that stays before others of its digest."""
    by_id = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    return entries.sortWithinPartitions("node", "digest", "bytes", by_id, "row").mapInArrow(_merge, entries.schema)


def _digit(number: Column, r: int) -> Column:
    """Digit r of a number below 2^32, to the base FAN."""
    return F.floor(number / FAN**r) % FAN


def _classes(digests: DataFrame, largest: bool) -> DataFrame:
    """(digest, bytes, id, row, n): one entry for each different text, by rounds of exchange and merging."""
    block = F.shiftright("row", 33)
    blocks = (digests.agg(F.max(block)).first()[0] or 0) + 1
    rounds = 1
    while FAN**rounds < blocks:
        rounds += 1
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    runs = _merged(digests.select((block % FAN**rounds).alias("node"), "digest", "bytes", "id", "row", F.lit(1).cast("long").alias("n")), largest)
    for r in range(rounds):
        node = F.col("node") + (_digit(head, r) - _digit(F.col("node"), r)) * FAN**r
        runs = _merged(runs.withColumn("node", node).repartition("node"), largest)
    return runs.drop("node")


def _decisions(digests: DataFrame, largest: bool) -> DataFrame:
    """(row, id, keep, size, kept, digest) of every row."""
    many = _classes(digests, largest).where("n > 1").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), F.col("id").alias("keep"), F.col("row").alias("keep_row"), "n")
    found = digests.join(many, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    alone = F.col("n").isNull()
    return found.select("row", "id", F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep"), F.coalesce("n", F.lit(1).cast("long")).alias("size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "digest")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs, dropped ones too.

    Of the rows with one text the one with the largest key stays (keep="smallest": the smallest); a null text counts as
    empty. Of several rows with that key one stays, the first one read, so that each text has exactly one row with
    kept = true. A null key is never preferred; where all keys of a text are null, keep_id is null. group_size counts rows.
    An empty table gives an empty result.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    out = _decisions(_digests(rows), keep == "largest")
    return out.select(F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each different text, chosen as by exact_duplicates.

    The rows are written once with a number, as they meet their decision by it.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    numbered = materialize(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    rows = numbered.select("row", F.col("doc").getField(key).alias("id"), F.coalesce(F.col("doc").getField(text), F.lit("")).alias("t"))
    stay = _decisions(_digests(rows), keep == "largest").where("kept").select("row")
    return numbered.join(stay, "row", "left_semi").select("doc.*")
