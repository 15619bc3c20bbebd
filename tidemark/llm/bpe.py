"""Byte-level BPE encoding and decoding (operator 2).

Method: overlapping chunk encoding. A long text is cut into chunks that overlap. Each chunk is split into
pre-tokens on its own; the boundary from which a chunk and its left neighbour agree is where they are stitched.
The pieces between stitches are encoded independently and their ids concatenated. Decoding concatenates bytes.

Why a stitch is exact: the pattern looks ahead but never behind, so from a true pre-token boundary on the split is
the same whatever stands before. The first chunk starts at a true boundary. If the boundaries of chunk i are true from
its stitch on, a boundary that chunk i+1 shares with them is a true one, and chunk i+1 is right from there.
A document in which two neighbours share no boundary (an unbroken run longer than the overlap) is encoded by one task, in segments
between pre-token boundaries; a single pre-token longer than a segment is merged without the pattern, whose
backtracking would give up on runs of hundreds of thousands of blanks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches

CHUNK = 32768
OVERLAP = 1024
#: Characters that are handed to the encoder's own splitting at once.
SEGMENT = 65536

_encodings: dict = {}


def read_ranks(path: str) -> bytes:
    """A rank file's bytes, read once on the driver; its size is fixed by the vocabulary."""
    with open(path, "rb") as f:
        return f.read()


def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    key = (hashlib.md5(ranks).digest(), pattern)
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def _ids(enc, pattern: str, text: str) -> np.ndarray:
    """The ids of a text of any length and shape."""
    if len(text) <= SEGMENT:
        return enc.encode_to_numpy(text, disallowed_special=())
    import regex

    out, start, last = [], 0, 0

    def flush(upto: int) -> None:
        nonlocal start
        if upto > start:
            out.append(enc.encode_to_numpy(text[start:upto], disallowed_special=()))
            start = upto

    for m in regex.compile(pattern).finditer(text):
        if m.end() - start > SEGMENT:
            flush(last)
        if m.end() - start > SEGMENT:
            flush(m.start())
            out.append(np.array(enc._core_bpe.encode_single_piece(m.group().encode()), np.uint32))
            start = m.end()
        last = m.end()
    flush(len(text))
    return np.concatenate(out)


class ByteBPE:
    """Encoder and decoder for one vocabulary. ranks: content of a rank file; pattern: the pre-token pattern."""

    def __init__(self, spark, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        if not 0 < overlap <= chunk:
            raise ValueError("the overlap must be positive and at most a chunk")
        self.pattern, self.chunk, self.overlap = pattern, chunk, overlap
        self.ranks = spark.sparkContext.broadcast(ranks)

    def _encode_column(self, text: Column) -> Column:
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            enc = _encoding(ranks.value, pattern)
            out, offsets, n = [], [0], 0
            for t in texts:
                ids = _ids(enc, pattern, t.as_py() or "").astype("int32")
                n += len(ids)
                out.append(pa.array(ids))
                offsets.append(n)
            values = pa.concat_arrays(out) if out else pa.array([], pa.int32())
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

        return encode(text)

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids, concatenated; a null array gives no bytes, an unknown id raises."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("binary")
        def decode(arrays: pa.Array) -> pa.Array:
            enc = _encoding(ranks.value, pattern)
            return pa.array([enc.decode_bytes(a.values.to_numpy().tolist() if a.is_valid else []) for a in arrays], pa.binary())

        return decode(ids)

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, ids array<int>) of each row; null texts count as empty and give an empty array.

        Texts up to a chunk long are encoded in place. Longer ones, and only those, are dealt out by chunk, so that
        one very long document is shared by many tasks. Equal long rows are encoded once and repeated.
        """
        bound_batches(docs.sparkSession)
        rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        short = rows.where(F.length("t") <= self.chunk).select("k", self._encode_column(F.col("t")).alias("ids"))
        long = rows.where(F.length("t") > self.chunk).groupBy("k", "t").agg(F.count("*").alias("copies"))
        long = long.withColumn("rk", F.concat_ws("|", F.coalesce(F.col("k").cast("string"), F.lit("null")), F.sha2("t", 256)))
        chunks = self._chunks(long)
        cuts = self._cuts(chunks)
        whole = cuts.groupBy("rk").agg(F.bool_and((F.col("no") == 0) | F.col("cut").isNotNull()).alias("synced"))
        apart = long.join(whole.where(~F.col("synced")).select("rk"), "rk", "left_semi").select("k", "copies", self._encode_column(F.col("t")).alias("ids"))
        pieces = (
            chunks.join(cuts, ["rk", "no"])
            .withColumn("until", F.coalesce(F.col("next_cut"), F.col("start") + F.length("t")))
            .select("rk", "no", "k", "copies", F.substring("t", F.col("cut") - F.col("start") + 1, F.col("until") - F.col("cut")).alias("piece"))
            .select("rk", "no", "k", "copies", self._encode_column(F.col("piece")).alias("ids"))
        )
        stitched = (
            pieces.groupBy("rk")
            .agg(F.first("k").alias("k"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
            .join(whole.where("synced").select("rk"), "rk", "left_semi")
            .select("k", "copies", F.flatten(F.col("parts.ids")).alias("ids"))
        )
        long_ids = apart.unionByName(stitched).select("k", "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        return short.unionByName(long_ids.select("k", "ids")).withColumnRenamed("k", key)

    def _chunks(self, long: DataFrame) -> DataFrame:
        """(rk, k, copies, no, start, last, t): chunk no covers chunk characters and the overlap behind them."""
        size, more = self.chunk, self.overlap
        key_type = long.schema["k"].dataType.simpleString()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in range(b.num_rows):
                    t = b.column("t")[row].as_py()
                    starts = list(range(0, len(t), size))
                    n = len(starts)
                    take = pa.array([row] * n)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("rk").take(take), b.column("k").take(take), b.column("copies").take(take), pa.array(range(n), pa.int32()), pa.array(starts, pa.int32()), pa.array([i == n - 1 for i in range(n)]), pa.array([t[s : s + size + more] for s in starts], pa.string())],
                        names=["rk", "k", "copies", "no", "start", "last", "t"],
                    )

        out = long.select("rk", "k", "copies", "t").mapInArrow(cut, f"rk string, k {key_type}, copies long, no int, start int, last boolean, t string")
        return out.repartition("rk", "no")

    def _cuts(self, chunks: DataFrame) -> DataFrame:
        """(rk, no, cut, next_cut): where chunk no is stitched to its left and its right neighbour."""
        pattern, size, more = self.pattern, self.chunk, self.overlap

        @F.arrow_udf("struct<heads:array<int>,tails:array<int>>")
        def boundaries(starts: pa.Array, lasts: pa.Array, texts: pa.Array) -> pa.Array:
            import regex

            split, out = regex.compile(pattern), []
            for s, last, t in zip(starts.to_pylist(), lasts.to_pylist(), texts, strict=True):
                t = t.as_py()
                ends = [m.end() for m in split.finditer(t)]
                if not last and ends:  # what stands at the cut end may go on
                    ends = [e for e in ends[:-1] if e <= len(t) - 3]
                out.append({"heads": [s, *(s + e for e in ends if e <= more)], "tails": [s + e for e in ends if size <= e]})
            return pa.array(out, pa.struct([("heads", pa.list_(pa.int32())), ("tails", pa.list_(pa.int32()))]))

        order = Window.partitionBy("rk").orderBy("no")
        found = chunks.select("rk", "no", boundaries("start", "last", "t").alias("b")).select("rk", "no", "b.heads", "b.tails")
        cut = F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(order))))
        return found.select("rk", "no", cut.alias("cut")).select("rk", "no", "cut", F.lead("cut").over(order).alias("next_cut"))


def public_bpe(spark, name: str = "byte_bpe_50k.tiktoken", **kw) -> ByteBPE:
    """The encoder for a vocabulary of the installed tokenizer package; nothing of it is copied here."""
    import public_tokenizers

    return ByteBPE(spark, read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN, **kw)


def token_digests(bpe: ByteBPE, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = bpe.encode(docs).select("doc_id", "ids", bpe.decode(F.col("ids")).alias("raw"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
