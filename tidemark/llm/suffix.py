"""Exact removal of repeated byte strings by suffix ranks (operator 1).

Method: anchor hashing, in place of the dealt prefix doubling; no round sorts pairs of ranks. A rank names the bytes that follow
a position; three rounds group by ranks of fixed lengths, drop what is unique and go on with the rest to the threshold length. Two things make this fit a
cluster's disks:

* Ranks are names made from content (two independent 64-bit polynomial names), not places in a global order. Equality is
  all that the result needs, and a name of any length comes from prefix sums within a document, without a shuffle.
* The first round ranks sampled positions only. Each string of the threshold length stands for the position of the least
  name of ANCHOR bytes within it (its anchor). Equal strings have equal anchors at equal places, so a string whose anchor is
  unique in the corpus is unique too. An anchor serves a run of consecutive strings.

Round 1 groups anchors by the rank of ANCHOR bytes; unique ones drop out with all their strings. Round 2 groups the rest by the
rank of the whole window of their run (all its strings): every run but the first of a class repeats, wholly. Round 3 takes,
for anchors with several classes, the first run of each class apart into strings and ranks these at the full length.
What is not the first of its rank repeats.

Order: smaller id first, then by a hash of the text among rows of one id. A null id counts as the smallest. Rows that repeat
both id and text are one document, with one result for each row. Matches never cross documents; strings are judged on the
input; texts shorter than the threshold are kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize

LENGTH = 100
ANCHOR = 32
#: Bytes ranked at once, and strings of round 3 that a task reduces at once.
BLOCK = 1 << 20
STRINGS = 1 << 19
#: Strings in a bucket of round 3, and buckets at least (so that a small corpus is shared by several tasks too).
BUCKET = 500_000
LEAST_BUCKETS = 16
#: More than the strings of a run.
SPAN = 1 << 12

_rng = np.random.default_rng(100)
_BYTES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(family: int, inverse: bool, n: int) -> np.ndarray:
    """At least n powers of a family's base modulo 2**64."""
    have = _powers.get((family, inverse))
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        x = pow(_BASES[family], -1 if inverse else 1, 1 << 64)
        have, k = np.ones(size, dtype=np.uint64), 1
        while k < size:
            m = min(k, size - k)
            have[k : k + m] = have[:m] * np.uint64(pow(x, k, 1 << 64))
            k += m
        _powers[family, inverse] = have
    return have


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Ranks:
    """Names of the substrings of some bytes."""

    def __init__(self, raw: bytes, families: tuple[int, ...] = (0, 1)):
        b = np.frombuffer(raw, dtype=np.uint8)
        self.n, self.sums = len(b), {}
        for f in families:
            s = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(_BYTES[f][b] * _power(f, False, self.n)[: self.n], out=s[1:])
            self.sums[f] = s

    def names(self, family: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        s = self.sums[family]
        return _mixed((s[ends] - s[starts]) * _power(family, True, self.n + 1)[starts] + (ends - starts).astype(np.uint64))

    def all_names(self, family: int, length: int) -> np.ndarray:
        """The name of every substring of one length."""
        s = self.sums[family]
        return _mixed((s[length:] - s[:-length]) * _power(family, True, self.n + 1)[: self.n - length + 1] + np.uint64(length))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def anchor_runs(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of strings that share an anchor: text, first start, number of strings, anchor rank, both window names."""
    raw = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    if len(raw) < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3)) + tuple(np.zeros(0, dtype=np.uint64) for _ in range(3))
    ranks = Ranks(raw)
    r = ranks.all_names(0, anchor)
    low = np.uint64(0xFFFFFFFF)
    at = (sliding_min((r & ~low) | np.arange(len(r), dtype=np.uint64), length - anchor + 1) & low).astype(np.int64)
    valid = np.ones(len(at) + 1, dtype=bool)  # starts whose string ends in their own text
    valid[-1] = False
    for e in ends.tolist():
        valid[max(0, e - length + 1) : e] = False
    valid = valid[:-1]
    change = at[1:] != at[:-1]
    first, last = valid.copy(), valid.copy()
    first[1:] &= change | ~valid[:-1]
    last[:-1] &= change | ~valid[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(ends, lo, side="right")
    stop = hi - 1 + length
    return text, lo - (ends - np.array([len(t) for t in texts]))[text], hi - lo, r[at[lo]], ranks.names(0, lo, stop), ranks.names(1, lo, stop)


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows of a batch with their bytes, in blocks of about BLOCK bytes."""
    rows, texts, size = [], [], 0
    for i, t in enumerate(b.column("t")):
        raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
        rows.append(i), texts.append(raw)
        size += len(raw)
        if size >= BLOCK:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(d, th, t): the id (null as the smallest), a hash of the text, the text."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def anchors(rows: DataFrame, length: int, anchor: int, windows: bool) -> DataFrame:
    """Round 1: (r) of each run, or with windows (r, w1, w2, d, th, at), at being the first start times SPAN plus the strings."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, th = b.column("d").to_numpy(), b.column("th").to_numpy()
            for at, texts in _blocks(b):
                text, lo, n, r, w1, w2 = anchor_runs(texts, length, anchor)
                row = np.array(at)[text]
                if windows:
                    yield pa.RecordBatch.from_arrays([_long(r), _long(w1), pa.array((w2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(d[row]), pa.array(th[row]), pa.array(lo * SPAN + n)], names=["r", "w1", "w2", "d", "th", "at"])
                else:
                    yield pa.RecordBatch.from_arrays([_long(r)], names=["r"])

    return rows.mapInArrow(find, "r long, w1 long, w2 int, d long, th long, at long" if windows else "r long")


def _packed(d: np.ndarray, th: np.ndarray, p: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> bytes:
    """Strings in the order of documents and places, with each document written once."""
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (th[1:] != th[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(d))).astype("<u4")
    return b"".join((np.array([len(first), len(d)], dtype="<u4").tobytes(), d[first].tobytes(), th[first].tobytes(), counts.tobytes(), p.astype("<i4").tobytes(), h1.tobytes(), h2.tobytes()))


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    k, n = (int(x) for x in np.frombuffer(raw, dtype="<u4", count=2))
    at, out = 8, []
    for kind, m in (("<i8", k), ("<i8", k), ("<u4", k), ("<i4", n), ("<u8", n), ("<u4", n)):
        out.append(np.frombuffer(raw, dtype=kind, count=m, offset=at))
        at += out[-1].nbytes
    d, th, counts, p, h1, h2 = out
    return np.repeat(d, counts), np.repeat(th, counts), p, h1, h2


def _heads(d: np.ndarray, th: np.ndarray, p: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each string is the first of its rank (or a second copy of that very place)."""
    order = np.lexsort((p, th, d, h2, h1))
    new = np.ones(len(d), dtype=bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    head = np.empty(len(d), dtype=np.int64)
    head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return (d == d[head]) & (th == th[head]) & (p == p[head])


def strings(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Round 3: (bucket, repeat, data) of the strings of the wanted runs (column runs of rows), packed by bucket of their rank.

    A task keeps the first of each rank that it sees, in parts of about STRINGS; the others repeat already. So a string that
    very many documents share leaves each part once, and no bucket grows with the copies of a string.
    """

    def parts(each: list) -> Iterator[pa.RecordBatch]:
        d, th, p, h1, h2 = (np.concatenate(x) for x in zip(*each, strict=True))
        first = _heads(d, th, p, h1, h2)
        # What repeats already is spread by its document.
        bucket = np.where(first, h1 % np.uint64(buckets), th.view(np.uint64) % np.uint64(buckets)).astype(np.int64) * 2 + ~first
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            at = order[lo:hi]
            b = int(bucket[at[0]])
            yield pa.RecordBatch.from_arrays([pa.array([b // 2], pa.int32()), pa.array([bool(b % 2)]), pa.array([_packed(d[at], th[at], p[at], h1[at], h2[at])], pa.binary())], names=["bucket", "repeat", "data"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, size = [], 0
        for b in batches:
            for d, th, t, runs in zip(b.column("d").to_pylist(), b.column("th").to_pylist(), b.column("t"), b.column("runs"), strict=True):
                ranks = Ranks(t.as_py().encode("utf-8", "surrogatepass"))
                at = np.sort(runs.values.to_numpy())
                lo, n = at // SPAN, at % SPAN
                p = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                h2 = (ranks.names(1, p, p + length) >> np.uint64(32)).astype(np.uint32)
                each.append((np.full(len(p), d), np.full(len(p), th), p.astype(np.int32), ranks.names(0, p, p + length), h2))
                size += len(p)
                if size >= STRINGS:
                    yield from parts(each)
                    each, size = [], 0
        if each:
            yield from parts(each)

    return rows.mapInArrow(find, "bucket int, repeat boolean, data binary")


def repeated_strings(packed: DataFrame, length: int) -> DataFrame:
    """(d, th, s, e): the byte ranges of the strings of each bucket that are not the first of their rank."""

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [_unpacked(x)[:3] for x in pdf["data"][pdf["repeat"]]]
        firsts = [_unpacked(x) for x in pdf["data"][~pdf["repeat"]]]
        if firsts:
            every = [np.concatenate(x) for x in zip(*firsts, strict=True)]
            later = ~_heads(*every)
            out.append(tuple(x[later] for x in every[:3]))
        d, th, p = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((p, th, d))
        d, th, p = d[order], th[order], p[order].astype(np.int64)
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (th[1:] != th[:-1]) | (p[1:] > p[:-1] + length)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(d)) - 1 if len(d) else first
        return pd.DataFrame({"d": d[first], "th": th[first], "s": p[first], "e": p[last] + length})

    return packed.groupBy("bucket").applyInPandas(rank, "d long, th long, s long, e long")


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, th, spans): for each document with repeated strings, (s, e) byte ranges that they cover, in no order."""
    if length - anchor + 1 >= SPAN:
        raise ValueError(f"a run must have fewer than {SPAN} strings")
    rows = _keyed(docs, key, text)
    # Written first, so that both sides of the join are plain shuffles, whose large partitions Spark can split.
    again = materialize(anchors(rows, length, anchor, False).groupBy("r").agg(F.count("*").alias("c")).where("c > 1").select(F.col("r").alias("again")), "again")
    runs = materialize(anchors(rows, length, anchor, True).join(again, F.col("r") == F.col("again")).drop("again"), "runs")
    discard(again)
    name = ["r", "w1", "w2"]
    classes = materialize(runs.groupBy(*name).agg(F.min(F.struct("d", "th", "at")).alias("f")), "classes")
    firsts = classes.select(*(F.col(c).alias(f"f_{c}") for c in name), "f")
    whole = runs.join(firsts, (F.col("r") == F.col("f_r")) & (F.col("w1") == F.col("f_w1")) & (F.col("w2") == F.col("f_w2"))).where(F.struct("d", "th", "at") != F.col("f"))
    start, count = F.floor(F.col("at") / SPAN), F.col("at") % SPAN
    whole = materialize(whole.select("d", "th", start.alias("s"), (start + count - 1 + length).alias("e")), "whole")
    several = materialize(classes.groupBy("r").agg(F.count("*").alias("c")).where("c > 1").select(F.col("r").alias("m_r")), "several")
    wanted = classes.join(several, F.col("r") == F.col("m_r")).select("f.*").groupBy(F.col("d").alias("w_d"), F.col("th").alias("w_th")).agg(F.collect_list("at").alias("runs"), F.sum(count).alias("n"))
    wanted = materialize(wanted, "wanted")
    discard(runs, classes, several)
    buckets = max(LEAST_BUCKETS, -(-(wanted.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    packed = strings(rows.join(wanted, (F.col("d") == F.col("w_d")) & (F.col("th") == F.col("w_th"))).select("d", "th", "t", "runs"), length, buckets)
    single = materialize(repeated_strings(packed, length), "single")
    discard(wanted)
    return whole.unionByName(single).groupBy("d", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that ranges cover together; ranges that touch are one run."""
    out: list[list[int]] = []
    for i in np.argsort(starts, kind="stable").tolist():
        s, e = int(starts[i]), int(ends[i])
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, removed array<struct<s,e>>, kept binary) of each row: its bytes without what repeats earlier ones."""
    bound_batches(docs.sparkSession)
    spans = repeats(docs, length, anchor, key, text)
    rows = _keyed(docs, key, text).withColumn("id", F.when(F.col("d") != -(1 << 63), F.col("d")))
    both = rows.join(spans.select(F.col("d").alias("s_d"), F.col("th").alias("s_th"), "spans"), (F.col("d") == F.col("s_d")) & (F.col("th") == F.col("s_th")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, kept = [], [], []
            for t, spans in zip(b.column("t"), b.column("spans"), strict=True):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                runs = merged(*(spans.values.field(k).to_numpy() for k in ("s", "e"))) if spans.is_valid else []
                edges = [0, *(x for run in runs for x in run), len(raw)]
                sizes.append(len(raw))
                removed.append([{"s": s, "e": e} for s, e in runs])
                kept.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])

    return both.select("id", "t", "spans").mapInArrow(cut, "id long, n_bytes long, removed array<struct<s:int,e:int>>, kept binary").withColumnRenamed("id", key)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]))
    return without_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
