"""SimHash near-duplicates (operator 8).

Method: a hierarchical index over fingerprints in Gray order. Consecutive fingerprints in that order share a masked bit
pattern; an upper node stands for the patterns of all below it. Two nodes whose patterns already differ in more bits
than allowed are dropped with everything below; otherwise their children are compared, with the difference carried on.

Distribution: the upper nodes are made by counting fingerprints by prefix and split until each holds at most NODE of them; they
are a table, and near ones meet by equality of patterns with up to two bits flipped. Pairs of near nodes are dealt out; each task descends from its pair with the
fingerprints of two nodes and returns a spanning forest of the links that it finds, not all pairs. Copies have one
fingerprint and are counted once.

Defined cases: a null text or one without words has fingerprint zero, which links like any other; repeated rows each get a row;
a null id is never the smallest unless all of its component are null; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, materialize
from .components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
NODE = 32768
#: Pairs of ranges of at most so many comparisons are compared one by one.
SMALL = 64
#: Bits that a level of upper nodes adds.
STEP = 4
#: Node pairs that are expanded at once.
FRONT = 1 << 20


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of UTF-8 text: a bit is set if it is set in over half of the shingle hashes."""
    import xxhash

    words, h = raw.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return 0
    if len(words) <= shingle:
        return h(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, total = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((h(line[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), dtype="<u8", count=n)
    for k in range(0, n, 4096):
        part = hashes[k : k + 4096]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint((t.as_py() or "").encode()) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(text: Column) -> Column:
    """Fingerprint of each text as a signed long; a null text or one without words gives zero."""
    return _fingerprints(text)


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order: the running XOR of its bits from the top."""
    g = f.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        g = g ^ (g >> np.uint64(s))
    return g


def _prefix(f: Column, bits: int) -> Column:
    return F.shiftrightunsigned(f, 64 - bits) if bits else F.lit(0).cast("long")


def upper_nodes(distinct: DataFrame, most: int = NODE, step: int = STEP) -> tuple[DataFrame, list[int]]:
    """((bits, prefix) of nodes that together hold each fingerprint once, at most `most` each; the levels that occur).

    Only nodes that are too large are counted again, by a longer prefix. The nodes stay a table.
    """
    empty = distinct.sparkSession.createDataFrame([], "bits int, prefix long, n long")
    counted = materialize(distinct.groupBy(F.lit(0).alias("bits"), F.lit(0).cast("long").alias("prefix")).agg(F.count("*").alias("n")), "nodes")
    nodes, levels, bits = empty, [], 0
    while True:
        whole = F.lit(True) if bits == 64 else F.col("n") <= most
        nodes, levels = nodes.unionByName(counted.where(whole)), [*levels, bits]
        large = counted.where(~whole)
        if large.isEmpty():
            return nodes.select("bits", "prefix"), levels
        open_ = distinct.join(large.select(F.col("prefix").alias("large")), _prefix(F.col("f"), bits) == F.col("large"), "left_semi")
        bits = min(64, bits + step)
        counted = materialize(open_.groupBy(F.lit(bits).alias("bits"), _prefix(F.col("f"), bits).alias("prefix")).agg(F.count("*").alias("n")), "nodes")


def near_node_pairs(nodes: DataFrame, levels: list[int], radius: int = RADIUS) -> DataFrame:
    """(a_bits, a_prefix, b_bits, b_prefix) of node pairs whose shared masked bits differ in at most `radius` places.

    b is the node with the shorter or the same pattern. It is found by equality: a's pattern, cut to b's length, with at most
    `radius` of its bits flipped. The flips are a fixed table for each level.
    """
    flips = [(bits, sum(1 << i for i in at)) for bits in levels for k in range(radius + 1) for at in itertools.combinations(range(bits), k)]
    masks = nodes.sparkSession.createDataFrame([(bits, x - (1 << 64) if x >= 1 << 63 else x) for bits, x in flips], "b_bits int, mask long")
    shorter = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda b: b <= F.col("bits"))).alias("b_bits")
    longer = nodes.select(F.col("bits").alias("a_bits"), F.col("prefix").alias("a_prefix"), shorter).join(F.broadcast(masks), "b_bits")
    cut = F.when(F.col("b_bits") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", "a_prefix", F.col("a_bits") - F.col("b_bits")))
    wanted = longer.select("a_bits", "a_prefix", "b_bits", cut.bitwiseXOR(F.col("mask")).alias("b_prefix"))
    found = wanted.join(nodes.select(F.col("bits").alias("b_bits"), F.col("prefix").alias("b_prefix")), ["b_bits", "b_prefix"])
    return found.where((F.col("a_bits") > F.col("b_bits")) | (F.col("a_prefix") >= F.col("b_prefix"))).select("a_bits", "a_prefix", "b_bits", "b_prefix")


def _children(g: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Split ranges of Gray-sorted codes by the next two bits: starts and ends of the four parts."""
    shift = np.uint64(64 - bits - 2)
    base = g[lo] >> np.uint64(64 - bits) << np.uint64(64 - bits) if bits else np.zeros(len(lo), dtype=np.uint64)
    cuts = [lo]
    for q in (1, 2, 3):
        at = base + (np.uint64(q) << shift)
        cuts.append(np.clip(np.searchsorted(g, at), lo, hi))
    cuts.append(hi)
    return np.stack(cuts[:4], axis=1), np.stack(cuts[1:], axis=1)


def links(f: np.ndarray, g: np.ndarray, side: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes (sorted by Gray rank g) that differ in at most `radius` bits.

    side: None for all pairs, else 0/1 for each code; then only pairs of unlike sides are wanted.
    """
    n = len(f)
    if n < 2:
        return
    stack = [(0, np.array([0]), np.array([n]), np.array([0]), np.array([n]))]
    while stack:
        bits, alo, ahi, blo, bhi = stack.pop()
        if len(alo) > FRONT:
            half = len(alo) // 2
            stack += [(bits, alo[half:], ahi[half:], blo[half:], bhi[half:]), (bits, alo[:half], ahi[:half], blo[:half], bhi[:half])]
            continue
        small = (((ahi - alo) * (bhi - blo)) <= SMALL) | (bits >= 64)
        if small.any():
            wide = (ahi - alo)[small] * (bhi - blo)[small]
            row = np.repeat(np.arange(len(wide)), wide)
            k = np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)
            width = (bhi - blo)[small][row]
            i, j = alo[small][row] + k // width, blo[small][row] + k % width
            ok = (i < j) & (np.bitwise_count(f[i] ^ f[j]) <= radius)
            if side is not None:
                ok &= side[i] != side[j]
            if ok.any():
                yield i[ok], j[ok]
        big = ~small
        if not big.any():
            continue
        alo, ahi, blo, bhi = alo[big], ahi[big], blo[big], bhi[big]
        cas, cae = _children(g, alo, ahi, bits)
        cbs, cbe = _children(g, blo, bhi, bits)
        bits += 2
        s = np.uint64(64 - bits)
        parts = []
        for x in range(4):
            for y in range(4):
                ok = np.flatnonzero((cas[:, x] < cae[:, x]) & (cbs[:, y] < cbe[:, y]) & (cas[:, x] <= cbs[:, y]))
                if len(ok):
                    d = np.bitwise_count((f[cas[ok, x]] ^ f[cbs[ok, y]]) >> s)
                    ok = ok[d <= radius]
                    parts.append((cas[ok, x], cae[ok, x], cbs[ok, y], cbe[ok, y]))
        if parts:
            stack.append((bits, *(np.concatenate([p[k] for p in parts]) for k in range(4))))


def spanning_forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low < high
            if not open_.any():
                break
            i, j = i[open_], j[open_]
            np.minimum.at(root, high[open_], low[open_])
            while not np.array_equal(root, root[root]):
                root = root[root]
    return root


def near_edges(distinct: DataFrame, radius: int = RADIUS, most: int = NODE) -> DataFrame:
    """Edges (a, b) between fingerprints (column f, distinct) that join all that lie within `radius` bits."""
    nodes, levels = upper_nodes(distinct, most)
    pairs = near_node_pairs(nodes, levels, radius)
    pair = F.struct("a_bits", "a_prefix", "b_bits", "b_prefix").alias("pair")
    alone = (F.col("a_bits") == F.col("b_bits")) & (F.col("a_prefix") == F.col("b_prefix"))
    left = pairs.select(F.col("a_bits").alias("bits"), F.col("a_prefix").alias("prefix"), pair, F.lit(0).alias("side"))
    right = pairs.where(~alone).select(F.col("b_bits").alias("bits"), F.col("b_prefix").alias("prefix"), pair, F.lit(1).alias("side"))
    # Grows with the fingerprints divided by `most`, times the nodes within the radius; a row is a few bytes.
    plan = materialize(left.unionByName(right), "node-pairs")
    keyed = distinct.select("f", F.explode(F.array(*(F.struct(F.lit(b).alias("bits"), _prefix(F.col("f"), b).alias("prefix")) for b in levels))).alias("n")).select("f", "n.bits", "n.prefix")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf["f"].to_numpy().view(np.uint64)
        g = gray_rank(f)
        order = np.argsort(g, kind="stable")
        f, g, side = f[order], g[order], pdf["side"].to_numpy()[order]
        root = spanning_forest(len(f), links(f, g, side if side.any() else None, radius))
        linked = np.flatnonzero(root != np.arange(len(f)))
        return pd.DataFrame({"a": f[linked].view(np.int64), "b": f[root[linked]].view(np.int64)})

    return keyed.join(plan, ["bits", "prefix"]).select("pair", "side", "f").groupBy("pair").applyInPandas(search, "a long, b long")


def _marked(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """Written columns of docs, fingerprints among them."""
    bound_batches(docs.sparkSession)
    return materialize(docs.select(*columns), "fingerprints")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, f, component_id) of each row: documents whose fingerprints link, directly or over others, share a component.

    component_id is the smallest id of the component. A null id is never the smallest unless all are null.
    """
    return components(_marked(docs, F.col(key).alias("doc_id"), fingerprints(F.col(text)).alias("f")), radius).select("doc_id", "f", "component_id")


def components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, f, root, component_id) of rows (doc_id, f). The root, a fingerprint, is the component's key; component_id is not, as ids may repeat or be null."""
    first = materialize(rows.groupBy("f").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected_components(near_edges(first.select("f"), radius))
    linked = first.join(roots, first["f"] == roots["node"]).select("f", "root", "low")
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of_linked = linked.join(lows, "root").select(F.col("f").alias("lf"), "root", "component_id")
    of_all = first.join(of_linked, F.col("f") == F.col("lf"), "left").select(F.col("f").alias("ff"), F.coalesce("root", "f").alias("root"), F.coalesce("component_id", "low").alias("component_id"))
    of_all = materialize(of_all, "components")
    return rows.join(of_all, F.col("f") == F.col("ff")).select("doc_id", "f", "root", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns kept: a row with its smallest id (if all ids are null, one of those)."""
    names = docs.columns
    mark = "f"
    while mark in names:
        mark += "_"
    marked = _marked(docs, "*", fingerprints(F.col("text")).alias(mark))
    found = components(marked.select("doc_id", F.col(mark).alias("f")))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("doc_id").alias("c_id"), F.min("f").alias("c_f"))
    rows = marked.join(kept, marked["doc_id"].eqNullSafe(kept["c_id"]) & (marked[mark] == kept["c_f"]))
    return rows.dropDuplicates(["doc_id", mark]).select(*names)
