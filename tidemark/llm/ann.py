"""Approximate nearest neighbours by inner product (operator 7).

Method: a forest of random-projection trees. A node splits its rows at the median of their projections on the line
between two of them. A search expands nodes on demand from one priority queue that all trees share, the likeliest first,
until the leaves that it took hold the wanted number of candidates, and ranks those by their exact scores.

Priority: the log probability that a near row lies below the node. A row at cosine c to the query has a projection of
mean c * (q.w) and deviation sqrt((1 - c^2) / d) on a direction w, so each node on the way adds the log of a normal tail.
The cosine of near rows (the reach) is measured on some queries.

Inner product becomes an angle by one more coordinate, sqrt(M^2 - |x|^2) for rows (M: the largest length), 0 for queries.

Distribution: the trees are fitted on a bounded sample (SAMPLE rows) and broadcast (MOST leaves each at most). Every row goes
down every tree to a leaf; a query goes to the leaves that its queue takes until they hold LOOK rows. The two meet by
(tree, leaf), and each leaf is scored for all its queries at once. LOOK is a least number: how many rows a query has to look at
for a recall of RECALL is measured on PROBES queries, whose true neighbours are found by comparing them with all rows, and
their leaves' places in the queue; vectors without structure need a share of the table, others far less. If leaves
hold far more than LEAF rows, as the sample is bounded, each goes on as a tree below that node, and a query takes as many of its
rows as the leaf's probability gives it.

Defined cases: rows that valid_rows leaves out and zero vectors take no part; equal vectors are one candidate that stands for
their rows; null ids rank last in ties; tables with fewer candidates give fewer rows; scores beyond double precision are
infinite, and those undefined (infinity less infinity) count as minus infinity; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .vectors import best_groups, folded, matrix, query_vectors, ranked_rows, valid_rows

EVERY = 20
K = 20
TREES = 8
#: Rows of a leaf.
LEAF = 64
#: Rows of the leaves that a query takes at least, those that several trees hold counted each time.
LOOK = 24576
#: Share of the true neighbours that the leaves taken shall hold, and the queries on which that is measured.
RECALL, PROBES = 0.95, 64
#: Rows that the trees are fitted on, and leaves of a tree, at most.
SAMPLE = 32768
MOST = 4096
#: Rows of the leaves that a task handles together, queries that a task sends on their way, and such tasks at least.
BUNDLE = 32768
QUERIES, LEAST = 4096, 16
SEED = 7
#: log of the normal distribution function at -8, -8 + 1/32, ..., 8.
LOG_NORMAL = np.array([math.log(0.5 * math.erfc(-z / 32 / math.sqrt(2))) for z in range(-256, 257)])


class Tree:
    """Node i: normal w[i], offset c[i], children kids[i]; a child below 0 is leaf ~child, whose rows are leaves[~child]."""

    def __init__(self, y: np.ndarray, leaf: int, rng: np.random.Generator):
        w, c, kids, self.leaves = [], [], [], []
        stack = [(np.arange(len(y)), -1, 0)]
        while stack:
            at, parent, side = stack.pop()
            split = self._split(y, at, rng) if len(at) > leaf else None
            if split is None:
                node = ~len(self.leaves)
                self.leaves.append(at)
            else:
                node = len(w)
                w.append(split[0])
                c.append(split[1])
                kids.append([0, 0])
                stack += [(at[split[2]], node, 0), (at[~split[2]], node, 1)]
            if parent >= 0:
                kids[parent][side] = node
        self.w, self.c, self.kids, self.root = np.array(w).reshape(len(w), y.shape[1]), np.array(c), kids, 0 if w else -1

    @staticmethod
    def _split(y: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> tuple | None:
        """(normal, offset, rows of the first child): halves, by the line between two rows; None if these are equal."""
        for _ in range(5):
            w = y[at[rng.integers(len(at))]] - y[at[rng.integers(len(at))]]
            size = math.sqrt(w @ w)
            if size > 0:
                w /= size
                p = y[at] @ w
                cut = float(np.median(p))
                left = p < cut
                if left.any() and not left.all():
                    return w, cut, left
        return None

    def leaf_of(self, y: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(y), dtype=np.int64)
        stack = [(self.root, np.arange(len(y)))]
        while stack:
            node, at = stack.pop()
            if node < 0:
                out[at] = ~node
            elif len(at):
                left = y[at] @ self.w[node] < self.c[node]
                stack += [(self.kids[node][0], at[left]), (self.kids[node][1], at[~left])]
        return out


class Queue:
    """One priority queue over the trees of a forest, for one query.

    The query's projections are made tree by tree at once (a matrix product costs less than the queue does); nodes are
    expanded only when they come first.
    """

    def __init__(self, trees: list[Tree], y: np.ndarray, reach: float, deviation: float):
        self.kids, self.costs = [t.kids for t in trees], []
        for t in trees:
            z = np.clip((reach * (t.w @ y) - t.c) * (32 / deviation) + 256.5, 0, 512).astype(np.int64)
            self.costs.append(((-LOG_NORMAL[512 - z]).tolist(), (-LOG_NORMAL[z]).tolist()))
        self.heap = [(0.0, i, t.root) for i, t in enumerate(trees)]

    def pop(self) -> tuple[float, int, int] | None:
        """(log probability, tree, leaf) of the likeliest leaf not taken yet; its nodes are expanded on the way."""
        while self.heap:
            cost, t, node = heapq.heappop(self.heap)
            while node >= 0:  # the likelier child may come first at once
                (a, b), (left, right) = self.kids[t][node], (self.costs[t][0][node], self.costs[t][1][node])
                near, far = ((cost + left, t, a), (cost + right, t, b)) if left <= right else ((cost + right, t, b), (cost + left, t, a))
                heapq.heappush(self.heap, far)
                if self.heap[0] < near:
                    cost, t, node = heapq.heapreplace(self.heap, near)
                else:
                    cost, t, node = near
            return -cost, t, ~node
        return None


def raised(x: np.ndarray, most: float, longest: float) -> np.ndarray:
    """Rows on the unit sphere with one more coordinate. most: largest component of all; longest: largest length, over most."""
    x = x / most
    return np.hstack([x, np.sqrt(np.maximum(longest * longest - (x * x).sum(axis=1), 0))[:, None]]) / longest


def directions(q: np.ndarray) -> np.ndarray:
    """Queries on the unit sphere, their further coordinate zero."""
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return np.hstack([q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))])


def reach_of(y: np.ndarray, q: np.ndarray, near: int) -> tuple[float, float]:
    """Mean cosine of the `near` nearest others of some rows, and the deviation that it leaves to a projection."""
    near = max(1, min(near, len(y) - 1))
    best = np.sort(np.partition(q @ y.T, max(0, len(y) - near - 1), axis=1)[:, max(0, len(y) - near - 1) :], axis=1)
    c = float(np.clip(np.mean(best[:, :-1]) if best.shape[1] > 1 else 0.5, 0.05, 0.98))
    return c, math.sqrt((1 - c * c) / (y.shape[1] - 1))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows with one query in double precision; undefined ones are minus infinity."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = (x * q).sum(axis=1)
    return np.where(np.isnan(s), -np.inf, s)


def search(queue: Queue, trees: list[Tree], look: int) -> np.ndarray:
    """Places of the candidates in the leaves that the queue gives until they hold `look` rows."""
    taken, have = [], 0
    while have < look and (got := queue.pop()) is not None:
        taken.append(trees[got[1]].leaves[got[2]])
        have += len(taken[-1])
    return np.unique(np.concatenate(taken)) if taken else np.zeros(0, dtype=np.int64)


class Forest:
    """Trees fitted on a sample of rows, and what a query needs to know: the sizes of leaves, the reach, a least score."""

    def __init__(self, x: np.ndarray, most: float, longest: float, rows: int, k: int, trees: int, leaf: int):
        rng, self.frame, self.wanted = np.random.default_rng(SEED), (most, longest), k + 1
        y = raised(x, *self.frame)
        size = max(1, round(len(y) * max(leaf, rows / MOST) / rows))
        self.trees = [Tree(y, size, rng) for _ in range(trees)]
        self.sizes = [np.array([len(at) for at in t.leaves]) * (rows / len(y)) for t in self.trees]
        for t in self.trees:
            t.leaves = None
        near = max(1, round(k * len(y) / rows))
        self.reach, self.deviation = reach_of(y, directions(x[:64]), near)
        self.bundle = max(1, round(BUNDLE / max(1.0, float(np.mean(np.concatenate(self.sizes))))))
        self.sample = x[: 1 << 13]

    def route(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows): the leaf of each row in each tree."""
        y = raised(x, *self.frame)
        return np.stack([t.leaf_of(y) for t in self.trees])

    def visits(self, q: np.ndarray, leaf: int, look: int) -> list[tuple[int, int, int]]:
        """(tree, leaf, rows to take) of a query, the likeliest first; a leaf of a usual size is taken whole."""
        queue, out, have = Queue(self.trees, directions(q[None, :])[0], self.reach, self.deviation), [], 0.0
        while have < look and (got := queue.pop()) is not None:
            size, part = self.sizes[got[1]][got[2]], look * math.exp(got[0]) / len(self.trees)
            take = size if size <= 4 * leaf else min(size, max(leaf, part))
            out.append((got[1], got[2], math.ceil(take)))
            have += take
        return out

    def rows_until(self, q: np.ndarray, neighbours: np.ndarray) -> list[float]:
        """How many rows a query looks at until its queue has taken a leaf of each of the neighbours."""
        queue, have, open_, out = Queue(self.trees, directions(q[None, :])[0], self.reach, self.deviation), 0.0, {}, {}
        for t, of in enumerate(self.route(neighbours)):
            for n, at in enumerate(of):
                open_.setdefault((t, int(at)), []).append(n)
        while len(out) < len(neighbours) and (got := queue.pop()) is not None:
            have += self.sizes[got[1]][got[2]]
            for n in open_.get(got[1:], ()):
                out.setdefault(n, have)
        return [out[n] for n in range(len(neighbours))]

    def least(self, q: np.ndarray) -> float:
        """A score that k + 1 rows reach: what scores less cannot be among the best. Minus infinity if the sample is too small."""
        if len(self.sample) < self.wanted:
            return -np.inf
        s = scores(self.sample, q)
        return float(np.partition(s, len(s) - self.wanted)[len(s) - self.wanted])


def score_leaf(x: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the rows of a leaf that may be among the k best of each of its queries.

    A rough product of all with all selects; scores are then made pair by pair, so that one pair has one score in every tree.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        rough = q @ x.T
        slack = 1e-9 * (np.abs(q) @ np.abs(x).T)
        rough = np.where(np.isfinite(rough) & np.isfinite(slack), rough + slack, np.inf)
    i, j = np.nonzero(rough >= least[:, None])
    if not len(i):
        return i, j, np.zeros(0)
    s = np.concatenate([scores(x[j[a : a + 65536]], q[i[a : a + 65536]]) for a in range(0, len(i), 65536)])
    order = np.lexsort((-s, i))
    i, j, s = i[order], j[order], s[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    # Equal scores at the kth place stay, as their ids decide.
    kth = s[np.minimum(np.searchsorted(i, i, side="left") + k - 1, np.searchsorted(i, i, side="right") - 1)]
    ok = (place < k) | (s >= kth)
    return i[ok], j[ok], s[ok]


def nearest(df: DataFrame, every: int = EVERY, k: int = K, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF, look: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id `every` divides, among all other rows.

    look: the rows that a query looks at; measured (see looks_for) if not given.
    """
    rows = materialize(valid_rows(df, key, vector).where(F.exists("v", lambda x: x != 0)), "rows")
    groups, (asked, queries) = folded(rows, k + 1), query_vectors(rows, every)
    discard(rows)
    fitted = fit(groups, k, trees, leaf, sample)
    forests = df.sparkSession.sparkContext.broadcast(fitted)
    looks = {d: look for d in fitted} if look else looks_for(groups, queries, fitted, k)

    def to_leaves(batches):
        for b in batches:
            for d in b["dim"].unique():
                some, forest = b[b["dim"] == d], forests.value[d]
                at = forest.route(matrix(some["v"]))
                for t, of in enumerate(at):
                    yield some.assign(tree=t, bundle=of // forest.bundle, leaf=of)

    def to_visits(batches):
        for b in batches:
            out = []
            for q, d, v in zip(b["q"], b["dim"], b["v"], strict=True):
                forest, each, wide = forests.value[d], {}, v.astype(np.float64)
                for t, n, take in forest.visits(wide, leaf, looks[d]):
                    each.setdefault((t, n // forest.bundle), []).append((n, take))
                least = forest.least(wide)
                out += [(q, d, v, least, t, n, [x for x, _ in at], [x for _, x in at]) for (t, n), at in each.items()]
            yield pd.DataFrame(out, columns=["q", "dim", "v", "least", "tree", "bundle", "leaves", "takes"])

    def meet(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0), np.zeros(0, dtype=bool))]
        if len(left) and len(right):
            forest, left = forests.value[keys[0]], left.sort_values(["leaf", "g"])
            x, g, low, of = matrix(left["v"]), left["g"].to_numpy(), left["low"].to_numpy(), left["leaf"].to_numpy()
            q, name, least = matrix(right["v"]), right["q"].to_numpy(), right["least"].to_numpy()
            asks = np.repeat(np.arange(len(right)), [len(n) for n in right["leaves"]])
            leaves, takes = np.concatenate(right["leaves"].to_numpy()), np.concatenate(right["takes"].to_numpy())
            for n in np.unique(leaves):
                lo, hi = np.searchsorted(of, (n, n + 1))
                at, take = asks[leaves == n], takes[leaves == n]
                if hi - lo <= 8 * leaf:
                    i, j, s = score_leaf(x[lo:hi], q[at], least[at], k + 1)
                    found = [(at[i], j, s)]
                else:  # the tree goes on below this node
                    below = Tree(raised(x[lo:hi], *forest.frame), leaf, np.random.default_rng(SEED))
                    dirs, found = directions(q[at]), []
                    for one in range(len(at)):
                        seen = search(Queue([below], dirs[one], forest.reach, forest.deviation), [below], take[one])
                        _, j, s = score_leaf(x[lo:hi][seen], q[at[one]][None, :], least[at[one : one + 1]], k + 1)
                        found.append((np.full(len(j), at[one]), seen[j], s))
                for i, j, s in found:
                    out.append((name[i], g[lo:hi][j], low[lo:hi][j], s, (x[lo:hi][j] == q[i]).all(axis=1)))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("q", "g", "low", "score", "same"), zip(*out, strict=True), strict=True)})

    at = ["dim", "tree", "bundle"]
    kind = groups.schema["v"].dataType.simpleString()
    left = groups.select("g", "low", "dim", "v").mapInPandas(to_leaves, f"g long, low long, dim int, v {kind}, tree int, bundle int, leaf int").groupBy(*at)
    # By number, as the rows are few but each is much work.
    dealt = queries.repartition(max(LEAST, -(-queries.count() // QUERIES)), "q")
    right = dealt.mapInPandas(to_visits, f"q long, dim int, v {kind}, least double, tree int, bundle int, leaves array<int>, takes array<int>").groupBy(*at)
    found = left.cogroup(right).applyInPandas(meet, "q long, g long, low long, score double, same boolean")
    return ranked_rows(best_groups(found, k + 1), groups, asked, k)


def looks_for(groups: DataFrame, queries: DataFrame, forests: dict[int, Forest], k: int) -> dict[int, int]:
    """The rows to look at for each vector length: LOOK, or more where PROBES queries need more for a recall of RECALL.

    The probes are the query vectors with the least hashes. They are compared with all rows; each task passes on the k best of a
    probe, so that a few thousand rows come to the driver, however large the table.
    """
    out = {}
    for d, forest in forests.items():
        probes = queries.where(F.col("dim") == d).orderBy(F.xxhash64("q"), "q").limit(PROBES).select("q", "v").toPandas()
        out[d] = LOOK
        if not len(probes):
            continue
        asked = groups.sparkSession.sparkContext.broadcast((probes["q"].to_numpy(), matrix(probes["v"])))

        def compare(batches):
            name, q = asked.value
            for b in batches:
                x, g, low = matrix(b["v"]), b["g"].to_numpy(), b["low"].to_numpy()
                for i in range(len(q)):
                    s = scores(x, q[i])
                    best = np.argsort(-s, kind="stable")[: k + 1]
                    yield pd.DataFrame({"q": name[i], "g": g[best], "low": low[best], "score": s[best], "same": (x[best] == q[i]).all(axis=1)})

        near = groups.where(F.col("dim") == d).select("g", "low", "v").mapInPandas(compare, "q long, g long, low long, score double, same boolean")
        true = best_groups(near, k + 1).where(~F.col("same")).join(groups.select("g", "v"), "g").select("q", "v").toPandas()
        wide = dict(zip(*asked.value, strict=True))
        needed = [n for q, some in true.groupby("q") for n in forest.rows_until(wide[q].astype(np.float64), matrix(some["v"]))]
        if needed:
            out[d] = max(LOOK, math.ceil(np.quantile(needed, RECALL, method="higher")))
    return out


def fit(groups: DataFrame, k: int, trees: int, leaf: int, sample: int) -> dict[int, Forest]:
    """A forest for each vector length, fitted on at most `sample` of its vectors, those with the least hashes."""
    out, most = {}, F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    for r in groups.groupBy("dim").agg(F.count("*").alias("n"), F.max(most).alias("most")).collect():
        of_dim = groups.where(F.col("dim") == r["dim"])
        scaled = F.transform("v", _over(r["most"]))
        longest = of_dim.agg(F.max(F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
        taken = of_dim.select("g", "v").orderBy(F.xxhash64("g"), "g").limit(sample).toArrow().column("v").combine_chunks()
        x = np.asarray((taken.chunk(0) if hasattr(taken, "chunk") else taken).flatten(), dtype=np.float64).reshape(-1, r["dim"])
        out[r["dim"]] = Forest(x, r["most"], longest, r["n"], k, trees, leaf)
    return out


def _over(most: float):
    return lambda x: x.cast("double") / F.lit(most)
