"""Language-model scores (operator 10).

Method: a hidden Markov language model. Latent states emit word classes, a class emits words by their counts; Baum-Welch
counts are summed across partitions to train states, and a scaled forward recursion gives the exact likelihood of each
whole text. Words fall into classes by their ending, so transitions and emissions have a fixed size; the word counts behind
the classes cover the whole training corpus and stay a distributed table.

P(text) = sum over state paths of prod A(state' | state) E(class | state) * P(word | class), the end being a class of its own, and
P(word | class) = (c + 1) / (N_class + V_class + 1), which leaves room for an unseen word in each class.

Layout: texts are tokenised once into chunk rows (a chunk's dictionary, and its documents as places in it, two bytes each
where the dictionary allows), written to the shared folder. Counting and looking up words moves a row for each word of a
chunk, not for each token. The recursions run over all documents of a chunk at once, packed by time: what stands at one
time lies side by side, the longest document first, so no cell is padding. Training cuts long documents into pieces that
run side by side, holds the states of at most HELD cells and computes the others again; scoring holds those of one time
only. So a text of any length needs bounded memory.

Defined cases: a null text has no words and is its end alone; repeated rows are scored each and all learnt from; a null id is
never held out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, in_fold, materialize

DIVISOR, HELD_OUT = 7, 2
STATES = 6
CLASSES = 1024
ROUNDS = 4
ENDING = 3
SEED = 10
#: Bytes of text in a chunk; cells whose state probabilities training holds at once; tokens looked up at once; tokens of
#: a piece of a document in training, and of a document that is not cut.
CHUNK = 16 << 20
HELD = 4 << 20
PART = 1 << 18
PIECE = 1 << 10
UNCUT = 1 << 12

CHUNK_SCHEMA = "chunk long, words array<string>, cls array<short>, cnt array<int>, doc_ids array<long>, held array<boolean>, lens array<int>, wide boolean, seq binary"


def _texts(b: pa.RecordBatch) -> Iterator[slice]:
    """Consecutive rows of a batch, of about CHUNK bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("t")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        yield slice(at, stop)
        at = stop


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts end to end, A-Z in lower case, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, edges = split.flatten(), np.append(0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))
    real = pc.not_equal(words, "")
    upto = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return words.filter(real), np.diff(upto[edges])


def _chunk(ids: list, held: list, words: list[pa.Array], lens: list[np.ndarray]) -> pa.RecordBatch:
    coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    seq, names, size = coded.indices.to_numpy(), coded.dictionary, np.concatenate(lens)
    held = np.concatenate(held)
    count = np.bincount(seq[np.repeat(~held, size)], minlength=len(names)).astype(np.int32)
    cls = np.fromiter((zlib.crc32(w[-ENDING:]) % CLASSES for w in names.cast(pa.binary()).to_pylist()), dtype=np.int16, count=len(names))
    wide, one = len(names) > 1 << 16, lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    columns = [pa.array([uuid.uuid4().int >> 65]), one(names), one(pa.array(cls)), one(pa.array(count)), one(pa.concat_arrays(ids)), one(pa.array(held)), one(pa.array(size.astype(np.int32))), pa.array([wide]), pa.array([seq.astype("<u4" if wide else "<u2").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "words", "cls", "cnt", "doc_ids", "held", "lens", "wide", "seq"])


def tokenise(docs: DataFrame, text: str = "text", key: str = "doc_id", divisor: int = DIVISOR, held_out: int = HELD_OUT) -> DataFrame:
    """Chunk rows of all documents; a null text has no words."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = ([], [], [], []), 0
        for b in batches:
            for at in _texts(b):
                some = b.slice(at.start, at.stop - at.start)
                words, lens = _tokens(some.column("t"))
                for kept, x in zip(parts, (some.column("doc_id"), some.column("held").to_numpy(zero_copy_only=False).astype(bool), words, lens), strict=True):
                    kept.append(x)
                size += some.column("t").nbytes
                if size >= CHUNK:
                    yield _chunk(*parts)
                    parts, size = ([], [], [], []), 0
        if parts[0]:
            yield _chunk(*parts)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), in_fold(F.col(key), divisor, held_out).alias("held"), F.col(text).alias("t"))
    return rows.mapInArrow(chunks, CHUNK_SCHEMA)


def with_ends(cls: np.ndarray, lens: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents end to end with the end behind each, and their lengths with it."""
    out = np.full(len(cls) + len(lens), end, dtype=np.int16)
    out[np.arange(len(cls)) + np.repeat(np.arange(len(lens)), lens)] = cls
    return out, lens + 1


class Packed:
    """Sequences (end to end, none empty) packed by time: cell edges[t] + j is time t of the jth longest sequence."""

    def __init__(self, obs: np.ndarray, lens: np.ndarray):
        self.order = np.argsort(-lens, kind="stable")
        rank = np.empty(len(lens), dtype=np.int64)
        rank[self.order] = np.arange(len(lens))
        self.live = np.searchsorted(-lens[self.order], -np.arange(lens.max()), side="left")
        self.edges = np.append(0, np.cumsum(self.live))
        time = np.arange(len(obs)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.obs = np.empty_like(obs)
        self.obs[self.edges[time] + np.repeat(rank, lens)] = obs

    def steps(self, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, sequences that go on) of the cells of each time from a to b."""
        e = self.edges[a : b + 1].tolist()
        return zip(e[:-1], e[1:], self.live[a:b].tolist(), strict=True)

    def segments(self, most: int) -> list[tuple[int, int]]:
        """Consecutive times in stretches of at most `most` cells, or one time."""
        out, a = [], 0
        while a < len(self.live):
            b = max(a + 1, int(np.searchsorted(self.edges, self.edges[a] + most, side="right")) - 1)
            out.append((a, b))
            a = b
        return out


def run_forward(model: tuple, obs: np.ndarray, lens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities at the end of each sequence and log10 of its probability, by the scaled forward recursion.

    first: (states, sequences), the state probabilities before each sequence's first observation. Holds one time only.
    """
    back, of = np.ascontiguousarray(model[1].T), np.ascontiguousarray(model[2].T)
    p = Packed(obs, lens)
    total, last, a = np.zeros(len(lens)), np.empty(first.shape), None
    for lo, hi in p.segments(PART):
        base = p.edges[lo]
        seen, scale = of.take(p.obs[base : p.edges[hi]], axis=1), np.empty(p.edges[hi] - base)
        for s, e, n in p.steps(lo, hi):
            if a is None:
                a = first[:, p.order]
            else:
                last[:, n : a.shape[1]] = a[:, n:]
                a = np.matmul(back, a[:, :n])
            a *= seen[:, s - base : e - base]
            a /= np.add.reduce(a, axis=0, out=scale[s - base : e - base])
        cell = np.arange(base, p.edges[hi]) - np.repeat(p.edges[lo:hi], p.live[lo:hi])
        total += np.bincount(cell, np.log10(scale), minlength=len(lens))
    last[:, : a.shape[1]] = a
    back_in_order = np.argsort(p.order)
    return last[:, back_in_order], total[back_in_order]


def log_likelihood(model: tuple, cls: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """log10 of the probability of each of the documents laid end to end."""
    if not len(lens):
        return np.zeros(0)
    obs, full = with_ends(cls, lens, len(model[2]) - 1)
    return run_forward(model, obs, full, np.repeat(model[0][:, None], len(lens), axis=1))[1]


def _chained(model: tuple, obs: np.ndarray, lens: np.ndarray, no: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces of documents (no: place in the document; more: whether another piece follows): the state probabilities
    before the first observation, at the end, and the weights of what follows the end.

    A piece is a linear map of the probabilities before it, found by running it from each state alone; the maps of a
    document's pieces are applied one behind the other, forwards and backwards.
    """
    start, move, _ = model
    k, n = len(start), len(lens)
    first, last, behind = np.repeat(start[:, None], n, axis=1), np.zeros((k, n)), np.ones((k, n))
    long = np.flatnonzero((no > 0) | more)
    if not len(long):
        return first, last, behind
    ends = np.cumsum(lens)
    some = np.concatenate([obs[ends[i] - lens[i] : ends[i]] for i in long])
    got = [run_forward(model, some, lens[long], np.repeat(np.eye(k)[:, i, None], len(long), axis=1)) for i in range(k)]
    size = np.stack([g[1] for g in got])
    maps = np.stack([g[0] for g in got]) * (10.0 ** (size - size.max(axis=0)))[:, None, :]  # from, to, piece
    at = np.full(n, -1)
    at[long] = np.arange(len(long))
    for j in range(no.max() + 1):
        here = long[no[long] == j]
        if j:
            first[:, here] = move.T @ last[:, here - 1]
        x = np.einsum("fp,ftp->tp", first[:, here], maps[:, :, at[here]])
        last[:, here] = x / x.sum(axis=0)
    for j in range(no.max(), 0, -1):
        here = long[no[long] == j]
        x = move @ np.einsum("ftp,tp->fp", maps[:, :, at[here]], behind[:, here])
        behind[:, here - 1] = x / x.sum(axis=0)
    return first, last, behind


def expected_counts(model: tuple, cls: np.ndarray, lens: np.ndarray, held: int = HELD, piece: int = PIECE, uncut: int = UNCUT) -> np.ndarray:
    """Baum-Welch counts of documents laid end to end: starts, moves and emissions in one flat array.

    Long documents are cut into pieces that run side by side, exactly, as _chained gives what stands before and behind each.
    States are held in single precision (scaled at each time), sums are made in double.
    """
    k, c = len(model[0]), len(model[2])
    obs, full = with_ends(cls, lens, c - 1)
    parts = np.where(full > uncut, -(-full // piece), 1)
    no = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    more = no < np.repeat(parts, parts) - 1
    sizes = np.where(more, piece, np.repeat(full - (parts - 1) * piece, parts))
    first, last, behind = _chained(model, obs, sizes, no, more)
    p = Packed(obs, sizes)
    start, move, emit = (np.ascontiguousarray(x, dtype=np.float32) for x in model)
    first, behind = (np.ascontiguousarray(x[:, p.order], dtype=np.float32) for x in (first, behind))
    back, of = np.ascontiguousarray(move.T), np.ascontiguousarray(emit.T)
    total_move, total_emit = np.zeros((k, k)), np.zeros((c, k))
    segments, before = p.segments(held), [None]

    def forward(lo: int, hi: int, ahead: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """State probabilities of a stretch and what divides them at each cell, from those of the time before it."""
        base = p.edges[lo]
        alpha, scale = of.take(p.obs[base : p.edges[hi]], axis=1), np.empty(p.edges[hi] - base, dtype=np.float32)
        for s, e, n in p.steps(lo, hi):
            a = alpha[:, s - base : e - base]
            a *= first if ahead is None else np.matmul(back, ahead[:, :n])
            a /= np.add.reduce(a, axis=0, out=scale[s - base : e - base])
            ahead = a
        return alpha, scale

    for lo, hi in segments[:-1]:
        alpha, _ = forward(lo, hi, before[-1])
        before.append(alpha[:, p.edges[hi - 1] - p.edges[lo] :].copy())
    later = np.zeros((k, 0), dtype=np.float32)  # weighted emissions of the time behind, for the moves into it
    beta = np.empty((k, len(sizes)), dtype=np.float32)
    for (lo, hi), ahead in zip(reversed(segments), reversed(before), strict=True):
        alpha, scale = forward(lo, hi, ahead)
        base = p.edges[lo]
        for s, e, n in reversed(list(p.steps(lo, hi))):
            a, m = alpha[:, s - base : e - base], later.shape[1]
            if m:
                total_move += np.matmul(a[:, :m], later.T)
                np.matmul(move, later, out=beta[:, :m])
            if m < n:  # sequences that end here
                beta[:, m:n] = behind[:, m:n] / (a[:, m:n] * behind[:, m:n]).sum(axis=0)
            a *= beta[:, :n]
            later = of.take(p.obs[s:e], axis=1)
            later *= beta[:, :n]
            later /= scale[s - base : e - base]
        seen = p.obs[base : p.edges[hi]]
        for i in range(k):
            total_emit[:, i] += np.bincount(seen, alpha[i], minlength=c)
    begins = no[p.order] == 0
    total_start = alpha[:, : p.live[0]][:, begins].sum(axis=1, dtype=np.float64)
    # Moves from the end of a piece into the next one.
    total_move += last[:, p.order[~begins] - 1] @ later[:, ~begins].T
    return np.concatenate([total_start, (move * total_move).ravel(), total_emit.ravel()])


def _normalised(counts: np.ndarray, k: int) -> tuple:
    start, move, emit = counts[:k] + 0.1, counts[k : k + k * k].reshape(k, k) + 0.1, counts[k + k * k :].reshape(-1, k) + 0.01
    return start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)


def first_model(freq: np.ndarray, k: int = STATES) -> tuple:
    """Sticky states whose emissions are the class frequencies, disturbed; always the same."""
    noise = np.exp(np.random.default_rng(SEED).normal(0, 1.0, (len(freq), k)))
    return _normalised(np.concatenate([np.ones(k), (np.eye(k) * 20 + 1).ravel() * 100, ((freq + 1)[:, None] * noise).ravel()]), k)


def _places(b: pa.RecordBatch, row: int) -> np.ndarray:
    return np.frombuffer(b.column("seq")[row].as_py(), dtype="<u4" if b.column("wide")[row].as_py() else "<u2")


def _classes_of(b: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a chunk's tokens end to end, lengths and held-out marks of its documents."""
    cls = b.column("cls")[row].values.to_numpy().astype(np.int16)
    return cls[_places(b, row)], b.column("lens")[row].values.to_numpy().astype(np.int64), b.column("held")[row].values.to_numpy(zero_copy_only=False).astype(bool)


def train(chunks: DataFrame, freq: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple:
    """(start, moves, emissions) after Baum-Welch over all training documents of the chunks."""
    model = first_model(freq, states)
    for _ in range(rounds if freq.any() else 0):
        shared = chunks.sparkSession.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for row in range(b.num_rows):
                    cls, lens, held = _classes_of(b, row)
                    cls, lens = cls[np.repeat(~held, lens)], lens[~held]
                    if len(lens):
                        got = expected_counts(shared.value, cls, lens)
                        total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

        rows = chunks.select("cls", "held", "lens", "wide", "seq").mapInArrow(count, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        counts = np.zeros(states + states * states + states * len(freq))
        counts[rows.column("i").to_numpy()] = rows.column("x").to_numpy()
        model = _normalised(counts, states)
    return model


def language_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    A text without words is its end alone. Without training documents every token has base probability one.
    """
    chunks = materialize(tokenise(docs, text, key), "chunks")
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "cls", "cnt")).alias("i", "w"))
    vocabulary = materialize(words.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.cnt").alias("c"), F.max("w.cls").alias("cls")).where("c > 0"), "vocabulary")
    classes = vocabulary.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    ends = chunks.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)).alias("n")).first()["n"]
    freq, kinds = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in classes:
        freq[r["cls"]], kinds[r["cls"]] = r["n"], r["v"]
    freq[CLASSES] = ends
    tokens, distinct = int(freq.sum()), int(kinds.sum()) + (ends > 0)
    model = train(chunks, freq, states, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((model, np.log10(freq + kinds + 1)))
    base_all, end_count = np.log10(tokens + 1.0 * (distinct + 1)), int(ends)

    found = words.select("chunk", "i", F.col("w.words").alias("word")).join(vocabulary.select(F.col("word").alias("v_word"), "c"), F.col("word") == F.col("v_word"), "left")
    looked_up = found.select("chunk", F.struct("i", F.coalesce("c", F.lit(0)).cast("long").alias("c")).alias("x")).groupBy(F.col("chunk").alias("c_chunk")).agg(F.array_sort(F.collect_list("x")).alias("x")).select("c_chunk", F.col("x.c").alias("counts"))
    # The counts of a partition's chunks are hashed, so that the long rows of tokens need no sorting.
    joined = chunks.join(looked_up.hint("shuffle_hash"), F.col("chunk") == F.col("c_chunk"), "left").select("doc_ids", "held", "lens", "wide", "seq", "cls", "counts")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, of_class = shared.value
        for b in batches:
            for row in range(b.num_rows):
                cls, lens, held = _classes_of(b, row)
                counts = b.column("counts")[row]
                counts = counts.values.to_numpy().astype(np.int64) if counts.is_valid else np.zeros(0, dtype=np.int64)
                seq, ends = _places(b, row), np.append(0, np.cumsum(lens))
                # By word of the chunk first, then gathered and summed for some tokens at a time.
                log_c = np.log10(counts + 1.0)
                tables = (log_c - base_all, log_c - of_class[b.column("cls")[row].values.to_numpy()], (counts > 0).astype(np.float64))
                base, total, known = (_sums(x, seq, ends) for x in tables)
                base += np.log10(end_count + 1.0) - base_all
                known = known.astype(np.int64) + (end_count > 0)
                total += log_likelihood(hmm, cls, lens)
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[row].values, pa.array(held), pa.array(lens + 1), pa.array(known), pa.array(base), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = materialize(joined.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores")
    discard(chunks, vocabulary)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _sums(table: np.ndarray, seq: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum over each document's tokens of its words' values; ends: where documents begin and end in seq."""
    out = np.zeros(len(ends) - 1)
    for lo in range(0, len(seq), PART):
        hi = min(len(seq), lo + PART)
        a, b = np.searchsorted(ends, lo, side="right") - 1, np.searchsorted(ends, hi, side="left")
        doc = np.repeat(np.arange(a, b), np.diff(np.clip(ends[a : b + 1], lo, hi)))
        out[a:b] += np.bincount(doc - a, table[seq[lo:hi]], minlength=b - a)
    return out
