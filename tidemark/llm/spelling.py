"""Spelling variant grouping (operator 13).

Method: full neighbourhood generation. The words of the corpus are counted; from each word all distinct deletions,
replacements and insertions over the observed alphabet are generated; candidates meet the vocabulary in a hash join.
What joins is one edit away by construction, so no distance is computed.

A candidate is described by (word, kind, place, character) and carries a 64-bit hash of its spelling, which follows from sums over
the word without writing the candidate out: with H(w) the sum of c_i B^i, an edit changes H by a term and shifts the rest by
one power. Candidates are generated in Arrow batches, tested against a bitmap of the vocabulary's hashes (BITS bits, whatever
the size of the vocabulary; it only keeps candidates from the shuffle that would not join), joined by hash, spelt out and compared with the word they
met, so a collision of hashes adds nothing.

Each spelling is generated once: of equal neighbouring characters only the last is deleted, and none is inserted right behind an equal one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RUN = "[A-Za-zÀ-ÿ]"
#: Size of the bitmap of the vocabulary's hashes, as a power of two.
BITS = 26
#: Hashes that are computed at once.
AT_ONCE = 1 << 20
#: Words that a task takes, about.
WORDS = 8192
#: The odd base of the hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPREAD = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
DELETE, REPLACE, INSERT = 0, 1, 2

ORACLE = r"""
WITH RECURSIVE steps AS (SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [192 + (unicode(s) >> 6)::BIGINT, 128 + (unicode(s) & 63)::BIGINT] END)) AS b FROM each),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda h, x: xor(t[xor(h & 255, x) + 1], h >> 8), 4294967295), 4294967295) AS h FROM bytes, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (SELECT word, word AS spot, 0 AS depth FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON c.spot = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(spot, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def _lower(run: Column) -> Column:
    """A-Z in lower case, nothing else; a run of ASCII letters takes the short way."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, capitals, capitals.lower()))


def misspelt(doc_id: Column, run: Column, every: int = 199) -> Column:
    """A lower-cased run, without one character if `every` divides the crc32 of '<doc_id>:<run>' (a null id: ':<run>')."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(g, word, n), written: the words of at least that many code points and occurrences, numbered; n is their count over all rows.

    Runs shorter than a word are never made rows. A null text has no words; repeated rows count each time.
    """
    runs = docs.select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{least_length},}}+"), F.lit(0))).alias("run"))
    words = runs.select("id", _lower(F.col("run")).alias("run")).select(misspelt(F.col("id"), F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return materialize(counted.select(F.monotonically_increasing_id().alias("g"), "word", "n"), "vocabulary")


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(words), -1)


def _powers(n: int) -> np.ndarray:
    """B^0 ... B^(n - 1) modulo 2^64."""
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _sums(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Column i: the sum of c_j B^j over j < i, for i from 0 to the length."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum(codes * powers[: codes.shape[1]], axis=1, out=out[:, 1:])
    return out


def _places(h: np.ndarray) -> list[np.ndarray]:
    """The two bits of the bitmap that stand for each hash."""
    x = h ^ (h >> np.uint64(33))
    return [(x * np.uint64(m)) >> np.uint64(64 - BITS) for m in SPREAD]


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, h) of each (g, word)."""
    for b in batches:
        words = b.column("word").to_pylist()
        h = np.zeros(len(words), np.uint64)
        for rows in _same_length(words):
            codes = _codes([words[r] for r in rows])
            h[rows] = _sums(codes, _powers(codes.shape[1]))[:, -1]
        yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(h.view(np.int64))], names=["g", "h"])


def _same_length(words: list[str]) -> Iterator[np.ndarray]:
    """Row numbers of words of one length, so many that their characters are at most AT_ONCE together (one word, if longer)."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        step = max(1, AT_ONCE // max(1, int(n)))
        for at in range(0, len(rows), step):
            yield rows[at : at + step]


def _bitmap(hashed: DataFrame) -> np.ndarray:
    """The bits of all hashes, as bytes; at most 2^BITS / 64 longs come to the driver, however large the vocabulary."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate(_places(b.column("h").to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    got = hashed.mapInArrow(places, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def _edits(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, row, place, character, hash) of all distinct edits of words of one length, AT_ONCE hashes at a time.

    The deletions first, then the replacements and insertions in slices of places.
    """
    w, n = codes.shape
    powers = _powers(n + 1)
    sums = _sums(codes, powers)
    total, base, inverse = sums[:, -1:], np.uint64(BASE), np.uint64(INVERSE)
    last = np.ones((w, n), bool)
    last[:, :-1] = codes[:, :-1] != codes[:, 1:]
    row, place = np.nonzero(last)
    yield DELETE, row, place, np.zeros(len(row), np.uint64), (sums[:, :-1] + (total - sums[:, 1:]) * inverse)[row, place]
    step = max(1, AT_ONCE // (w * len(alphabet)))
    for low in range(0, n + 1, step):
        at = np.arange(low, min(low + step, n + 1))
        inside = at[at < n]
        for kind, here in ((REPLACE, inside), (INSERT, at)):
            if not len(here):
                continue
            if kind == REPLACE:
                rest, unlike = total - codes[:, here] * powers[here], codes[:, here]
            else:
                rest = sums[:, here] + (total - sums[:, here]) * base
                unlike = np.where(here > 0, codes[:, np.maximum(here - 1, 0)], np.uint64(0))
            h = rest[:, :, None] + powers[here][:, None] * alphabet
            row, place, char = np.nonzero(unlike[:, :, None] != alphabet)
            yield kind, row, here[place], alphabet[char], h[row, place, char]


def _candidates(bitmap, alphabet: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, letters, names = bitmap.value, np.array(alphabet, np.uint64), pa.array(["", *map(chr, alphabet)])
        for b in batches:
            words, g = b.column("word").to_pylist(), b.column("g").to_numpy()
            for rows in _same_length(words):
                few = max(1, AT_ONCE // ((len(words[rows[0]]) + 1) * len(letters)))
                for at in range(0, len(rows), few):
                    some = rows[at : at + few]
                    for kind, row, place, char, h in _edits(_codes([words[r] for r in some]), letters):
                        for k in range(2):
                            p = _places(h)[k]
                            known = (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 != 0
                            row, place, char, h = row[known], place[known], char[known], h[known]
                        yield pa.RecordBatch.from_arrays([pa.array(g[some[row]]), pa.array(h.view(np.int64)), pa.array(np.full(len(h), kind, np.int32)), pa.array(place.astype(np.int32)), names.take(pa.array(np.searchsorted(letters, char) + (kind != DELETE)))], names=["g", "h", "kind", "place", "letter"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(g, near_g, near, near_n): each pair of words (g, word, n) that differ by one inserted, deleted or replaced code point, both ways.

    words is read several times and should be a written table. An empty one gives no pairs.
    """
    spark = words.sparkSession
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").distinct()
    alphabet = sorted(ord(r.letter) for r in letters.collect())
    if not alphabet:
        return spark.createDataFrame([], "g long, near_g long, near string, near_n long")
    hashed = materialize(words.select("g", "word").mapInArrow(_hashes, "g long, h long"), "hashes")
    bitmap = spark.sparkContext.broadcast(_bitmap(hashed))
    dealt = words.select("g", "word").repartition(max(spark.sparkContext.defaultParallelism, words.count() // WORDS), "g")
    made = dealt.mapInArrow(_candidates(bitmap, alphabet), "g long, h long, kind int, place int, letter string")
    met = made.join(hashed.select(F.col("g").alias("near_g"), F.col("h").alias("near_h")), F.col("h") == F.col("near_h"))
    both = met.join(words.select("g", "word"), "g").join(words.select(F.col("g").alias("near_g"), F.col("word").alias("near"), F.col("n").alias("near_n")), "near_g")
    head, tail = F.substr("word", F.lit(1), F.col("place")), F.when(F.col("kind") == INSERT, F.substr("word", F.col("place") + 1)).otherwise(F.substr("word", F.col("place") + 2))
    spelt = F.concat(head, F.col("letter"), tail)
    return both.where(spelt == F.col("near")).select("g", "near_g", "near", "near_n")


def _roots(parents: DataFrame) -> DataFrame:
    """(g, root): where each word (g, parent) ends if parents are followed to the last, by doubling the steps.

    A parent occurs at least `ratio` times as often as its child, so chains are short and have no cycles; rounds grow with the logarithm of the longest.
    """
    now = materialize(parents.select("g", F.col("parent").alias("root")), "roots")
    while True:
        on = now.select(F.col("g").alias("root"), F.col("root").alias("further"))
        step = materialize(now.join(on, "root", "left").select("g", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = step.select("g", "root")
        if step.where("moved").isEmpty():
            return now


def variant_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = 5, **kw) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the corpus.

    form: the word's near word of largest n (ties: smallest in code-point order), if it occurs at least `ratio` (over 1) times as
    often as the word, else null. root: from the word along forms to the last. n_near counts near words. No words, no rows.
    """
    if ratio <= 1:
        raise ValueError("the ratio must be over 1")
    words = vocabulary(docs, key, text, **kw)
    near = near_words(words)
    best = near.groupBy("g").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near", "near_g")).alias("best"))
    every = words.join(best, "g", "left")
    formed = -F.col("best.order") >= ratio * F.col("n")
    chosen = materialize(every.select("g", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.order")).alias("form_n"), F.when(formed, F.col("best.near_g")).alias("parent")), "forms")
    roots = _roots(chosen.where("parent is not null").select("g", "parent"))
    named = roots.join(words.select(F.col("g").alias("root"), F.col("word").alias("root_word")), "root").select("g", "root_word")
    return chosen.join(named, "g", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
