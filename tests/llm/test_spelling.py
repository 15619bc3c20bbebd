"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import spelling

from .conftest import SCHEMA

CAPITALS = {i: i + 32 for i in range(65, 91)}


def one_edit(a, b):
    """Whether a and b differ by one inserted, deleted or replaced character."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :]


def brute(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(CAPITALS)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [] for w in words}
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for w in words:
        near[w] = [v for k in (-1, 0, 1) for v in by.get(len(w) + k, []) if one_edit(w, v)]
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def answer(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_variant_groups(request, which):
    df = request.getfixturevalue(which)
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert answer(spelling.variant_groups(df)) == want


def test_chains_ties_and_null_ids(spark):
    text = ["strange " * 1400, "strangé " * 230 + "Strange", "strangéé " * 40, "straangéé " * 4, "straangéé", "letters letters lettérs " * 30, "aaaaaa " * 40 + "aaaaaaa " * 5 + "aaaaab " * 6 + "baaaaa aaaaa " * 7, None, "", "×÷×÷×÷ " * 9]
    rows = [(None if n == 5 else n, t) for n, t in enumerate(text)] + [(3, "straangéé")] * 2
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    want = brute(rows)
    assert answer(spelling.variant_groups(df)) == want
    assert {w[2] for w in want if w[0] == "straangéé"} == {"strange"}


def test_edits_are_all_and_each_once():
    """The hashes of all edits of a word are those of its distinct neighbours."""
    letters = "abcdé"
    codes = np.array([ord(c) for c in letters], np.uint64)
    spell = lambda words: [int(spelling._sums(c := spelling._codes([w]), spelling._powers(c.shape[1]))[0, -1]) for w in words]
    for word in ("abcabc", "aabbcc", "aaaaaa", "éabde", "a"):
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
        got = [int(h) for _, _, _, _, hs in spelling._edits(spelling._codes([word]), codes) for h in hs]
        assert sorted(got) == sorted(spell(want - {word}))


def test_a_full_bitmap_changes_nothing(spark, documents, monkeypatch):
    """The bitmap only saves candidates from the shuffle: one bit set for all gives the same groups."""
    want = answer(spelling.variant_groups(documents))
    monkeypatch.setattr(spelling, "_bitmap", lambda hashed: np.full(1 << (spelling.BITS - 3), 255, np.uint8))
    assert answer(spelling.variant_groups(documents)) == want


def test_colliding_hashes_add_nothing(spark, documents, monkeypatch):
    """Words whose hashes agree are told apart by their spelling."""
    want = answer(spelling.variant_groups(documents))
    weak = spelling._hashes

    def clash(batches):
        for b in weak(batches):
            yield b
            yield b.set_column(0, "g", spelling.pa.array(np.roll(b.column("g").to_numpy(), 1)))

    monkeypatch.setattr(spelling, "_hashes", clash)
    assert answer(spelling.variant_groups(documents)) == want


def test_very_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "AT_ONCE", 1000)
    rows = [(n, "a" * 3000 + " " + "a" * 2999 + "b") for n in range(12)] + [(50 + n, "a" * 2999 + " abcdef") for n in range(70)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    assert answer(spelling.variant_groups(df)) == brute(rows)


def test_parameters_and_empty(spark, none):
    assert spelling.variant_groups(none).count() == 0
    df = spark.createDataFrame([(1, "Oslo oslo osla", None, None, 0)], SCHEMA)
    assert answer(spelling.variant_groups(df, ratio=2, least_length=4, least_count=1)) == [("osla", "oslo", "oslo", 1, 1, 2), ("oslo", None, "oslo", 2, 1, None)]
    with pytest.raises(ValueError):
        spelling.variant_groups(none, ratio=1)
