"""The operators on documents against brute force, on real rows and on odd ones."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import bpe, hmm, mixing, pii, quality, simhash, suffix, toxicity
from tidemark.llm.common import in_fold

from .conftest import SCHEMA

sha = lambda b: hashlib.sha256(b).hexdigest()


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)


# --- repeated byte strings


def brute_repeats(rows, length):
    order = sorted({(i is not None, i or 0, t) for i, t in rows})
    seen, out = set(), {}
    for has, i, t in order:
        raw = t.encode()
        cover = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                cover[k : k + length] = b"\x01" * length
            seen.add(s)
        runs = len([x for x in bytes(cover).split(b"\0") if x])
        out[i if has else None, t] = (len(raw), sum(cover), runs, sha(bytes(x for x, c in zip(raw, cover, strict=True) if not c)))
    return out


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_suffix(request, which):
    df = request.getfixturevalue(which)
    if which == "odd":
        df = df.where("doc_id is null or doc_id <> 11").unionByName(df.where("doc_id = 11").withColumn("text", F.expr("repeat('ab', 400)")))
    rows = texts(df)
    want = brute_repeats(rows, 100)
    got = multiset(suffix.repeat_digests(df).collect())
    assert got == multiset((i, *want[i, t]) for i, t in rows)


def test_suffix_general_interface_and_empty(spark, none):
    assert suffix.repeat_digests(none).count() == 0
    df = spark.createDataFrame([(2, "xxabcdefghijxx"), (1, "abcdefghij--abcdefghij")], "doc_id long, text string")
    got = {r.doc_id: (r.kept, [(x.s, x.e) for x in r.removed]) for r in suffix.without_repeats(df, length=8, anchor=4).collect()}
    assert got == {1: (b"abcdefghij--", [(12, 22)]), 2: (b"xxxx", [(2, 12)])}


# --- byte-level BPE


def brute_bpe(t):
    import base64

    import public_tokenizers as p
    import tiktoken

    global _enc
    try:
        _enc
    except NameError:
        with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _enc.encode_ordinary(t)


@pytest.mark.parametrize("chunk, overlap", [(32768, 1024), (500, 60)])
def test_bpe(spark, odd, chunk, overlap):
    rows = texts(odd) + [(77, "don't stop'  \n\n  well 'll" * 300), (78, "   " * 800 + "x"), (79, "<|endoftext|> ok")]
    df = odd.unionByName(spark.createDataFrame(rows[-3:], "doc_id long, text string"), allowMissingColumns=True)
    got = multiset(bpe.token_digests(bpe.public_bpe(spark, chunk=chunk, overlap=overlap), df).collect())
    want = [(i, len(ids := brute_bpe(t)), sha(" ".join(map(str, ids)).encode()), sha(t.encode())) for i, t in rows]
    assert got == multiset(want)


@pytest.mark.parametrize("size", [200_000, 5_000_000])
def test_bpe_of_long_runs(spark, size):
    """Runs of one kind of character far longer than a chunk, alone and within text, equal their pre-tokens encoded one by one."""
    encoder = bpe.public_bpe(spark)
    enc, split = bpe._encoding(encoder.ranks.value, encoder.pattern), regex.compile(encoder.pattern)
    runs = [" " * size, "\n" * size, "ab" * (size // 2), "7" * size, "x" + " " * size + "y and more", "Ñ\x1c" + "\t " * (size // 2) + "日本 it's " * 20_000 + "!" * size]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(runs if size < 1_000_000 else runs[::2])], SCHEMA)
    texts_ = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in bpe.token_digests(encoder, docs).collect():
        ids = [i for m in split.finditer(texts_[r.doc_id]) for i in enc._core_bpe.encode_single_piece(m.group().encode())]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts_[r.doc_id].encode()).hexdigest()


def test_bpe_empty(spark, none):
    assert bpe.token_digests(bpe.public_bpe(spark), none).count() == 0


# --- personal data


def brute_spans(t):
    def luhn(x):
        v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(x))]
        return sum(x - 9 if x > 9 else x for x in v) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


TRICKY = [
    "a@b.com_x@y.z a.@-.- @@x@y.z..q", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.0003.4 1..2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1234567812345670 0000000000000",
    "+1 (243) 555-7962 +12 +123456789012345678 +1-+1 555 555 5555-", "日本é bob@é.com x@y.zé +4420 7946 0958 日", "9" * 3000 + " " + "1 " * 300 + "a" * 3000 + "@" + "b." * 300,
]


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.train(spark)


def test_pii(spark, odd, documents, pii_model):
    extra = spark.createDataFrame([(500 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    df = odd.unionByName(extra, allowMissingColumns=True).select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    want = []
    for i, t in texts(df):
        b = brute_spans(t)
        want.append((i, *(sum(k == n for _, k, _ in b) for n in range(4)), sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b).encode())))
    got = pii.pii_digests(df, pii_model).collect()
    assert multiset(r[:-1] for r in got) == multiset(want)


def test_pii_zero_parts_of_addresses(spark, pii_model):
    rows = list(enumerate(["at 10.0.0.1 and 192.168.0.1, 0.0.0.0", "1.00.2.000 000.0255.0.00 0.0.0", "0.0.0.256 10.0.0.0256 0.0.0.300", "0" * 3000 + ".0.0.0 " + "0" * 3000 + ".0.0.999", "255.255.255.255 8.8.8.8"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for i, t in rows:
        b = brute_spans(t)
        want.append((i, *(sum(k == n for _, k, _ in b) for n in range(4)), sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b).encode())))
    assert multiset(r[:-1] for r in pii.pii_digests(df, pii_model).collect()) == multiset(want)
    assert {r.doc_id: r.text for r in pii.redact(df, pii_model).collect()}[0] == "at [IP] and [IP], [IP]"


def test_pii_model_adds_and_redacts(spark, odd, pii_model):
    df = spark.createDataFrame([(1, "mail me: bob.x (at) mailer dot com. call 555-123-4567 today; isbn 978-123-4567, 2024/05/17"), (2, None), (3, "a@b.com and 4111.1111.1111.1111")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df, pii_model).collect()}
    assert got[2] is None and "bob" not in got[1] and "555-123" not in got[1] and "978-123-4567" in got[1] and "2024/05/17" in got[1]
    assert got[3].startswith("[EMAIL] and ")
    assert pii.redact(odd, pii_model).columns == odd.columns and pii.redact(odd, pii_model).count() == odd.count()
    spans = {r.doc_id: r.spans for r in pii.pii_digests(df, pii_model).collect()}
    assert spans[1].count(":") >= 4 and spans[2] == ""


def test_pii_of_a_long_text_of_matches(spark, pii_model):
    """A megabyte of matches in one text: all found and replaced, in time that grows about as the text does."""
    import time

    n = 60_000
    text = " ".join(f"ab{i}@x{i % 7}.org" if i % 3 else "call (555) 123-4567" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.pii_digests(df, pii_model).first()
    b = brute_spans(text)
    assert got.n_email == len(b) == n - n // 3 and got.base_sha256 == sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b).encode())
    spans = [x.split(":") for x in got.spans.split(",")]
    want = text
    for k, s, e in reversed(spans):
        want = want[: int(s)] + f"[{k.upper()}]" + want[int(e) :]
    assert pii.redact(df, pii_model).first().text == want and len(text) > 900_000
    assert time.time() - began < 120


def test_pii_reads_and_places_across_pages_and_blocks(spark, pii_model):
    texts_ = ["日" * (pii.PAGE - 3) + " a@b.co " + "é" * pii.PAGE + " call 555-123-4567 now", "x@y.z " * (pii.BLOCK * 2 + 1), "x@y.z", " " * pii.PAGE + "x@y.z", "a" * (pii.PAGE * 2)]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.pii_digests(df, pii_model).collect()}
    for r in pii.redact(df, pii_model).collect():
        want = texts_[r.doc_id]
        for k, s, e in reversed([x.split(":") for x in spans[r.doc_id].split(",") if x]):
            want = want[: int(s)] + f"[{k.upper()}]" + want[int(e) :]
        assert r.text == want
    assert spans[1].count("email") == pii.BLOCK * 2 + 1 and "phone" in spans[0] and spans[4] == ""


def test_pii_plan_has_no_python(odd, pii_model):
    plan = pii.pii_digests(odd, pii_model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_empty(none, pii_model):
    assert pii.pii_digests(none, pii_model).count() == 0


# --- mixing


def brute_mix(rows):
    size = {}
    for k, (_, t, s) in enumerate(rows):
        size[k] = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k, r in enumerate(rows) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    budget, full = 1.5 * sum(total.values()), set()
    while True:
        left, w = budget - sum(2.0 * total[s] for s in full), sum(weight[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and left * weight[s] / w > 2.0 * total[s] + 1e-9}
        if not over:
            break
        full |= over
    return size, total, {s: 2.0 * total[s] if s in full else left * weight[s] / w for s in sources}


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    size, total, target = brute_mix(rows)
    got = mixing.mix_report(df).collect()
    want = multiset((i, size[k], total[s], round(target[s], 4)) for k, (i, _, s) in enumerate(rows))
    assert multiset((r.doc_id, r["size"], r.source_size, round(r.target, 4)) for r in got) == want
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert multiset(got) == multiset(mixing.mix_report(df.repartition(3)).collect())
    by = collections.Counter()
    for r in got:
        by[r.source_size, round(r.target, 4)] += r.taken
    for (_, t), n in by.items():
        assert abs(n - t) <= 0.5 * sum(round(x, 4) == t for x in target.values()) + 1e-3


def test_mixed_documents(odd):
    taken = mixing.mix_report(odd).agg(F.sum("taken")).first()[0]
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert out.select(F.sum(mixing.words(F.col("text")))).first()[0] == taken


def test_mixing_plan_has_no_python_and_empty(odd, none):
    plan = mixing.mix(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


# --- SimHash


def brute_fingerprint(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(prints, radius=2):
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fs = list(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_simhash(request, which):
    df = request.getfixturevalue(which)
    rows = [(i, brute_fingerprint(t)) for i, t in texts(df)]
    root = brute_components({f for _, f in rows})
    low = {}
    for i, f in rows:
        if i is not None:
            low[root[f]] = min(low.get(root[f], i), i)
    want = multiset((i, f"{f:016x}", low.get(root[f])) for i, f in rows)
    assert multiset(simhash.simhash_components(df).collect()) == want
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(low.values())


def test_simhash_index_splits_and_finds_every_link(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(6))])
    ball = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    f = np.unique(np.concatenate([near, ball, rng.integers(0, 1 << 63, 400, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "f long")
    edges = simhash.near_edges(df, most=40).collect()
    got = brute_components({int(x) for x in f}, -1)

    def find(x):
        while got[x] != x:
            x = got[x]
        return x

    for r in edges:
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        got[find(a)] = find(b)
    want = brute_components({int(x) for x in f})
    groups = lambda of, g: {frozenset(x for x in of if g(x) == k) for k in {g(x) for x in of}}
    every = [int(x) for x in f]
    assert groups(every, find) == groups(every, lambda x: want[x])


def test_near_duplicates_keep_one_row_of_each_component(spark):
    texts_ = [f"{w} alone speaks of {w}s and {w}ness in its own {w} words" for w in ("river", "granite", "violin", "harbour", "meadow", "lantern")]
    rows = [(None, t) for t in texts_[:3]] + [(None, texts_[0])] + [(7, t) for t in texts_[3:5]] + [(9, texts_[5]), (None, texts_[5]), (8, texts_[5])]
    prints = {brute_fingerprint(t) for _, t in rows}
    assert len(set(brute_components(prints).values())) == len(texts_)
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert multiset(got) == multiset([(None, t) for t in texts_[:3]] + [(7, t) for t in texts_[3:5]] + [(8, texts_[5])])


def test_simhash_empty(none):
    assert simhash.simhash_components(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


# --- classifiers


def fold(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("score, divisor, held, limit", [(toxicity.toxicity_scores, 5, 0, 0.5), (quality.quality_scores, 4, 2, 0.7)])
def test_classifiers_on_odd_rows(odd, none, labels, score, divisor, held, limit):
    got = score(odd, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in texts(odd))
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit) and r.held_out == (fold(r.doc_id, divisor) == held)
    assert score(none, labels).count() == 0
    bare = {r.score for r in score(odd, labels.where("false")).collect()}
    assert bare == {0.5}


@pytest.mark.parametrize("score, name, least", [(toxicity.toxicity_scores, "toxic", 0.9), (quality.quality_scores, "quality", 0.93)])
def test_held_out_accuracy(spark, score, name, least):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = score(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r[name] for r in got]) >= least


def test_scores_ignore_other_columns(documents, labels):
    a = {r.doc_id: r.score for r in toxicity.toxicity_scores(documents, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity_scores(documents.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")), labels).collect()}
    assert a == b


def test_toxicity_scores_are_sums_over_ngrams(odd, documents, spark):
    """Each score again from the fitted weights, n-gram by n-gram in plain Python."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = toxicity.train(documents, labels)

    def places(t):
        c, out, mask = [ord(x) for x in f" {t.lower()} "], set(), (1 << 64) - 1
        for n in toxicity.SIZES:
            for i in range(len(c) - n + 1):
                h = n
                for k in range(n):
                    h = ((h ^ c[i + k]) * 0x9E3779B97F4A7C15) & mask
                    h ^= h >> 29
                out.add(h >> (64 - toxicity.BITS))
        return out

    df = documents.select("doc_id", "text").limit(40).unionByName(odd.select("doc_id", "text").where("length(text) < 500 or text is null"))
    want = sorted((str(i), 1 / (1 + math.exp(-max(-40, min(40, model.bias + sum(float(model.weights[p]) for p in places(t))))))) for i, t in texts(df))
    got = sorted((str(r.doc_id), r.score) for r in df.select("doc_id", model.score(spark, F.col("text")).alias("score")).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-6)


def test_toxicity_learns_from_few_texts_by_parameter(spark):
    rows = [(i, ("you vile rotten scum" if i % 2 else "a calm and kindly note") + f" {i}") for i in range(1, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, few, least_texts=1)
    got = {r.doc_id: r.score for r in df.select("doc_id", model.score(spark, F.col("text")).alias("score")).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2)


def test_quality_scores_again_from_the_model(spark, odd, documents):
    model = quality.train(documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    w = np.random.default_rng(quality.SEED)
    directions, shifts = w.normal(0, quality.WIDTH, (len(quality.NAMES), quality.FEATURES)), w.uniform(0, 2 * np.pi, quality.FEATURES)
    df = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = []
    for i, t in texts(df):
        x = np.clip((quality.statistics(t) - model.mean) / model.scale, -8, 8)
        value = sum(math.cos(x @ directions[:, k] + shifts[k]) * math.sqrt(2 / quality.FEATURES) * model.weights[k] for k in range(quality.FEATURES)) + model.weights[-1]
        at = np.searchsorted(model.knots, value)
        if at in (0, len(model.knots)):
            p = model.levels[0] if at == 0 else model.levels[-1]
        else:
            part = (value - model.knots[at - 1]) / (model.knots[at] - model.knots[at - 1])
            p = model.levels[at - 1] + part * (model.levels[at] - model.levels[at - 1])
        want.append((str(i), float(p)))
    got = sorted((str(r.doc_id), r.score) for r in df.select("doc_id", model.score(spark, F.col("text")).alias("score")).collect())
    want.sort()
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-8)


def test_isotonic():
    got = quality.isotonic(np.array([1.0, 3.0, 2.0, 2.0, 5.0]), np.array([1.0, 1.0, 1.0, 1.0, 2.0]))
    assert np.allclose(got, [1, 7 / 3, 7 / 3, 7 / 3, 5])


def test_reject_toxic_keeps_columns(odd, labels):
    out = toxicity.reject_toxic(odd, labels)
    assert out.columns == odd.columns and out.count() <= odd.count()


# --- language model


def path_sums(model, obs):
    """Probability of the observations and the expected counts, over all state paths one by one."""
    start, move, emit = model
    k, total = len(start), 0.0
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape)
    for path in np.ndindex(*[k] * len(obs)):
        p = start[path[0]] * emit[obs[0], path[0]]
        for t in range(1, len(obs)):
            p *= move[path[t - 1], path[t]] * emit[obs[t], path[t]]
        total += p
        starts[path[0]] += p
        for t in range(1, len(obs)):
            moves[path[t - 1], path[t]] += p
        for t, o in enumerate(obs):
            emits[o, path[t]] += p
    return total, np.concatenate([starts, moves.ravel(), emits.ravel()]) / total


def test_recursions_equal_sums_over_paths():
    rng = np.random.default_rng(1)
    model = hmm._normalised(rng.random(2 + 4 + 2 * 4), 2)
    seqs = [np.array([0, 1, 2, 1]), np.array([], dtype=int), np.array([2]), np.array([1, 1, 0, 2, 2, 0, 1])]
    lens = np.array([len(s) for s in seqs])
    cls = np.concatenate(seqs).astype(np.int16)
    each = [path_sums(model, [*s, 3]) for s in seqs]
    assert np.allclose(hmm.log_likelihood(model, cls, lens), [math.log10(p) for p, _ in each], rtol=1e-12)
    want = sum(c for _, c in each)
    for held, piece, uncut in ((1 << 20, 1 << 10, 1 << 12), (3, 1 << 10, 1 << 12), (1 << 20, 2, 0), (4, 3, 4), (1, 1, 1)):
        assert np.allclose(hmm.expected_counts(model, cls, lens, held, piece, uncut), want, rtol=1e-5), (held, piece, uncut)


def test_a_text_of_a_million_words_is_counted_in_pieces():
    rng = np.random.default_rng(2)
    model = hmm._normalised(rng.random(6 + 36 + 6 * 1025), 6)
    cls, lens = rng.integers(0, 1024, 1_000_000).astype(np.int16), np.array([1_000_000])
    assert max(b - a for a, b in hmm.Packed(cls[:5000], np.array([2000, 3000])).segments(10)) <= 10
    got = hmm.expected_counts(model, cls, lens, held=1 << 16)
    assert np.allclose([got[:6].sum(), got[6:42].sum(), got[42:].sum()], [1, 1_000_000, 1_000_001], rtol=1e-4)
    assert np.isfinite(hmm.log_likelihood(model, cls, lens)).all()


def hmm_state(df):
    """What the operator learns from: class frequencies and kinds, word counts; by plain Python."""
    c = collections.Counter()
    for i, t in texts(df):
        if fold(i, 7) != 2:
            c.update([*t.encode().lower().split(), b"\n"])
    cls = lambda w: hmm.CLASSES if w == b"\n" else zlib.crc32(w[-hmm.ENDING :]) % hmm.CLASSES
    freq, kinds = np.zeros(hmm.CLASSES + 1), np.zeros(hmm.CLASSES + 1)
    for w, n in c.items():
        freq[cls(w)] += n
        kinds[cls(w)] += w != b"\n"
    return c, cls, freq, kinds


def plain_forward(model, obs):
    a, total = model[0], 0.0
    for t, o in enumerate(obs):
        a = (a if t == 0 else a @ model[1]) * model[2][o]
        total += math.log10(a.sum())
        a = a / a.sum()
    return total


def test_baum_welch_raises_likelihood(documents):
    chunks = hmm.tokenise(documents).cache()
    c, cls, freq, _ = hmm_state(documents)
    seqs = [[cls(w) for w in [*t.encode().lower().split(), b"\n"]] for i, t in texts(documents) if fold(i, 7) != 2]
    values = [sum(plain_forward(hmm.train(chunks, freq, rounds=k), s) for s in seqs[:60]) for k in (0, 1, 3)]
    assert values[0] < values[1] < values[2]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_language_model_score_end_to_end(request, which):
    """The score of every text again, from the model: forward recursion in plain Python, and the words within classes."""
    df = request.getfixturevalue(which)
    c, cls, freq, kinds = hmm_state(df)
    model = hmm.train(hmm.tokenise(df), freq)
    norm = np.log10(freq + kinds + 1)
    want = []
    for i, t in texts(df):
        w = t.encode().lower().split()
        within = sum(math.log10(c[x] + 1) - norm[cls(x)] for x in w)
        want.append((str(i), within + plain_forward(model, [*map(cls, w), hmm.CLASSES])))
    got = sorted((str(r.doc_id), r.score) for r in hmm.language_scores(df).collect())
    for (i, x), (j, y) in zip(got, sorted(want), strict=True):
        assert i == j and math.isclose(x, y, rel_tol=1e-6), (i, x, y)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_language_scores(request, which):
    df = request.getfixturevalue(which)
    rows = [(i, [*t.encode().lower().split(), b"\n"]) for i, t in texts(df)]
    c = collections.Counter()
    for i, w in rows:
        if fold(i, 7) != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = multiset((i, fold(i, 7) == 2, len(w), sum(c[x] > 0 for x in w), n, f"{sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w):.6f}") for i, w in rows)
    got = hmm.language_scores(df).collect()
    assert multiset((*r[:5], f"{r.base_score:.6f}") for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    if which == "documents":
        assert np.mean([r.score > r.base_score for r in got if r.n_tokens > 30]) > 0.9


def test_language_scores_empty_and_untrained(spark, none):
    assert hmm.language_scores(none).count() == 0
    alone = next(i for i in range(50) if fold(i, 7) == 2)
    r = hmm.language_scores(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_folds(spark):
    got = spark.createDataFrame([(i,) for i in (None, 0, 1, 17)], "doc_id long").select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("x")).collect()
    assert all(r.x == (fold(r.doc_id, 5) == 0) for r in got)


def test_an_id_that_many_rows_repeat_gives_one_training_text(spark):
    from tidemark.llm.common import labelled_sample, labelled_texts

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(1, None), (2, "b"), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = labelled_texts(docs, labelled_sample(labels, "toxic", 1, 1, 10), "text")
    assert sorted(map(tuple, got.collect())) == [("", 1), ("b", 0)]
