"""Counts and unigram scores against plain Python over a whole table; the model against the unigram on held-out texts."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quern.llm import language_model as lm
from quern.llm import words

SF = "/root/testdata/sf0.001"


def toks(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None]


def test_scores(spark, monkeypatch):
    docs = duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall()
    c = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1 for w in toks(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm.op8_language_model(spark, SF).collect()}
    assert set(got) == {i for i, _ in docs}
    for i, t in docs:
        r, w = got[i], toks(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_are_joined_when_few_are_broadcast(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    counts = lm.count_words(docs)
    a, b = (sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm.score_documents(docs, m, counts).collect()) for m in (lm.fit(docs, counts, rounds=1), lm.fit(docs, counts, rounds=1, hot=50)))
    assert a == b


def any_model(seed=1):
    """A model of random shares and weights."""
    rng = np.random.default_rng(seed)
    m = lm.Model(10, 3, *[np.zeros(0)] * 4, np.zeros((lm.NODES, lm.WIDTH), "f4"))
    m.prior = rng.normal(size=m.prior.shape).astype("f4")
    m.prior -= np.log(np.exp(m.prior).sum(axis=1, keepdims=True))
    m.start()
    m.weights = rng.normal(size=m.weights.shape).astype("f4")
    return m


def test_chances_sum_to_one():
    m = any_model()
    codes = np.concatenate([f + (np.arange(n) << low) for f, n, low in zip(lm.FIRST, (*lm.OWN, lm.SHARED), (12, 8, 4, 0))])
    ctx = np.random.default_rng(2).integers(0, 2**63, (lm.CONTEXTS, 1)).astype(np.uint64).repeat(len(codes), 1)
    token, node, branch, rows = m.steps(codes, ctx)
    log = np.bincount(token, np.log(m.chances(node, rows)[np.arange(len(node)), branch].astype(float)))
    assert np.exp(log).sum() == pytest.approx(1, abs=1e-4)


def mix(x):
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ x >> shift) * times % 2**64
    return x ^ x >> 33


def brute_gain(m, text):
    """The gain of a text over its counts' score, a token and a node at a time."""
    import pyarrow as pa

    (_, _, data, offs), = words.slices(pa.array([text]))
    h = [int(x) for x in words.hashes(data, *words.words(data, offs)[:2])] + [int(lm.END)]
    place = dict(zip(m.own.tolist(), m.own_code.tolist()))
    codes = [place.get(x, 0xF0000 | x >> 48) for x in h]
    total = 0.0
    for i, code in enumerate(codes):
        one, two = (h[i - k] if i >= k else 0 for k in (1, 2))
        near, far = ((codes[i - k] >> 12) + 1 if i >= k else 0 for k in (1, 2))
        ctx = [mix(x % 2**64) for x in (one + 1, two * 5 + 2, near * 512 + far + 3)]
        digits = [code >> s & 15 for s in (16, 12, 8, 4, 0)]
        node = 0
        for k in range(2 if digits[0] < 8 else 3 if digits[0] < 12 else 4 if digits[0] < 15 else 5):
            number = sum(16**j for j in range(k)) + node
            key = number * 0x9E3779B97F4A7C15 % 2**64
            rows = [((c ^ key) * 0xC4CEB9FE1A85EC53 % 2**64) * len(m.weights) >> 64 for c in ctx]
            z = [float(m.prior[number][b]) + sum(float(m.weights[r][b]) for r in rows) for b in range(16)]
            total += z[digits[k]] - math.log(sum(math.exp(x) for x in z)) - float(m.prior[number][digits[k]])
            node = node * 16 + digits[k]
    return total / math.log(10)


def test_score_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 400")
    counts = lm.count_words(docs)
    model = lm.fit(docs, counts, batch=256)
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: "", -2: "never seen words here", -3: "The the THE"}
    asked = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = lm.score_documents(asked, model, counts).collect()
    assert len(got) == len(texts) and np.abs(model.weights).max() > 0.1
    for r in got:
        assert r.score - r.base_score == pytest.approx(brute_gain(model, texts[r.doc_id]), rel=1e-3, abs=1e-3)


def test_context_tells_words_of_a_class_apart(spark):
    lines = ["red xaqqq", "blue yaqqq"] * 100
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").coalesce(2)
    counts = lm.count_words(docs)
    texts = ["red xaqqq", "red yaqqq", "blue yaqqq", "blue xaqqq"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {texts[r.doc_id]: r.score for r in lm.score_documents(asked, lm.fit(docs, counts, batch=64), counts).collect()}
    assert got["red xaqqq"] > got["red yaqqq"] + 0.1 and got["blue yaqqq"] > got["blue xaqqq"] + 0.1


def test_merge_in_steps_is_the_merge_at_once():
    rng = np.random.default_rng(3)
    start = any_model()
    tables = []
    for task in range(6):
        m = any_model()
        rows = rng.choice(len(m.weights), 50, replace=False)
        m.weights[rows] += rng.normal(size=(50, lm.WIDTH)).astype("f4")
        m.seen[rows] += rng.random(50).astype("f4") + 0.1
        tables.append(lm.pa.Table.from_batches(list(lm._moved(m, start.weights, start.seen, task))))

    def merged(tables):
        t = lm.pa.concat_tables(tables)
        blocks = t.column("block").to_numpy()
        return lm.pa.concat_tables([lm._put_together(t.filter(lm.pa.array(blocks == b))) for b in np.unique(blocks)])

    out = []
    for t in (merged(tables), merged([merged(tables[:3]), merged(tables[3:])])):
        m = any_model()
        for r in t.to_pylist():
            lm._take_in(m, *lm._read(r))
        out.append(m)
    assert np.allclose(out[0].weights, out[1].weights, atol=0.02) and np.allclose(out[0].seen, out[1].seen, rtol=1e-3)
    assert np.abs(out[0].weights - start.weights).max() > 0.5


def added(to, at, what, times):
    lm._add_rows(to, at, what, times, np.empty(len(to), "i4"), lm._room())


def test_rows_add_up_where_they_repeat(monkeypatch):
    rng = np.random.default_rng(4)
    what, times = rng.normal(size=(5000, lm.WIDTH)).astype("f4"), rng.random(5000).astype("f4")
    for block in (8192, 700, 1):
        monkeypatch.setattr(lm, "BLOCK", block)
        for at in (rng.integers(0, 4000, 5000), rng.zipf(1.5, 5000) % 4000, np.zeros(5000, np.int64), rng.integers(0, 4000, 0)):
            got, want = np.ones((4000, lm.WIDTH), "f4"), np.ones((4000, lm.WIDTH))
            added(got, at, what[: len(at)], times[: len(at)])
            np.add.at(want, at, what[: len(at)].astype(float) * times[: len(at), None])
            assert np.allclose(got, want, atol=1e-3)


def test_words_with_equal_first_bits_have_their_codes():
    rng = np.random.default_rng(6)
    m = any_model()
    few = rng.integers(0, 4, 60).astype(np.uint64) << np.uint64(48) | rng.integers(0, 50, 60).astype(np.uint64)
    m.own, m.own_code = np.unique(np.append(few, lm.END)), rng.permutation(61)[: len(np.unique(np.append(few, lm.END)))]
    place = dict(zip(m.own.tolist(), m.own_code.tolist()))
    asked = np.concatenate([m.own, m.own + np.uint64(1), rng.integers(0, 2**63, 100).astype(np.uint64)])
    assert m.codes(asked).tolist() == [place.get(x, 0xF0000 | x >> 48) for x in asked.tolist()]


def test_word_places_and_hashes():
    import pyarrow as pa

    texts = ["Ab ab\tcd", "", "x", "ab", None, " cd  é "]
    (_, _, data, offs), = words.slices(pa.array(texts))
    starts, ends, doc = words.words(data, offs)
    got = [(int(d), bytes(data[s:e]).decode()) for s, e, d in zip(starts, ends, doc)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    h = words.hashes(data, starts, ends)
    low = [w.lower() for _, w in got]
    assert len(set(h.tolist())) == len(set(low)) and all((h[i] == h[j]) == (low[i] == low[j]) for i in range(len(h)) for j in range(len(h)))
    many = [(a, b) for a, b, _, _ in words.slices(pa.array(["aaaa"] * 10), 9)]
    assert many == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]


def test_odd_tables(spark):
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "Ab ab  c"), (2, "x " * 30_000)], "doc_id bigint, text string")
    counts = lm.count_words(odd)
    model = lm.fit(odd, counts)
    assert sorted(r.n_tokens for r in lm.score_documents(odd, model, counts).collect()) == [1, 1, 4, 30_001]
    none = odd.limit(0)
    counts = lm.count_words(none)
    model = lm.fit(none, counts)
    assert lm.score_documents(none, model, counts).collect() == []
    assert [r.base_score for r in lm.score_documents(odd, model, counts).collect()] == [0.0] * 4
