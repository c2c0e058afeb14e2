"""Near duplicates against a comparison of all pairs of a whole table; hot buckets against the same."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from quern.llm import near_dedup as nd

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in t.split()]
    return {k: 1 + math.log(v) for k, v in Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))).items()} if w else {}


def likeness(x, y):
    if not x or not y:
        return float(not x and not y)
    both = x.keys() & y.keys()
    if {*x.values(), *y.values()} == {1.0}:
        return len(both) / (len(x) + len(y) - len(both))
    return sum(1 / sum(max(x.get(j, 0) / x[d], y.get(j, 0) / y[d]) for j in x.keys() | y.keys()) for d in both)


def classes(docs):
    s, up = [(i, shingles(t)) for i, t in docs], {i: i for i, _ in docs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, x) in enumerate(s):
        for j, y in s[:n]:
            if (not x and not y) or (len(x.keys() & y.keys()) >= 0.3 * max(len(x), len(y)) and likeness(x, y) >= 0.8):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in up}


def test_all_pairs(spark):
    docs = duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: r.class_id for r in nd.op5_near_dedup(spark, SF).collect()}
    assert got == classes(docs)
    assert len(set(got.values())) < len(docs)


def pairs_alike(docs, least=0.7):
    """All pairs of different shingle sets with their likeness, where that is ``least`` or more.

    A pair that alike shares one of the rarest of its shingles; which those are follows
    from the overlap that the likeness needs, with room for weights.
    """
    sets, first = {}, {}
    for i, t in docs:
        x = shingles(t)
        if x and first.setdefault(frozenset(x.items()), i) == i:
            sets[i] = x
    df = Counter(g for x in sets.values() for g in x)
    at, out = {}, {}
    for i, x in sets.items():
        rare = sorted(x, key=lambda g: (df[g], g))[: int((1 - least * 0.6) * len(x)) + 1]
        for j in {j for g in rare for j in at.get(g, ())}:
            y = sets[j]
            if min(len(x), len(y)) >= 0.5 * max(len(x), len(y)):
                s = likeness(x, y) if len(x.keys() & y.keys()) >= 0.4 * max(len(x), len(y)) else 0
                if s >= least:
                    out[j, i] = s
        for g in rare:
            if df[g] > 1:
                at.setdefault(g, []).append(i)
    return out


def recall_by_band(spark, sf):
    """Pairs of each band of likeness, and those of them in one class."""
    docs = duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet' order by 1").fetchall()
    got = {r.doc_id: r.class_id for r in nd.op5_near_dedup(spark, sf).collect()}
    out = {}
    for (i, j), s in pairs_alike(docs).items():
        band = out.setdefault(math.floor(s * 20 + 1e-9) / 20, [0, 0])
        band[0] += 1
        band[1] += got[i] == got[j]
    return dict(sorted(out.items()))


def test_recall_by_band(spark):
    bands = recall_by_band(spark, "/root/testdata/sf0.01")
    assert sum(n for b, (n, _) in bands.items() if b >= 0.8) >= 5
    assert all(hit >= 0.99 * n for b, (n, hit) in bands.items() if b >= 0.8)


def test_a_hot_bucket(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    docs = [(0, "one two three")]
    for i in range(1, 161):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(150)] += f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(base).upper()) for i in range(50)]
    got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == classes(docs)
    assert len(set(got.values())) > 3
    docs = docs[:161]  # without the text in the middle
    got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == classes(docs)


def test_estimate_and_likeness():
    rng = random.Random(1)
    for _ in range(5):
        x = {k: 1 + math.log(rng.choice([1, 1, 2, 9])) for k in range(200)}
        y = {k: 1 + math.log(rng.choice([1, 1, 2, 9])) for k in range(20, 230)}
        a, b = (np.array(sorted(nd.words.mix(np.array(sorted(d), np.uint64)).tolist()), np.uint64) for d in (x, y))
        name = {int(nd.words.mix(np.array([k], np.uint64))[0]): k for k in range(230)}
        wx, wy = np.array([x[name[int(g)]] for g in a]), np.array([y[name[int(g)]] for g in b])
        true = likeness(x, y)
        assert nd.likeness(a, wx, b, wy) == pytest.approx(true)
        of = np.repeat([0, 1], [len(a), len(b)])
        sig = nd.signatures(of, np.concatenate([a, b]), np.concatenate([wx, wy]), 2, 2000)
        assert (sig[0] == sig[1]).mean() == pytest.approx(true, abs=0.05)


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, rep string, key int"
    rows = [(1, None, "a", 1), (2, "", None, None), (3, " \n", "b", 2), (4, "One", "c", 3), (5, "one ", "c", 3), (6, "two words", "d", 4), (6, "two words", "d", 4), (None, "one", "e", 5), (7, "y " * 20_000, "f", 6), (8, "y " * 20_001, "g", 7)]
    got = sorted((r.doc_id or 0, r.class_id) for r in nd.near_classes(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, None), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (6, 6), (7, 7), (8, 7)]
    assert nd.near_classes(spark.createDataFrame([], schema)).collect() == []
