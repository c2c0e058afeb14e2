"""The line classifier: held-out accuracy, forward-backward against all labellings, and odd tables."""

import itertools

import numpy as np
import pytest

from quern.llm import quality


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality.op4_quality(spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(r.score, r.predicted, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert np.mean([p == y for _, p, y in held]) > 0.95
    good, bad = ([s for s, _, y in held if y == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_marginals():
    rng = np.random.default_rng(0)
    doc = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    score, move = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    log, pairs = quality._Chains(doc).marginals(score, move)
    total = np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        paths = list(itertools.product((0, 1), repeat=len(at)))
        w = np.exp([sum(score[i, y] for i, y in zip(at, p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths])
        w /= w.sum()
        for k, i in enumerate(at):
            assert np.exp(log[i, 1]) == pytest.approx(sum(x for x, p in zip(w, paths) if p[k]))
        for x, p in zip(w, paths):
            for a, b in zip(p, p[1:]):
                total[a, b] += x
    assert pairs == pytest.approx(total)


def plain_features(line):
    """A line's own features, from its definition."""
    raw = line.encode()
    white, marks, odd = b"\t\n\v\f\r ", b".,;:'\"-()?", b"#$%&*@+=<>~^_/\\[]{}`"
    count = lambda some: sum(c in some for c in raw)
    upper, digits = sum(65 <= c <= 90 for c in raw), sum(48 <= c <= 57 for c in raw)
    lower = len(raw) - upper - digits - count(white) - count(marks) - count(odd) - count(b"|!")
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in raw.split()]
    n, letters = len(words) + 1, upper + lower
    again = sum(a == b for a, b in zip(words, words[1:]))
    own = [1, upper / (letters + 1), count(odd) / n, count(b"|") / n, count(b"!") / n, 10 * digits / (len(raw) + 1), count(marks) / n, np.log1p(len(words)) / 4, again / n, letters / n / 10, float(not raw)]
    return [min(x, 3.0) for x in own], len(raw)


def plain_score(model, text):
    """A text's score by forward and backward sums over its lines, one at a time."""
    own, sizes = zip(*[plain_features(x) for x in text.split("\n")])
    n, none = len(own), [0.0] * 10
    x = [[*own[t], *(own[t - 1][1:] if t else none), *(own[t + 1][1:] if t + 1 < n else none), float(t == 0), float(t == n - 1)] for t in range(n)]
    s = [[0.0, float(np.dot(row, model.weights))] for row in x]
    fwd, bwd = [s[0]], [[0.0, 0.0]]
    for t in range(1, n):
        fwd.append([s[t][j] + np.logaddexp(fwd[-1][0] + model.move[0, j], fwd[-1][1] + model.move[1, j]) for j in (0, 1)])
        u = n - t
        bwd.insert(0, [np.logaddexp(model.move[i, 0] + s[u][0] + bwd[0][0], model.move[i, 1] + s[u][1] + bwd[0][1]) for i in (0, 1)])
    good = [1 / (1 + np.exp(f[0] + b[0] - f[1] - b[1])) for f, b in zip(fwd, bwd)]
    mean = min(max(float(np.average(good, weights=[z + 1 for z in sizes])), 1e-4), 1 - 1e-4)
    return 1 / (1 + np.exp(-(model.slope * np.log(mean / (1 - mean)) + model.shift)))


def test_scores_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where(~quality.held_out()))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in quality.op4_quality(spark, sf).collect()}
    assert set(got) == set(text)
    for i, r in got.items():
        want = plain_score(model, text[i])
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.3)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "\n\n", None), (3, "x\n" * 20_000, 1.0), (3, "x\n" * 20_000, 1.0), (4, "a | b\n\nUPPER!! CASE!!", 1.0)], "doc_id bigint, text string, score double")
    for rows in ([], [(4, 0, "z"), (3, 1, "z"), (None, 1, None), (2, None, None)], [(3, 1, "z")]):
        model = quality.fit(docs, spark.createDataFrame(rows, "doc_id bigint, quality int, text string"))
        got = quality.score_documents(docs, model)
        assert got.columns == ["doc_id", "text", "score"] and all(0 <= r.score <= 1 for r in got.collect()) and got.count() == 6
        assert quality.score_documents(docs.limit(0), model).collect() == []
    lines = quality.label_lines(docs.where("doc_id = 4"), model).collect()
    assert [(r.line, r.n_bytes) for r in sorted(lines, key=lambda r: r.line)] == [(0, 5), (1, 0), (2, 14)]


def test_the_sample_is_bounded_in_lines(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "GOOD line, indeed.\n" * 4 if i % 2 else "bad | | |\n" * 4) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    whole = quality.fit(docs, labels)
    monkeypatch.setattr(quality, "TRAIN_LINES", 60)
    some = quality.fit(docs, labels)
    assert not np.allclose(whole.weights, some.weights) and np.isfinite(some.weights).all()
    monkeypatch.setattr(quality, "TRAIN_LINES", 1)
    assert (quality.fit(docs, labels).weights == 0).all()
