"""Hashes, chunks and embeddings against independent models and known values."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import chunking, embedding, hashing

QA = [
    (1, "RAII binds resource lifetime to object lifetime.", "memory"),
    (2, "Move semantics transfer ownership of resources without copying.", "memory"),
    (3, "A move constructor transfers resources from another object.", "cpp"),
    (4, "A virtual function enables runtime polymorphism.", "cpp"),
    (5, "A mutex provides mutual exclusion for concurrent access.", "concurrency"),
]
Q1, Q2 = "How does C++ transfer ownership?", "How does C++ transfer ownership without copying?"


def chunks(text, most=512):
    """A byte-level model of the chunker."""
    out = []
    for p in re.split(r"\n{2,}", text):
        p = re.sub(r"^[\s\x85\xa0]+|[\s\x85\xa0]+$", "", p)
        p = p.encode()
        if 0 < len(p) <= most:
            out.append(p.decode())
            continue
        while p:
            if len(p) <= most:
                cut = len(p)
            else:
                spaces = [i for i in range(1, most + 1) if p[i : i + 1] in (b" ", b"\t", b"\n", b"\f", b"\r")]
                cut = max(spaces, default=most)
                while not spaces and p[cut] & 0xC0 == 0x80:
                    cut -= 1
            out.append(p[:cut].decode())
            p = p[cut:].lstrip(b" \t\n\f\r")
    return out


def test_hashes(spark):
    r = spark.createDataFrame([("",), ("a",), (None,)], "t string").select(hashing.fnv1a(F.col("t")).alias("h")).collect()
    assert [x.h for x in r] == ["cbf29ce484222325", "af63dc4c8601ec8c", None]
    r = spark.createDataFrame([("What is RAII?",)], "t string").select(hashing.content_hash(F.col("t")).alias("h")).first()
    assert r.h == "fd99bd121be74026"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=60), max_size=60))
def test_many_hashes(rows):
    assert [int(x) for x in hashing.fnv1a_many(rows)] == [hashing.fnv1a_bytes(r) for r in rows]


def test_chunks(spark):
    texts = ["", " \n ", "one\n\ntwo\n \nthree\n\n\n\nfour", "word " * 300, "x" * 1300, "é" * 700, "ab " + "é" * 600 + " cd", "a\n\n" + "b c " * 200, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.chunk_text(F.col("t")).alias("c"))
    for r in df.collect():
        assert r.c == chunks(texts[r.i] or ""), texts[r.i]


def test_scores(spark):
    p = embedding.HashingProvider()
    a = p.embed([t for _, t, _ in QA])
    for q, want in ((Q1, [0.1111, 0.8286, 0.7866, 0.0, -0.1202]), (Q2, [0.1072, 0.8727, 0.7746, -0.0013, -0.1833])):
        assert (a @ p.embed([q])[0]).tolist() == pytest.approx(want, abs=6e-5)


def test_provider():
    p = embedding.HashingProvider("m", 64)
    x = p.embed(["some text", "", "some text"])
    assert x.shape == (3, 64) and (x[0] == x[2]).all() and (x[0] ** 2).sum() == pytest.approx(1) and (x[1] == 0).all()
    with pytest.raises(ValueError):
        embedding.HashingProvider("m", 0)


def test_cosine(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [-1.0, -1.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0, 9.0], [3.0, 4.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(embedding.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == pytest.approx([1, 0, -1, 0])


def test_sql_functions(spark):
    embedding.register_sql(spark)
    spark.createDataFrame(QA, "id bigint, answer string, topic string").createOrReplaceTempView("qa")
    ids = lambda sql: [r[0] for r in spark.sql(sql).collect()]
    assert ids(f"SELECT id FROM qa WHERE topic = 'memory' AND SIMILARITY(answer, '{Q1}') > 0.3") == [2]
    assert ids(f"SELECT id FROM qa WHERE topic = 'memory' AND SIMILARITY(answer, '{Q1}') > 0.3 LIMIT 5") == [2]
    assert ids(f"SELECT id FROM qa WHERE VECTOR_SEARCH(answer, '{Q2}', 0.3) ORDER BY id") == [2, 3]
    assert ids(f"SELECT id FROM qa WHERE SIMILARITY(answer, '{QA[0][1]}') > 0.99") == [1]


def test_workers_hold_bounded_texts(spark, monkeypatch):
    texts = ["x" * 300_000, "é" * 10, *["word " * 2_000] * 60, *["a"] * 1_200, ""]
    cut = list(embedding.slices(texts))
    assert [a for a, _ in cut] == [0, *[b for _, b in cut[:-1]]] and cut[-1][1] == len(texts) and list(embedding.slices([])) == []
    assert all(b - a <= embedding.SLICE_TEXTS and (b - a == 1 or sum(len(t.encode()) for t in texts[a:b]) <= embedding.SLICE_BYTES) for a, b in cut)

    df = spark.createDataFrame([(t,) for t in texts[1:200]], "t string")
    for use in (lambda: embedding.embed_column(df, "t"), lambda: hashing.fnv1a(F.col("t")), lambda: embedding.similarity_to(F.col("t"), "word")):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        use()
        assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= 4 << 20

    words = [f"w{i} raii" for i in range(50)]
    free = embedding.HashingProvider().embed(words)
    monkeypatch.setattr(embedding, "KNOWN_WORDS", 7)
    p = embedding.HashingProvider()
    assert (p.embed(words) == free).all() and len(p._known) <= 7
