"""The incremental engine: counts of work, versions, migration, and state against a fresh ingest."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.embedding import HashingProvider, cosine
from quern.operators import lifecycle, relational, vectors
from quern.operators.incremental import Engine
from quern.plans.routing import ResultCache, hybrid_search, search_many
from quern.sources.tables import LOG, Step, Tables, read_csv, read_texts
from quern.streaming.ingest import apply_batch, start
from tests.test_functions import QA, Q1, Q2


def docs(spark, rows):
    return spark.createDataFrame(list(rows), "document_id bigint, content string")


def text(i, revised=False):
    return "\n\n".join(f"Section {k} of document {i}." + (" REVISED" if revised and k == 2 else "") for k in range(1, 6))


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/engine")


def state(engine):
    v = {(r.document_id, r.chunk_id): r.source_version for r in engine.vectors.collect()}
    return v, {r.document_id: (r.version, r.state) for r in engine.sources.collect()}


class Counting(HashingProvider):
    def __init__(self, counter):
        super().__init__()
        self.counter = counter

    def embed(self, texts):
        self.counter.add(len(texts))
        return super().embed(texts)


def test_work_is_what_changed(spark, tmp_path):
    counter = spark.sparkContext.accumulator(0)
    e = Engine(spark, f"file://{tmp_path}/e", Counting(counter))
    e.ingest(docs(spark, [(i, text(i)) for i in range(1000)]))
    assert counter.value == 5000
    r = e.update(docs(spark, [(i, text(i, i < 100)) for i in range(1000)])).first()
    assert counter.value == 5100
    assert (r.generated, r.skipped, r.removed, r.work_avoided) == (100, 4900, 0, 98.0)
    assert e.vectors.count() == 5000
    assert e.search("Section 2 of document 7. REVISED", 1).first()[:2] == (7, 1)
    d = e.delete(docs(spark, [(100, "")])).first()
    assert (d.chunks, d.vectors, e.vectors.count()) == (5, 5, 4995)
    assert e.search(text(100).split("\n\n")[0], 5).where("document_id = 100").count() == 0


def test_versions(spark, engine):
    engine.ingest(docs(spark, [(1, text(1))]))
    assert state(engine) == ({(1, k): 1 for k in range(5)}, {1: (1, "Active")})
    r = engine.update(docs(spark, [(1, text(1))])).first()
    assert (r.generated, r.skipped, r.work_avoided) == (0, 5, 100.0)
    r = engine.update(docs(spark, [(1, text(1, True))])).first()
    assert (r.generated, r.skipped, r.work_avoided) == (1, 4, 80.0)
    assert state(engine) == ({(1, 0): 1, (1, 1): 2, (1, 2): 1, (1, 3): 1, (1, 4): 1}, {1: (2, "Stale")})
    assert lifecycle.derived_state(engine.sources, engine.vectors, engine.chunks).first().derived_state == "Active"
    r = engine.update(docs(spark, [(1, "\n\n".join(text(1, True).split("\n\n")[:2]))])).first()
    assert (r.generated, r.removed) == (0, 3) and engine.vectors.count() == 2
    for f in (engine.update, engine.delete):
        with pytest.raises(lifecycle.Untracked):
            f(docs(spark, [(9, "x")]))
    with pytest.raises(ValueError):
        engine.ingest(docs(spark, [(3, "x"), (3, "y")]))
    engine.delete(docs(spark, [(1, "")]))
    engine.ingest(docs(spark, [(1, text(1))]))
    assert state(engine)[1] == {1: (1, "Active")}


def test_migration(spark, engine):
    engine.ingest(docs(spark, [(i, text(i)) for i in range(20)]))
    engine.update(docs(spark, [(1, text(1, True))]))
    v2 = HashingProvider("model-v2")
    assert engine.migrate(v2).first()[:] == (100, 0)
    assert engine.migrate(v2).first()[:] == (0, 100)
    assert state(engine)[0][(1, 1)] == 2
    with pytest.raises(ValueError):
        Engine(spark, engine.tables.root)
    assert Engine(spark, engine.tables.root, v2).vectors.where("model_id = 'model-v2'").count() == 100


def test_any_sequence_ends_as_a_fresh_ingest(spark, engine, tmp_path):
    rng, now = random.Random(5), {}
    for _ in range(5):
        kind = rng.choice(["ingest", "update", "delete"])
        ids = rng.sample(range(8), 3)
        ids = [i for i in ids if kind == "ingest" or i in now]
        if not ids:
            continue
        if kind == "delete":
            engine.delete(docs(spark, [(i, "") for i in ids]))
            now = {i: t for i, t in now.items() if i not in ids}
        else:
            new = {i: "\n\n".join(f"part {rng.randrange(4)}" for _ in range(rng.randrange(4))) for i in ids}
            getattr(engine, kind)(docs(spark, new.items()))
            now |= new
    fresh = Engine(spark, f"file://{tmp_path}/fresh")
    fresh.ingest(docs(spark, now.items()))
    for name in ("sources", "chunks", "vectors"):
        a, b = (sorted(tuple(str(x) for x in r) for r in getattr(e, name).drop("version", "source_version", "state").collect()) for e in (engine, fresh))
        assert a == b, name


class Broken(Exception):
    pass


def tables_of(engine):
    return {n: sorted(map(str, engine.tables.open(n).collect())) for n in ("sources", "chunks", "vectors", "model")}


def test_a_step_that_breaks_off_leaves_no_trace(spark, engine, tmp_path, monkeypatch):
    engine.ingest(docs(spark, [(i, text(i)) for i in range(6)]))
    before, part, commit = tables_of(engine), Step._part, Tables._commit
    new = docs(spark, [(0, text(0, True)), (1, "short"), (7, text(7))])
    steps = {"update": lambda: engine.update(new.where("document_id < 7")), "ingest": lambda: engine.ingest(new), "delete": lambda: engine.delete(docs(spark, [(2, "")])), "migrate": lambda: engine.migrate(HashingProvider("model-v2"))}
    for name, run in steps.items():
        for at in range(20):
            calls = []

            def write(self, *a, calls=calls, at=at):
                calls.append(a)
                if len(calls) > at:
                    raise Broken
                return part(self, *a)

            def half(self, number, state):
                fs, p = self._fs(self._log_path(number))
                out = fs.create(p, False)
                out.write(bytearray(b'{"sources": {'))
                out.close()
                raise Broken

            monkeypatch.setattr(Step, "_part", write)
            monkeypatch.setattr(Tables, "_commit", half)
            with pytest.raises(Broken):
                run()
            assert tables_of(engine) == before, (name, at)
            if len(calls) <= at:  # it broke off in the log itself
                break
        assert at >= 2
    monkeypatch.setattr(Step, "_part", part)
    monkeypatch.setattr(Tables, "_commit", commit)
    engine.ingest(new)
    assert state(engine)[1] == {0: (2, "Stale"), 1: (2, "Stale"), 7: (1, "Active")} | {i: (1, "Active") for i in range(2, 6)}
    again = Engine(spark, engine.tables.root)
    assert tables_of(again) == tables_of(engine)


def test_two_steps_at_once(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    df = spark.createDataFrame([(1, "a")], "id bigint, name string")
    t.replace("x", df)
    with pytest.raises(Exception, match="exists"), t.step() as late:
        t.append("x", df)
        late.append("x", df)
    assert t.open("x").count() == 2


def test_writes_follow_the_changes(spark, engine):
    engine.ingest(docs(spark, [(i, text(i)) for i in range(400)]))
    for percent in (1, 5, 10):
        old = {p["path"] for m in engine.tables.state()[1].values() for p in m["parts"]}
        n = 4 * percent
        r = engine.update(docs(spark, [(i, text(i) + f" {percent}" * (i < n)) for i in range(400)])).first()
        new = {name: sum(p["rows"] for p in m["parts"] if p["path"] not in old) for name, m in engine.tables.state()[1].items()}
        assert (r.generated, r.skipped) == (n, 2000 - n)
        assert new == {"sources": n, "chunks": 5 * n, "vectors": n, "model": 0}
        assert (engine.sources.count(), engine.chunks.count(), engine.vectors.count()) == (400, 2000, 2000)


def test_upserts_are_put_together_and_old_data_goes(spark, tmp_path, monkeypatch):
    from quern.sources import tables

    monkeypatch.setattr(tables, "MOST_PARTS", 5)
    t = Tables(spark, f"file://{tmp_path}/t")
    t.replace("x", spark.createDataFrame([(i, 0) for i in range(50)], "id bigint, n bigint"))
    for n in range(1, 6):
        rows = spark.createDataFrame([(i, n) for i in range(n)], "id bigint, n bigint")
        t.upsert("x", rows, rows.select("id"), ["id"])
        want = {i: max([k for k in range(1, n + 1) if i < k], default=0) for i in range(50)}
        assert {r.id: r.n for r in t.open("x").collect()} == want and t.info("x")["rows"] == 50
        assert len(t.state()[1]["x"]["parts"]) <= 5
    with pytest.raises(ValueError):
        t.upsert("x", rows, rows.select("n"), ["n"])
    assert t.vacuum(keep=1) > 0 and {r.id: r.n for r in t.open("x").collect()} == want and t.version("x") == 6


def test_vectors(spark):
    schema = "document_id bigint, chunk_id int, source_version bigint, model_id string, vector array<double>"
    v = spark.createDataFrame([(1, 0, 1, "m", [1.0, 0.0]), (1, 1, 1, "m", [0.0, 1.0]), (1, 2, 1, "m", [0.8, 0.6])], schema)
    assert [r.chunk_id for r in vectors.top_k(v, [1.0, 0.0], 2).collect()] == [0, 2]
    assert vectors.top_k(v, [1.0, 0.0], 0).count() == 0 and vectors.top_k(v, [1.0, 0.0, 0.0], 3).count() == 0
    for block in (1, 2, 2000):
        got = vectors.pairs_above(v, 0.5, block=block).collect()
        assert sorted((r.chunk_id_a, r.chunk_id_b, round(r.similarity, 6)) for r in got) == [(0, 2, 0.8), (1, 2, 0.6)]
    assert vectors.semantic_duplicates(v.limit(0), 0.5).count() == 0
    odd = spark.createDataFrame([(2, 0, 1, "n", [0.6, 0.8, 5.0]), (2, 1, 1, "n", None), (2, 2, 1, "n", [0.0, 0.0])], schema)
    every = v.unionByName(odd)
    for block in (1, 2000):
        got = {((r.document_id_a, r.chunk_id_a), (r.document_id_b, r.chunk_id_b)): round(r.similarity, 6) for r in vectors.pairs_above(every, 0.5, block=block).collect()}
        assert got == {((1, 0), (1, 2)): 0.8, ((1, 1), (1, 2)): 0.6, ((1, 0), (2, 0)): 0.6, ((1, 1), (2, 0)): 0.8, ((1, 2), (2, 0)): 0.96}
    both = odd.crossJoin(v.where("chunk_id = 1").select(F.col("vector").alias("other"))).select("chunk_id", cosine(F.col("vector"), F.col("other")).alias("c"))
    assert {r.chunk_id: r.c and round(r.c, 6) for r in both.collect()} == {0: 0.8, 1: None, 2: 0.0}


def test_pairs_shuffle_each_vector_once(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(90, 6))
    rows = [(f"d{i % 9}", i // 9, x[i].tolist()) for i in range(90)]
    v = spark.createDataFrame([*rows, ("d0", 0, [1.0] * 6), (None, 1, [1.0] * 6)], "document_id string, chunk_id int, vector array<double>")  # a key given twice, and none
    unit = np.array([z for *_, z in rows] + [[1.0] * 6])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    keys = [(d, c) for d, c, _ in rows] + [("d0", 0)]
    want = sorted((*keys[i], *keys[j], round(float(unit[i] @ unit[j]), 6)) for i in range(91) for j in range(91) if keys[i] < keys[j] and unit[i] @ unit[j] >= 0.4)
    for block in (4, 30, 2000):
        pairs = vectors.pairs_above(v.repartition(3), 0.4, block=block)
        got = pairs.select("document_id_a", "chunk_id_a", "document_id_b", "chunk_id_b", F.round("similarity", 6)).collect()
        assert sorted(tuple(r) for r in got) == want
        # copies of a vector for each block it meets are read, and not shuffled
        assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_semantic_duplicates_move_only_pairs(spark):
    r = np.random.default_rng(6)
    v = spark.createDataFrame([(i, i % 2, r.normal(size=5).tolist()) for i in range(40)], "document_id bigint, chunk_id int, vector array<double>")
    found = vectors.semantic_duplicates(v, 0.5)
    got = [(-x.similarity, x.document_id_a, x.chunk_id_a, x.document_id_b, x.chunk_id_b) for x in found.collect()]
    assert got == sorted(got) and {x[1:] for x in got} == {tuple(x)[:4] for x in vectors.pairs_above(v, 0.5).select("document_id_a", "chunk_id_a", "document_id_b", "chunk_id_b").collect()}
    plan = vectors.semantic_duplicates(v, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 == plan.count("Exchange ")


def test_vacuum_keeps_whole_states(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    for n in (1, 2, 3):
        t.replace("x", spark.range(n))
    last = t.state()[0]
    for n in (last + 1, last + 2):  # two writers in a row broke off within the log
        (tmp_path / "t" / LOG / f"{n:020d}.json").write_text('{"x": {"vers')
    assert t.vacuum(keep=1) == 2 and t.open("x").count() == 3
    t.replace("x", spark.range(4))
    assert t.open("x").count() == 4 and t.state()[0] == last + 3
    assert t.vacuum(keep=2) == 0 and t.vacuum(keep=1) == 1 and t.open("x").count() == 4


def test_dedup_report(spark):
    d = docs(spark, [(i, f"text {i % 9000}") for i in range(10_000)])
    assert lifecycle.duplicate_report(d).first()[:] == (10_000, 9_000, 1_000, 0.1)
    assert lifecycle.duplicate_report(d.limit(0)).first()[:] == (0, 0, 0, 0.0)


def test_tables(spark, tmp_path):
    t = Tables(spark, f"file://{tmp_path}/t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, name string")
    with pytest.raises(FileNotFoundError):
        t.open("x")
    t.create("x", df.schema)
    assert t.open("x").count() == 0 and t.version("x") == 0
    t.append("x", df)
    t.append("x", df)
    assert t.open("x").count() == 6 and t.version("x") == 2
    with pytest.raises(ValueError):
        t.append("x", df.select("name", "id"))
    t.replace("x", t.open("x").where("id > 1"), sort_by=["id"])
    assert t.info("x")["rows"] == 4 and t.names() == ["x"]


def test_csv_and_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,d,s,blank\n1,1.5,x,\n2,2,,\n,3,z,\n")
    a = read_csv(spark, f"file://{tmp_path}/a.csv")
    assert a.dtypes == [("i", "bigint"), ("d", "double"), ("s", "string"), ("blank", "bigint")]
    assert [tuple(r) for r in a.collect()] == [(1, 1.5, "x", None), (2, 2.0, None, None), (None, 3.0, "z", None)]
    assert [tuple(r) for r in read_csv(spark, f"file://{tmp_path}/a.csv", sample=None, blank_as_zero=True).collect()][1:] == [(2, 2.0, "", 0), (0, 3.0, "z", 0)]
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    assert read_texts(spark, f"file://{tmp_path}/b.txt").first().content == "one\n\ntwo"


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0), ("b", 4.0), ("a", 5.0)], "cat string, val double")
    assert {tuple(r) for r in relational.aggregate(df, [("SUM", "val", None)], ["cat"]).collect()} == {("a", 9.0), ("b", 6.0)}
    assert relational.aggregate(df, [("SUM", "val", None)], ["cat"]).columns == ["cat", "SUM(val)"]
    assert relational.aggregate(df.limit(0), [("COUNT", "*", "n"), ("MIN", "val", "m")]).first()[:] == (0, None)
    with pytest.raises(ValueError):
        relational.aggregate(df, [("SUM", "*", None)])
    assert df.where("val = 3").count() == 1 and df.where("2 < val").count() == 3


def test_hybrid_and_cache(spark):
    qa = spark.createDataFrame(QA, "id bigint, answer string, topic string")
    assert [r.id for r in hybrid_search(qa, "answer", Q1, 0.3, "topic = 'memory'", limit=3).collect()] == [2]
    assert [r.id for r in hybrid_search(qa, "answer", Q2, 0.3, candidates=2).collect()] == [2, 3]
    cache = ResultCache(1)
    a = qa.where("id > 2")
    cache.put(a, 1)
    assert cache.get(qa.where("id > 2"), 1) is not None and cache.get(a, 2) is None
    cache.put(qa.where("id > 3"), 1)
    assert cache.get(a, 1) is None
    cache.clear()


def test_search_of_many(spark):
    rows = [("b", "alpha beta"), ("a", "alpha beta"), (None, "alpha beta"), ("c", None), ("d", "gamma")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, None)], "item_id bigint, text string")
    for block in (1, 1000):
        got = [(r.item_id, r.doc_id) for r in search_many(d, q, 2, block=block).collect()]
        assert len(got) == 6 and {(1, None), (1, "a"), (2, "d")} <= set(got)
    assert search_many(d, q.limit(0), 2).count() == 0 and search_many(d.limit(0), q, 2).count() == 0


def test_stream(spark, engine, tmp_path):
    schema = "document_id bigint, seq bigint, content string"
    batch = spark.createDataFrame([(1, 1, "old"), (1, 2, "new\n\ntext"), (2, 1, "x"), (3, 1, None)], schema)
    assert apply_batch(engine, batch, 0, "hand") and not apply_batch(engine, batch, 0, "hand")
    assert engine.chunks.count() == 3
    batch.write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(2, 2, None)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), engine, f"{tmp_path}/ck").awaitTermination(120)
    assert {r.document_id for r in engine.sources.collect()} == {1}


def test_command_line(spark, tmp_path, capsys):
    from quern import cli

    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    root = f"file://{tmp_path}/root"
    cli.run(spark, ["--root", root, "load", "t", f"file://{tmp_path}/a.csv"])
    cli.run(spark, ["--root", root, "info", "t"])
    assert "rows: 2" in capsys.readouterr().out
    cli.run(spark, ["--root", root, "query", "SELECT count(*) AS n FROM t WHERE id > 1"])
    assert "|1  |" in capsys.readouterr().out
