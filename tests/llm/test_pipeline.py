"""The pipeline's stages, each against plain Python or SQL on what the stage before kept, over a whole table."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quern.llm import mixing, quality, tokens
from quern.plans.shared import written
from tests.llm.test_near_dedup import classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept, tables = [docs], {}
    for name, stage in cp.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], SF), "test"))
        assert kept[-1].dtypes == docs.dtypes
        tables[name] = kept[-1].toPandas()
        assert all(text[i] == t for i, t in zip(tables[name].doc_id, tables[name].text))
    ids = [set(docs.toPandas().doc_id), *[set(t.doc_id) for t in tables.values()]]
    # quality: what goes is what the scores reject, and hardly any document labelled good
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in ids[0] if labels.get(i) == 1]
    assert len([i for i in good if i in ids[1]]) >= 0.97 * len(good)
    assert len([i for i in ids[1] if labels.get(i) == 0]) <= 0.2 * len([i for i in ids[0] if labels.get(i) == 0])
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out()))
    assert ids[1] == {r.doc_id for r in quality.score_documents(docs, model).collect() if r.score >= quality.KEEP}
    first = {}
    for i in sorted(ids[1]):
        first.setdefault(" ".join(text[i].split()), i)
    assert ids[2] == set(first.values())
    assert ids[3] == set(classes([(i, text[i]) for i in sorted(ids[2])]).values())
    documents = kept[3].toPandas()  # noqa: F841  read by DuckDB
    want = {i: t // n for i, n, t in duckdb.sql(f"select doc_id, size, taken from ({mixing.ORACLE})").fetchall() if t}
    assert Counter(tables["mixture"].doc_id) == want
    e = tokens.encoder(tokens.default_path()).whole
    sizes = Counter({i: n * (len(e.encode(text[i], add_special_tokens=False).ids) + 1) for i, n in want.items()})
    out = cp.pack_stage(spark, kept[4], SF).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == dict(sizes) and out.sequence_id.is_unique


def test_rows_of_repeated_and_null_ids(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    body = " ".join(f"word{k}" for k in range(60))
    near, other = body.replace("word7 ", "changed "), "quite another text of its own, with its own words"
    rows = [(5, body, "en", "s", 1), (5, body, "en", "s", 1), (5, other, "en", "s", 1), (-2, body, "en", "s", 1), (None, other, "en", "s", 1), (None, other, "en", "s", 1), (9, near, "en", "s", 1), (None, None, "en", "s", 0), (8, "", "en", "s", 0)]
    docs = written(spark.createDataFrame(rows, schema), "test")
    exact = written(cp.exact_stage(spark, docs, SF), "test")
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text or "") for r in exact.collect()), key=key) == sorted([(-2, body), (None, other), (9, near), (None, "")], key=key)
    left = written(cp.near_stage(spark, exact, SF), "test")
    assert sorted(((r.doc_id, r.text or "") for r in left.collect()), key=key) == sorted([(-2, body), (None, other), (None, "")], key=key)
    twice = [(1, f"a b c {i}", "en", "s", 1) for i in range(4)] + [(i, "w " * 20, "en", "t", 1) for i in range(10, 90)]
    docs = written(spark.createDataFrame(twice, schema), "test")
    plain = written(docs.withColumn("doc_id", F.monotonically_increasing_id()), "test")
    assert cp.mix_stage(spark, docs, SF).count() == pytest.approx(cp.mix_stage(spark, plain, SF).count(), abs=2)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a b", "en", "s", 1), (2, "", "en", "s", 0), (3, "Good words here. And more of them, too.", "en", "s", 3), (3, "Good words here. And more of them, too.", "en", "s", 3), (4, "x" * 300_000, "en", "s", 1), (5, "many words " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in cp.STAGES:
        stage(spark, docs, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
