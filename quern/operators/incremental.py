"""The incremental engine: documents in, maintained chunks and vectors out.

State is four tables: sources, chunks, vectors and the model. A step writes the rows that
changed and the keys of those they replace, and then one state of all tables, so that a
step that breaks off leaves no trace and can be run again. Only chunks whose hash changed
are embedded, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.embedding import EmbeddingProvider, HashingProvider, embed_column
from quern.operators import lifecycle, vectors
from quern.plans.shared import bounded, written
from quern.sources.tables import Step, Tables

SOURCES = "document_id bigint, version bigint, content_hash string, state string"
CHUNKS = "document_id bigint, chunk_id int, source_version bigint, content string, content_hash string"
VECTORS = "document_id bigint, chunk_id int, source_version bigint, model_id string, vector array<double>"
REPORT = "documents bigint, generated bigint, skipped bigint, removed bigint, work_avoided double"


class Engine:
    def __init__(self, spark: SparkSession, root: str, provider: EmbeddingProvider | None = None):
        self.spark, self.tables, self.provider = spark, Tables(spark, root), provider or HashingProvider()
        if not self.tables.exists("model"):
            with self.tables.step() as step:
                for name, schema in (("sources", SOURCES), ("chunks", CHUNKS), ("vectors", VECTORS)):
                    step.create(name, spark.createDataFrame([], schema).schema)
                step.replace("model", self._model())
        kept = self.tables.open("model").first()
        if (kept["model_id"], kept["dimension"]) != (self.provider.model_id, self.provider.dimension):
            raise ValueError(f"the tables are of model {kept['model_id']} with {kept['dimension']} dimensions")

    def _model(self) -> DataFrame:
        return self.spark.createDataFrame([(self.provider.model_id, self.provider.dimension)], "model_id string, dimension int")

    sources = property(lambda self: self.tables.open("sources"))
    chunks = property(lambda self: self.tables.open("chunks"))
    vectors = property(lambda self: self.tables.open("vectors"))

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        v = embed_column(chunks.select("document_id", "chunk_id", "source_version", "content"), "content", self.provider)
        return written(v.select("document_id", "chunk_id", "source_version", F.lit(self.provider.model_id).alias("model_id"), "vector"), "engine-vectors")

    def _one_each(self, documents: DataFrame) -> DataFrame:
        d = written(documents.select(F.col("document_id").cast("bigint").alias("document_id"), "content"), "engine-input")
        twice = [r[0] for r in d.groupBy("document_id").count().where("count > 1").limit(20).collect()]
        if twice:
            raise ValueError(f"documents given twice: {twice}")
        return d

    def _report(self, documents: int, generated: int, skipped: int, removed: int) -> DataFrame:
        total = generated + skipped
        return self.spark.createDataFrame([(documents, generated, skipped, removed, 100.0 * skipped / total if total else 0.0)], REPORT)

    def ingest(self, documents: DataFrame) -> DataFrame:
        """Add ``documents(document_id, content)``; tracked ones are updated. Returns the report."""
        d = self._one_each(documents)
        with self.tables.step() as step:
            old = d.join(step.open("sources"), "document_id", "left_semi")
            new = written(d.join(step.open("sources"), "document_id", "left_anti"), "engine-new")
            counts = self._updated(step, written(old, "engine-old")) if not old.isEmpty() else (0, 0, 0)
            fresh = written(lifecycle.register(self.spark.createDataFrame([], SOURCES), new), "engine-sources")
            chunks = written(lifecycle.versioned_chunks(new, fresh).select("document_id", "chunk_id", "source_version", "content", "content_hash"), "engine-chunks")
            vecs = self._embedded(chunks)
            step.append("sources", fresh)
            step.append("chunks", chunks)
            step.append("vectors", vecs)
        return self._report(d.count(), vecs.count() + counts[0], counts[1], counts[2])

    def update(self, documents: DataFrame) -> DataFrame:
        """Replace tracked documents; an untracked one raises. Returns the report."""
        d = self._one_each(documents)
        with self.tables.step() as step:
            lifecycle.require_tracked(step.open("sources"), d)
            counts = self._updated(step, d)
        return self._report(d.count(), *counts)

    def _updated(self, step: Step, d: DataFrame) -> tuple[int, int, int]:
        """Update tracked documents within a step; returns chunks made, skipped and removed."""
        old_sources, old_chunks, old_vectors = (step.open(n) for n in ("sources", "chunks", "vectors"))
        changed = written(lifecycle.changes(old_sources, d).where("changed").select("document_id"), "engine-changed")
        few = bounded(changed)
        d2 = d.join(few, "document_id", "left_semi")
        sources = written(lifecycle.apply_update(old_sources.join(few, "document_id", "left_semi"), d2), "engine-sources")
        was = written(old_chunks.join(few, "document_id", "left_semi"), "engine-was")
        diff = written(lifecycle.chunk_diff(was, lifecycle.versioned_chunks(d2, sources)), "engine-diff")
        made = self._embedded(diff.where("action = 'Process'"))
        gone = written(was.join(diff, vectors.KEY, "left_anti").select(*vectors.KEY), "engine-gone")
        kept = old_chunks.join(bounded(d.select("document_id")), "document_id", "left_semi").join(few, "document_id", "left_anti").count() + diff.where("action = 'Skip'").count()
        step.upsert("sources", sources.select(old_sources.columns), changed, ["document_id"])
        step.upsert("chunks", diff.select(old_chunks.columns), changed, ["document_id"])
        step.upsert("vectors", made.select(old_vectors.columns), gone.unionByName(made.select(*vectors.KEY)), vectors.KEY)
        return made.count(), kept, gone.count()

    def delete(self, ids: DataFrame) -> DataFrame:
        """Forget the documents of ``ids(document_id)``; an untracked one raises. Returns the counts."""
        ids = written(ids.select(F.col("document_id").cast("bigint").alias("document_id")).distinct(), "engine-ids")
        with self.tables.step() as step:
            lifecycle.require_tracked(step.open("sources"), ids)
            counts = []
            for name, key in (("sources", ["document_id"]), ("chunks", ["document_id"]), ("vectors", vectors.KEY)):
                old = step.open(name)
                gone = written(old.join(bounded(ids), "document_id", "left_semi").select(*key), "engine-gone")
                counts.append(gone.count())
                step.upsert(name, old.limit(0), gone, key)
        return self.spark.createDataFrame([tuple(counts)], "documents bigint, chunks bigint, vectors bigint")

    def migrate(self, provider: EmbeddingProvider) -> DataFrame:
        """Embed anew what another model made; vectors without a chunk are left. Returns the counts."""
        before = self.provider
        try:
            with self.tables.step() as step:
                old = step.open("vectors")
                todo = written(vectors.to_migrate(old, step.open("chunks"), provider.model_id), "engine-todo")
                self.provider = provider
                made = self._embedded(todo)
                n, total = made.count(), old.count()
                step.upsert("vectors", made.select(old.columns), made.select(*vectors.KEY), vectors.KEY)
                step.replace("model", self._model())
        except BaseException:
            self.provider = before
            raise
        return self.spark.createDataFrame([(n, total - n)], "migrated bigint, skipped bigint")

    def search(self, query: str, k: int, any_model: bool = False) -> DataFrame:
        """The ``k`` chunks most like a text, of the current model unless asked otherwise."""
        v = self.vectors if any_model else self.vectors.where(F.col("model_id") == self.provider.model_id)
        hits = vectors.top_k(v, self.provider.embed([query])[0].tolist(), k)
        return hits.drop("vector").join(self.chunks.select(*vectors.KEY, "content"), vectors.KEY).orderBy(F.desc("score"), *vectors.KEY)
