"""Which engine a query needs, searches that are routed to vectors, and cached results."""

from __future__ import annotations

import functools
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.embedding import EmbeddingProvider, HashingProvider, embed_column, similarity_to
from quern.operators.vectors import numbered as ranked
from quern.plans.shared import small_batches, written

CANDIDATES = 64
VECTOR_FUNCTIONS = frozenset(("similarity", "vector_search"))


def _functions(plan) -> set[str]:
    """The names of the Python functions in an analyzed plan."""
    found, stack = set(), [plan]
    while stack:
        node = stack.pop()
        for expressions in (node.expressions(),):
            todo = [expressions.apply(i) for i in range(expressions.size())]
            while todo:
                e = todo.pop()
                if e.getClass().getSimpleName() == "PythonUDF":
                    found.add(e.name().lower())
                todo += [e.children().apply(i) for i in range(e.children().size())]
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return found


def route(spark: SparkSession, sql: str) -> str:
    """``vector`` if a query calls SIMILARITY or VECTOR_SEARCH, else ``table``. Literals don't count."""
    plan = spark.sql(sql)._jdf.queryExecution().analyzed()
    return "vector" if _functions(plan) & VECTOR_FUNCTIONS else "table"


def hybrid_search(rows: DataFrame, text: str, query: str, threshold: float, where: str | None = None, limit: int | None = None, candidates: int | None = None, provider: EmbeddingProvider | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose text is like a query, best first, with ``score``; ties by the columns ``by``.

    The structured condition is applied first. With ``candidates`` it is applied to the
    best so many of all rows instead.
    """
    order = [F.desc("score"), *by]
    scored = (rows if candidates or not where else rows.where(where)).withColumn("score", similarity_to(F.col(text), query, provider))
    if candidates:
        scored = scored.orderBy(*order).limit(candidates)
        scored = scored.where(where) if where else scored
    out = scored.where(F.col("score") >= threshold).orderBy(*order)
    return out.limit(limit) if limit is not None else out


def search_many(documents: DataFrame, queries: DataFrame, k: int, provider: EmbeddingProvider | None = None, block: int = 1_000) -> DataFrame:
    """The ``k`` documents most like each query: ``item_id, doc_id, score``.

    ``documents(doc_id, text)`` are embedded once, to a written table. Queries
    ``(item_id, text)`` meet the vectors in blocks of bounded size; each task keeps its
    best ``k`` a query, and those are merged. Scores are compared to nine decimals, ties
    by doc_id, null first. Ids may be of any ordered type.
    """
    provider = provider or HashingProvider()
    count = queries.count()
    spark = documents.sparkSession
    small_batches(spark)
    kinds = queries.schema["item_id"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()
    schema = f"item_id {kinds[0]}, doc_id {kinds[1]}, score double"
    blocks = max(1, -(-count // block))
    numbered = written(queries.select("item_id", "text").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "search-queries")
    vectors = written(embed_column(documents.select("doc_id", "text"), "text", provider).select("doc_id", "vector"), "search-vectors")
    parts = []
    for b in range(blocks):
        rows = numbered.where(F.col("block") == b).orderBy("item_id").collect()  # about ``block`` rows
        if not rows:
            continue
        known = spark.sparkContext.broadcast(provider.embed([r["text"] or "" for r in rows]))
        items = pa.array([r["item_id"] for r in rows])

        def run(batches: Iterator[pa.RecordBatch], known=known, items=items) -> Iterator[pa.RecordBatch]:
            q = known.value
            held, least = [], np.full(len(q), -np.inf)

            def best(held: list[pa.Table]) -> pa.Table:
                t = pa.concat_tables(held)
                t = t.take(pc.sort_indices(t, sort_keys=[("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_start"))
                of = t.column("query").to_numpy()
                rank = np.arange(len(of)) - np.searchsorted(of, of, "left")
                full = rank == k - 1
                least[of[full]] = t.column("score").to_numpy()[full]
                return t.filter(pa.array(rank < k))

            for batch in batches:
                x = np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, -1)
                scores = np.round(x @ q.T, 9)
                i, j = np.nonzero(scores >= least)
                held.append(pa.table({"query": j, "score": scores[i, j], "doc_id": batch.column("doc_id").take(pa.array(i))}))
                held = [best(held)]
            for batch in held[0].to_batches(10_000) if held else ():
                yield pa.record_batch([items.take(batch.column("query")), batch.column("doc_id"), batch.column("score")], ["item_id", "doc_id", "score"])

        parts.append(vectors.mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    hits = functools.reduce(DataFrame.unionByName, parts)
    return ranked(hits, "item_id", F.desc("score"), F.asc_nulls_first("doc_id")).where(F.col("rank") <= k).select("item_id", "doc_id", F.round("score", 6).alias("score"))


class ResultCache:
    """Results by plan and data version; the least recently used leaves when full."""

    def __init__(self, most: int = 64):
        self.most, self._kept = most, OrderedDict()

    def get(self, df: DataFrame, version: int) -> DataFrame | None:
        key = (df.semanticHash(), version)
        for kept in self._kept.get(key, ()):
            if kept[0].sameSemantics(df):
                self._kept.move_to_end(key)
                return kept[1]
        return None

    def put(self, df: DataFrame, version: int) -> DataFrame:
        found = self.get(df, version)
        if found is not None:
            return found
        self._kept.setdefault((df.semanticHash(), version), []).append((df, df.persist()))
        while len(self._kept) > self.most:
            for _, old in self._kept.popitem(last=False)[1]:
                old.unpersist()
        return df

    def clear(self) -> None:
        for entries in self._kept.values():
            for _, df in entries:
                df.unpersist()
        self._kept.clear()
