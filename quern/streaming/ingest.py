"""Continuous ingestion: micro-batches of documents applied to the engine.

An extension of the engine. A batch that is run again is applied once: the engine's
folder remembers the last batch of each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quern.operators.incremental import Engine


def apply_batch(engine: Engine, batch: DataFrame, batch_id: int, stream: str = "stream") -> bool:
    """Apply a batch of ``document_id, seq, content``; of one document the last by seq counts.

    A null content deletes the document, if it is tracked. False if the batch was applied before.
    """
    name = f"batches-{stream}"
    spark = engine.spark
    if not engine.tables.exists(name):
        engine.tables.create(name, spark.createDataFrame([], "batch_id bigint").schema)
    if not engine.tables.open(name).where(F.col("batch_id") >= batch_id).isEmpty():
        return False
    last = batch.groupBy("document_id").agg(F.max(F.struct("seq", F.col("content").isNotNull().alias("has"), "content")).alias("x")).select("document_id", "x.content").persist()
    try:
        there = last.where("content is not null")
        if not there.isEmpty():
            engine.ingest(there)
        gone = last.where("content is null").join(engine.sources, "document_id", "left_semi").select("document_id")
        if not gone.isEmpty():
            engine.delete(gone)
        engine.tables.replace(name, spark.createDataFrame([(batch_id,)], "batch_id bigint"))
    finally:
        last.unpersist()
    return True


def start(stream: DataFrame, engine: Engine, checkpoint: str, name: str = "stream", **trigger) -> StreamingQuery:
    """Run a stream of ``document_id, seq, content`` into the engine."""
    return stream.writeStream.foreachBatch(lambda df, i: apply_batch(engine, df, i, name)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
