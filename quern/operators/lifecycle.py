"""Versions of documents and of their chunks, kept by keyed joins.

``sources``: document_id, version, content_hash, state. ``chunks``: document_id,
chunk_id, source_version, content, content_hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.chunking import chunk_documents
from quern.functions.hashing import content_hash

ACTIVE, STALE = "Active", "Stale"


class Untracked(KeyError):
    """A document that was never registered."""


def hashed(documents: DataFrame) -> DataFrame:
    """``document_id, content_hash`` of ``documents(document_id, content)``."""
    return documents.select("document_id", content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"))


def register(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """New documents become version 1, Active; those tracked stay as they are."""
    new = hashed(documents).join(sources, "document_id", "left_anti")
    new = new.select("document_id", F.lit(1).cast("bigint").alias("version"), "content_hash", F.lit(ACTIVE).alias("state"))
    return sources.unionByName(new)


def untracked(sources: DataFrame, documents: DataFrame) -> DataFrame:
    return documents.select("document_id").join(sources, "document_id", "left_anti")


def require_tracked(sources: DataFrame, documents: DataFrame) -> None:
    missing = [r[0] for r in untracked(sources, documents).limit(20).collect()]
    if missing:
        raise Untracked(f"not tracked: {missing}")


def changes(sources: DataFrame, updates: DataFrame) -> DataFrame:
    """``document_id, old_hash, new_hash, old_version, new_version, changed`` for tracked updates."""
    new = hashed(updates).withColumnRenamed("content_hash", "new_hash")
    both = new.join(sources, "document_id").withColumn("changed", F.col("new_hash") != F.col("content_hash"))
    return both.select("document_id", F.col("content_hash").alias("old_hash"), "new_hash", F.col("version").alias("old_version"), (F.col("version") + F.col("changed").cast("bigint")).alias("new_version"), "changed")


def apply_update(sources: DataFrame, updates: DataFrame) -> DataFrame:
    """Changed documents get the next version, the new hash and the state Stale."""
    new = changes(sources, updates).where("changed").select("document_id", "new_version", "new_hash")
    both = sources.join(new, "document_id", "left")
    hit = F.col("new_version").isNotNull()
    return both.select(
        "document_id",
        F.coalesce("new_version", "version").alias("version"),
        F.coalesce("new_hash", "content_hash").alias("content_hash"),
        F.when(hit, F.lit(STALE)).otherwise(F.col("state")).alias("state"),
    )


def derived_state(sources: DataFrame, vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active once every chunk of a document has a vector, else Stale."""
    open_ = chunks.join(vectors, ["document_id", "chunk_id"], "left_anti").select("document_id").distinct().withColumn("open", F.lit(True))
    return sources.join(open_, "document_id", "left").withColumn("derived_state", F.when(F.col("open"), F.lit(STALE)).otherwise(F.lit(ACTIVE))).drop("open")


def versioned_chunks(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """The chunks of documents with their version from ``versions(document_id, version)``."""
    return chunk_documents(documents).join(versions.select("document_id", F.col("version").alias("source_version")), "document_id")


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each new chunk against the old one in its place: ``action`` is Skip or Process.

    ``previous_hash`` is null for a place that is new.
    """
    was = old.select("document_id", "chunk_id", F.col("content_hash").alias("previous_hash"))
    same = F.col("previous_hash").eqNullSafe(F.col("content_hash"))
    return new.join(was, ["document_id", "chunk_id"], "left").withColumn("action", F.when(same, F.lit("Skip")).otherwise(F.lit("Process")))


def removed_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old places, of the documents that ``new`` has, that are no more."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_semi").join(new, ["document_id", "chunk_id"], "left_anti")


def work_report(diff: DataFrame) -> DataFrame:
    """Per document the chunks made, skipped and in all, and the percentage of work avoided."""
    made = F.sum((F.col("action") == "Process").cast("bigint"))
    total = F.count(F.lit(1))
    return diff.groupBy("document_id").agg(total.alias("total"), made.alias("generated"), (total - made).alias("skipped"), F.round((1 - made / total) * 100, 4).alias("work_avoided"))


def duplicate_report(documents: DataFrame) -> DataFrame:
    """One row: total, unique, duplicates and their ratio (0 for no documents)."""
    n, u = F.count(F.lit(1)), F.countDistinct("content_hash")
    return hashed(documents).agg(n.alias("total"), u.alias("unique_documents"), (n - u).alias("duplicates"), F.when(n > 0, (n - u) / n).otherwise(0.0).alias("ratio"))
