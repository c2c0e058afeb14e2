"""A training corpus from raw documents: quality, exact and near duplicates, mixture, packing.

Each stage reads the whole of what the one before kept. All but the last return the
columns of ``documents``; the last returns a row a packed piece.

Stages work on rows. Where ids repeat or are null, rows get keys of their own that keep
the order of ids (null first, then as the rows lie), so that of equal or near-equal rows
one stays and no other text goes. Null texts count as empty: they are equal to each
other, near to each other, have no words for the mixture, and are packed as the end
alone. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, mixing, near_dedup, packing, quality
from quern.plans.shared import bounded, written


KEY = "_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for each row: its id, where ids are unique, else a text in the order of ids."""
    repeated = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if repeated.isEmpty():
        return docs.withColumn(KEY, F.col("doc_id"))
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    ordered = F.col("doc_id")
    if docs.schema["doc_id"].dataType.simpleString() != "string":
        # the sign bit turned over, integers are in the order of their digits
        ordered = F.lpad(F.hex(ordered.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat(F.when(F.col("doc_id").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), ordered)), F.lit(" "), F.lpad(F.hex("_row"), 16, "0"))
    return rows.withColumn(KEY, key).drop("_row")


def _for_operator(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.col(KEY).alias("doc_id"), *columns)


def _without(rows: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """``rows`` without those whose key is in ``dropped(doc_id)``, and without the key."""
    dropped = written(dropped.select(F.col("doc_id").alias(KEY)).distinct(), name)
    return rows.join(bounded(dropped), KEY, "left_anti").drop(KEY)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labels that aren't held out, does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out()))
    return quality.score_documents(docs, model).where(F.col("score") >= quality.KEEP).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least id."""
    rows = _keyed(docs)
    found = exact_dedup.exact_duplicates(_for_operator(rows, "text"))
    return _without(rows, found.where("not kept"), "pipeline-equal").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least id."""
    rows = _keyed(docs)
    found = near_dedup.near_classes(_for_operator(rows, "text"))
    return _without(rows, found.where("doc_id <> class_id"), "pipeline-near").select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it."""
    rows = _keyed(docs)
    copies = mixing.mix(_for_operator(rows, "text", "source")).where("copies > 0").select(F.col("doc_id").alias(KEY), "copies")
    both = rows.join(bounded(written(copies, "pipeline-copies")), KEY)
    return both.select(*docs.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of binary lengths."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixture", mix_stage), ("packing", pack_stage)]
#: Neither the classifier nor the hashed signatures can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
