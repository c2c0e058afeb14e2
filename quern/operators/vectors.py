"""Vector tables: search, upsert, removal, migration and semantic duplicates.

A vector table has ``document_id, chunk_id, source_version, model_id, vector``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.embedding import cosine
from quern.plans.shared import small_batches, written

KEY = ["document_id", "chunk_id"]
#: About so many vectors a block of the exact all-pairs comparison.
BLOCK = 2_000
#: Bytes at which a block is closed before; rows of a block that are multiplied at once.
BLOCK_BYTES, TILE = 16 << 20, 512


def scored(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """Every vector of the query's dimension with its ``score``."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.size("vector") == len(query)).withColumn("score", cosine(F.col("vector"), q))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, by: Sequence[str] = KEY) -> DataFrame:
    """The ``k`` vectors most like the query, ties by key; none for k = 0 or another dimension."""
    return scored(vectors, query).orderBy(F.desc("score"), *by).limit(k)


def best_per_document(hits: DataFrame) -> DataFrame:
    """Of each document its best hit, ties by chunk."""
    best = F.max(F.struct("score", (-F.col("chunk_id")).alias("c")))
    return hits.groupBy("document_id").agg(best.alias("x")).select("document_id", (-F.col("x.c")).alias("chunk_id"), F.col("x.score").alias("score"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(*key), list(key), "left_anti").select(old.columns).unionByName(new.select(old.columns))


def remove(old: DataFrame, gone: DataFrame, key: Sequence[str] = ("document_id",)) -> DataFrame:
    """``old`` without the rows whose key is in ``gone``."""
    return old.join(gone.select(*key).distinct(), list(key), "left_anti").select(old.columns)


def _cosines(x: Sequence[np.ndarray], y: Sequence[np.ndarray]) -> np.ndarray:
    """The cosine of each vector of ``x`` with each of ``y``, of two lengths both cut to the shorter."""
    out = np.zeros((len(x), len(y)))
    sizes = [np.array([len(v) for v in vectors]) for vectors in (x, y)]
    for p in np.unique(sizes[0]):
        for q in np.unique(sizes[1]):
            i, j = np.flatnonzero(sizes[0] == p), np.flatnonzero(sizes[1] == q)
            cut = (np.stack([vectors[r][: min(p, q)] for r in rows]) for vectors, rows in ((x, i), (y, j)))
            a, b = (np.divide(m, s, out=np.zeros_like(m), where=s > 0) for m, s in ((m, np.linalg.norm(m, axis=1, keepdims=True)) for m in cut))
            out[np.ix_(i, j)] = a @ b.T
    return out


def _packed(vectors: DataFrame, key: Sequence[str], block: int) -> DataFrame:
    """The vectors in rows of about ``block``, a written table: ``block`` (a number), ``sizes``, ``data`` (doubles) and each key's values as ``k0``, ``k1`` and so on."""
    spark = vectors.sparkSession
    small_batches(spark)
    v = vectors.where("vector is not null").dropna(subset=list(key)).select(*key, "vector")
    lists = [f"k{i}" for i in range(len(key))]
    kinds = ", ".join(f"{k} array<{v.schema[c].dataType.simpleString()}>" for k, c in zip(lists, key, strict=True))

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        *keys, x = (pa.concat_arrays([p.column(i) for p in parts]) for i in range(len(lists) + 1))
        data = x.flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
        whole = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), c) for c in (pc.list_value_length(x).cast(pa.int32()), *keys)]
        return pa.record_batch([pa.array([data], pa.binary()), *whole], ["data", "sizes", *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, size = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, block):
                parts.append(b.slice(at, block))
                rows, size = rows + parts[-1].num_rows, size + parts[-1].nbytes
                if rows >= 2 * block or size >= BLOCK_BYTES:
                    yield row(parts)
                    parts, rows, size = [], 0, 0
        if parts:
            yield row(parts)

    dealt = v.repartition(max(1, math.ceil(v.count() / block)))
    return written(dealt.mapInArrow(run, f"data binary, sizes array<int>, {kinds}").withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


def _ranks(columns: list[pa.Array]) -> np.ndarray:
    """The places of rows in the order of some columns; equal rows share one."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        at = pc.rank(c, tiebreaker="dense").to_numpy().astype(np.int64)
        out = np.unique(out * (len(at) + 1) + at, return_inverse=True)[1]
    return out


def pairs_above(vectors: DataFrame, threshold: float, key: Sequence[str] = KEY, block: int = BLOCK) -> DataFrame:
    """All pairs with a cosine of ``threshold`` or more, exactly.

    Vectors are dealt once into blocks of bounded size, which are written; a task reads
    some of the blocks twice over and multiplies each with each, so nothing but the
    vectors themselves is shuffled. Returns the key columns of both with the suffixes
    ``_a`` and ``_b`` (a before b) and ``similarity``. Of two lengths, both are cut to
    the shorter. A cosine with zeros is 0; a null vector or key is in no pair.
    """
    kinds = [vectors.schema[k].dataType.simpleString() for k in key]
    names = [f"{k}_{side}" for side in "ab" for k in key]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds * 2, strict=True)) + ", similarity double"
    blocks = _packed(vectors, key, block)
    left, right = (blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in blocks.columns]) for side in "ab")
    # a block meets itself and every other once; which of two is on the left takes turns, so that tasks have equal shares
    turn = lambda c: F.pmod(F.col(c) + F.shiftright(c, 33), F.lit(2))
    once = F.when(turn("block_a") == turn("block_b"), F.col("block_a") <= F.col("block_b")).otherwise(F.col("block_a") > F.col("block_b"))
    cells = left.join(right.hint("shuffle_replicate_nl"), once).withColumn("itself", F.col("block_a") == F.col("block_b")).drop("block_a", "block_b")

    def unpacked(b: pa.RecordBatch, r: int, side: str) -> tuple[list[pa.Array], list[np.ndarray]]:
        sizes = b.column(f"sizes_{side}")[r].values.to_numpy()
        data, ends = np.frombuffer(b.column(f"data_{side}")[r].as_buffer(), "<f8"), np.cumsum(sizes)
        return [b.column(f"k{i}_{side}")[r].values for i in range(len(key))], [data[e - n : e] for e, n in zip(ends, sizes, strict=True)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (keys, x), (others, y) = unpacked(b, r, "a"), unpacked(b, r, "b")
                both = [pa.concat_arrays(k) for k in zip(keys, others, strict=True)]
                rank, itself = _ranks(both), b.column("itself")[r].as_py()
                for at in range(0, len(x), TILE):
                    sim = _cosines(x[at : at + TILE], y)
                    i, j = np.nonzero(sim >= threshold)
                    score, i, j = sim[i, j], i + at, j + len(x)
                    less = rank[i] < rank[j]
                    good = less if itself else rank[i] != rank[j]
                    first, second = (pa.array(np.where(less, *ij)[good]) for ij in ((i, j), (j, i)))
                    yield pa.record_batch([k.take(at) for at in (first, second) for k in both] + [pa.array(score[good])], [*names, "similarity"])

    return cells.mapInArrow(compare, schema)


def semantic_duplicates(vectors: DataFrame, threshold: float) -> DataFrame:
    """Pairs of chunks at or above the threshold, most alike first."""
    return pairs_above(vectors, threshold).orderBy(F.desc("similarity"), "document_id_a", "chunk_id_a", "document_id_b", "chunk_id_b")


def to_migrate(vectors: DataFrame, chunks: DataFrame, model_id: str) -> DataFrame:
    """The vectors of other models that still have a chunk, with its ``content``."""
    return vectors.where(F.col("model_id") != model_id).join(chunks.select(*KEY, "content"), KEY)


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with ``canonical``, the first of its equals by ``order``, and ``is_duplicate``."""
    least = rows.groupBy(key).agg(F.min(order).alias("canonical"))
    return rows.join(least, key).withColumn("is_duplicate", F.col(order) != F.col("canonical"))


def numbered(rows: DataFrame, part: str, *order) -> DataFrame:
    """``rows`` with ``rank`` within ``part``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
