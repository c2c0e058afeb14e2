"""Exact dedup with composable polynomial fingerprints.

A text's bytes are cut into chunks; each chunk is hashed as a polynomial in two prime
fields, and hash(ab) = hash(a) * base^len(b) + hash(b) puts chunks together, in any
grouping. A text of usual length is hashed in its row's task; the pieces of a huge one
are dealt out, hashed in parallel, each shifted by the bytes after it, and summed. Texts whose fingerprint and length are equal are then compared chunk by chunk:
within a fingerprint and a chunk number the least and the greatest chunk must be the
same bytes. Minima and maxima are taken map-side first, so a group of any size leaves
each task as one row a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import words
from quern.plans.shared import bounded, small_batches, written

#: Two primes below 2^31 and a base for each. Products with a byte stay below 2^39, so
#: sums over a chunk are exact in doubles.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_566_083_941)
CHUNK = 1 << 14
COMPARE = 1 << 16
#: Texts of more code points are hashed in pieces of so many bytes by many tasks.
HUGE, PIECE = 1 << 22, 1 << 20
#: Copies that are looked up by a broadcast table of ids; beyond it, by a shuffled join.
BROADCAST_ROWS = 200_000
_SPACE = frozenset(b" \t\n\v\f\r")


def _powers(prime: int, base: int) -> np.ndarray:
    out, x = np.empty(CHUNK), 1
    for i in range(CHUNK):
        out[CHUNK - 1 - i] = x
        x = x * base % prime
    return out


_POWERS = [_powers(p, b) for p, b in zip(PRIMES, BASES, strict=True)]


def chunk_hash(data: bytes) -> tuple[int, int]:
    """The polynomials of at most ``CHUNK`` bytes."""
    x = np.frombuffer(data, "u1").astype("f8")
    return tuple(int(w[CHUNK - len(x) :] @ x) % p for w, p in zip(_POWERS, PRIMES, strict=True))


def combine(a: tuple[int, int], b: tuple[int, int], b_len: int) -> tuple[int, int]:
    """The polynomials of two texts in a row; ``b_len`` is the length of the second."""
    return tuple((x * pow(base, b_len, p) + y) % p for x, y, base, p in zip(a, b, BASES, PRIMES, strict=True))


def polynomials(data: bytes) -> tuple[int, int]:
    """The chunks' polynomials combined."""
    h = 0, 0
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        h = combine(h, chunk_hash(part), len(part))
    return h


def fingerprint(data: bytes) -> int:
    """The polynomials as one signed 64-bit integer."""
    h = polynomials(data)
    return h[0] << 31 | h[1]


def normal(text: str) -> bytes:
    """A text in UTF-8 with each run of ASCII white space replaced by one space."""
    raw = text.encode()
    if not raw:
        return raw
    words = b" ".join(raw.split())
    return (b" " if raw[0] in _SPACE else b"") + words + (b" " if words and raw[-1] in _SPACE else b"")


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, fp, n_bytes, text_sha256`` of the normal form of each row of ``documents(doc_id, text)``."""
    d = documents.select("doc_id", "text")
    huge = F.coalesce(F.length("text") > HUGE, F.lit(False))
    long = d.where(huge)
    if long.isEmpty():
        return _in_one_task(d)
    return _in_one_task(d.where(~huge)).unionByName(_in_pieces(long))


def _in_pieces(documents: DataFrame) -> DataFrame:
    """The same for huge texts, whose pieces are hashed by as many tasks as there are."""
    body = _normal(F.col("text")).cast("binary")
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", body.alias("body"))
    rows = written(rows.withColumns({"n_bytes": F.length("body").cast("bigint"), "text_sha256": F.sha2("body", 256)}), "exact-huge")
    places = F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / PIECE).cast("int"))
    pieces = rows.select("row", "n_bytes", "body", F.explode(places).alias("n"))
    piece = F.substring(F.col("body"), F.col("n") * PIECE + 1, F.lit(PIECE))
    pieces = pieces.select("row", "n", F.greatest(F.lit(0).cast("bigint"), F.col("n_bytes") - (F.col("n") + 1) * PIECE).alias("after"), piece.alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.give_back()
        for b in batches:
            shifted = [combine(polynomials(x.as_py()), (0, 0), after) for x, after in zip(b.column("bytes"), b.column("after").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("row"), *[pa.array([h[k] for h in shifted], pa.int64()) for k in (0, 1)]], ["row", "a", "b"])

    parts = pieces.repartition("row", "n").mapInArrow(run, "row bigint, a bigint, b bigint")
    sums = parts.groupBy("row").agg(*[(F.sum(c) % p).alias(c) for c, p in zip("ab", PRIMES, strict=True)])
    fp = F.col("a") * F.lit(1 << 31).cast("bigint") + F.col("b")
    return rows.drop("body").join(sums, "row").select("doc_id", fp.alias("fp"), "n_bytes", "text_sha256")


def _in_one_task(documents: DataFrame) -> DataFrame:

    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.give_back()
        for b in batches:
            fps, sizes, shas = [], [], []
            for text in b.column("text"):
                x = normal(text.as_py() or "")
                fps.append(fingerprint(x))
                sizes.append(len(x))
                shas.append(hashlib.sha256(x).hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "fp", "n_bytes", "text_sha256"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp bigint, n_bytes bigint, text_sha256 string")


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _unequal(documents: DataFrame, shared: DataFrame) -> DataFrame:
    """The ``fp, n_bytes`` of ``shared(doc_id, fp, n_bytes)`` whose texts are not all the same bytes."""
    few = bounded(shared, BROADCAST_ROWS)
    body = _normal(F.col("text")).cast("binary")
    texts = documents.select(F.col("doc_id").alias("of"), "text").join(few, F.col("of").eqNullSafe(F.col("doc_id"))).select("fp", "n_bytes", body.alias("body"))
    chunk = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.length("body") - 1) / COMPARE).cast("int"))), lambda i: F.substring(F.col("body"), i * COMPARE + 1, COMPARE))
    chunks = texts.select("fp", "n_bytes", F.posexplode(chunk).alias("n", "bytes"))
    same = chunks.groupBy("fp", "n_bytes", "n").agg((F.min("bytes") == F.max("bytes")).alias("same"))
    return same.where("not same").select("fp", "n_bytes").distinct()


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space became one space.
    Of equal texts the row with the least doc_id stays. ``text_sha256`` is of the normal
    form in UTF-8.

    Huge texts are hashed in parallel and compared in chunks, as all are. A null text
    counts as empty, and empty texts are equal. Repeated rows of one id are
    members of their group and all have ``kept`` true if that id is the least: ids should
    be unique. A null doc_id is least of all and its row stays. An empty table gives no
    rows. Other columns are ignored.
    """
    prints = written(fingerprints(documents), "exact-prints")
    by = ["fp", "n_bytes"]
    groups = _groups(prints, by)
    shared = written(prints.join(groups.where("group_size > 1"), by, "left_semi").select("doc_id", *by), "exact-shared")
    # repeated rows go after the table is cut off, so that it is dealt by doc_id as well and not by the hot group
    odd = written(_unequal(documents, shared.distinct()), "exact-odd")
    if not odd.isEmpty():
        # where a fingerprint has met different texts, their digests tell them apart
        part = F.when(F.col("odd"), F.col("text_sha256")).otherwise("")
        prints = prints.join(odd.withColumn("odd", F.lit(True)), by, "left").withColumn("part", part)
        by = [*by, "part"]
        groups = _groups(prints, by)
    return prints.join(groups, by).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _groups(prints: DataFrame, by: list[str]) -> DataFrame:
    """The least doc_id and the size of each group, as a written table: joins with it can split a hot group."""
    least = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")
    return written(prints.groupBy(by).agg(F.min(least)["doc_id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
