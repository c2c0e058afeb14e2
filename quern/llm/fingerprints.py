"""Canonical exact digests: normal form, then a wide hash, then bytes.

The canonical form of a text is its compatibility normal form with case folded and runs
of white space made one space, without any at the ends. Its 128-bit xxhash is the
fingerprint. Equal fingerprints are not yet equal texts: grouping compares the canonical
bytes inside each bucket.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from quern.llm import words
from quern.plans.shared import bounded, small_batches, written

#: Fingerprints that a join looks up by a broadcast table; beyond it, by a shuffle.
BROADCAST_ROWS = 200_000


def canonical(text: str) -> str:
    """Compatibility normal form, case folded, white space folded."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def fingerprint(text: str) -> str:
    """The 128-bit xxhash of the canonical form, in hex."""
    return xxh3_128_hexdigest(canonical(text).encode())


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, else 0: an exact digest knows no more."""
    return float(a == b)


def canonical_groups(documents: DataFrame, digest: Callable[[bytes], str] = xxh3_128_hexdigest) -> DataFrame:
    """Group ``documents(doc_id, text)`` by canonical form: ``doc_id, fingerprint, keep_id, group_size``.

    ``keep_id`` is the least doc_id of a group. Rows are grouped by fingerprint, then by
    the canonical bytes themselves where a fingerprint occurs twice or more; copies are
    put together before the shuffle, so a bucket of any size is a row a task.

    A null text counts as empty; empty texts are a group. A null doc_id is least of all.
    Repeated rows count as often as they occur. An empty table gives no rows. Other
    columns are ignored.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [canonical(t.as_py() or "") for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array([digest(t.encode()) for t in texts], pa.string()), pa.array(texts, pa.string())], ["doc_id", "fingerprint", "form"])

    d = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fingerprint string, form string")
    d = written(d, "canonical-forms")
    least = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")
    twice = written(d.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "canonical-twice")
    forms = d.join(twice, "fingerprint", "left_semi").groupBy("fingerprint", "form").agg(F.count(F.lit(1)).alias("n"))
    # a bucket with more than one form is a collision; its rows are told apart by the form
    clash = forms.groupBy("fingerprint").count().where("count > 1").select("fingerprint", F.lit(True).alias("clash"))
    clash = written(clash, "canonical-clashes")
    part = F.lit("")
    if not clash.isEmpty():
        d, part = d.join(clash, "fingerprint", "left"), F.when(F.col("clash"), F.col("form")).otherwise("")
    d = d.withColumn("part", part).select("doc_id", "fingerprint", "part")
    groups = written(d.groupBy("fingerprint", "part").agg(F.min(least)["doc_id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "canonical-groups")
    return d.join(groups, ["fingerprint", "part"]).select("doc_id", "fingerprint", "keep_id", "group_size")


def with_next(documents: DataFrame) -> DataFrame:
    """Each row of ``documents(doc_id, text)`` edited by the next in descending order of doc_id.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The last third of a text (rounded down, in code points) is
    replaced by as many code points from the start of the next document, or all it has;
    after the last document comes the first.

    A null text counts as empty. Equal ids are ordered by a hash of the text, then the
    text; equal rows are interchangeable. A null doc_id comes last. A single row is its
    own next. An empty table gives no rows. Other columns are ignored.

    The rows are dealt by ranges of doc_id; each range also gets the first row of the
    range below it, so the text moves once and each task reads its rows in order. Ids
    must be numbers; rows of one id, and those without, are in one range.
    """
    return _with_next(documents).drop("part")


def _with_next(documents: DataFrame, digest: Callable[[bytes], str] = xxh3_128_hexdigest, clashing: Collection[str] = ()) -> DataFrame:
    """``with_next`` and ``part``: the canonical form where the fingerprint is in ``clashing``, else empty."""
    small_batches(documents.sparkSession)
    spark, id_type = documents.sparkSession, documents.schema["doc_id"].dataType.simpleString()
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = d.select("doc_id").where("doc_id is not null")
    at = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(at[: n - 1]))
    # the range of an id is the number of bounds below it; null ids are in the lowest
    bucket = F.lit(0)
    if bounds:
        array = F.array(*[F.lit(b) for b in bounds])
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(array, lambda b: b < F.col("doc_id"))))
    d = d.withColumn("bucket", bucket)
    first = {r["bucket"]: r["top"] for r in d.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    # a range's first rows (its greatest id) go to the range above as well; the first of all goes to the lowest
    order = sorted(first, reverse=True)
    above = dict(zip(order, [*order[-1:], *order[:-1]], strict=True))
    places = range(len(bounds) + 1)
    top = F.array(*[F.lit(first.get(b)).cast(id_type) for b in places])[F.col("bucket")]
    to = F.array(*[F.lit(above.get(b)).cast("int") for b in places])[F.col("bucket")]
    own = F.struct(F.col("bucket").alias("at"), F.lit(0).alias("lent"))
    rows = F.when(F.col("doc_id").eqNullSafe(top), F.array(own, F.struct(to.alias("at"), F.lit(1).alias("lent")))).otherwise(F.array(own))
    d = d.select("doc_id", "text", F.explode(rows).alias("x")).select("doc_id", "text", "x.at", "x.lent")
    d = d.repartitionById(max(1, len(bounds) + 1), F.col("at")).withColumn("h", F.xxhash64("text"))
    d = d.sortWithinPartitions("at", "lent", F.col("doc_id").desc_nulls_last(), "h", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part"]
    clashing = frozenset(clashing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the id, text, fingerprint and part of the row before, and its range
        lent_to = None

        def result(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
            columns = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array(columns[0], batch_type), *[pa.array(c, k) for c, k in zip(columns[1:], kinds[1:], strict=True)]], names)

        for b in batches:
            batch_type, out = b.column("doc_id").type, []
            for i, t, at, lent in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("at").to_pylist(), b.column("lent").to_pylist(), strict=True):
                if lent and (lent_to == at or held is None):
                    continue  # only the first row of the range below is next to this one
                text = t.as_py()
                form = canonical(text)
                mine = digest(form.encode())
                if held is not None and held[4] == at:
                    doc_id, body, fp, part, _ = held
                    k = len(body) // 3
                    edited = body[: len(body) - k] + text[:k]
                    edited_fp = digest(canonical(edited).encode())
                    out.append((doc_id, len(body), hashlib.sha256(edited.encode()).hexdigest(), fp, edited_fp, likeness(fp, edited_fp), likeness(fp, mine), part))
                if lent:
                    held, lent_to = None, at
                else:
                    held = i, text, mine, form if mine in clashing else "", at
            if out:
                yield result(out)

    return d.select("doc_id", "text", "at", "lent").mapInArrow(run, f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part string")


def _clashes(documents: DataFrame, twice: DataFrame, digest: Callable[[bytes], str]) -> list[str]:
    """The fingerprints of ``twice(fingerprint)`` that texts of different canonical bytes share.

    Only texts with such a fingerprint leave a task, and copies are put together before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [canonical(t.as_py() or "") for t in b.column("text")]
            yield pa.record_batch([pa.array([digest(t.encode()) for t in texts], pa.string()), pa.array(texts, pa.string())], ["fingerprint", "form"])

    forms = documents.select("text").mapInArrow(run, "fingerprint string, form string").join(bounded(twice, BROADCAST_ROWS), "fingerprint", "left_semi")
    forms = forms.groupBy("fingerprint", "form").agg(F.lit(1).alias("one"))
    return [r["fingerprint"] for r in forms.groupBy("fingerprint").count().where("count > 1").select("fingerprint").collect()]


def with_groups(documents: DataFrame, digest: Callable[[bytes], str] = xxh3_128_hexdigest) -> DataFrame:
    """The columns of ``with_next``, and ``keep_id, group_size`` of each row's group of equal canonical forms.

    Groups are those of ``canonical_groups``: fingerprints that occur twice or more are
    buckets, inside which the canonical bytes are compared. A bucket with different
    texts is told apart by the bytes themselves. A row by itself keeps its own id and
    has a group of one. Odd rows are as in both.
    """
    rows = written(_with_next(documents, digest), "canonical-rows")
    twice = written(rows.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "canonical-twice")
    clashing = _clashes(documents, twice, digest)
    if clashing:
        rows = written(_with_next(documents, digest, clashing), "canonical-rows")
    by = ["fingerprint", "part"]
    least = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")
    groups = rows.groupBy(by).agg(F.min(least)["doc_id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.where("group_size > 1"), "canonical-groups")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id")
    columns = [c for c in rows.columns if c != "part"]
    return rows.join(bounded(groups, BROADCAST_ROWS), by, "left").select(*columns, keep, F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
