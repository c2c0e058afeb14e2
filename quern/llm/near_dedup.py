"""Near-duplicate documents by ProbMinHash.

A document is its shingles of five words, each weighted by 1 + ln of how often it occurs.
Every shingle sends arrivals of a Poisson process with its weight as rate to random
registers; a register keeps the shingle that came first, and a shingle stops when its
next arrival is later than all registers' firsts. The share of equal registers estimates
the probability Jaccard likeness. Bands of registers give candidate buckets; candidates
are verified by their exact likeness; links are put together as connected components.

Within a bucket nothing is paired with everything. All members are compared with the
bucket's leader, and linked documents become a class. Members left in different classes
are dealt into blocks, and tasks compare blocks by products of matrices; out come the
links that join classes, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from quern.llm import words
from quern.llm.components import connected_components
from quern.plans.shared import bounded, small_batches, written

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares no band with a chance of (1 - 0.8^5)^24 = 7e-5.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Documents (between an eighth of a group, within bounds) and shingles a block
#: of the comparison of what the leaders left open, on average.
BLOCK, LEAST_BLOCK, BLOCK_SHINGLES = 256, 128, 500_000
#: Candidates that are looked up by a broadcast table of ids; beyond it, by a shuffled join.
BROADCAST_ROWS = 200_000
_MULTIPLY = words.mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, distinct shingles and their counts, ordered by text and shingle; then all words' hashes and texts.

    Words are runs without ASCII white space, A-Z as a-z. A text of one to four words is
    one shingle; a text without words has none.
    """
    n = len(offs) - 1
    starts, ends, doc = words.words(data, offs)
    h = words.hashes(data, starts, ends)
    if len(h) == 0:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, h, doc
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    place = np.arange(len(h)) - first[doc]
    # every word begins a shingle, of fewer words at a text's end; only whole ones and those of short texts stay
    whole = (place + size <= counts[doc]) | (place == 0)
    g = np.zeros(len(h), np.uint64)
    for k in range(min(size, len(h))):
        inside = place[: len(h) - k] + k < counts[doc[: len(h) - k]]
        g[: len(h) - k] += np.where(inside, h[k:] * _MULTIPLY[k], np.uint64(0))
    g, of = words.mix(g[whole]), doc[whole]
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    new = np.append(True, (g[1:] != g[:-1]) | (of[1:] != of[:-1]))
    at = np.flatnonzero(new)
    return of[at], g[at], np.diff(np.append(at, len(g))), h, doc


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signatures(of: np.ndarray, g: np.ndarray, w: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The ``n`` texts' registers, each the shingle that came first; 0 where a text has none."""
    first, who = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    time, k = np.zeros(len(g)), 0
    while len(g):
        k += 1
        x = words.mix(g + np.array([k], np.uint64) * _STEP)
        time = time - np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / w
        at = of * m + (words.mix(x ^ _STEP) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        who[at[won]] = g[won]
        # early termination: no later arrival of a shingle can be a first
        last = first.reshape(n, m).max(axis=1) if k < 8 or k % 8 == 0 else last  # noqa: F821
        on = time < last[of]
        of, g, w, time = of[on], g[on], w[on], time[on]
    return who.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; bands differ in their keys."""
    x = sig.reshape(len(sig), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        key = words.mix(key * _STEP + x[:, :, r])
    return key


def likeness(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The exact probability Jaccard likeness of sorted distinct shingles ``a`` and ``b`` with weights ``x`` and ``y``."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    n = int(both.sum())
    if n == 0:
        return 0.0
    if x.min() == x.max() and y.min() == y.max():
        return n / (len(a) + len(b) - n)
    # sum of max(x_j, t y_j) over all j for t = x_d / y_d, by the order of x_j / y_j
    xs, ys = x[both], y[at[both]]
    t = xs / ys
    order = np.argsort(t)
    sum_x, sum_y = np.append(0, np.cumsum(xs[order])), np.append(0, np.cumsum(ys[order]))
    k = np.searchsorted(t[order], t, "left")
    only_x, only_y = x.sum() - xs.sum(), y.sum() - ys.sum()
    total = only_x + (sum_x[-1] - sum_x[k]) + t * (only_y + sum_y[k])
    return float((xs / total).sum())


def _signed(documents: DataFrame) -> DataFrame:
    """``doc_id, digest, bands`` of each row, as a written table; a text without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offs in words.slices(b.column("text")):
                n = to - at
                of, g, c, h, doc = shingles(data, offs)
                keys = band_keys(signatures(of, g, weights(c), n)).view(np.int64)
                edge = np.searchsorted(doc, np.arange(n + 1))
                digests = [xxh3_128_digest(h[edge[i] : edge[i + 1]].tobytes()) for i in range(n)]
                some = edge[1:] > edge[:-1]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some * BANDS)), pa.int32()), pa.array(keys[some].ravel()))
                yield pa.record_batch([b.column("doc_id").slice(at, n), pa.array(digests, pa.binary()), lists], ["doc_id", "digest", "bands"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    d = documents.where("doc_id is not null").select("doc_id", "text")
    return written(d.mapInArrow(run, f"doc_id {id_type}, digest binary, bands array<bigint>"), "near-signed")


def _sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``rep, n, uniform, g, w`` of the documents in ``ids(rep)``: distinct shingles and weights as bytes, a written table."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offs in words.slices(b.column("text")):
                of, g, c, _, _ = shingles(data, offs)
                w = weights(c).astype("<f4")
                edge = np.searchsorted(of, np.arange(to - at + 1))
                cut = list(zip(edge, edge[1:], strict=False))
                yield pa.record_batch(
                    [b.column("doc_id").slice(at, to - at), pa.array(np.diff(edge)), pa.array([bool(j == i or w[i:j].min() == w[i:j].max()) for i, j in cut]), pa.array([g[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([w[i:j].tobytes() for i, j in cut], pa.binary())],
                    ["rep", "n", "uniform", "g", "w"],
                )

    few = bounded(ids, BROADCAST_ROWS)
    texts = documents.select("doc_id", "text").join(few, F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", "text")
    return written(texts.mapInArrow(run, f"rep {id_type}, n bigint, uniform boolean, g binary, w binary").distinct(), "near-sets")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs(a, b)`` those whose likeness reaches the threshold, as a written table."""
    id_type = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.give_back()
        for batch in batches:
            good = []
            for r in zip(*[batch.column(c) for c in ("g", "w", "g2", "w2")], strict=True):
                a, x, b, y = (np.frombuffer(v.as_buffer(), t) for v, t in zip(r, ("<u8", "<f4", "<u8", "<f4"), strict=True))
                good.append(likeness(a, x.astype(float), b, y.astype(float)) >= threshold)
            yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("rep").alias("a"), "g", "w"), sets.select(F.col("rep").alias("b"), F.col("g").alias("g2"), F.col("w").alias("w2"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "g", "w", "g2", "w2")
    return written(both.mapInArrow(run, f"a {id_type}, b {id_type}").distinct(), "near-links")


def _shared_shingles(sets: DataFrame) -> DataFrame:
    """``rep, shared``: how many of a document's shingles another document of ``sets`` has too."""
    id_type = sets.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.give_back()
        for b in batches:
            for i, g in enumerate(b.column("g")):
                x = np.frombuffer(g.as_buffer(), "<i8")
                yield pa.record_batch([b.column("rep").take(pa.array(np.full(len(x), i))), pa.array(x)], ["rep", "h"])

    each = sets.select("rep", "g").mapInArrow(run, f"rep {id_type}, h bigint")
    twice = written(each.groupBy("h").count().where("count > 1").select("h"), "near-shared")
    return written(each.join(twice, "h", "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("shared")), "near-share")


def _classes(links: DataFrame, name: str) -> DataFrame:
    return written(connected_components(links), name).select(F.col("node").alias("rep"), F.col("component").alias("class"))


def near_classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Classes of near duplicates: ``doc_id, class_id`` for each row of ``documents(doc_id, text)``.

    Two documents are linked when the probability Jaccard likeness of their weighted
    shingles reaches the threshold; where no shingle repeats within either, that is the
    Jaccard likeness of the sets. ``class_id`` is the least doc_id of those that links,
    or equal sequences of words, connect.

    A null text counts as empty; texts without words are copies of each other. Rows of
    one id are one document and share its class. A null doc_id has no class (null). Case
    of A-Z and the kind of white space make no difference. An empty table gives no rows.
    Other columns are ignored.
    """
    small_batches(documents.sparkSession)
    signed = _signed(documents)
    reps = written(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "near-reps")
    each = reps.select("rep", F.explode("bands").alias("key"))
    buckets = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("leader")).where("size > 1").drop("size"), "near-buckets")
    members = written(each.join(buckets, "key").where("rep <> leader"), "near-members")
    pairs = members.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    ids = written(members.select("rep").union(members.select("leader")).distinct(), "near-ids")
    sets = _sets(documents, ids)
    links = _verified(pairs, sets, threshold)
    classes = _settled(members.select("key", "rep"), sets, links, threshold)
    labels = written(reps.select("digest", "rep").join(classes, "rep", "left").select("digest", F.coalesce("class", "rep").alias("class")), "near-labels")
    known = signed.select("doc_id", "digest").join(labels, "digest").select("doc_id", F.col("class").alias("class_id"))
    null = documents.where("doc_id is null").select("doc_id", F.lit(None).cast(known.schema["class_id"].dataType).alias("class_id"))
    return known.unionByName(null)


def _settled(members: DataFrame, sets: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """The classes after comparing what the buckets' leaders left open.

    Open are the members of a bucket, its leader apart, that are not all in one class.
    Those that have too few shingles in common with any others leave. Buckets that share
    members are put together as one group, so that a pair is compared once; of a group,
    the members outside its largest class are compared with all, in blocks.
    """
    classes = _classes(links, "near-classes")
    of = members.join(classes, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    open_ = of.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    left = written(of.join(written(open_, "near-open"), "key", "left_semi"), "near-left")
    if left.isEmpty():
        return classes
    here = sets.join(left.select("rep").distinct(), "rep", "left_semi")
    share = here.select("rep", "n", "uniform").join(_shared_shingles(here), "rep", "left").fillna(0, ["shared"])
    wide = written(left.join(share, "rep"), "near-wide")
    least = written(wide.groupBy("key").agg(F.min("n").alias("least"), F.bool_and("uniform").alias("plain")), "near-least")
    # the most that any overlap can come to, against the smallest of the bucket
    could = F.col("shared") / (F.col("n") + F.col("least") - F.col("shared")) >= threshold
    left = written(wide.join(least, "key").where(~F.col("plain") | could).select("key", "rep", "class"), "near-could")
    open_ = left.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    left = written(left.join(written(open_, "near-open"), "key", "left_semi"), "near-left")
    if left.isEmpty():
        return classes
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    groups = written(connected_components(left.select(name("d", "rep").alias("a"), name("k", "key").alias("b"))), "near-groups")
    left = left.select("rep", "class").distinct().withColumn("node", name("d", "rep")).join(groups, "node").select(F.col("component").alias("part"), "rep", "class")
    left = written(left.join(sets, "rep"), "near-open-sets")
    sizes = left.groupBy("part", "class").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    main = sizes.groupBy("part").agg(F.max(F.struct("size", "class"))["class"].alias("main"), F.sum("size").alias("all"), F.sum("n").alias("all_n"))
    main = written(main.withColumn("blocks", F.greatest(F.ceil(F.col("all") / F.least(F.lit(float(BLOCK)), F.greatest(F.lit(float(LEAST_BLOCK)), F.col("all") / 8))), F.ceil(F.col("all_n") / BLOCK_SHINGLES)).cast("int")), "near-main")
    more = _compared(left.join(main.select("part", "main", "blocks"), "part"), threshold)
    return _classes(classes.selectExpr("rep as a", "class as b").unionByName(more), "near-classes")


def _compared(left: DataFrame, threshold: float) -> DataFrame:
    """Links that connect what is alike among the members of each part, as a written table.

    Rows of ``left`` have ``part, rep, class, main, blocks, n, g, w``. Members are dealt
    into blocks, those of the main class into blocks of their own; a task compares two
    blocks, of which one at least is not of the main class.
    """
    id_type = left.schema["rep"].dataType.simpleString()
    d = left.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("minor", (F.col("class") != F.col("main")).cast("int"))
    # blocks 0 to n-1 are minor, n to 2n-1 of the main class
    d = d.withColumn("block", F.col("block") + F.when(F.col("minor") == 1, 0).otherwise(F.col("blocks")))
    others = F.sequence(F.lit(0), F.when(F.col("minor") == 1, F.col("blocks") * 2 - 1).otherwise(F.col("blocks") - 1))
    d = d.withColumn("other", F.explode(others)).withColumn("cell", F.concat_ws(":", "part", F.least("block", "other"), F.greatest("block", "other")))

    def compare(t: pa.Table) -> pa.Table:
        rep, cls = t.column("rep").to_numpy(), t.column("class").to_numpy()
        none = pa.table({"a": t.column("rep").slice(0, 0), "b": t.column("rep").slice(0, 0)})
        if len(rep) < 2 or (cls == cls[0]).all():
            return none
        g = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("g")]
        w = [np.frombuffer(x.as_buffer(), "<f4").astype(float) for x in t.column("w")]
        alike = alike_pairs(g, w, threshold)
        words.give_back()
        label = np.arange(len(rep))
        while True:  # the least number that links reach
            new = np.minimum(label, np.where(alike, label[None, :], len(rep)).min(axis=1))
            if (new == label).all():
                break
            label = new
        on = label != np.arange(len(rep))
        return pa.table({"a": pa.array(rep[label[on]]), "b": pa.array(rep[on])})

    got = d.select("cell", "rep", "class", "g", "w").groupBy("cell").applyInArrow(compare, f"a {id_type}, b {id_type}")
    return written(got.distinct(), "near-more")


def alike_pairs(g: list[np.ndarray], w: list[np.ndarray], threshold: float, columns: int = 4096) -> np.ndarray:
    """Which of some documents, given by sorted shingles and weights, reach the threshold with which: a square of booleans."""
    n, sizes = len(g), np.array([len(x) for x in g], float)
    of = np.repeat(np.arange(n), sizes.astype(int))
    u, at, times = np.unique(np.concatenate(g), return_inverse=True, return_counts=True)
    weight = np.concatenate(w)
    keep = times[at] > 1  # a shingle of one document is in no overlap
    number = np.cumsum(times > 1) - 1
    of, at, weight = of[keep], number[at[keep]], weight[keep]
    order = np.argsort(at, kind="stable")
    of, at, weight = of[order], at[order], weight[order]
    overlap, mass = np.zeros((n, n)), np.zeros((n, n))
    plain = np.array([len(x) == 0 or x.min() == x.max() for x in w])
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        a, b = np.searchsorted(at, (lo, lo + columns))
        x = np.zeros((n, columns), "f4")
        x[of[a:b], at[a:b] - lo] = 1
        overlap += x @ x.T
        if not plain.all():
            y = np.zeros((n, columns), "f4")
            y[of[a:b], at[a:b] - lo] = weight[a:b]
            mass += y @ x.T
    out = overlap / np.maximum(sizes[:, None] + sizes[None, :] - overlap, 1) >= threshold
    if not plain.all():
        # a likeness is at most the share of either's weight that the other has
        share = mass / np.maximum(np.array([x.sum() for x in w]), 1e-9)[:, None]
        odd = ~(plain[:, None] & plain[None, :])
        maybe = odd & (share >= threshold - 1e-5) & (share.T >= threshold - 1e-5)
        out[odd] = False
        for i, j in zip(*np.nonzero(np.triu(maybe, 1)), strict=True):
            out[i, j] = out[j, i] = likeness(g[i], w[i], g[j], w[j]) >= threshold
    np.fill_diagonal(out, False)
    return out


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
