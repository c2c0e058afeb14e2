"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies each of its documents should
get. Whole copies are certain; the rest is a sample without replacement of unequal
inclusion chances, which grow with a document's size up to 1 and are such that the words
expected are the rest. Documents with a chance of 1 are certain again. The others are
ranked by their random odds over their inclusion odds, and the lowest ranks are taken
until the words of the rest are reached. Chances are solved on a summary of sizes, and
where the sample ends is found from sums over bins of ranks, so no task holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.shared import bounded, written

WEIGHTS, MOST = (5, 2, 1), 3
#: Documents of about this many words or fewer have clearly lower inclusion chances.
SHORT_WORDS = 50
BINS, SEED = 4096, "mix-1"


def words_in(text: Column) -> Column:
    """The number of runs without white space in a text; 0 for null."""
    words = F.size(F.split(text, r"[\x20\x09-\x0D]+", -1)).cast("bigint")
    outer = F.when(text.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    return F.when(text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(0).cast("bigint")).otherwise(words - outer)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, a row a source.

    Sources by code point, null last, take the weights in turn and share the sum of all
    sizes by weight. No target exceeds ``most`` times its source's size; what is over is
    shared again among the others, until none is above. The table has one row a source,
    so its windows are over a summary, not over documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    # sources reach their bound in the order of size over weight; k counts them
    s = s.withColumn("k", F.row_number().over(Window.orderBy(F.col("source_size") / F.col("w"), "k")))
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bound = F.col("source_size") * F.lit(float(most))
    left = F.sum(F.col("source_size").cast("double")).over(every.partitionBy()) - F.coalesce(F.sum(bound).over(before), F.lit(0.0))
    s = s.withColumns({"rate": left / F.sum("w").over(after), "bound": bound})
    free = F.col("rate") * F.col("w") <= F.col("bound")
    # the rate of the first source that stays below its bound holds for all after it
    rate = F.min(F.when(free, F.struct("k", "rate"))).over(every.partitionBy())
    target = F.when(rate.isNotNull() & (F.col("k") >= rate["k"]), rate["rate"] * F.col("w")).otherwise(F.col("bound"))
    return s.select("source", "source_size", F.round(F.least(target, F.col("bound")), 6).alias("target"))


def _uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 48)


def _rounded(size: Column) -> Column:
    """A size rounded down to three binary digits: few values, whatever the sizes."""
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - 3, F.lit(0))).cast("bigint")
    return size - size % step


def _share(rounded: Column, short_words: float) -> Column:
    """What an inclusion chance is in proportion to."""
    return rounded / (rounded + F.lit(float(short_words)))


def inclusion_rates(summary: DataFrame) -> DataFrame:
    """``source, certain, rate`` from ``source, share, words, rest``, a row for each source and share.

    A document's chance is ``min(1, rate * share)``, so that the words expected are the
    rest; ``certain`` is the words of those with a chance of 1. The windows are over a
    summary of at most four shares to a doubling of sizes.
    """
    by = Window.partitionBy("source").orderBy(F.desc("share"))
    above = F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("share") * F.col("words")).over(by.rowsBetween(0, Window.unboundedFollowing))
    s = summary.where("share > 0").withColumns({"certain": above, "rate": (F.col("rest") - above) / below})
    # the largest shares have a chance of 1; the first rate that gives no more than 1 holds
    fits = s.where(F.col("rate") * F.col("share") <= 1).withColumn("first", F.row_number().over(by))
    return fits.where("first = 1").select("source", "certain", "rate")


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, short_words: float = SHORT_WORDS, seed: str = SEED) -> DataFrame:
    """How often each document goes into the mix.

    Reads ``doc_id, text, source`` of ``documents`` and returns ``doc_id, source, size,
    source_size, target, chance, copies, taken``: ``chance`` is that of a copy beyond the
    whole ones (approximate where one document is a large part of a source's rest, as the
    sample ends at a number of words), ``taken`` = ``copies`` x ``size``, the words that
    the mix takes of the document. A source's taken words differ from its target by at most the size of one
    document.

    A null text counts as empty; documents without words are taken 0 times. Null is a
    source, the last. Ids should be unique: rows with one id share a random number and
    so stand or fall by size; ties are broken by size, and equal rows are interchangeable.
    An empty table gives no rows. Other columns are ignored. Reruns agree.
    """
    size = F.col("size")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    few = bounded
    d = documents.select("doc_id", "source", words_in(F.col("text")).alias("size"))
    d = written(d.withColumns({"u": _uniform(F.col("doc_id"), seed), "share": _share(_rounded(size), short_words)}), "mix-sizes")
    summary = written(d.groupBy("source", "share").agg(F.sum("size").alias("words")), "mix-summary")
    t = source_targets(summary.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int"))
    t = written(t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "of"), "mix-targets")
    rates = inclusion_rates(summary.join(few(t.select("of", "rest")), same("source", "of")).drop("of")).withColumnRenamed("source", "of2")
    t = written(t.join(few(written(rates, "mix-rates")), same("of", "of2"), "left").drop("of2"), "mix-rated")
    d = d.join(few(t), same("source", "of")).drop("of")
    chance = F.when((size > 0) & (F.col("rest") > 0), F.least(F.lit(1.0), F.col("rate") * F.col("share"))).otherwise(0.0)
    d = d.withColumn("chance", chance)
    rank = F.when((F.col("chance") > 0) & (F.col("chance") < 1), (F.col("u") / (1.0 - F.col("u"))) / (F.col("chance") / (1.0 - F.col("chance"))))
    d = d.withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") / (1.0 + F.col("rank")) * BINS))
    # the bin in which a source's running sum of words passes the rest
    bins = d.where("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("certain").alias("certain"), F.first("rest").alias("rest"))
    bins = bins.withColumn("before", F.col("certain") + F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words"))
    cut = bins.where("before < rest and before + words >= rest").select(F.col("source").alias("of"), F.col("bin").alias("cut"), "before")
    d = d.join(few(written(cut, "mix-cuts")), same("source", "of"), "left").drop("of")
    # inside the bin, a few thousandths of a source, documents are taken one by one
    inside = d.where("bin = cut")
    running = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("upto", F.col("before") + running)
    # the document at the point goes in when that brings the sum nearer
    extra = F.when((F.col("upto") <= F.col("rest")) | ((F.col("upto") - size < F.col("rest")) & (F.col("upto") - F.col("rest") < F.col("rest") - F.col("upto") + size)), 1).otherwise(0)
    inside = inside.withColumn("extra", extra)
    # without a cut the certain ones alone reach the rest, or all together don't
    goes = (F.col("chance") >= 1) | (F.col("bin") < F.col("cut")) | (F.col("bin").isNotNull() & F.col("cut").isNull() & (F.col("certain") < F.col("rest")))
    outside = d.where("bin is null or cut is null or bin <> cut").withColumn("extra", F.when(goes, 1).otherwise(0))
    keep = ["doc_id", "source", "size", "source_size", "target", "chance", "whole", "extra"]
    d = outside.select(keep).unionByName(inside.select(keep))
    copies = F.when(size > 0, F.col("whole") + F.col("extra")).otherwise(0)
    return d.select("doc_id", "source", "size", "source_size", "target", "chance", copies.cast("int").alias("copies"), (copies * size).cast("bigint").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_SQL_U = f"((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r}::DOUBLE)"
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, n) AS k, source_size * 3.0::DOUBLE AS bound FROM w),
r AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(bound) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM o),
f AS (SELECT min(k) AS first, arg_min(rate, k) AS rate FROM r WHERE rate * w <= bound),
t AS (SELECT source, source_size, round(least(CASE WHEN k >= first THEN f.rate * w ELSE bound END, bound), 6) AS target FROM r LEFT JOIN f ON true),
c AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::INT AS whole FROM t),
e AS (SELECT *, size - size % (2 ** greatest(length(bin(size)) - 3, 0))::BIGINT AS r FROM d),
h AS (SELECT source, r / (r + {SHORT_WORDS}.0::DOUBLE) AS share, sum(size)::BIGINT AS words FROM e WHERE size > 0 GROUP BY ALL),
i AS (SELECT h.*, target - whole * source_size AS rest FROM h JOIN c ON h.source IS NOT DISTINCT FROM c.source),
j AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY share DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS certain,
  sum(share * words) OVER (PARTITION BY source ORDER BY share DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS below FROM i),
l AS (SELECT source, max(share) AS share, arg_max((rest - certain) / below, share) AS rate, arg_max(certain, share) AS certain FROM j WHERE (rest - certain) / below * share <= 1 GROUP BY 1),
m AS (SELECT e.*, source_size, target, whole, target - whole * source_size AS rest, l.certain, CASE WHEN size > 0 AND target - whole * source_size > 0 THEN least(1.0, rate * (r / (r + {SHORT_WORDS}.0::DOUBLE))) ELSE 0 END AS chance
  FROM e JOIN c ON e.source IS NOT DISTINCT FROM c.source LEFT JOIN l ON e.source IS NOT DISTINCT FROM l.source),
q AS (SELECT *, CASE WHEN chance >= 1 THEN 0 WHEN chance > 0 THEN ({_SQL_U} / (1.0::DOUBLE - {_SQL_U})) / (chance / (1.0::DOUBLE - chance)) END AS rank FROM m),
g AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN chance >= 1 OR rank IS NOT NULL AND (upto <= rest OR (upto - size < rest AND upto - rest < rest - upto + size)) THEN 1 ELSE 0 END) END::BIGINT AS taken FROM g
"""
