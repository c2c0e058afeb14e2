"""Distributed connected components by alternating large-star and small-star steps.

Edges stay in DataFrames and in written tables; the driver sees one count a round.
Every step takes minima after map-side pre-aggregation and joins them back to the
edges, so a node with a third of all edges is split by skewed-join handling: no
task ever holds the neighbours of a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.shared import discard, written


def _minima(pairs: DataFrame) -> DataFrame:
    """Per node ``u`` the least of itself and its neighbours, as a written table."""
    return written(pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m")), "cc-min")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each node of ``edges(a, b)`` with the least node it is connected to.

    Returns ``node, component`` for every node of an edge. Nulls in either column
    and loops are no edges; repeated edges count once; an empty table gives no rows.
    Columns other than ``a`` and ``b`` are not read. Node values may be of any
    ordered type.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _minima(both)
        large = written(both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        m2 = _minima(large)
        small = large.join(m2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(m2.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        small = written(small, "cc-small")
        # done when each node points once and to a node that points nowhere
        tips = small.select("v").join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        twice = small.groupBy("u").count().where("count > 1").select("u")
        settled = tips.isEmpty() and twice.isEmpty()
        discard(e, m, large, m2)
        e = small
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return roots.unionByName(e.select(F.col("u").alias("node"), F.col("v").alias("component")))
