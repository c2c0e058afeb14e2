"""Scans, filters, projections, aggregates and limits as DataFrame operations, plus their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def scan(df: DataFrame, columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """Filter, then project; no columns named means all. Unknown names raise."""
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def _fixed(column: Column, digits: int) -> Column:
    """A number as a whole number of its last decimal place."""
    return F.floor(column * float(10**digits) + 0.5).cast("bigint")


def aggregate(df: DataFrame, aggregates: list[tuple[str, str, str | None]], group_by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """``(function, column or *, name)`` by the group columns; the name is ``FUNC(col)`` by default.

    With ``digits`` sums and means are those of fixed-point numbers with so many decimal
    places: exact, so that the order in which partitions arrive makes no difference.

    Without group columns there is one row, also for an empty input. Without aggregates
    the distinct groups are returned.
    """
    columns = []
    for name, column, alias in aggregates:
        if name.upper() not in AGGREGATES:
            raise ValueError(f"unknown aggregate {name}")
        if column == "*" and name.upper() != "COUNT":
            raise ValueError("* is for COUNT only")
        f = AGGREGATES[name.upper()]
        if digits is not None and name.upper() in ("SUM", "AVG"):
            total = F.sum(_fixed(F.col(column), digits)).cast("double") / float(10**digits)
            columns.append((total / F.count(column) if name.upper() == "AVG" else total).alias(alias or f"{name.upper()}({column})"))
            continue
        columns.append(f(F.lit(1) if column == "*" else F.col(column)).alias(alias or f"{name.upper()}({column})"))
    if not columns:
        return df.select(*group_by).distinct()
    return df.groupBy(*group_by).agg(*columns) if group_by else df.agg(*columns)


def coerce_number(column: Column) -> Column:
    """Any cell as a double; what is no number becomes 0."""
    return F.coalesce(column.try_cast("double"), F.lit(0.0))


def limit(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows, by ``order`` where given (else any)."""
    return (df.orderBy(*order) if order else df).limit(n)
