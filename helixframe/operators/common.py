"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_struct(one_row: DataFrame) -> Column:
    """All columns of a one-row DataFrame as one struct scalar subquery."""
    return one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()


def zip_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Side-by-side concatenation of one-row aggregates (scalar subqueries, no join)."""
    cols = [F.col(c) for c in first.columns]
    for o in others:
        s = scalar_struct(o)
        cols += [s.getField(c).alias(c) for c in o.columns]
    return first.select(*cols)


def r6(c) -> Column:
    """Round to 6 decimals and turn -0.0 into 0.0 (oracle comparisons)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)
