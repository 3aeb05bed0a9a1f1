"""One-row aggregates (min/max spans, totals, quantiles) attached to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add every column of ``one_row`` (an aggregate without grouping, at
    most one row) to ``df`` through one uncorrelated scalar subquery: Spark
    runs the aggregate once, before the main query, and inlines its values
    (NULL when ``one_row`` is empty). No join is planned."""
    cols = one_row.columns
    packed = one_row.select(F.struct(*cols).alias("_scalars")).scalar()
    return df.select("*", packed.alias("_scalars")).select(
        *[F.col(c) for c in df.columns], *[F.col("_scalars").getField(c).alias(c) for c in cols])
