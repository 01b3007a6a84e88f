"""Newest-n and best-n per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column], rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per group with their rank.

    The literal bound lets Spark cut every map task to ``n`` rows per group before
    the shuffle, so a group holding most of the data still ships only ``n`` per task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def newest(df: DataFrame, n: int, time: str = "created_at", by: Sequence[str] = ("project_id",)) -> DataFrame:
    return top_n(df, n, by, [F.col(time).desc_nulls_first(), F.col("id").asc()])


def by_priority(*, tie: str = "created_at") -> list[Column]:
    """Priority descending with unset priorities first, then oldest first."""
    return [F.col("priority").desc_nulls_first(), F.col(tie).asc_nulls_last(), F.col("id").asc()]
