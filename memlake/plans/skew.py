"""Splitting of hot join keys.

A key that holds more rows than one task should see is spread over ``splits``
salts: the spread side picks one salt per row, the other side is repeated once per
salt. Which keys are hot is counted exactly, so every other key pays nothing. The
list of hot keys is cut to a fixed length before it is broadcast; that cut bounds
the broadcast and never changes a result, because salting only moves rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 65_536
SPLITS = "_splits"
SALT = "_salt"


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int) -> DataFrame:
    """Keys of ``df`` with more than ``rows_per_task`` rows and their number of splits."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_task)
        .orderBy(F.desc("_n"), *keys)
        .limit(MAX_HOT_KEYS)
        .select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias(SPLITS))
    )


def spread(df: DataFrame, hot: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """Add the salt column, one salt per row, chosen by a hash of ``by``."""
    return (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn(SALT, F.pmod(F.xxhash64(by), F.coalesce(SPLITS, F.lit(1))).cast("int"))
        .drop(SPLITS)
    )


def repeat(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Repeat each row once per salt of its key."""
    return (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(SPLITS, F.lit(1)) - 1)))
        .drop(SPLITS)
    )
