"""Join shapes the reports and searches are made of.

No join here carries a broadcast hint: the planner broadcasts a side only when its
size statistics allow it, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_counts(base: DataFrame, counts: dict[str, DataFrame], key: str = "project_id") -> DataFrame:
    """Add one count column per table, 0 where a key has no rows."""
    for name, table in counts.items():
        counted = table.groupBy(key).agg(F.count(F.lit(1)).alias(name))
        base = base.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return base


def resolve_sources(hits: DataFrame, table: DataFrame, source_type: str) -> DataFrame:
    """Source rows of vector hits of one source type."""
    rows = table.drop("project_id").withColumnRenamed("id", "source_id")
    return hits.filter(F.col("source_type") == source_type).join(rows, "source_id")


def minus_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def join_member(df: DataFrame, arr: str, keys: DataFrame, member: str = "path", on: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Rows whose array column holds a key; one row per distinct element."""
    exploded = df.withColumn(member, F.explode(F.array_distinct(arr)))
    return exploded.join(keys, [*on, member])


def join_pairs(table: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Both sides of (project_id, id1, id2), NULL where a side is missing."""
    def side(n: int) -> DataFrame:
        return table.select(
            "project_id", F.col("id").alias(f"id{n}"), F.lit(True).alias(f"_there{n}"), *[F.col(c).alias(f"{c}_{n}") for c in columns]
        )

    return pairs.join(side(1), ["project_id", "id1"], "left").join(side(2), ["project_id", "id2"], "left")


def pair_queries(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """``query_id``, ``id`` and ``project_id``: each query with every stored vector row of its project, for small query sets."""
    return memory.select("id", "project_id").join(queries.select("query_id", "project_id"), "project_id").select("query_id", "id", "project_id")


def queries_per_row(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """How many queries each stored row has to answer; the pairs themselves are not made."""
    asked = queries.groupBy("project_id").agg(F.count(F.lit(1)).alias("asked"))
    return memory.select("id", "project_id").join(asked, "project_id")
