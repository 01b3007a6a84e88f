"""Filter conditions shared by the reports and searches."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import days, hours


def eq(**values: object) -> Column:
    """Equality on each given column; None values are left out."""
    return all_of(*[F.col(name) == F.lit(value) for name, value in values.items() if value is not None])


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are present."""
    present = [c for c in conditions if c is not None]
    return reduce(and_, present) if present else F.lit(True)


def is_open(status: str = "status") -> Column:
    return F.col(status) != "done"


def is_active(active: str = "active") -> Column:
    """A filter's condition: NULL is dropped like false, and the bare column reaches the parquet scan."""
    return F.col(active)


def is_completed(completed_at: str = "completed_at") -> Column:
    return F.col(completed_at).isNotNull()


def _texts(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def has_any_tag(tags: Iterable[str], col: str = "tags") -> Column:
    # NULL elements would turn "no overlap" into NULL
    return F.arrays_overlap(F.array_compact(F.col(col)), _texts(tags))


def has_no_tag(tags: Iterable[str], col: str = "tags") -> Column:
    """NULL tags give NULL, that is: not matched."""
    return ~has_any_tag(tags, col)


def mentions(arr: str, value: str) -> Column:
    return F.array_contains(F.col(arr), value)


def newer_than(col: str, as_of: Column, n_hours: int) -> Column:
    return F.col(col) > as_of - hours(n_hours)


def older_than(col: str, as_of: Column, n_days: int) -> Column:
    return F.col(col) < as_of - days(n_days)


def above(similarity: Column, threshold: float) -> Column:
    return similarity > F.lit(threshold)


def project(df: DataFrame, spec: dict[str, str | Column]) -> DataFrame:
    """Select and rename: ``{output name: column}``."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in spec.items()])


def timestamp(value: str) -> Column:
    """Time literal without zone, as the tables hold it."""
    return F.to_timestamp_ntz(F.lit(value))
