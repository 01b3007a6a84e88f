"""Input typing, defaults and value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.schemas import ALLOWED, COLUMNS, DEFAULTS, RANGES, REQUIRED


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill defaults; empty texts count as absent, empty arrays do not."""
    changes: dict[str, Column] = {}
    for name in df.columns:
        kind = COLUMNS[table].get(name)
        if kind == "text" and not isinstance(df.schema[name].dataType, T.StringType):
            kind = "key"
        value = F.col(name)
        if kind == "text" and name not in REQUIRED[table]:
            value = F.nullif(value, F.lit(""))
        if name in DEFAULTS.get(table, {}):
            base = F.nullif(F.col(name), F.lit("")) if kind == "text" else value
            value = F.coalesce(base, F.lit(DEFAULTS[table][name]))
        elif kind == "texts":
            value = F.coalesce(value, F.array().cast("array<string>"))
        changes[name] = value
    return df.withColumns(changes)


def _reasons(df: DataFrame, table: str) -> Column:
    rules = [F.when(F.col(c).isNull(), f"{c} missing") for c in REQUIRED[table] if c in df.columns]
    for name, values in ALLOWED.get(table, {}).items():
        if name in df.columns:
            rules.append(F.when(~F.col(name).isin(values), f"{name} not allowed"))
    for name, (low, high) in RANGES.get(table, {}).items():
        if name in df.columns:
            rules.append(F.when(~F.col(name).between(low, high), f"{name} out of range"))
    return F.array_compact(F.array(*rules))


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with their ``reasons``)."""
    checked = with_defaults(df, table).withColumn("reasons", _reasons(df, table))
    ok = checked.filter(F.size("reasons") == 0).drop("reasons")
    return ok, checked.filter(F.size("reasons") > 0)


def validate_updates(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Like ``validate`` for partial updates: only the columns named in ``set_fields`` are checked."""
    def when_set(name: str, broken: Column, reason: str) -> Column:
        return F.when(F.array_contains("set_fields", name) & broken, reason)

    rules = [when_set(c, F.col(c).isNull(), f"{c} missing") for c in REQUIRED[table] if c in df.columns]
    for name, values in ALLOWED.get(table, {}).items():
        if name in df.columns:
            rules.append(when_set(name, ~F.col(name).isin(values), f"{name} not allowed"))
    for name, (low, high) in RANGES.get(table, {}).items():
        if name in df.columns:
            rules.append(when_set(name, ~F.col(name).between(low, high), f"{name} out of range"))
    checked = df.withColumn("reasons", F.array_compact(F.array(*rules)))
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def to_number(text: Column) -> Column:
    """Number from text; blank text is 0, anything else unreadable is NULL."""
    return F.when(F.trim(text) == "", F.lit(0.0)).otherwise(text.try_cast("double"))


def to_texts(text: Column) -> Column:
    """Array of strings from its JSON text; NULL unless every element is a string."""
    whole = r'^\s*\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$'
    return F.when(text.rlike(whole), F.from_json(text, T.ArrayType(T.StringType())))


def coerce(df: DataFrame, numbers: list[str], arrays: list[str]) -> tuple[DataFrame, DataFrame]:
    """Turn text columns into numbers and arrays; (accepted, rejected with ``reasons``)."""
    converters = {**{c: to_number for c in numbers}, **{c: to_texts for c in arrays}}
    bad = [
        F.when(F.col(c).isNotNull() & converter(F.col(c)).isNull(), f"{c} not readable")
        for c, converter in converters.items()
    ]
    tagged = df.withColumn("reasons", F.array_compact(F.array(*bad)))
    good = tagged.filter(F.size("reasons") == 0).drop("reasons")
    return (
        good.withColumns({c: converter(F.col(c)) for c, converter in converters.items()}),
        tagged.filter(F.size("reasons") > 0),
    )
