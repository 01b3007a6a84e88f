"""Text helpers as native column expressions (lengths count code points)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(text: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(_c(text), _EDGE_SPACE, "")


def empty_to_null(text: Column | str) -> Column:
    return F.nullif(_c(text), F.lit(""))


def truncate_text(text: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, dots included; NULL gives an empty text."""
    text = _c(text)
    short = F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    return F.coalesce(F.when(F.length(text) <= limit, text).otherwise(short), F.lit(""))


def summary_line(text: Column | str, limit: int = 120) -> Column:
    """First line, trimmed and truncated."""
    return truncate_text(strip(F.split(_c(text), r"[\n\r]")[0]), limit)


def preview(text: Column | str, length: int) -> Column:
    return F.substring(_c(text), 1, length)


def ellipsis(text: Column | str, length: int = 120) -> Column:
    """``length`` characters, then dots if something was cut."""
    text = _c(text)
    return F.concat(F.substring(text, 1, length), F.when(F.length(text) > length, "...").otherwise(""))


def escape_like(text: Column | str) -> Column:
    r"""Put a backslash before ``%``, ``_`` and ``\`` so LIKE takes them literally."""
    return F.regexp_replace(_c(text), r"([%_\\])", r"\\$1")


def icontains(text: Column | str, part: Column | str) -> Column:
    """Case-insensitive literal substring test."""
    return F.contains(F.lower(_c(text)), F.lower(_c(part)))


def join_non_empty(*parts: Column | str, sep: str = ". ") -> Column:
    return F.concat_ws(sep, *[empty_to_null(p) for p in parts])


def first_non_null(new: Column | str, old: Column | str) -> Column:
    return F.coalesce(_c(new), _c(old))


def array_union_ordered(old: Column | str, new: Column | str) -> Column:
    """Union keeping first-seen order; NULL counts as empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(_c(old), none), F.coalesce(_c(new), none)))


def json_text(value: Column | str) -> Column:
    """JSON text of an array, map or struct."""
    return F.to_json(_c(value))


def project_key(path: Column | str) -> Column:
    """Project id of a working folder: 12 hex digits of its hash."""
    return F.substring(F.sha2(_c(path), 256), 1, 12)


def split_tags(text: Column | str) -> Column:
    """Comma-separated tags, neither trimmed nor filtered."""
    return F.split(_c(text), ",")


def days(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(n).cast("int") if isinstance(n, int) else n.cast("int"))


def hours(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n).cast("int") if isinstance(n, int) else n.cast("int"))


def window_hours(raw: Column) -> Column:
    """Whole hours of a look-back window, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(raw))


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / 4)


def heading_text(line: Column) -> Column:
    """Title of a level 1-3 markdown heading line, NULL on other lines."""
    found = F.regexp_extract(line, r"(?s)^#{1,3}\s+(.+)$", 1)
    return strip(empty_to_null(found))
