"""Updates, deletes and upserts as joins, and the fold of a change log."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import empty_to_null, token_estimate
from memlake.schemas import BRIEF_FIELDS, UPDATABLE

# fixed values: recommended sizes of brief fields and of the whole brief
BRIEF_LIMITS = {
    "tech_stack": 500,
    "module_map": 500,
    "conventions": 500,
    "critical_constraints": 400,
    "entry_points": 500,
}
BRIEF_TOTAL_LIMIT = 2000


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert new keys; on known keys non-null incoming values win."""
    new = incoming.select(key, *[F.col(c).alias(f"_new_{c}") for c in incoming.columns if c != key])
    return current.join(new, key, "full_outer").select(
        key,
        *[
            (F.coalesce(f"_new_{c}", c) if c in incoming.columns else F.col(c)).alias(c)
            for c in current.columns
            if c != key
        ],
    )


def upsert_projects(current: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Register or refresh projects; ``incoming`` is (id, name, path, seq), last non-empty value wins."""
    def last(name: str) -> Column:
        value = empty_to_null(name)
        return F.max_by(value, F.when(value.isNotNull(), F.col("seq"))).alias(name)

    folded = incoming.groupBy("id").agg(last("name"), last("path"))
    stamped = folded.withColumn("last_accessed_at", as_of)
    merged = upsert(current, stamped, "id")
    return merged.withColumn("created_at", F.coalesce("created_at", as_of))


def upsert_brief(current: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """One brief per project; the last write replaces every field, absent ones included."""
    fields = ["project_name", *BRIEF_FIELDS]
    values = F.struct("seq", *[(F.col(c) if c == "project_name" else empty_to_null(c)).alias(c) for c in fields])
    new = incoming.groupBy("project_id").agg(F.max(values).alias("_b")).select(
        "project_id", *[F.col(f"_b.{c}").alias(c) for c in fields], as_of.alias("updated_at")
    )
    kept = current.join(new.select("project_id"), "project_id", "left_anti")
    return kept.select("project_id", *fields, "updated_at").unionByName(new)


def brief_warnings(df: DataFrame) -> DataFrame:
    """Size warnings per brief; sizes are advisory and nothing is rejected."""
    sizes = {f: F.length(F.coalesce(F.col(f), F.lit(""))) for f in BRIEF_LIMITS}
    total = reduce(lambda a, b: a + b, sizes.values())
    per_field = [
        F.when(size > BRIEF_LIMITS[f], F.concat(
            F.lit(f"{f}: "), size.cast("string"), F.lit(f" chars (recommended max: {BRIEF_LIMITS[f]}). Consider condensing.")))
        for f, size in sizes.items()
    ]
    whole = F.when(total > BRIEF_TOTAL_LIMIT, F.concat(
        F.lit("Total brief size: "), total.cast("string"), F.lit(" chars. This costs ~"),
        token_estimate(total).cast("string"),
        F.lit(" tokens on every session start. Consider using notes for extended details and keeping the brief concise."),
    ))
    return df.select(
        "project_id", total.alias("total_chars"), token_estimate(total).alias("tokens"),
        F.array_compact(F.array(*per_field, whole)).alias("warnings"),
    )


def _latest_set(changes: DataFrame, columns: Iterable[str], order: list[str]) -> list[Column]:
    """Per column the last value explicitly set, wrapped so that a set NULL differs from absent."""
    return [
        F.max(
            F.when(F.array_contains("set_fields", c), F.struct(*order, F.col(c).alias("value")))
        ).alias(f"_set_{c}")
        for c in columns
    ]


def apply_updates(
    current: DataFrame, changes: DataFrame, table: str, as_of: Column | None = None, order: tuple[str, ...] = ("seq",)
) -> DataFrame:
    """Partial updates: (id, project_id, seq, set_fields, values...).

    Only allow-listed columns named in ``set_fields`` change; rows of another project and
    unknown ids are left alone. Todos also get ``updated_at``.
    """
    columns = [c for c in UPDATABLE[table] if c in changes.columns and c in current.columns]
    allowed = F.array(*[F.lit(c) for c in columns])
    effective = changes.filter(F.arrays_overlap("set_fields", allowed))
    folded = effective.groupBy("id", "project_id").agg(
        *_latest_set(effective, columns, list(order)), F.lit(True).alias("_hit")
    )
    out = current.join(folded, ["id", "project_id"], "left")
    updated = {
        c: F.when(F.col(f"_set_{c}").isNotNull(), F.col(f"_set_{c}.value")).otherwise(F.col(c)) for c in columns
    }
    if table == "todos" and as_of is not None:
        updated["updated_at"] = F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at"))
    return out.withColumns(updated).select(*current.columns)


def complete_todos(current: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Mark (id, project_id) done; asking again moves ``completed_at``."""
    hit = F.col("_hit").isNotNull()
    marked = ids.select("id", "project_id", F.lit(True).alias("_hit")).distinct()
    return (
        current.join(marked, ["id", "project_id"], "left")
        .withColumns({
            "status": F.when(hit, "done").otherwise(F.col("status")),
            "completed_at": F.when(hit, as_of).otherwise(F.col("completed_at")),
            "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
        })
        .select(*current.columns)
    )


def delete_rows(
    current: DataFrame, vectors: DataFrame, ids: DataFrame, source_type: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining rows, remaining vector rows, ids with ``found``)."""
    keys = ids.select("id", "project_id").distinct()
    rest = current.join(keys, ["id", "project_id"], "left_anti")
    gone = keys.select(F.lit(source_type).alias("source_type"), F.col("id").alias("source_id"), "project_id")
    rest_vectors = vectors.join(gone, ["source_type", "source_id", "project_id"], "left_anti")
    present = current.select("id", "project_id", F.lit(True).alias("found"))
    report = keys.join(present, ["id", "project_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    return rest, rest_vectors, report


def deactivate(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete of instructions; their vector rows stay searchable."""
    marked = ids.select("id", "project_id", F.lit(True).alias("_hit")).distinct()
    off = F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("active"))
    return current.join(marked, ["id", "project_id"], "left").withColumn("active", off).drop("_hit").select(*current.columns)


def null_dangling(child: DataFrame, parent: DataFrame, fk: str) -> DataFrame:
    """Set links to rows that no longer exist to NULL."""
    keys = parent.select(F.col("id").alias(fk), F.lit(True).alias("_there"))
    kept = F.when(F.col("_there"), F.col(fk)).alias(fk)
    return child.join(keys, fk, "left").select(*[kept if c == fk else F.col(c) for c in child.columns])


def session_counts(sessions: DataFrame, snapshot_inserts: DataFrame) -> DataFrame:
    """Sessions with the number of snapshots ever inserted for them."""
    counts = (
        snapshot_inserts.filter(F.col("session_id").isNotNull())
        .groupBy(F.col("session_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("snapshot_count"))
    )
    return sessions.drop("snapshot_count").join(counts, "id", "left").withColumn(
        "snapshot_count", F.coalesce("snapshot_count", F.lit(0)).cast("int")
    )


def fold_changes(log: DataFrame, columns: list[str], order: tuple[str, ...] = ("changed_at", "change_id")) -> DataFrame:
    """One row per id: the last insert, delete, completion and touch, and the last set of each column.

    All are maxima in log order, so folding parts of a log and then the parts together gives
    the same as folding it whole, whatever came late or twice. Everything combines on the map
    side, so a busy id ships one row per task.
    """
    at = F.struct(*order)
    is_set = F.col("op") == "update"
    sets = [
        F.max(F.when(is_set & F.array_contains("set_fields", c), F.struct(at.alias("at"), F.col(c).alias("value")))).alias(f"_set_{c}")
        for c in columns
    ]
    return log.groupBy("id", "project_id").agg(
        F.max(F.when(F.col("op") == "insert", F.struct(at.alias("at"), *columns))).alias("_base"),
        F.max(F.when(F.col("op") == "delete", at)).alias("_deleted"),
        F.max(F.when(F.col("op") == "complete", at)).alias("_completed"),
        F.max(F.when(is_set | (F.col("op") == "complete"), at)).alias("_touched"),
        *sets,
    )


def current_state(
    log: DataFrame, columns: list[str], as_of: Column | None = None, order: tuple[str, ...] = ("changed_at", "change_id")
) -> DataFrame:
    """Rows alive after replaying a change log of inserts, updates, completions and deletes.

    One aggregate per id: the last insert is the base row if no delete follows it, and a
    column takes its last set value if that is later than the base. Changes of ids that are
    not alive do nothing.
    """
    if as_of is not None:
        log = log.filter(F.col(order[0]) <= as_of)
    folded = fold_changes(log, columns, order)
    alive = folded.filter(
        F.col("_base").isNotNull() & (F.col("_deleted").isNull() | (F.col("_deleted") < F.col("_base.at")))
    )
    base_at = F.col("_base.at")
    done = F.col("_completed") > base_at

    def value(c: str) -> Column:
        late = F.col(f"_set_{c}.at") > base_at
        out = F.when(late, F.col(f"_set_{c}.value")).otherwise(F.col(f"_base.{c}"))
        if c == "status":
            done_last = done & (~F.coalesce(late, F.lit(False)) | (F.col("_completed") > F.col(f"_set_{c}.at")))
            out = F.when(done_last, F.lit("done")).otherwise(out)
        return out.alias(c)

    time = order[0]
    return alive.select(
        "id", "project_id", *[value(c) for c in columns],
        F.col(f"_base.at.{time}").alias("created_at"),
        F.when(F.col("_touched") > base_at, F.col(f"_touched.{time}")).otherwise(F.col(f"_base.at.{time}")).alias("updated_at"),
        F.when(done, F.col(f"_completed.{time}")).alias("completed_at"),
    )


def prune(
    vectors: DataFrame, as_of: Column, older_than_days: int, keep: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(kept vector rows, pruned count per project); rows without tags survive if ``keep`` is given."""
    from memlake.functions.predicates import has_no_tag, older_than

    gone = older_than("created_at", as_of, older_than_days)
    if keep:
        gone = gone & has_no_tag(keep)
    gone = F.coalesce(gone, F.lit(False))
    counts = vectors.groupBy("project_id").agg(F.count_if(gone).alias("pruned"))
    return vectors.filter(~gone), counts


# fixed order of deletion; a project is gone from the registry last
PROJECT_TABLES = [
    "memory_embeddings", "todos", "notes", "error_patterns", "instructions", "project_brief", "snapshots", "sessions",
    "projects",
]


def delete_projects(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(remaining tables, deleted row counts per project and table)."""
    keys = ids.select("project_id").distinct()
    rest, counted = {}, []
    for name in PROJECT_TABLES:
        if name not in tables:
            continue
        df = tables[name]
        key = "id" if name == "projects" else "project_id"
        gone = keys.withColumnRenamed("project_id", key)
        rest[name] = df.join(gone, key, "left_anti")
        counted.append(df.groupBy(F.col(key).alias("project_id")).agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit(name)))
    counts = reduce(DataFrame.unionByName, counted)
    wide = keys.join(counts, "project_id", "left").groupBy("project_id").pivot("tbl", PROJECT_TABLES).agg(F.sum("n"))
    return rest, wide.na.fill(0, PROJECT_TABLES)
