"""Per-project reports.

A report is a long table: one row per list element with its ``section``. Lists of
limited length carry a ``rank``; lists without limit (all open tasks, all active
instructions) carry the sort keys instead, because numbering them would gather a
whole project in one task. The last step of a plain list is a global, range
partitioned sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.predicates import all_of, eq, has_any_tag, is_active, is_completed, is_open, newer_than
from memlake.functions.text import (
    ellipsis,
    empty_to_null,
    json_text,
    preview,
    summary_line,
    truncate_text,
    window_hours,
)
from memlake.operators.joins import join_member, join_pairs, with_counts
from memlake.plans.ranking import by_priority, newest, top_n
from memlake.schemas import BRIEF_FIELDS

TODO_STATUSES = ["todo", "in_progress", "blocked", "done"]
SNAPSHOT_FIELDS = ["summary", "architecture_notes", "module_focus", "assumptions", "constraints", "file_paths", "tags"]


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def list_projects(projects: DataFrame, snapshots: DataFrame, todos: DataFrame, notes: DataFrame) -> DataFrame:
    counts = {"snapshot_count": snapshots, "active_todos": todos.filter(is_open()), "note_count": notes}
    base = projects.select(F.col("id").alias("project_id"), "name", "path", "last_accessed_at")
    return with_counts(base, counts).orderBy(F.desc("last_accessed_at"), "project_id")


def stats(
    snapshots: DataFrame, todos: DataFrame, notes: DataFrame, memory: DataFrame, errors: DataFrame,
    instructions: DataFrame, by_project: bool = True, projects: DataFrame | None = None,
) -> DataFrame:
    """Row counts per project, or over all projects; ``todos`` maps status to count.

    With ``projects`` those without any row are listed too.
    """
    plain = {
        "snapshots": snapshots, "notes": notes, "memories": memory, "error_patterns": errors,
        "instructions": instructions.filter(is_active()),
    }
    key = F.col("project_id") if by_project else F.lit("all").alias("project_id")
    counted = [
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select("project_id", F.lit(name).alias("what"), "n")
        for name, df in plain.items()
    ]
    by_status = todos.groupBy(key, "status").agg(F.count(F.lit(1)).alias("n"))
    counted.append(by_status.select("project_id", F.concat(F.lit("todo:"), "status").alias("what"), "n"))
    if projects is not None:
        counted.append(projects.select(F.col("id").alias("project_id"), F.lit("project").alias("what"), F.lit(0).cast("long").alias("n")))
    long = reduce(DataFrame.unionByName, counted)
    status_counts = F.collect_list(
        F.when(F.col("what").startswith("todo:"), F.struct(F.substring("what", 6, 99).alias("k"), F.col("n").alias("v")))
    )
    return long.groupBy("project_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).cast("long").alias(name) for name in plain],
        F.map_from_entries(F.array_sort(status_counts)).alias("todos"),
    )


def list_todos(todos: DataFrame, status: str = "active", tags: Sequence[str] | None = None) -> DataFrame:
    chosen = {"active": is_open(), "all": None}.get(status, F.col("status") == status)
    rows = todos.filter(all_of(chosen, has_any_tag(tags) if tags else None))
    columns = ["project_id", "id", "title", "status", "priority", "tags", "blocked_reason", "created_at", "updated_at"]
    return rows.select(*columns).orderBy("project_id", *by_priority())


def todo_board(
    todos: DataFrame, status: str = "active", tags: Sequence[str] | None = None, projects: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(cards in board order, size of each of the four lists and their total per project, also of ``projects`` without tasks)."""
    cards = list_todos(todos, status, tags)
    listed = F.explode(F.array(*[F.lit(s) for s in TODO_STATUSES])).alias("status")
    known = todos.select("project_id")
    if projects is not None:
        known = known.unionByName(projects.select(F.col("id").alias("project_id")))
    lists = known.distinct().select("project_id", listed)
    sizes = cards.groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("size"))
    totals = cards.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"))
    filled = lists.join(sizes, ["project_id", "status"], "left").join(totals, "project_id", "left")
    return cards.orderBy("project_id", "status", *by_priority()), filled.na.fill(0, ["size", "total"])


def list_notes(notes: DataFrame, category: str | None = None, n: int = 20) -> DataFrame:
    return newest(notes.filter(eq(category=category) if category else F.lit(True)), n)


def list_snapshots(snapshots: DataFrame, n: int = 20) -> DataFrame:
    return newest(snapshots, n)


def list_errors(errors: DataFrame, n: int = 50) -> DataFrame:
    return newest(errors, n, "last_seen_at")


def list_instructions(instructions: DataFrame, category: str | None = None) -> DataFrame:
    rows = instructions.filter(all_of(is_active(), eq(category=category) if category else None))
    return rows.orderBy("project_id", *by_priority())


def lookup(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Full rows of (project_id, id) keys with ``found``; an id of another project is not found."""
    rows = table.withColumn("_there", F.lit(True))
    return keys.join(rows, ["project_id", "id"], "left").withColumn(
        "found", F.coalesce("_there", F.lit(False))
    ).drop("_there")


def _as_text(column: Column, kind: str) -> Column:
    return json_text(column) if kind.startswith(("array", "struct", "map")) else column.cast("string")


def _with_diff(df: DataFrame, fields: list[str], kinds: dict[str, str]) -> DataFrame:
    """``changes``: field -> (before, after) of differing fields; arrays compare in order."""
    pairs = [
        (f, _as_text(F.col(f"{f}_1"), kinds[f]), _as_text(F.col(f"{f}_2"), kinds[f])) for f in fields
    ]
    both = F.map_from_arrays(
        F.array(*[F.lit(f) for f, _, _ in pairs]),
        F.array(*[F.struct(a.alias("before"), b.alias("after")) for _, a, b in pairs]),
    )
    changed = F.map_filter(both, lambda _, v: ~v["before"].eqNullSafe(v["after"]))
    return df.withColumn("changes", changed).withColumn("fields_changed", F.map_keys("changes"))


def diff_snapshots(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences for (project_id, id1, id2); ``error`` if a side is missing."""
    fields = [f for f in SNAPSHOT_FIELDS if f in snapshots.columns]
    joined = join_pairs(snapshots, pairs, [*fields, "created_at"])
    missing = F.col("_there1").isNull() | F.col("_there2").isNull()
    out = _with_diff(joined, fields, dict(snapshots.dtypes))
    return out.select(
        "project_id", "id1", "id2", "created_at_1", "created_at_2", missing.alias("error"),
        F.when(~missing, F.col("changes")).alias("changes"),
        F.when(~missing, F.col("fields_changed")).alias("fields_changed"),
    )


def diff_consecutive(snapshots: DataFrame, grain: str = "hour") -> DataFrame:
    """Each snapshot against the previous one of its project.

    The look-back runs per time slice, and only the last snapshot of each slice is carried
    to the next one, so a busy project is not scanned by a single task.
    """
    fields = [f for f in SNAPSHOT_FIELDS if f in snapshots.columns]
    order = ["created_at", "id"]
    state = F.struct(*order, *fields)
    rows = snapshots.select("project_id", state.alias("_now"), F.date_trunc(grain, "created_at").alias("_slice"))
    within = Window.partitionBy("project_id", "_slice").orderBy("_now.created_at", "_now.id")
    last = rows.groupBy("project_id", "_slice").agg(F.max("_now").alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy("project_id").orderBy("_slice"))).drop("_last")
    paired = (
        rows.withColumn("_before", F.lag("_now").over(within))
        .join(carried, ["project_id", "_slice"])
        .withColumn("_before", F.coalesce("_before", "_carry"))
        .filter(F.col("_before").isNotNull())
    )
    flat = paired.select(
        "project_id",
        F.col("_before.id").alias("id1"), F.col("_now.id").alias("id2"),
        *[F.col(f"_before.{f}").alias(f"{f}_1") for f in fields],
        *[F.col(f"_now.{f}").alias(f"{f}_2") for f in fields],
    )
    out = _with_diff(flat, fields, dict(snapshots.dtypes))
    return out.select("project_id", "id1", "id2", "changes", "fields_changed")


_LONG = {
    "rank": "int", "id": None, "kind": "string", "text": "string", "detail": "string", "priority": "int",
    "n": "bigint", "at": "timestamp_ntz", "tags": "array<string>", "assumptions": "array<string>", "constraints": "array<string>",
}


def _section(df: DataFrame, name: str, **columns: Column | str) -> DataFrame:
    """Bring a branch into the long report shape."""
    id_type = df.schema["id"].dataType if "id" in df.columns else None
    out = []
    for field, kind in _LONG.items():
        value = columns.get(field)
        if value is None and field in ("rank", "id") and field in df.columns:
            value = field
        if value is None:
            out.append(F.lit(None).cast(kind or id_type or "bigint").alias(field))
        else:
            col = F.col(value) if isinstance(value, str) else value
            out.append((col.cast(kind) if kind else col).alias(field))
    return df.select("project_id", F.lit(name).alias("section"), *out)


def _union(*branches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, branches)


def _open_todos(todos: DataFrame) -> DataFrame:
    return _section(
        todos.filter(is_open()), "active_todos", kind="status", text="title", detail="blocked_reason",
        priority="priority", at="created_at", tags="tags",
    )


def _counted(section: DataFrame, name: str, projects: DataFrame | None) -> DataFrame:
    counts = section.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    if projects is not None:
        counts = projects.select(F.col("id").alias("project_id")).join(counts, "project_id", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.select("project_id", F.lit(name).alias("section"), *[
        F.lit(None).cast(k or section.schema["id"].dataType).alias(f) if f != "n" else F.col("n") for f, k in _LONG.items()])


def summarize(snapshots: DataFrame, todos: DataFrame, notes: DataFrame, depth: int = 3, projects: DataFrame | None = None) -> DataFrame:
    """Latest snapshots, open tasks and five newest notes, with the sizes of the two first lists.

    With ``projects`` every one of them has its sizes, zero where it has no rows.
    """
    latest = _section(newest(snapshots, depth), "latest_snapshots", kind="module_focus", text="summary", detail="architecture_notes",
                      at="created_at", tags="tags", assumptions="assumptions", constraints="constraints")
    tasks = _open_todos(todos)
    recent = _section(newest(notes, 5), "recent_notes", kind="category", text="content", at="created_at", tags="tags")
    return _union(latest, tasks, recent, _counted(latest, "snapshot_count", projects), _counted(tasks, "active_todo_count", projects))


def session_sync(
    snapshots: DataFrame, todos: DataFrame, notes: DataFrame, memory: DataFrame, instructions: DataFrame, errors: DataFrame
) -> DataFrame:
    """What a returning session needs: latest snapshot, open tasks, newest notes and memories,
    active instructions, latest errors."""
    return _union(
        _section(newest(snapshots, 1), "snapshot", kind="module_focus", text="summary", at="created_at"),
        _open_todos(todos),
        _section(newest(notes, 10), "recent_notes", kind="category", text=preview("content", 150), at="created_at", tags="tags"),
        _section(newest(memory.select("project_id", "id", "content_type", "content_text", "tags", "created_at"), 10),
                 "recent_memories", kind="content_type", text=preview("content_text", 100), at="created_at", tags="tags"),
        _section(instructions.filter(is_active()), "instructions", kind="category", text="content", priority="priority", at="created_at"),
        _section(newest(errors, 5, "last_seen_at"), "recent_error_patterns", kind="error_type", text="error_message",
                 detail="resolution", n="occurrence_count", at="last_seen_at"),
    )


def recent_changes(
    projects: DataFrame, snapshots: DataFrame, todos: DataFrame, notes: DataFrame, as_of: Column, hours: float = 24
) -> DataFrame:
    """Changes inside the window, at most ten per list; if a project has none in any list,
    its last five of each. ``fallback`` tells which."""
    whole_hours = window_hours(F.lit(float(hours)))

    def branch(df: DataFrame, name: str, time: str, **columns: Column | str) -> DataFrame:
        ranked = newest(df, 10, time).withColumn("_in", newer_than(time, as_of, whole_hours))
        shaped = _section(ranked, name, at=time, **columns)
        return shaped.withColumn("_in", newer_than("at", as_of, whole_hours))

    lists = _union(
        branch(snapshots, "snapshots", "created_at", kind="module_focus", text="summary", tags="tags"),
        branch(notes, "notes", "created_at", kind="category", text="content", tags="tags"),
        branch(todos, "new_todos", "created_at", kind="status", text="title", priority="priority", tags="tags"),
        branch(todos.filter(is_completed()), "completed", "completed_at", text="title"),
    )
    flags = lists.groupBy("project_id").agg(F.bool_or("_in").alias("_any"))
    chosen = lists.join(flags, "project_id").filter(
        F.when(F.col("_any"), F.col("_in")).otherwise(F.col("rank") <= 5)
    )
    known = projects.select(F.col("id").alias("project_id"))
    return known.join(chosen.withColumn("fallback", ~F.col("_any")).drop("_any", "_in"), "project_id", "left").withColumn(
        "fallback", F.coalesce("fallback", F.lit(True))
    )


def narrative(changes: DataFrame, hours: float = 24) -> DataFrame:
    """Text form of ``recent_changes``, one row per project (at most forty lines each)."""
    raw = f"{hours:g}"
    line = (
        F.when(F.col("section") == "snapshots", F.concat(
            F.lit("  - "), "text", F.coalesce(F.concat(F.lit(" ["), empty_to_null("kind"), F.lit("]")), F.lit(""))))
        .when(F.col("section") == "notes", F.concat(F.lit("  - ["), "kind", F.lit("] "), ellipsis("text", 120)))
        .when(F.col("section") == "new_todos", F.concat(F.lit("  - ["), "kind", F.lit("] "), "text"))
        .when(F.col("section") == "completed", F.concat(F.lit("  - done: "), "text"))
    )
    grouped = changes.withColumn("_line", line).groupBy("project_id").agg(
        F.bool_or("fallback").alias("fallback"),
        *[
            F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("rank", "_line"))))["_line"].alias(s)
            for s in ("snapshots", "notes", "new_todos", "completed")
        ],
    )
    titles = {"snapshots": "snapshot(s):", "notes": "note(s):", "new_todos": "new task(s):", "completed": "completed:"}
    blocks = [
        F.when(F.size(s) > 0, F.concat(F.lit("\n"), F.size(s).cast("string"), F.lit(f" {title}\n"), F.array_join(s, "\n")))
        for s, title in titles.items()
    ]
    header = F.when(F.col("fallback"), f"No changes in last {raw}h. Last recorded activity:").otherwise(f"Changes in last {raw}h:")
    nothing = F.when(reduce(lambda a, b: a + b, [F.size(s) for s in titles]) == 0, "  No activity recorded for this project.")
    return grouped.select(
        "project_id", "fallback", F.concat_ws("\n", header, *blocks, nothing).alias("narrative"),
        *[F.size(s).alias(f"n_{s}") for s in titles],
    )


def file_context(
    paths: DataFrame, notes: DataFrame, todos: DataFrame, errors: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """What is known about (project_id, path): newest notes, open tasks, latest errors, newest snapshots."""
    keys = paths.select("project_id", "path").distinct()

    def branch(df: DataFrame, arr: str, name: str, limit: int | None, time: str | None, **columns: Column | str) -> DataFrame:
        joined = join_member(df, arr, keys)
        if limit is not None:
            joined = top_n(joined, limit, ["project_id", "path"], [F.col(time).desc(), F.col("id").asc()])
        held = F.struct("project_id", "path").alias("project_id")
        return _section(joined.withColumn("project_id", held), name, at=time, **columns)

    lists = _union(
        branch(notes, "related_files", "notes", 10, "created_at", kind="category", text="content", tags="tags"),
        branch(todos.filter(is_open()), "related_files", "active_todos", None, None, kind="status", text="title",
               detail="description", priority="priority", tags="tags"),
        branch(errors, "file_paths", "error_patterns", 5, "last_seen_at", kind="error_type", text="error_message",
               detail="resolution", n="occurrence_count"),
        branch(snapshots, "file_paths", "recent_snapshots", 3, "created_at", kind="module_focus", text="summary"),
    ).select("project_id.project_id", "project_id.path", *[c for c in ["section", *_LONG]])
    return keys.join(lists, ["project_id", "path"], "left").withColumn("has_context", F.col("section").isNotNull())


def file_hotspots(notes: DataFrame, todos: DataFrame, errors: DataFrame, snapshots: DataFrame) -> DataFrame:
    """References per file and table, and occurrences of the errors naming it."""
    def refs(df: DataFrame, arr: str, kind: str, hits: Column) -> DataFrame:
        return df.select("project_id", F.explode(F.array_distinct(arr)).alias("path"), F.lit(kind).alias("kind"), hits.alias("hits"))

    every = _union(
        refs(notes, "related_files", "notes", F.lit(0)),
        refs(todos, "related_files", "todos", F.lit(0)),
        refs(errors, "file_paths", "errors", F.col("occurrence_count")),
        refs(snapshots, "file_paths", "snapshots", F.lit(0)),
    )
    return every.groupBy("project_id", "path").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("notes", "todos", "errors", "snapshots")],
        F.sum("hits").alias("error_occurrences"),
    )


def project_index(
    projects: DataFrame, brief: DataFrame, snapshots: DataFrame, todos: DataFrame, notes: DataFrame,
    errors: DataFrame, instructions: DataFrame,
) -> DataFrame:
    """Compact catalogue of a project. Notes are cut to twenty before they are grouped by category."""
    active = instructions.filter(is_active())
    head = projects.select(F.col("id").alias("project_id")).join(
        brief.select("project_id", "project_name", "tech_stack"), "project_id", "left"
    )
    summary = head.select(
        "project_id", F.lit("project").alias("section"),
        *[
            {
                "text": F.coalesce(empty_to_null("project_name"), F.lit("Unknown")),
                "detail": F.when(F.length("tech_stack") > 0, summary_line("tech_stack", 200)),
            }.get(f, F.lit(None).cast(k or notes.schema["id"].dataType)).alias(f)
            for f, k in _LONG.items()
        ],
    )
    counts = with_counts(
        projects.select(F.col("id").alias("project_id")),
        {"snapshots": snapshots, "notes": notes, "active_todos": todos.filter(is_open()), "errors": errors, "instructions": active},
    )
    names = ["snapshots", "notes", "active_todos", "errors", "instructions"]
    count_rows = counts.select(
        "project_id", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in names])).alias("_c")
    ).select(
        "project_id", F.lit("counts").alias("section"),
        *[F.col(f"_c.{f}").alias(f) if f in ("kind", "n") else F.lit(None).cast(k or notes.schema["id"].dataType).alias(f) for f, k in _LONG.items()],
    )
    return _union(
        summary,
        count_rows,
        _section(todos.filter(is_open()), "active_todos", kind="status", text="title", priority="priority", at="created_at"),
        _section(newest(snapshots, 3), "recent_snapshots", text=summary_line("summary"), at="created_at"),
        _section(newest(notes, 20), "notes_by_category", kind=F.coalesce(empty_to_null("category"), F.lit("general")), text=summary_line("content")),
        _section(newest(errors, 10, "last_seen_at"), "error_patterns", kind="error_type", text=summary_line("error_message"), n="occurrence_count"),
        _section(active, "active_instructions", text=summary_line("content"), priority="priority", at="created_at"),
    )


# fixed values: titles of the brief fields and their lengths in the compact form
BRIEF_TITLES = {
    "tech_stack": ("Stack", 200),
    "module_map": ("Modules", 200),
    "conventions": ("Conventions", 150),
    "critical_constraints": ("Constraints", 200),
    "entry_points": ("Entry points", 200),
}


def render_brief(projects: DataFrame, brief: DataFrame, compact: bool = False) -> DataFrame:
    """Brief text and field sizes per project, ``exists`` false where there is none."""
    joined = projects.select(F.col("id").alias("project_id")).join(
        brief.withColumn("exists", F.lit(True)), "project_id", "left"
    )
    lines = [F.concat(F.lit("Project: "), "project_name")]
    for field, (title, limit) in BRIEF_TITLES.items():
        value = truncate_text(field, limit) if compact else F.col(field)
        lines.append(F.when(F.length(field) > 0, F.concat(F.lit(f"{title}: "), value)))
    lines.append(F.concat(F.lit("Last updated: "), F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")))
    sizes = {f: F.length(F.coalesce(F.col(f), F.lit(""))) for f in BRIEF_FIELDS}
    there = F.col("exists").isNotNull()
    return joined.select(
        "project_id",
        F.when(there, F.concat_ws("\n", *lines)).alias("brief"),
        F.when(there, reduce(lambda a, b: a + b, sizes.values())).alias("total_chars"),
        *[F.when(there, size).alias(f"{f}_chars") for f, size in sizes.items()],
        F.coalesce("exists", F.lit(False)).alias("exists"),
    )
