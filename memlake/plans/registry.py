"""Every operator as a query over the derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import predicates as P
from memlake.functions import text as X
from memlake.functions import vectors as V
from memlake.functions.trigram import jaccard, trgm_sim, trigrams
from memlake.operators import changes as C
from memlake.operators import embedding as E
from memlake.operators import imports as I
from memlake.operators import joins as J
from memlake.operators import merge as M
from memlake.operators import reports as R
from memlake.operators import search as S
from memlake.operators import similarity as Sim
from memlake.operators.validate import coerce, validate
from memlake.session import ensure_checkpoint_dir
from memlake.sources import tables as store
from memlake.sources.derived import AS_OF, Tables
from memlake.streaming import sinks, tasks, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TODO_COLUMNS = ["title", "status", "priority", "blocked_reason"]


def _query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def as_of() -> Column:
    return P.timestamp(AS_OF)


def _list(col: str) -> Column:
    return F.array_join(col, "|").alias(col)


def _checksum(vector: str = "embedding") -> Column:
    """Sum of a vector's components times their place."""
    parts = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), 3).alias("checksum")


def _score(col: str = "similarity") -> Column:
    return F.round(col, 6).alias(col)


# --- sources, validation, changes -------------------------------------------------


@_query
def scan_memory(t):
    folder = _folder(t)
    store.write_version(t.notes, folder, "notes", 1)
    return store.scan(t._spark, folder, "notes", columns=["id", "project_id", "category", "created_at"])


@_query
def validate_rows(t):
    ok, bad = validate(t.todo_changes.select("change_id", "id", "project_id", *TODO_COLUMNS), "todos")
    return ok.select("change_id", "status", "priority", F.lit("").alias("reasons")).unionByName(
        bad.select("change_id", "status", "priority", _list("reasons"))
    )


@_query
def append_rows(t):
    folder = _folder(t)
    store.append_changes(store.insert_rows(t.notes, ["content", "category"], F.col("created_at"), F.col("id")), folder, "notes", "0")
    log = store.read_log(t._spark, folder, "notes")
    return log.select("change_id", "changed_at", "id", "project_id", "op", _list("set_fields"), F.length("content").alias("chars"), "category")


@_query
def upsert_projects(t):
    incoming = t.instructions.select(
        F.col("project_id").alias("id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("Named "), "id")).alias("name"),
        F.when(F.col("id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("/home/"), "id")).alias("path"), F.col("id").alias("seq"),
    )
    return C.upsert_projects(t.projects, incoming, as_of())


def _brief_writes(t):
    part = lambda k: F.when(F.col("category") == k, F.col("content"))
    return t.notes.select(
        "project_id", F.concat(F.lit("P"), "id").alias("project_name"), part("decision").alias("tech_stack"),
        part("debug").alias("module_map"), part("architecture").alias("conventions"),
        part("reference").alias("critical_constraints"), part("general").alias("entry_points"), F.col("id").alias("seq"),
    )


@_query
def upsert_brief(t):
    return C.upsert_brief(t.project_brief, _brief_writes(t), as_of())


@_query
def brief_size_warnings(t):
    return C.brief_warnings(t.every_brief).withColumn("warnings", _list("warnings"))


def _updates(t):
    return t.todo_changes.filter("op = 'update'").withColumn("seq", F.col("change_id"))


def _keys(t, op):
    return t.todo_changes.filter(F.col("op") == op).select("id", "project_id")


@_query
def apply_updates(t):
    out = C.apply_updates(t.todos, _updates(t), "todos", as_of())
    return out.select("id", "project_id", "title", "status", "priority", "blocked_reason")


@_query
def touch_updated_at(t):
    return C.apply_updates(t.todos, _updates(t), "todos", as_of()).select("id", "updated_at")


@_query
def complete_todos(t):
    return C.complete_todos(t.todos, _keys(t, "complete"), as_of()).select("id", "project_id", "status", "completed_at", "updated_at")


@_query
def delete_with_vectors(t):
    rows, vectors, report = C.delete_rows(t.notes, t.memory, _keys(t, "delete"), "note")
    return (
        rows.select(F.lit("note").alias("kind"), "id", "project_id", F.lit(None).cast("boolean").alias("found"))
        .unionByName(vectors.select(F.lit("vector").alias("kind"), "id", "project_id", F.lit(None).cast("boolean").alias("found")))
        .unionByName(report.select(F.lit("report").alias("kind"), "id", "project_id", "found"))
    )


@_query
def deactivate_instructions(t):
    return C.deactivate(t.instructions, _keys(t, "delete")).select("id", "project_id", "active")


@_query
def delete_projects(t):
    tables = {
        "memory_embeddings": t.memory, "todos": t.todos, "notes": t.notes, "error_patterns": t.error_patterns,
        "instructions": t.instructions, "project_brief": t.project_brief, "snapshots": t.snapshots,
        "sessions": t.sessions, "projects": t.projects,
    }
    gone = t.project_brief.filter("critical_constraints is not null").select("project_id")
    _, counts = C.delete_projects(tables, gone)
    return counts


@_query
def null_dangling_refs(t):
    return C.null_dangling(t.notes, t.snapshots, "snapshot_id").select("id", "snapshot_id")


@_query
def session_snapshot_counts(t):
    return C.session_counts(t.sessions, t.snapshots)


@_query
def coerce_input(t):
    kind = F.col("change_id") % 5
    raw = t.todo_changes.select(
        "change_id",
        F.when(kind == 0, "12").when(kind == 1, "").when(kind == 2, "abc").when(kind == 3, " 1.5 ").alias("priority"),
        F.when(F.col("change_id") % 4 == 0, F.to_json("set_fields")).when(F.col("change_id") % 4 == 1, "[1]")
        .when(F.col("change_id") % 4 == 2, "[]").otherwise(F.col("title")).alias("tags"),
    )
    ok, bad = coerce(raw, ["priority"], ["tags"])
    return ok.select("change_id", "priority", _list("tags"), F.lit("").alias("reasons")).unionByName(
        bad.select("change_id", F.lit(None).cast("double").alias("priority"), F.lit(None).cast("string").alias("tags"), _list("reasons"))
    )


@_query
def split_tags(t):
    return t.notes.select("id", F.to_json(X.split_tags(F.concat_ws(",", "tags"))).alias("tags"), F.size(X.split_tags("content")).alias("parts"))


@_query
def project_key(t):
    return t.projects.select("id", X.project_key("path").alias("key"))


@_query
def split_sections(t):
    return I.split_sections(t.md_docs).select("doc_id", "pos", "heading", "body")


@_query
def classify_sections(t):
    return I.extract_brief(t.md_docs).drop("project_id")


@_query
def chunk_documents(t):
    return I.chunk(t.md_docs).select("doc_id", "part", "parts", "content", _list("tags"))


@_query
def import_rows(t):
    rows = I.import_documents(t.md_docs, as_of(), "Build failed")
    return (
        rows["notes"].select(F.lit("note").alias("kind"), "id", "project_id", F.col("content").alias("text"))
        .unionByName(rows["briefs"].select(F.lit("brief").alias("kind"), F.col("doc_id").alias("id"), "project_id", F.col("project_name").alias("text")))
        .unionByName(rows["snapshots"].select(F.lit("snapshot").alias("kind"), "id", "project_id", F.col("summary").alias("text")))
    )


@_query
def import_documents(t):
    rows = I.import_documents(t.md_docs, as_of())
    notes = M.merge_notes(t.notes, rows["notes"].withColumn("id", F.col("id") + 1_000_000_000))
    briefs = C.upsert_brief(t.project_brief, rows["briefs"], as_of())
    return (
        notes.select(F.lit("note").alias("kind"), "project_id", F.col("content").alias("text"))
        .unionByName(briefs.select(F.lit("brief").alias("kind"), "project_id", F.col("project_name").alias("text")))
        .unionByName(rows["snapshots"].select(F.lit("snapshot").alias("kind"), "project_id", F.col("summary").alias("text")))
    )


@_query
def current_state(t):
    return C.current_state(t.todo_changes, TODO_COLUMNS)


@_query
def current_state_as_of(t):
    return C.current_state(t.todo_changes, TODO_COLUMNS, P.timestamp("2024-01-15 00:00:00"))


@_query
def compact(t):
    # three batches in turn, so that each holds changes earlier than some of those before it
    folder, log, cut = _folder(t), t.todo_changes, P.timestamp("2024-01-15 00:00:00")
    first, second, third = (log.filter(F.pmod("change_id", F.lit(3)) == i) for i in range(3))
    store.append_changes(first, folder, "todos", "0")
    store.compact(t._spark, folder, "todos", TODO_COLUMNS, cut)
    store.append_changes(second, folder, "todos", "1")
    store.append_changes(first, folder, "todos", "0")
    store.compact(t._spark, folder, "todos", TODO_COLUMNS)
    store.append_changes(third, folder, "todos", "2")
    return C.current_state(store.read_log(t._spark, folder, "todos"), TODO_COLUMNS)


# --- filters and scalar functions --------------------------------------------------


@_query
def filter_conditions(t):
    truth = lambda c: F.coalesce(c, F.lit(False))
    return t.todos.select(
        "id",
        truth(P.eq(status="blocked", project_id="src3")).alias("eq"),
        P.is_open().alias("open"),
        truth(P.has_any_tag(["t1", "t5"])).alias("any_tag"),
        truth(P.has_no_tag(["t1", "t5"])).alias("no_tag"),
        P.mentions("related_files", "src/f3.py").alias("mentions"),
        X.icontains("title", F.lit("ORDER 1")).alias("icontains"),
        truth(P.newer_than("created_at", P.timestamp("1998-01-01 00:00:00"), 36)).alias("newer"),
        truth(P.older_than("created_at", P.timestamp("1998-01-01 00:00:00"), 30)).alias("older"),
        P.is_completed().alias("completed"),
        truth(P.all_of(P.is_open(), None, F.col("priority") == 2)).alias("all_of"),
    )


@_query
def filter_active(t):
    return t.instructions.filter(P.is_active()).select("id", "project_id")


@_query
def filter_similarity(t):
    sim = trgm_sim("error_message", F.concat_ws(" ", "error_type", "resolution", "root_cause"))
    return t.error_log.filter(P.above(sim, 0.05)).select("id", _score_of(sim))


def _score_of(col: Column) -> Column:
    return F.round(col, 6).alias("similarity")


@_query
def scalar_text(t):
    return t.notes.select(
        "id",
        X.summary_line("content").alias("summary_line"),
        X.truncate_text("content", 50).alias("truncated"),
        X.preview("content", 150).alias("preview"),
        X.ellipsis("content").alias("ellipsis"),
        X.escape_like(F.concat(F.lit("50%_\\"), F.substring("content", 1, 20))).alias("escaped"),
        X.join_non_empty("category", F.lit(""), F.lit(None).cast("string"), "project_id").alias("joined"),
        X.first_non_null(F.when(F.col("id") % 2 == 0, F.col("category")), "project_id").alias("first_non_null"),
        F.array_join(X.array_union_ordered("tags", "related_files"), "|").alias("union"),
        X.project_key("content").alias("key"),
        X.token_estimate(F.length("content")).alias("tokens"),
        X.window_hours(F.length("content") / 7.0 - 1000).alias("hours"),
        F.coalesce(X.heading_text(F.concat(F.lit("## "), "category")), F.lit("")).alias("heading"),
        (F.col("created_at") - X.days(F.col("id") % 9) + X.hours(5)).alias("moved"),
        X.json_text("tags").alias("json"),
    )


@_query
def l2_normalise(t):
    unit = t.memory.filter("embedding is not null").select("id", V.l2_normalise("embedding").alias("v"))
    return unit.select("id", F.round(V.l2_norm("v"), 5).alias("norm"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"))


# --- text similarity ---------------------------------------------------------------


@_query
def trigram_sets(t):
    return t.error_log.select("id", F.array_join(F.array_sort(trigrams("error_message")), "|").alias("grams"))


@_query
def trigram_similarity(t):
    # the trigrams of a brief are taken once, not for each of its notes
    stacks = t.project_brief.select("project_id", trigrams("tech_stack").alias("_stack"))
    both = t.notes.select("id", "project_id", trigrams("content").alias("_grams")).join(stacks, "project_id")
    common = F.size(F.array_intersect("_grams", "_stack"))
    return both.select("id", F.round(jaccard(common, F.size("_grams"), F.size("_stack")), 6).alias("similarity"))


@_query
def similar_pairs(t):
    return Sim.similar_pairs(t.notes, ["project_id"], "content", 0.8).withColumn("similarity", _score())


@_query
def similar_error_pairs(t):
    return Sim.similar_pairs(t.error_log, ["project_id"], "error_message", 0.7).withColumn("similarity", _score())


def _known(df):
    """Rows stored in the first half of the month; all rows arrive again as incoming."""
    return df.filter(F.col("created_at") < P.timestamp("2024-01-16 00:00:00"))


@_query
def best_match_notes(t):
    return Sim.best_match(t.notes, _known(t.notes), ["project_id", "category"], "content", 0.8).withColumn("similarity", _score())


@_query
def best_match_errors(t):
    return Sim.best_match(t.error_log, _known(t.error_patterns), ["project_id"], "error_message", 0.7).withColumn("similarity", _score())


@_query
def best_match_instructions(t):
    active = t.instructions.filter(P.is_active())
    return Sim.best_match(t.instructions, active, ["project_id"], "content", 0.8).withColumn("similarity", _score())


@_query
def exact_match_fallback(t):
    return Sim.best_match(t.error_log, t.error_patterns, ["project_id"], "error_message", 0.7, mode="exact")


@_query
def merge_notes(t):
    out = M.merge_notes(_known(t.notes), t.arriving_notes)
    return out.select("id", "project_id", "category", "content", _list("tags"), "created_at")


@_query
def merge_errors(t):
    out = M.merge_errors(t.error_patterns, t.arriving_errors)
    return out.select("id", "project_id", "error_message", _list("attempted_fixes"), "resolution", "occurrence_count", "last_seen_at")


@_query
def insert_instructions_if_new(t):
    return M.insert_instructions_if_new(_known(t.instructions), t.arriving_instructions).select("id", "project_id", "content")


@_query
def error_frequency(t):
    return M.error_frequency(t.error_log).withColumn("fixes", _list("fixes"))


# --- embedding and search ----------------------------------------------------------


@_query
def embed_column(t):
    encoded = E.embed(t.notes.select("id", "content"), "content", lambda: E.HashingEncoder(64))
    filled = F.size(F.filter("embedding", lambda x: x != 0)).alias("filled")
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 3).alias("first")
    return encoded.select("id", F.size("embedding").alias("dims"), F.round(V.l2_norm("embedding"), 4).alias("norm"), filled, first, _checksum())


@_query
def build_embedding_rows(t):
    rows = E.embedding_rows(t.snapshots, t.todos, t.notes, t.error_patterns, t.instructions, t.project_brief)
    return rows.select("project_id", "source_type", "source_id", "content_type", "content_text", "embed_text", _list("tags"))


@_query
def refresh_embeddings(t):
    changed = t.notes.select(
        F.lit("note").alias("source_type"), F.col("id").alias("source_id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("New "), "content")).otherwise(F.col("content")).alias("content_text"),
    )
    out = E.refresh(t.memory, changed, as_of(), lambda: E.HashingEncoder(64))
    return out.select("id", "content_text", "created_at", _checksum())


@_query
def degrade_without_vectors(t):
    blind = E.embed(t.search_queries.drop("query_vec"), "query_text", None, "query_vec")
    return S.hybrid_search(blind, t.memory).select("query_id", "rank", "id", "search_mode")


@_query
def cosine_similarity(t):
    pairs = t.memory.join(t.search_queries.drop("project_id"), F.col("id") == F.col("query_id"))
    scored = pairs.withColumn("similarity", V.cosine("embedding", "query_vec"))
    others = t.memory.join(t.search_queries.select("query_id", "query_vec"), F.col("id") == F.col("query_id") + 1)
    return scored.select("id", "query_id", _score()).unionByName(
        others.withColumn("similarity", V.cosine("embedding", "query_vec")).select("id", "query_id", _score())
    )


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "id", "content_type", "search_mode", _score())


@_query
def semantic_topk(t):
    return _hits(S.semantic_topk(t.search_queries, t.memory))


@_query
def semantic_topk_filtered(t):
    return _hits(S.semantic_topk(t.search_queries, t.memory, 3, content_type="note", tags=["t1", "t2", "t3"]))


@_query
def semantic_topk_shuffled(t):
    """The plan for more queries than may be shipped to the tasks."""
    return _hits(S.semantic_topk(t.search_queries, t.memory, max_shipped=0))


@_query
def ann_topk(t):
    return S.ann_topk(t.search_queries, t.memory).select("query_id", "rank", "id", _score())


@_query
def ann_topk_all_cells(t):
    """With every cell probed, the approximate search is exact."""
    return S.ann_topk(t.search_queries, t.memory, nlist=8, nprobe=8).select("query_id", "rank", "id", _score())


@_query
def keyword_search(t):
    return _hits(S.keyword_search(t.search_queries, t.memory))


@_query
def hybrid_search(t):
    return _hits(S.hybrid_search(t.search_queries, t.memory))


@_query
def hybrid_search_filtered(t):
    return _hits(S.hybrid_search(t.search_queries, t.memory, content_type="note"))


@_query
def search(t):
    return _hits(S.search(t.search_queries, t.memory, "keyword", tags=["t1", "t2"]))


@_query
def search_modes(t):
    """The dispatching search in its semantic and hybrid modes, by tags and by type."""
    semantic = _hits(S.search(t.search_queries, t.memory, "semantic", k=3, tags=["t3", "t5"]))
    hybrid = _hits(S.search(t.search_queries, t.memory, "hybrid", k=4, content_type="note", tags=["t1", "t2"]))
    return semantic.withColumn("mode", F.lit("semantic")).unionByName(hybrid.withColumn("mode", F.lit("hybrid")))


@_query
def match_errors(t):
    return S.match_errors(t.error_queries, t.error_patterns, t.memory).withColumn("match_score", _score("match_score"))


@_query
def match_errors_keyword(t):
    return S.match_errors_keyword(t.error_queries, t.error_patterns)


# --- joins -------------------------------------------------------------------------


@_query
def with_counts(t):
    base = t.projects.select(F.col("id").alias("project_id"))
    return J.with_counts(base, {"notes": t.notes, "briefs": t.project_brief})


@_query
def resolve_sources(t):
    hits = t.memory.select("id", "project_id", "source_type", "source_id")
    return J.resolve_sources(hits, t.error_patterns, "error_pattern").select("id", "source_id", "error_message")


@_query
def pair_queries(t):
    return J.queries_per_row(t.search_queries, t.memory).select("id", "project_id", "asked")


@_query
def minus_keys(t):
    return J.minus_keys(t.memory, t.error_log.select("id"), ["id"]).select("id", "project_id")


def _paths(t):
    return t.error_patterns.select("project_id", F.explode("file_paths").alias("path")).distinct()


@_query
def join_member(t):
    return J.join_member(t.notes, "related_files", _paths(t)).select("id", "project_id", "path")


def _snapshot_pairs(t):
    return t.snapshots.select("project_id", F.coalesce("parent_snapshot_id", F.lit(-1)).alias("id1"), F.col("id").alias("id2"))


@_query
def join_pairs(t):
    return J.join_pairs(t.snapshots, _snapshot_pairs(t), ["summary"]).select("id1", "id2", "summary_1", "summary_2")


@_query
def upsert_join(t):
    incoming = t.sessions.select("project_id", F.lit("seen").alias("module_map")).distinct()
    return C.upsert(t.project_brief.select("project_id", "project_name", "module_map"), incoming, "project_id")


# --- reports -----------------------------------------------------------------------


@_query
def list_projects(t):
    return R.list_projects(t.projects, t.snapshots, t.todos, t.notes)


def _flat(report):
    return report.withColumns({c: _list(c) for c in ("tags", "assumptions", "constraints")})


def _flat_stats(df):
    pairs = F.transform(F.map_entries("todos"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.withColumn("todos", F.array_join(pairs, "|"))


@_query
def stats(t):
    return _flat_stats(R.stats(t.snapshots, t.todos, t.notes, t.memory, t.error_patterns, t.instructions, projects=t.projects))


@_query
def stats_global(t):
    return _flat_stats(R.stats(t.snapshots, t.todos, t.notes, t.memory, t.error_patterns, t.instructions, by_project=False))


@_query
def list_todos(t):
    return R.list_todos(t.todos).withColumn("tags", _list("tags"))


@_query
def list_todos_tagged(t):
    return R.list_todos(t.todos, "all", ["t2", "t6"]).withColumn("tags", _list("tags"))


@_query
def todo_board(t):
    cards, sizes = R.todo_board(t.todos, "all", projects=t.projects)
    return sizes.select("project_id", "status", "size", "total", F.lit(None).cast("bigint").alias("id")).unionByName(
        cards.select("project_id", "status", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("total"), "id")
    )


@_query
def list_notes(t):
    return R.list_notes(t.notes).select("project_id", "rank", "id", "category", "content")


@_query
def list_notes_category(t):
    return R.list_notes(t.notes, "decision", 5).select("project_id", "rank", "id", "category", "content")


@_query
def list_snapshots(t):
    return R.list_snapshots(t.snapshots).select("project_id", "rank", "id", "summary", "created_at")


@_query
def list_error_patterns(t):
    return R.list_errors(t.error_patterns).select("project_id", "rank", "id", "error_message", "occurrence_count", "last_seen_at")


@_query
def list_instructions(t):
    return R.list_instructions(t.instructions).select("project_id", "id", "content", "priority", "created_at")


@_query
def lookup_by_ids(t):
    return R.lookup(t.notes, t.todo_changes.select("project_id", "id").distinct()).select("project_id", "id", "content", "found")


def _flat_diff(df):
    return df.withColumn("fields_changed", F.array_join("fields_changed", "|")).withColumn(
        "changes", F.array_join(F.transform(F.map_entries("changes"), lambda e: F.concat(
            e["key"], F.lit(":"), F.coalesce(e["value"]["before"], F.lit("~")), F.lit(">"), F.coalesce(e["value"]["after"], F.lit("~")))), ";")
    )


@_query
def diff_snapshots(t):
    return _flat_diff(R.diff_snapshots(t.snapshots, _snapshot_pairs(t))).select("id1", "id2", "error", "changes", "fields_changed")


@_query
def diff_consecutive_snapshots(t):
    return _flat_diff(R.diff_consecutive(t.snapshots)).select("project_id", "id1", "id2", "changes", "fields_changed")


@_query
def summarize_project(t):
    return _flat(R.summarize(t.snapshots, t.todos, t.notes, projects=t.projects))


@_query
def session_sync(t):
    return _flat(R.session_sync(t.snapshots, t.todos, t.notes, t.memory, t.instructions, t.error_patterns))


@_query
def recent_changes(t):
    return _flat(R.recent_changes(t.projects, t.snapshots, t.todos, t.notes, P.timestamp("2024-01-30 12:00:00"), 24))


@_query
def recent_changes_quiet(t):
    return _flat(R.recent_changes(t.projects, t.snapshots, t.todos, t.notes, as_of(), 24))


@_query
def recent_changes_narrative(t):
    changes = R.recent_changes(t.projects, t.snapshots, t.todos, t.notes, P.timestamp("2024-01-30 12:00:00"), 24)
    return R.narrative(changes, 24)


@_query
def file_context(t):
    return _flat(R.file_context(_paths(t), t.notes, t.todos, t.error_patterns, t.snapshots))


@_query
def file_hotspots(t):
    return R.file_hotspots(t.notes, t.todos, t.error_patterns, t.snapshots)


@_query
def project_index(t):
    return _flat(R.project_index(t.projects, t.project_brief, t.snapshots, t.todos, t.notes, t.error_patterns, t.instructions))


@_query
def render_brief(t):
    return R.render_brief(t.projects, t.project_brief)


@_query
def render_brief_compact(t):
    return R.render_brief(t.projects, t.project_brief, compact=True)


@_query
def prune_memory(t):
    kept, counts = C.prune(t.memory, as_of(), 10, ["t1", "t3"])
    return kept.select("project_id", "id", F.lit(None).cast("bigint").alias("pruned")).unionByName(
        counts.select("project_id", F.lit(None).cast("bigint").alias("id"), "pruned")
    )


# --- streams -----------------------------------------------------------------------

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PROJECT = "concat('src', cast(user_id % 20 as string))"


def _activity(events: DataFrame) -> DataFrame:
    kind = F.expr("case event_type when 'purchase' then 'snapshot' when 'signup' then 'todo' when 'error' then 'error' else 'note' end")
    return events.select(F.expr(PROJECT).alias("project_id"), kind.alias("kind"), "ts", "event_id")


def _events(t: Tables) -> DataFrame:
    return t._spark.read.parquet(f"{t._dir}/events.parquet")


def _event_stream(t: Tables) -> DataFrame:
    return t._spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(t._dir)


def _folder(t: Tables) -> str:
    return f"{ensure_checkpoint_dir(t._spark)}/streams/{uuid.uuid4()}"


def _to_parquet(t: Tables, stream: DataFrame, folder: str) -> DataFrame:
    # a stateful query keeps one state store per shuffle partition: no more of them than cores
    conf = t._spark.conf
    partitions = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(min(int(partitions), t._spark.sparkContext.defaultParallelism)))
    try:
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp")
            .option("path", f"{folder}/out").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        conf.set("spark.sql.shuffle.partitions", partitions)
    return t._spark.read.parquet(f"{folder}/out")


def _run(writer) -> None:
    writer.start().awaitTermination()


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@_query
def activity_windows(t):
    df = windows.activity_windows(windows.with_event_time(_activity(_events(t)), "ts"), "ts", "24 hours", "1 hour")
    return _ntz(df, "window_start", "window_end")


@_query
def activity_windows_tumbling(t):
    df = windows.activity_windows(windows.with_event_time(_activity(_events(t)), "ts"), "ts", "24 hours")
    return _ntz(df, "window_start", "window_end")


@_query
def activity_sessions(t):
    df = windows.activity_sessions(windows.with_event_time(_activity(_events(t)), "ts"), "ts", "90 minutes")
    return _ntz(df, "started_at", "ended_at")


@_query
def stream_activity_windows(t):
    stream = windows.with_event_time(_activity(_event_stream(t)), "ts", "1 hour")
    return _ntz(_to_parquet(t, windows.activity_windows(stream, "ts", "24 hours"), _folder(t)), "window_start", "window_end")


@_query
def stream_activity_sessions(t):
    stream = windows.with_event_time(_activity(_event_stream(t)), "ts", "1 hour")
    return _ntz(_to_parquet(t, windows.activity_sessions(stream, "ts", "90 minutes"), _folder(t)), "started_at", "ended_at")


@_query
def stream_drop_replays(t):
    stream = _activity(_event_stream(t))
    doubled = stream.unionByName(stream)
    return _ntz(_to_parquet(t, windows.drop_replays(doubled, "event_id", "ts", "1 hour"), _folder(t)), "ts")


def _change_stream(t: Tables) -> DataFrame:
    return _event_stream(t).selectExpr(
        "event_id as change_id", "ts as changed_at", "user_id * 10 + event_id % 10 as id", f"{PROJECT} as project_id",
        "case event_type when 'signup' then 'insert' when 'purchase' then 'complete' when 'error' then 'delete' else 'update' end as op",
        "case event_type when 'click' then array('status') when 'view' then array('priority', 'blocked_reason') else array('title', 'status', 'priority') end as set_fields",
        "concat('Task ', cast(event_id as string)) as title",
        "case event_id % 3 when 0 then 'todo' when 1 then 'in_progress' else 'blocked' end as status",
        "cast(event_id % 4 as int) as priority",
        "case when event_id % 2 = 0 then concat('wait ', cast(event_id % 5 as string)) end as blocked_reason",
    )


@_query
def stream_ingest(t):
    folder = _folder(t)
    _run(sinks.ingest(_change_stream(t), folder, "todos", f"{folder}/cp"))
    return C.current_state(store.read_log(t._spark, folder, "todos"), TODO_COLUMNS)


@_query
def stream_task_state(t):
    t._spark.conf.set("spark.sql.streaming.stateStore.providerClass", tasks.STATE_PROVIDER)
    stream = windows.with_event_time(_change_stream(t), "changed_at")
    return _ntz(_to_parquet(t, tasks.task_transitions(stream), _folder(t)), "changed_at", "completed_at")


def _error_stream(t: Tables) -> DataFrame:
    return _event_stream(t).filter("event_type = 'error'").selectExpr(
        "event_id as id", "event_id as seq", f"{PROJECT} as project_id",
        "concat('Failure ', substr(md5(cast(event_id % 40 as string)), 1, 8), ' ', substr(md5(cast(user_id % 30 as string)), 1, 8)) as error_message",
        "'runtime' as error_type", "array(concat('fix', cast(event_id % 4 as string))) as attempted_fixes",
        "cast(null as string) as root_cause", "cast(null as string) as resolution",
        "array(concat('src/f', cast(event_id % 11 as string), '.py')) as file_paths", "array('t') as tags", "ts as seen_at",
    )


@_query
def stream_merge_errors(t):
    folder = _folder(t)
    _run(sinks.merge_error_stream(_error_stream(t), folder, f"{folder}/cp"))
    return store.scan(t._spark, folder, "error_patterns", columns=["id", "project_id", "error_message", "occurrence_count", "last_seen_at"])


@_query
def stream_embed(t):
    folder = _folder(t)
    stream = _error_stream(t).selectExpr("id as source_id", "project_id", "error_message as content_text", "error_message as embed_text")
    _run(sinks.embed_stream(stream, lambda: E.HashingEncoder(64), folder, f"{folder}/cp"))
    stored = t._spark.read.parquet(f"{folder}/memory_embeddings")
    return stored.select("source_id", "project_id", F.size("embedding").alias("dims"), _checksum())


@_query
def stream_match_errors(t):
    folder = _folder(t)
    vectors = t._spark.read.parquet(f"{t._dir}/embeddings.parquet")
    stream = _error_stream(t).join(vectors, F.col("id") == F.col("vec_id"), "left").selectExpr(
        "id as query_id", "project_id", "error_message as query_text", "embedding as query_vec")
    _run(sinks.match_error_stream(stream, lambda: t.error_patterns, lambda: t.memory, folder, f"{folder}/cp"))
    return t._spark.read.parquet(f"{folder}/error_matches").select("query_id", "rank", "id", _score("match_score"), "match_type")
