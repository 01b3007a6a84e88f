"""The checking SQL, by query name."""

from __future__ import annotations

from memlake.sources.derived import AS_OF, check_sql

NOW = f"timestamp '{AS_OF}'"
NOON = "timestamp '2024-01-30 12:00:00'"
NL = "chr(10)"
ORACLES: dict[str, str] = {}


def _add(name: str, tables: str, body: str, ctes: str = "") -> None:
    head = check_sql(*tables.split())
    ORACLES[name] = f"{head}{', ' + ctes if ctes else ''} {body}"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def line(t: str, n: int = 120) -> str:
    first = strip(rf"regexp_split_to_array({t}, '[\n\r]')[1]")
    return f"coalesce(case when length({first}) <= {n} then {first} else substr({first}, 1, {n - 3}) || '...' end, '')"


def cap(t: str, n: int) -> str:
    return f"coalesce(case when length({t}) <= {n} then {t} else substr({t}, 1, {n - 3}) || '...' end, '')"


def grams(t: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    pieces = "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))"
    return f"list_sort(list_distinct(flatten(list_transform({words}, {pieces}))))"


def sim(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return (
        f"coalesce(cast(cast({common}::double / nullif(len({a}) + len({b}) - {common}, 0) as float) as double), 0.0)"
    )


def joined(col: str) -> str:
    return f"array_to_string({col}, '|') as {col}"


def newest(table: str, n: int, time: str = "created_at", where: str = "true") -> str:
    return (
        f"(select *, cast(row_number() over (partition by project_id order by {time} desc nulls first, id) as int) as rank "
        f"from {table} where {where} qualify rank <= {n})"
    )


# --- sources, validation, changes
_add("scan_memory", "notes", "select id, project_id, category, created_at from notes")
_add("validate_rows", "todo_changes", """
    select change_id, status, priority, case when priority > 2 then 'priority out of range' else '' end as reasons
    from todo_changes""")
_add("append_rows", "notes", """
    select id as change_id, created_at as changed_at, id, project_id, 'insert' as op, 'content|category' as set_fields,
           cast(length(content) as int) as chars, category from notes""")
_add("upsert_projects", "projects instructions", f"""
    select coalesce(p.id, i.id) as id, coalesce(i.name, p.name) as name, coalesce(i.path, p.path) as path,
           coalesce(p.created_at, {NOW}) as created_at,
           case when i.id is null then p.last_accessed_at else {NOW} end as last_accessed_at
    from projects p full join (
        select project_id as id, arg_max('Named ' || id, id) filter (id % 3 = 0) as name,
               arg_max('/home/' || id, id) filter (id % 7 <> 0) as path
        from instructions group by project_id) i on p.id = i.id""")
_add("upsert_brief", "project_brief notes", f"""
    select project_id, project_name, tech_stack, module_map, conventions, critical_constraints, entry_points, updated_at
    from project_brief where project_id not in (select project_id from notes)
    union all
    select project_id, 'P' || id, case when category = 'decision' then nullif(content, '') end,
           case when category = 'debug' then nullif(content, '') end, case when category = 'architecture' then nullif(content, '') end,
           case when category = 'reference' then nullif(content, '') end, case when category = 'general' then nullif(content, '') end, {NOW}
    from (select *, row_number() over (partition by project_id order by id desc) as r from notes) where r = 1""")
_LIMITS = {"tech_stack": 500, "module_map": 500, "conventions": 500, "critical_constraints": 400, "entry_points": 500}
_total = " + ".join(f"length(coalesce({f}, ''))" for f in _LIMITS)
_warn = ", ".join(
    f"case when length({f}) > {n} then '{f}: ' || length({f}) || ' chars (recommended max: {n}). Consider condensing.' end"
    for f, n in _LIMITS.items()
)
_add("brief_size_warnings", "every_brief", f"""
    select project_id, cast({_total} as int) as total_chars, cast(ceil(({_total}) / 4.0) as bigint) as tokens,
           concat_ws('|', {_warn}, case when {_total} > 2000 then 'Total brief size: ' || ({_total}) || ' chars. This costs ~'
             || cast(ceil(({_total}) / 4.0) as bigint) || ' tokens on every session start. Consider using notes for extended details and keeping the brief concise.' end) as warnings
    from every_brief""")
_last = lambda c: (
    f"(select struct_pack(v := {c}) from todo_changes x where x.op = 'update' and x.id = t.id and x.project_id = t.project_id "
    f"and list_contains(x.set_fields, '{c}') order by x.change_id desc limit 1)"
)
_upd = ", ".join(
    f"case when u_{c} is null then {c} else u_{c}.v end as {c}" for c in ("status", "priority", "blocked_reason")
)
_add("apply_updates", "todos todo_changes", f"""
    select id, project_id, title, {_upd}
    from (select *, {_last('status')} as u_status, {_last('priority')} as u_priority, {_last('blocked_reason')} as u_blocked_reason from todos t)""")
_add("touch_updated_at", "todos todo_changes", f"""
    select id, case when exists (select 1 from todo_changes x where x.op = 'update' and x.id = t.id and x.project_id = t.project_id)
           then {NOW} else updated_at end as updated_at from todos t""")
_done = "exists (select 1 from todo_changes x where x.op = 'complete' and x.id = t.id and x.project_id = t.project_id)"
_add("complete_todos", "todos todo_changes", f"""
    select id, project_id, case when {_done} then 'done' else status end as status,
           case when {_done} then {NOW} else completed_at end as completed_at,
           case when {_done} then {NOW} else updated_at end as updated_at from todos t""")
_gone = "(select distinct id, project_id from todo_changes where op = 'delete')"
_add("delete_with_vectors", "notes memory todo_changes", f"""
    select 'note' as kind, id, project_id, null::boolean as found from notes where (id, project_id) not in {_gone}
    union all
    select 'vector', id, project_id, null from memory where source_type <> 'note' or (source_id, project_id) not in {_gone}
    union all
    select 'report', id, project_id, (id, project_id) in (select (id, project_id) from notes) from {_gone}""")
_add("deactivate_instructions", "instructions todo_changes", f"""
    select id, project_id, case when (id, project_id) in {_gone} then false else active end as active from instructions""")
_TABLES = ["memory_embeddings", "todos", "notes", "error_patterns", "instructions", "project_brief", "snapshots", "sessions", "projects"]
_add("delete_projects", "memory todos notes error_patterns instructions project_brief snapshots sessions projects", "select project_id, " + ", ".join(
    f"(select count(*) from {'memory' if t == 'memory_embeddings' else t} x where x.{'id' if t == 'projects' else 'project_id'} = b.project_id) as {t}"
    for t in _TABLES) + " from project_brief b where critical_constraints is not null")
_add("null_dangling_refs", "notes snapshots", """
    select id, case when snapshot_id in (select id from snapshots) then snapshot_id end as snapshot_id from notes""")
_add("session_snapshot_counts", "sessions snapshots", """
    select s.*, cast((select count(*) from snapshots x where x.session_id = s.id) as int) as snapshot_count from sessions s""")
_add("coerce_input", "todo_changes", """
    select change_id, case when bad = '' then case change_id % 5 when 0 then 12.0 when 1 then 0.0 when 3 then 1.5 end end::double as priority,
           case when bad = '' then case change_id % 4 when 0 then array_to_string(set_fields, '|') when 2 then '' end end as tags,
           bad as reasons
    from (select *, concat_ws('|', case when change_id % 5 = 2 then 'priority not readable' end,
                              case when change_id % 4 in (1, 3) then 'tags not readable' end) as bad from todo_changes)""")
_add("split_tags", "notes", """
    select id, '["' || array_to_string(tags, '","') || '"]' as tags, cast(length(content) - length(replace(content, ',', '')) + 1 as int) as parts from notes""")
_add("project_key", "projects", "select id, substr(sha256(path), 1, 12) as key from projects")
_SECTIONS = rf"""
    doc_lines as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line
                  from (select doc_id, string_split(content, {NL}) as l from md_docs)),
    marked as (select *, {strip(r"nullif(regexp_extract(line, '(?s)^#{1,3}\s+(.+)$', 1), '')")} as head from doc_lines),
    grouped as (select *, sum(case when head is not null then 1 else 0 end) over (partition by doc_id order by i) as g from marked),
    bodies as (select doc_id, g, coalesce(max(head), '__preamble__') as heading,
                      {strip(f"string_agg(line, {NL} order by i) filter (head is null)")} as body
               from grouped group by doc_id, g having count(*) filter (head is null) > 0),
    sections as (select doc_id, heading, arg_max(body, g) as body,
                        cast(row_number() over (partition by doc_id order by min(g)) - 1 as int) as pos
                 from bodies group by doc_id, heading)"""
_add("split_sections", "md_docs", "select doc_id, pos, heading, body from sections", _SECTIONS)
_KEYWORDS = {
    "tech_stack": "tech stack dependencies tools framework language",
    "module_map": "module structure architecture component service layout overview",
    "conventions": "convention style pattern standard rule guideline coding",
    "critical_constraints": "constraint requirement limitation important critical warning",
    "entry_points": "entry start command script build run deploy setup",
}
_steps, _prev = [], "s0"
for _n, (_f, _k) in enumerate(_KEYWORDS.items(), 1):
    _match = " or ".join(f"contains(lower(x.heading), '{w}')" for w in _k.split())
    _steps.append(
        f"s{_n} as (select *, list_append(used, hit{_n}.heading) as used_next from (select * exclude (used_next), used_next as used, "
        f"list_filter(sec, lambda x: x.heading <> '__preamble__' and not list_contains(used_next, x.heading) and ({_match}))[1] as hit{_n} from (select * exclude (used) from {_prev})))"
        if _n > 1 else
        f"s1 as (select * exclude (used), used, list_append(used, hit1.heading) as used_next from (select *, list_filter(sec, lambda x: x.heading <> '__preamble__' and ({_match}))[1] as hit1 from s0))"
    )
    _prev = f"s{_n}"
_filled = " + ".join(f"(length(coalesce(hit{n}.body, '')) > 0)::int" for n in range(1, 6))
_BRIEF = _SECTIONS + rf""",
    s0 as (select d.doc_id, d.content, list(struct_pack(heading := s.heading, body := s.body) order by s.pos) as sec, []::varchar[] as used,
                  coalesce(nullif({strip(r"regexp_extract(coalesce(max(case when heading = '__preamble__' then body end), ''), '(?i)^(?:Project|Name|Title):\s*([^\n]+)', 1)")}, ''),
                           arg_min(heading, pos) filter (heading <> '__preamble__'), '') as name
           from md_docs d join sections s using (doc_id) group by d.doc_id, d.content),
    {', '.join(_steps)},
    briefs as (select doc_id, case when name = '' then 'Unknown Project' else name end as project_name, hit1.body as tech_stack,
                      case when (name <> '')::int + {_filled} <= 2 then substr(content, 1, 2000) else hit2.body end as module_map,
                      hit3.body as conventions, hit4.body as critical_constraints, hit5.body as entry_points from s5)"""
_add("classify_sections", "md_docs", "select * from briefs", _BRIEF)
_CHUNKS = f"""
    chunks as (select doc_id, project_id, cast(part as int) as part, cast(parts as int) as parts,
                      case when parts = 1 then content else '[CLAUDE.md migration part ' || part || '/' || parts || ']' || {NL} || {NL}
                           || substr(content, (part - 1) * 4000 + 1, 4000) end as content,
                      case when parts = 1 then 'migrated-from-claude-md|original-full' else 'migrated-from-claude-md|part-' || part end as tags
               from (select *, unnest(range(1, parts + 1)) as part from (
                     select *, cast(greatest(ceil(length(content) / 4000.0), 1) as bigint) as parts from md_docs)))"""
_add("chunk_documents", "md_docs", "select doc_id, part, parts, content, tags from chunks", _CHUNKS)
_add("import_rows", "md_docs", f"""
    select 'note' as kind, doc_id * 1000000 + part as id, project_id, content as text from chunks
    where doc_id in (select doc_id from md_docs where not contains(content, 'Build failed'))
    union all
    select 'brief', doc_id, project_id, project_name from briefs join md_docs using (doc_id) where not contains(content, 'Build failed')
    union all
    select 'snapshot', doc_id, project_id, 'Initial migration from CLAUDE.md. Imported ' || (select count(*) from sections s where s.doc_id = d.doc_id) || ' sections.'
    from md_docs d where not contains(content, 'Build failed')""", _BRIEF + "," + _CHUNKS)


def _state(source: str) -> str:
    def latest(c: str) -> str:
        extra = " or op = 'complete'" if c == "status" else ""
        value = "case when op = 'complete' then 'done' else status end" if c == "status" else c
        return (f"arg_max(struct_pack(v := {value}), o) filter (o > b and ((op = 'update' and list_contains(set_fields, '{c}')){extra})) as u_{c}, "
                f"arg_max(struct_pack(v := {c}), o) filter (o = b) as b_{c}")

    cols = ["title", "status", "priority", "blocked_reason"]
    picks = ", ".join(f"case when u_{c} is null then b_{c}.v else u_{c}.v end as {c}" for c in cols)
    return f"""
    select id, project_id, {picks}, created_at, coalesce(touched, created_at) as updated_at, completed_at
    from (select id, project_id, {', '.join(latest(c) for c in cols)},
                 max(changed_at) filter (o = b) as created_at,
                 max(changed_at) filter (o > b and op in ('update', 'complete')) as touched,
                 max(changed_at) filter (o > b and op = 'complete') as completed_at
          from (select *, max(o) filter (op = 'insert') over (partition by id) as b, max(o) filter (op = 'delete') over (partition by id) as d
                from (select *, row_number() over (order by changed_at, change_id) as o from {source}))
          where b is not null and (d is null or d < b) group by id, project_id)"""


_add("current_state", "todo_changes", _state("todo_changes"))
_add("compact", "todo_changes", _state("todo_changes"))
_add("current_state_as_of", "todo_changes", _state("(select * from todo_changes where changed_at <= timestamp '2024-01-15 00:00:00')"))
_add("stream_ingest", "todo_changes", _state(
    "(select * from todo_changes where not (op in ('insert') and priority > 2) and not (op <> 'insert' and list_contains(set_fields, 'priority') and priority > 2))"))

# --- filters and scalars
_any = "coalesce(list_has_any(tags, ['t1', 't5']), false)"
_add("filter_conditions", "todos", f"""
    select id, coalesce(status = 'blocked' and project_id = 'src3', false) as eq, status <> 'done' as open, {_any} as any_tag,
           tags is not null and not {_any} as no_tag, list_contains(related_files, 'src/f3.py') as mentions,
           title ilike '%ORDER 1%' escape '\\' as icontains,
           created_at > timestamp '1998-01-01' - interval 36 hours as newer, created_at < timestamp '1998-01-01' - interval 30 days as older,
           completed_at is not null as completed, coalesce(status <> 'done' and priority = 2, false) as all_of from todos""")
_add("filter_active", "instructions", "select id, project_id from instructions where active")
_add("filter_similarity", "error_log", f"""
    select id, round(s, 6) as similarity from (select id, {sim('a', 'b')} as s from (
        select id, {grams('error_message')} as a, {grams("concat_ws(' ', error_type, resolution, root_cause)")} as b from error_log)) where s > 0.05""")
_add("scalar_text", "notes", f"""
    select id, {line('content')} as summary_line, {cap('content', 50)} as truncated, substr(content, 1, 150) as preview,
           substr(content, 1, 120) || case when length(content) > 120 then '...' else '' end as ellipsis,
           '50\\%\\_\\\\' || replace(replace(replace(substr(content, 1, 20), '\\', '\\\\'), '%', '\\%'), '_', '\\_') as escaped,
           category || '. ' || project_id as joined,
           case when id % 2 = 0 then category else project_id end as first_non_null,
           array_to_string(tags, '|') || '|' || array_to_string(related_files, '|') as "union",
           substr(sha256(content), 1, 12) as key, cast(ceil(length(content) / 4.0) as bigint) as tokens,
           greatest(1, cast(floor(length(content) / 7.0 - 1000) as bigint)) as hours, category as heading,
           created_at - to_days(cast(id % 9 as int)) + interval 5 hours as moved,
           '["' || array_to_string(tags, '","') || '"]' as json from notes""")
_add("l2_normalise", "memory", """
    select id, 1.0::double as norm, round((embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))))::float::double, 5) as first
    from memory where embedding is not null""")

# --- text similarity
_add("trigram_sets", "error_log", f"select id, array_to_string({grams('error_message')}, '|') as grams from error_log")
_add("trigram_similarity", "notes project_brief", f"""
    select id, round({sim('a', 'b')}, 6) as similarity from (
        select n.id, n.a, b.b from (select id, project_id, {grams('content')} as a from notes) n
        join (select project_id, {grams('tech_stack')} as b from project_brief) b using (project_id))""")


def _pairs(table: str, text: str, threshold: float) -> str:
    return f"""
    select project_id, id_a, id_b, copies_a, copies_b, round(s, 6) as similarity from (
        select a.project_id, a.id as id_a, b.id as id_b, a.n as copies_a, b.n as copies_b, {sim('a.g', 'b.g')} as s
        from sets a join sets b on a.project_id = b.project_id and a.id < b.id) where s > {threshold}"""


def _sets(table: str, text: str) -> str:
    return f"""sets as (select project_id, g, min(id) as id, count(*) as n from (
        select project_id, id, {grams(text)} as g from {table}) where len(g) > 0 group by project_id, g)"""


_add("similar_pairs", "notes", _pairs("notes", "content", 0.8), _sets("notes", "content"))
_add("similar_error_pairs", "error_log", _pairs("error_log", "error_message", 0.7), _sets("error_log", "error_message"))
_HALF = "created_at < timestamp '2024-01-16 00:00:00'"


def _best(asked: str, stored: str, where: str, text: str, block: str, threshold: float) -> tuple[str, str]:
    ctes = f"""
    asked as (select id, {block}, {grams(text)} as g from {asked}),
    stored as (select id, {block}, {grams(text)} as g from {stored} where {where}),
    aset as (select {block}, g, list(id) as ids from asked group by {block}, g),
    sset as (select {block}, g, min(id) as id from stored group by {block}, g),
    hits as (select a.ids, s.id as match_id, {sim('a.g', 's.g')} as s from aset a join sset s using ({block}))"""
    body = f"""
    select unnest(ids) as id, match_id, round(s, 6) as similarity from (
        select *, row_number() over (partition by ids order by s desc, match_id) as r from hits where s > {threshold}) where r = 1"""
    return body, ctes


_add("best_match_notes", "notes", *_best("notes", "notes", _HALF, "content", "project_id, category", 0.8))
_add("best_match_errors", "error_log error_patterns", *_best("error_log", "error_patterns", _HALF, "error_message", "project_id", 0.7))
_add("best_match_instructions", "instructions", *_best("instructions", "instructions", "active", "content", "project_id", 0.8))
_add("exact_match_fallback", "error_log error_patterns", """
    select e.id, (select min(p.id) from error_patterns p where p.project_id = e.project_id and p.error_message = e.error_message) as match_id,
           1.0::double as similarity from error_log e""")
_add("error_frequency", "error_log", """
    select project_id, error_message, count(*) as occurrence_count, min(seen_at) as first_seen_at, max(seen_at) as last_seen_at,
           array_to_string(list_sort(list_distinct(flatten(list(attempted_fixes)))), '|') as fixes
    from error_log group by project_id, error_message""")

def _new_ones(stored: str, incoming: str, text: str, threshold: float) -> str:
    """Rows handled one by one in ``seq`` order: ``led`` holds the ids stored as new; ``known`` and ``near`` what each row is like."""
    return f"""
    kept as materialized (select id, project_id, {grams(text)} as g from {stored}),
    coming as materialized (select id, seq, project_id, {grams(text)} as g from {incoming}),
    known as materialized (select c.id, k.id as target, {sim('c.g', 'k.g')} as s from coming c join kept k using (project_id) where s > {threshold}),
    near as materialized (select c.id, e.id as target, {sim('c.g', 'e.g')} as s from coming c join coming e on e.project_id = c.project_id and e.seq < c.seq where s > {threshold}),
    open as materialized (select id, row_number() over (order by seq) as n, coalesce((select list(target) from near where near.id = c.id), []::bigint[]) as others
             from coming c where id not in (select id from known)),
    walk as (select 0::bigint as n, []::bigint[] as led union all
             select w.n + 1, case when list_has_any(o.others, w.led) then w.led else list_append(w.led, o.id) end from walk w join open o on o.n = w.n + 1),
    led as (select unnest(arg_max(led, n)) as id from walk),
    target as (select id, arg_min(target, struct_pack(a := -s, b := target)) as target from (
        select * from known union all select * from near where target in (select id from led)) where id not in (select id from led) group by id)"""


_add("insert_instructions_if_new", "instructions arriving_instructions", "select id, project_id, content from arriving_instructions where id in (select id from led)",
     _new_ones(f"(select * from instructions where active and {_HALF})", "arriving_instructions", "content", 0.8))


def _merged_errors(stored: str, incoming: str) -> str:
    return _new_ones(stored, incoming, "error_message", 0.7) + f""",
    base as (select id, project_id, error_message, attempted_fixes, resolution, occurrence_count, last_seen_at from {stored} union all
             select id, project_id, error_message, coalesce(attempted_fixes, []), nullif(resolution, ''), 1, seen_at from {incoming} where id in (select id from led)),
    again as (select t.target as id, i.seq, i.seen_at, nullif(i.resolution, '') as resolution, coalesce(i.attempted_fixes, []) as fixes from target t join {incoming} i using (id)),
    tried as (select id, fix, min(struct_pack(a := seq, b := pos)) as spot from (
        select id, -1 as seq, unnest(attempted_fixes) as fix, unnest(range(len(attempted_fixes))) as pos from base where id in (select id from again)
        union all select id, seq, unnest(fixes), unnest(range(len(fixes))) from again) group by id, fix),
    merged as (select b.id, project_id, error_message,
        case when a.n is null then array_to_string(attempted_fixes, '|') else (select coalesce(string_agg(fix, '|' order by spot), '') from tried x where x.id = b.id) end as attempted_fixes,
        coalesce(a.resolution, b.resolution) as resolution, cast(occurrence_count + coalesce(a.n, 0) as int) as occurrence_count, coalesce(a.seen, last_seen_at) as last_seen_at
        from base b left join (select id, count(*) as n, arg_max(seen_at, seq) as seen, arg_max(resolution, seq) filter (resolution is not null) as resolution from again group by id) a using (id))"""


_add("merge_errors", "error_patterns arriving_errors", "select * from merged", _merged_errors("error_patterns", "arriving_errors"))
_add("stream_merge_errors", "error_log", "select id, project_id, error_message, occurrence_count, last_seen_at from merged", """
    stream as (select event_id as id, event_id as seq, 'src' || user_id % 20 as project_id, ['fix' || event_id % 4] as attempted_fixes, null::varchar as resolution, ts as seen_at,
                      'Failure ' || substr(md5((event_id % 40)::varchar), 1, 8) || ' ' || substr(md5((user_id % 30)::varchar), 1, 8) as error_message
               from events where event_type = 'error'),
    nothing as (select id, project_id, error_message, attempted_fixes, resolution, 1 as occurrence_count, seen_at as last_seen_at from stream where false), """ + _merged_errors("nothing", "stream"))


def _merged_notes(stored: str, incoming: str) -> str:
    """Notes handled one by one: a row takes over the most similar text that stands then, the most recently written of equal ones."""
    return f"""
    kept as materialized (select 'n' || id as key, id, project_id, category, content, tags, created_at, {grams('content')} as g from {stored}),
    coming as materialized (select 'r' || id as key, id, seq, project_id, coalesce(nullif(category, ''), 'general') as category, content, coalesce(tags, []) as tags, created_at, {grams('content')} as g from {incoming}),
    close as materialized (
        select c.seq, k.key, {sim('c.g', 'k.g')} as s, -1::bigint as put, k.created_at as written, k.id from coming c join kept k using (project_id, category) where s > 0.8
        union all
        select c.seq, e.key, {sim('c.g', 'e.g')} as s, e.seq, null, e.id from coming c join coming e on e.project_id = c.project_id and e.category = c.category and e.seq < c.seq where s > 0.8),
    turn as materialized (select key, row_number() over (order by seq) as n, coalesce((select list(x.key order by s desc, put desc, written desc, x.id) from close x where x.seq = c.seq), []::varchar[]) as choice from coming c),
    walk as (select 0::bigint as n, []::varchar[] as taken, null::varchar as key, null::varchar as took union all
             select n, case when took is null then taken else list_append(taken, took) end, key, took from (
                select t.n, w.taken, t.key, list_filter(t.choice, lambda x: not list_contains(w.taken, x))[1] as took from walk w join turn t on t.n = w.n + 1)),
    chain as (select key, coalesce(case when took like 'n%' then took end, case when took is null then key end) as head, took from walk where key is not null),
    owner as (select key, head from chain where head is not null union all select c.key, o.head from chain c join owner o on c.head is null and c.took = o.key),
    last as (select o.head, arg_max(c.content, seq) as content, arg_max(c.tags, seq) as tags, arg_max(c.created_at, seq) as created_at
             from owner o join coming c using (key) group by o.head having count(*) filter (o.key <> o.head) > 0),
    merged as (select b.id, project_id, category, coalesce(l.content, b.content) as content, coalesce(l.tags, b.tags) as tags, coalesce(l.created_at, b.created_at) as created_at
        from (select key, id, project_id, category, content, tags, created_at from kept union all
              select key, id, project_id, category, content, tags, created_at from coming where key in (select head from chain)) b left join last l on l.head = b.key)"""


_add("merge_notes", "notes arriving_notes", f"select id, project_id, category, content, {joined('tags')}, created_at from merged",
     _merged_notes(f"(select * from notes where {_HALF})", "arriving_notes"))

_add("import_documents", "notes project_brief md_docs", f"""
    select 'note' as kind, project_id, content as text from merged
    union all
    select 'brief', project_id, project_name from (select * from briefs join md_docs using (doc_id) qualify row_number() over (partition by project_id order by doc_id desc) = 1)
    union all
    select 'brief', project_id, project_name from project_brief where project_id not in (select project_id from md_docs)
    union all
    select 'snapshot', project_id, 'Initial migration from CLAUDE.md. Imported ' || (select count(*) from sections s where s.doc_id = d.doc_id) || ' sections.' from md_docs d""",
     _BRIEF + "," + _CHUNKS + f""",
    arrived as (select doc_id * 1000000 + part + 1000000000 as id, doc_id * 1000000 + part as seq, project_id, content, 'reference' as category,
                       string_split(tags, '|') as tags, {NOW} as created_at from chunks),""" + _merged_notes("notes", "arrived"))

# --- embedding and search


def _hashed(name: str, source: str, dims: int = 64) -> str:
    """Vectors of hashed word counts (CRC-32 of the UTF-8 bytes, to length one) of ``source`` (key, t): ``cs`` is the sum of components times their place."""
    return f"""
    crc_table as materialized (
        select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as tab),
    {name}_words as materialized (select key, word, count(*) as n from (select key, unnest(string_split_regex(lower(t), '\\s+')) as word from ({source})) where word <> '' group by key, word),
    {name}_slots as materialized (
        select word, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(word) + 1), lambda k: case
            when unicode(substr(word, k, 1)) < 128 then [unicode(substr(word, k, 1))::bigint]
            when unicode(substr(word, k, 1)) < 2048 then [(192 + (unicode(substr(word, k, 1)) >> 6))::bigint, (128 + (unicode(substr(word, k, 1)) & 63))::bigint]
            else [(224 + (unicode(substr(word, k, 1)) >> 12))::bigint, (128 + ((unicode(substr(word, k, 1)) >> 6) & 63))::bigint, (128 + (unicode(substr(word, k, 1)) & 63))::bigint] end))),
            lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % {dims} as slot
        from (select distinct word from {name}_words), crc_table),
    {name}_counts as materialized (select key, slot, sum(n)::float as x, sqrt(sum(sum(n) * sum(n)) over (partition by key))::float as norm
        from {name}_words join {name}_slots using (word) group by key, slot),
    {name} as materialized (select key, sum((slot + 1) * (x / norm)::double) as cs, coalesce(max((x / norm)::double) filter (slot = 0), 0) as first, count(*) as filled from {name}_counts group by key)"""


_add("embed_column", "notes", """
    select n.id, 64::int as dims, case when h.key is null then 0.0 else 1.0 end::double as norm, coalesce(h.filled, 0)::int as filled,
           round(coalesce(h.first, 0), 3)::double as first, round(coalesce(h.cs, 0), 3)::double as checksum
    from notes n left join h on h.key = n.id""", _hashed("h", "select id as key, content as t from notes"))
_TAGS = joined("tags")
_add("build_embedding_rows", "snapshots todos notes error_patterns instructions project_brief", f"""
    select project_id, 'snapshot' as source_type, id as source_id, 'summary' as content_type, summary as content_text, summary as embed_text, {_TAGS} from snapshots where summary <> ''
    union all select project_id, 'snapshot', id, 'architecture', architecture_notes, architecture_notes, {_TAGS} from snapshots where architecture_notes <> ''
    union all select project_id, 'todo', id, 'task', title || ': ' || coalesce(description, ''), 'Task: ' || title || '. ' || coalesce(description, ''), {_TAGS} from todos
    union all select project_id, 'note', id, case when category in ('decision', 'debug') then category else 'note' end, content, content, {_TAGS} from notes
    union all select project_id, 'error_pattern', id, 'error', t, t, {_TAGS} from (select *, {strip("'Error: ' || error_message || '. ' || coalesce(root_cause, '') || ' ' || coalesce(resolution, '')")} as t from error_patterns)
    union all select project_id, 'instruction', id, 'instruction', content, content, {_TAGS} from instructions
    union all select project_id, 'snapshot', null, 'brief', t, t, 'project-brief' from (
        select *, concat_ws('. ', nullif(project_name, ''), nullif(tech_stack, ''), nullif(module_map, ''), nullif(conventions, ''), nullif(critical_constraints, ''), nullif(entry_points, '')) as t from project_brief)""")
_add("refresh_embeddings", "memory notes", f"""
    select id, case when hit then 'New ' || content_text else content_text end as content_text,
           case when hit then {NOW} else created_at end as created_at,
           round(case when hit then coalesce(h.cs, 0) else list_sum(list_transform(embedding, lambda x, i: x::double * i)) end, 3)::double as checksum
    from (select *, source_type = 'note' and source_id % 2 = 0 as hit from memory) m left join h on h.key = m.id""",
     _hashed("h", "select id as key, 'New ' || content_text as t from memory where source_type = 'note' and source_id % 2 = 0"))
_add("cosine_similarity", "memory search_queries", """
    select m.id, q.query_id, round(list_cosine_similarity(m.embedding::double[], q.query_vec::double[]), 6) as similarity
    from memory m join search_queries q on m.id = q.query_id
    union all
    select m.id, q.query_id, round(list_cosine_similarity(m.embedding::double[], q.query_vec::double[]), 6)
    from memory m join search_queries q on m.id = q.query_id + 1""")


def _semantic(k: int, where: str, name: str = "semantic", queries: str = "search_queries") -> str:
    return f"""{name} as (select * from (
        select query_id, id, source_id, content_type, sim, cast(row_number() over (partition by query_id order by round(sim, 12) desc, id) as int) as rank
        from (select q.query_id, m.id, m.source_id, m.content_type, list_cosine_similarity(m.embedding::double[], q.query_vec::double[]) as sim
              from {queries} q join memory m using (project_id)
              where m.embedding is not null and q.query_vec is not null and ({where}))) where rank <= {k})"""


def _keyword(k: int, where: str) -> str:
    return f"""keyword as (select * from (
        select query_id, id, content_type, 0.0 as sim, cast(row_number() over (partition by query_id order by created_at desc, id) as int) as rank
        from (select q.query_id, m.* from search_queries q join memory m using (project_id)
              where contains(lower(m.content_text), lower(q.query_text)) and ({where}))) where rank <= {k})"""


_HYBRID = """hybrid as (select query_id, id, content_type, search_mode, sim, cast(row_number() over (partition by query_id order by l, rank) as int) as rank
    from (select *, row_number() over (partition by query_id, id order by l) as seen from (
        select query_id, id, content_type, sim, rank, 0 as l, 'semantic' as search_mode from semantic
        union all select query_id, id, content_type, sim, rank, 1, 'keyword' from keyword)) where seen = 1)"""
_SELECT = "select query_id, rank, id, content_type, '{}' as search_mode, round(sim, 6) as similarity from {}"
_Q = "memory search_queries"
_add("semantic_topk", _Q, _SELECT.format("semantic", "semantic"), _semantic(5, "true"))
_add("semantic_topk_shuffled", _Q, _SELECT.format("semantic", "semantic"), _semantic(5, "true"))
_add("ann_topk_all_cells", _Q, "select query_id, rank, id, round(sim, 6) as similarity from semantic", _semantic(5, "true"))
_add("semantic_topk_filtered", _Q, _SELECT.format("semantic", "semantic"),
     _semantic(3, "content_type = 'note' and list_has_any(tags, ['t1', 't2', 't3'])"))
_add("keyword_search", _Q, _SELECT.format("keyword", "keyword").replace("round(sim, 6)", "sim::double"), _keyword(5, "true"))
_add("search", _Q, _SELECT.format("keyword", "keyword").replace("round(sim, 6)", "sim::double"), _keyword(5, "list_has_any(tags, ['t1', 't2'])"))
_tagged = "content_type = 'note' and list_has_any(tags, ['t1', 't2'])"
_add("search_modes", _Q, """
    select query_id, rank, id, content_type, 'semantic' as search_mode, round(sim, 6) as similarity, 'semantic' as mode from other
    union all select query_id, rank, id, content_type, search_mode, round(sim, 6), 'hybrid' from hybrid where rank <= 4""",
     f"""{_semantic(3, "list_has_any(tags, ['t3', 't5'])", "other")}, {_semantic(4, _tagged)}, {_keyword(4, _tagged)}, {_HYBRID}""")
_add("degrade_without_vectors", _Q, "select query_id, rank, id, 'keyword' as search_mode from keyword", _keyword(5, "true"))
_HITS = "select query_id, rank, id, content_type, search_mode, round(sim, 6) as similarity from hybrid where rank <= 5"
_add("hybrid_search", _Q, _HITS, f"{_semantic(5, 'true')}, {_keyword(5, 'true')}, {_HYBRID}")
_note = "content_type = 'note'"
_add("hybrid_search_filtered", _Q, _HITS, f"{_semantic(5, _note)}, {_keyword(5, _note)}, {_HYBRID}")
_MATCHED = """
    select query_id, id, cast(rank as int) as rank, round(score, 6) as match_score, match_type from (
        select query_id, id, score, match_type, row_number() over (partition by query_id order by place) as rank from (
            select query_id, id, s as score, 'text' as match_type, r as place from texts
            union all
            select f.query_id, f.source_id, min(f.sim), 'semantic', min(f.rank) + 3 from semantic f
            where f.query_id not in (select query_id from texts where r = 3) and (f.query_id, f.source_id) not in (select query_id, id from texts)
              and f.source_id in (select id from error_patterns) group by f.query_id, f.source_id)) where rank <= 3"""


def _texts(queries: str) -> str:
    return f"""
    qs as (select project_id, g, list(query_id) as ids from (select query_id, project_id, {grams('query_text')} as g from {queries}) group by project_id, g),
    ps as (select id, project_id, {grams('error_message')} as g from error_patterns),
    scored as (select qs.ids, ps.id, {sim('qs.g', 'ps.g')} as s from qs join ps using (project_id)),
    texts as (select unnest(ids) as query_id, id, s, r from (
        select *, row_number() over (partition by ids order by s desc, id) as r from scored where s > 0.3) where r <= 3),
    {_semantic(3, "content_type = 'error'", queries=queries)}"""


_add("match_errors", "memory error_queries error_patterns", _MATCHED, _texts("error_queries"))
_add("match_errors_keyword", "error_queries error_patterns", """
    select query_id, id, cast(rank as int) as rank, 0.0::double as match_score, 'keyword' as match_type from (
        select q.query_id, p.id, row_number() over (partition by q.query_id order by p.last_seen_at desc, p.id) as rank
        from error_queries q join error_patterns p on p.project_id = q.project_id and contains(lower(p.error_message), lower(substr(q.query_text, 1, 100)))) where rank <= 3""")

# --- joins
_add("with_counts", "projects notes project_brief", """
    select id as project_id, (select count(*) from notes n where n.project_id = p.id) as notes,
           (select count(*) from project_brief b where b.project_id = p.id) as briefs from projects p""")
_add("resolve_sources", "memory error_patterns", """
    select m.id, m.source_id, e.error_message from memory m join error_patterns e on e.id = m.source_id where m.source_type = 'error_pattern'""")
_add("pair_queries", _Q, """
    select m.id, m.project_id, q.asked from memory m join (select project_id, count(*) as asked from search_queries group by project_id) q using (project_id)""")
_add("minus_keys", "memory error_log", "select id, project_id from memory where id not in (select id from error_log)")
_PATHS = "paths as (select distinct project_id, unnest(file_paths) as path from error_patterns)"
_add("join_member", "notes error_patterns", """
    select n.id, n.project_id, p.path from notes n join paths p on p.project_id = n.project_id and list_contains(n.related_files, p.path)""", _PATHS)
_PAIRS = "pairs as (select project_id, coalesce(parent_snapshot_id, -1) as id1, id as id2 from snapshots)"
_add("join_pairs", "snapshots", """
    select id1, id2, a.summary as summary_1, b.summary as summary_2 from pairs p
    left join snapshots a on a.id = p.id1 and a.project_id = p.project_id left join snapshots b on b.id = p.id2 and b.project_id = p.project_id""", _PAIRS)
_add("upsert_join", "project_brief sessions", """
    select project_id, b.project_name, case when s.project_id is not null then 'seen' else b.module_map end as module_map
    from project_brief b full join (select distinct project_id from sessions) s using (project_id)""")

# --- reports
_add("list_projects", "projects snapshots todos notes", """
    select id as project_id, name, path, last_accessed_at, (select count(*) from snapshots s where s.project_id = p.id) as snapshot_count,
           (select count(*) from todos s where s.project_id = p.id and status <> 'done') as active_todos,
           (select count(*) from notes s where s.project_id = p.id) as note_count from projects p""")
_ALL = "snapshots todos notes memory error_patterns instructions"


def _stats(key: str) -> str:
    counts = ", ".join(
        f"(select count(*) from {t} x where ({key} = p.project_id){w}) as {name}"
        for name, t, w in (("snapshots", "snapshots", ""), ("notes", "notes", ""), ("memories", "memory", ""),
                           ("error_patterns", "error_patterns", ""), ("instructions", "instructions", " and active"))
    )
    return f"""select p.project_id, {counts}, (select coalesce(string_agg(status || '=' || n, '|' order by status), '') from (
        select status, count(*) as n from todos x where {key} = p.project_id group by status)) as todos from"""


_add("stats", _ALL + " projects", _stats("x.project_id") + """ (select id as project_id from projects union select project_id from snapshots union select project_id from notes union select project_id from memory
    union select project_id from error_patterns union select project_id from instructions where active union select project_id from todos) p""")
_add("stats_global", _ALL, _stats("'all'") + " (select 'all' as project_id) p")
_TODO = f"project_id, id, title, status, priority, {_TAGS}, blocked_reason, created_at, updated_at"
_add("list_todos", "todos", f"select {_TODO} from todos where status <> 'done'")
_add("list_todos_tagged", "todos", f"select {_TODO} from todos where list_has_any(tags, ['t2', 't6'])")
_add("todo_board", "todos projects", """
    select p.project_id, s.status, (select count(*) from todos t where t.project_id = p.project_id and t.status = s.status) as size,
           (select count(*) from todos t where t.project_id = p.project_id) as total, null::bigint as id
    from (select project_id from todos union select id from projects) p, (select unnest(['todo', 'in_progress', 'blocked', 'done']) as status) s
    union all select project_id, status, null, null, id from todos""")
_add("list_notes", "notes", f"select project_id, rank, id, category, content from {newest('notes', 20)}")
_add("list_notes_category", "notes", f"""select project_id, rank, id, category, content from {newest('notes', 5, where="category = 'decision'")}""")
_add("list_snapshots", "snapshots", f"select project_id, rank, id, summary, created_at from {newest('snapshots', 20)}")
_add("list_error_patterns", "error_patterns", f"select project_id, rank, id, error_message, occurrence_count, last_seen_at from {newest('error_patterns', 50, 'last_seen_at')}")
_add("list_instructions", "instructions", "select project_id, id, content, priority, created_at from instructions where active")
_add("lookup_by_ids", "notes todo_changes", """
    select k.project_id, k.id, n.content, n.id is not null as found from (select distinct project_id, id from todo_changes) k
    left join notes n on n.id = k.id and n.project_id = k.project_id""")
_TEXTS = ["summary", "architecture_notes", "module_focus"]
_LISTS = ["assumptions", "constraints", "file_paths", "tags"]


def _val(side: str, f: str) -> str:
    return f"{side}.{f}" if f in _TEXTS else f"""('["' || array_to_string({side}.{f}, '","') || '"]')"""


def _diff() -> tuple[str, str]:
    parts, names = [], []
    for f in _TEXTS + _LISTS:
        a, b = _val("a", f), _val("b", f)
        parts.append(f"case when {a} is distinct from {b} then '{f}:' || coalesce({a}, '~') || '>' || coalesce({b}, '~') end")
        names.append(f"case when {a} is distinct from {b} then '{f}' end")
    return f"concat_ws(';', {', '.join(parts)})", f"concat_ws('|', {', '.join(names)})"


_changes, _names = _diff()
_add("diff_snapshots", "snapshots", f"""
    select id1, id2, a.id is null or b.id is null as error, case when a.id is not null and b.id is not null then {_changes} end as changes,
           case when a.id is not null and b.id is not null then {_names} end as fields_changed
    from pairs p left join snapshots a on a.id = p.id1 and a.project_id = p.project_id left join snapshots b on b.id = p.id2 and b.project_id = p.project_id""", _PAIRS)
_add("diff_consecutive_snapshots", "snapshots", f"""
    select b.project_id, a.id as id1, b.id as id2, {_changes} as changes, {_names} as fields_changed
    from (select *, lag(id) over (partition by project_id order by created_at, id) as prev from snapshots) b join snapshots a on a.id = b.prev""")


def _row(section: str, source: str, where: str = "true", rank: str = "null", id: str = "id", kind: str = "null", text: str = "null",
         detail: str = "null", priority: str = "null", n: str = "null", at: str = "null", key: str = "project_id",
         tags: str = "null", assumptions: str = "null", constraints: str = "null") -> str:
    lists = ", ".join(f"array_to_string(cast({v} as varchar[]), '|') as {c}" for c, v in (("tags", tags), ("assumptions", assumptions), ("constraints", constraints)))
    return (
        f"select {key}, '{section}' as section, cast({rank} as int) as rank, cast({id} as bigint) as id, cast({kind} as varchar) as kind, "
        f"cast({text} as varchar) as text, cast({detail} as varchar) as detail, cast({priority} as int) as priority, cast({n} as bigint) as n, "
        f"cast({at} as timestamp) as at, {lists} from {source} where {where}"
    )


_open = _row("active_todos", "todos", "status <> 'done'", kind="status", text="title", detail="blocked_reason", priority="priority", at="created_at", tags="tags")
_COUNTED = "(select p.project_id, least((select count(*) from {0} x where x.project_id = p.project_id and {1}), {2}) as c from (select id as project_id from projects union select project_id from {0} where {1}) p)"
_add("summarize_project", "projects snapshots todos notes", " union all ".join([
    _row("latest_snapshots", newest("snapshots", 3), rank="rank", kind="module_focus", text="summary", detail="architecture_notes", at="created_at",
         tags="tags", assumptions="assumptions", constraints="constraints"),
    _open,
    _row("recent_notes", newest("notes", 5), rank="rank", kind="category", text="content", at="created_at", tags="tags"),
    _row("snapshot_count", _COUNTED.format("snapshots", "true", 3), id="null", n="c"),
    _row("active_todo_count", _COUNTED.format("todos", "status <> 'done'", 10**18), id="null", n="c"),
]))
_add("session_sync", "snapshots todos notes memory instructions error_patterns", " union all ".join([
    _row("snapshot", newest("snapshots", 1), rank="rank", kind="module_focus", text="summary", at="created_at"),
    _open,
    _row("recent_notes", newest("notes", 10), rank="rank", kind="category", text="substr(content, 1, 150)", at="created_at", tags="tags"),
    _row("recent_memories", newest("memory", 10), rank="rank", kind="content_type", text="substr(content_text, 1, 100)", at="created_at", tags="tags"),
    _row("instructions", "instructions", "active", kind="category", text="content", priority="priority", at="created_at"),
    _row("recent_error_patterns", newest("error_patterns", 5, "last_seen_at"), rank="rank", kind="error_type", text="error_message",
         detail="resolution", n="occurrence_count", at="last_seen_at"),
]))


def _recent(now: str) -> str:
    branches = {
        "snapshots": ("snapshots", "created_at", "true", dict(kind="module_focus", text="summary", tags="tags")),
        "notes": ("notes", "created_at", "true", dict(kind="category", text="content", tags="tags")),
        "new_todos": ("todos", "created_at", "true", dict(kind="status", text="title", priority="priority", tags="tags")),
        "completed": ("todos", "completed_at", "completed_at is not null", dict(text="title")),
    }
    window = " union all ".join(
        _row(s, newest(t, 10, time, f"{w} and {time} > {now} - interval 24 hours"), rank="rank", at=time, **c)
        for s, (t, time, w, c) in branches.items()
    )
    last = " union all ".join(_row(s, newest(t, 5, time, w), rank="rank", at=time, **c) for s, (t, time, w, c) in branches.items())
    return f"""inside as ({window}), latest as ({last}),
    chosen as (select *, false as fallback from inside union all select *, true from latest where project_id not in (select project_id from inside)),
    changes as (select p.id as project_id, c.* exclude (project_id, fallback), coalesce(c.fallback, true) as fallback
                from projects p left join chosen c on c.project_id = p.id)"""


_R = "projects snapshots todos notes"
_add("recent_changes", _R, "select * from changes", _recent(NOON))
_add("recent_changes_quiet", _R, "select * from changes", _recent(NOW))
_block = lambda s, title, text: (
    f"case when count(*) filter (section = '{s}') > 0 then {NL} || count(*) filter (section = '{s}') || ' {title}' || {NL} || "
    f"string_agg({text}, {NL} order by rank) filter (section = '{s}') end"
)
_add("recent_changes_narrative", _R, f"""
    select project_id, bool_or(fallback) as fallback, concat_ws({NL},
        case when bool_or(fallback) then 'No changes in last 24h. Last recorded activity:' else 'Changes in last 24h:' end,
        {_block('snapshots', 'snapshot(s):', "'  - ' || text || case when coalesce(kind, '') <> '' then ' [' || kind || ']' else '' end")},
        {_block('notes', 'note(s):', "'  - [' || kind || '] ' || substr(text, 1, 120) || case when length(text) > 120 then '...' else '' end")},
        {_block('new_todos', 'new task(s):', "'  - [' || kind || '] ' || text")},
        {_block('completed', 'completed:', "'  - done: ' || text")},
        case when count(section) = 0 then '  No activity recorded for this project.' end) as narrative,
        cast(count(*) filter (section = 'snapshots') as int) as n_snapshots, cast(count(*) filter (section = 'notes') as int) as n_notes,
        cast(count(*) filter (section = 'new_todos') as int) as n_new_todos, cast(count(*) filter (section = 'completed') as int) as n_completed
    from changes group by project_id""", _recent(NOON))


def _files(table: str, arr: str, limit: int | None, time: str, where: str = "true") -> str:
    cut = f"qualify rank <= {limit}" if limit else ""
    rank = f"cast(row_number() over (partition by x.project_id, p.path order by {time} desc, x.id) as int)" if limit else "null"
    return f"(select x.*, p.path, {rank} as rank from {table} x join paths p on p.project_id = x.project_id and list_contains(x.{arr}, p.path) where {where} {cut})"


_K = "project_id, path"
_add("file_context", "notes todos error_patterns snapshots", f"""
    select p.project_id, p.path, c.* exclude (project_id, path), c.section is not null as has_context from paths p left join ("""
     + " union all ".join([
         _row("notes", _files("notes", "related_files", 10, "created_at"), rank="rank", kind="category", text="content", at="created_at", key=_K, tags="tags"),
         _row("active_todos", _files("todos", "related_files", None, "", "status <> 'done'"), kind="status", text="title", detail="description", priority="priority", key=_K, tags="tags"),
         _row("error_patterns", _files("error_patterns", "file_paths", 5, "last_seen_at"), rank="rank", kind="error_type", text="error_message",
              detail="resolution", n="occurrence_count", at="last_seen_at", key=_K),
         _row("recent_snapshots", _files("snapshots", "file_paths", 3, "created_at"), rank="rank", kind="module_focus", text="summary", at="created_at", key=_K),
     ]) + ") c on c.project_id = p.project_id and c.path = p.path", _PATHS)
_add("file_hotspots", "notes todos error_patterns snapshots", """
    select project_id, path, count(*) filter (k = 'n') as notes, count(*) filter (k = 't') as todos, count(*) filter (k = 'e') as errors,
           count(*) filter (k = 's') as snapshots, cast(sum(o) as bigint) as error_occurrences from (
        select project_id, unnest(related_files) as path, 'n' as k, 0 as o from notes
        union all select project_id, unnest(related_files), 't', 0 from todos
        union all select project_id, unnest(file_paths), 'e', occurrence_count from error_patterns
        union all select project_id, unnest(file_paths), 's', 0 from snapshots) group by project_id, path""")
_counts = " union all ".join(
    _row("counts", f"(select id as project_id, '{name}' as k, (select count(*) from {t} x where x.project_id = p.id and {w}) as c from projects p)", id="null", kind="k", n="c")
    for name, t, w in (("snapshots", "snapshots", "true"), ("notes", "notes", "true"), ("active_todos", "todos", "status <> 'done'"),
                       ("errors", "error_patterns", "true"), ("instructions", "instructions", "active"))
)
_add("project_index", "projects project_brief snapshots todos notes error_patterns instructions", " union all ".join([
    _row("project", "(select p.id as project_id, b.project_name, b.tech_stack from projects p left join project_brief b on b.project_id = p.id)",
         id="null", text="coalesce(nullif(project_name, ''), 'Unknown')", detail=f"case when tech_stack <> '' then {line('tech_stack', 200)} end"),
    _counts,
    _row("active_todos", "todos", "status <> 'done'", kind="status", text="title", priority="priority", at="created_at"),
    _row("recent_snapshots", newest("snapshots", 3), rank="rank", text=line("summary"), at="created_at"),
    _row("notes_by_category", newest("notes", 20), rank="rank", kind="category", text=line("content")),
    _row("error_patterns", newest("error_patterns", 10, "last_seen_at"), rank="rank", kind="error_type", text=line("error_message"), n="occurrence_count"),
    _row("active_instructions", "instructions", "active", text=line("content"), priority="priority", at="created_at"),
]))


def _brief(compact: bool) -> str:
    titles = {"tech_stack": ("Stack", 200), "module_map": ("Modules", 200), "conventions": ("Conventions", 150),
              "critical_constraints": ("Constraints", 200), "entry_points": ("Entry points", 200)}
    lines = ", ".join(f"case when {f} <> '' then '{t}: ' || {cap(f, n) if compact else f} end" for f, (t, n) in titles.items())
    sizes = ", ".join(f"case when b.project_id is not null then cast(length(coalesce({f}, '')) as int) end as {f}_chars" for f in titles)
    return f"""select p.id as project_id, case when b.project_id is not null then concat_ws({NL}, 'Project: ' || project_name, {lines},
        'Last updated: ' || strftime(updated_at, '%Y-%m-%d %H:%M:%S')) end as brief,
        case when b.project_id is not null then cast({_total} as int) end as total_chars, {sizes}, b.project_id is not null as exists
        from projects p left join project_brief b on b.project_id = p.id"""


_add("render_brief", "projects project_brief", _brief(False))
_add("render_brief_compact", "projects project_brief", _brief(True))
_old = f"coalesce(created_at < {NOW} - interval 10 days and not list_has_any(tags, ['t1', 't3']), false)"
_add("prune_memory", "memory", f"""
    select project_id, id, null::bigint as pruned from memory where not {_old}
    union all select project_id, null, count(*) filter ({_old}) from memory group by project_id""")

# --- streams
_ACT = """select 'src' || user_id % 20 as project_id, case event_type when 'purchase' then 'snapshot' when 'signup' then 'todo'
    when 'error' then 'error' else 'note' end as kind, ts, event_id from events"""


def _tumbling(extra: str = "true") -> str:
    return f"""with a as ({_ACT}) select * from (select project_id, kind, date_trunc('day', ts)::timestamp as window_start,
        date_trunc('day', ts)::timestamp + interval 1 day as window_end, count(*) as items from a group by all) where {extra}"""


def _session(extra: str = "true") -> str:
    return f"""with a as ({_ACT}),
    b as (select *, case when ts > lag(ts) over (partition by project_id order by ts) + interval 90 minutes then 1 else 0 end as fresh from a),
    c as (select *, sum(fresh) over (partition by project_id order by ts) as g from b)
    select * from (select project_id, min(ts) as started_at, max(ts) as ended_at, count(*) filter (kind = 'snapshot') as snapshot_count, count(*) as items
    from c group by project_id, g) where {extra}"""


_MARK = "(select max(ts) from events) - interval 1 hour"
ORACLES["activity_windows"] = f"""with a as ({_ACT}) select project_id, kind, s as window_start, s + interval 24 hours as window_end, count(*) as items
    from (select *, date_trunc('hour', ts)::timestamp - to_hours(cast(unnest(range(0, 24)) as int)) as s from a) group by all"""
ORACLES["activity_windows_tumbling"] = _tumbling()
ORACLES["activity_sessions"] = _session()
ORACLES["stream_activity_windows"] = _tumbling(f"window_end <= {_MARK}")
ORACLES["stream_activity_sessions"] = _session(f"ended_at + interval 90 minutes <= {_MARK}")
ORACLES["stream_drop_replays"] = f"with a as ({_ACT}) select project_id, kind, ts, event_id from a"
_add("stream_embed", "error_log", "select event_id as source_id, 'src' || user_id % 20 as project_id, 64::int as dims, round(h.cs, 3)::double as checksum from events join h on h.key = event_id where event_type = 'error'",
     _hashed("h", "select event_id as key, 'Failure ' || substr(md5((event_id % 40)::varchar), 1, 8) || ' ' || substr(md5((user_id % 30)::varchar), 1, 8) as t from events where event_type = 'error'"))
_add("stream_task_state", "todo_changes", """
    select id, change_id, changed_at, from_status, to_status,
           case when from_status is not null then (epoch_us(changed_at) - epoch_us(since)) / 1e6 end as seconds_in_status, done.v as completed_at
    from (select *, last_value(case when to_status is distinct from from_status then changed_at end ignore nulls)
                    over (w rows between unbounded preceding and 1 preceding) as since,
                 last_value(case op when 'complete' then struct_pack(v := changed_at) when 'insert' then struct_pack(v := null::timestamp)
                            when 'delete' then struct_pack(v := null::timestamp) end ignore nulls) over (w rows unbounded preceding) as done
          from (select *, lag(to_status) over (partition by id order by changed_at, change_id) as from_status
                from (select *, case op when 'complete' then 'done' when 'delete' then null else status end as to_status
                      from (select *, last_value(case op when 'insert' then true when 'delete' then false end ignore nulls)
                                      over (partition by id order by changed_at, change_id rows between unbounded preceding and 1 preceding) as alive
                            from todo_changes)
                      where op = 'insert' or (alive and (op <> 'update' or list_contains(set_fields, 'status')))))
          window w as (partition by id order by changed_at, change_id))""")
_add("stream_match_errors", "memory error_patterns", _MATCHED, f"""
    asked as (select event_id as query_id, 'src' || user_id % 20 as project_id, embedding as query_vec,
                     'Failure ' || substr(md5((event_id % 40)::varchar), 1, 8) || ' ' || substr(md5((user_id % 30)::varchar), 1, 8) as query_text
              from events left join embeddings on vec_id = event_id where event_type = 'error'), {_texts("asked")}""")
