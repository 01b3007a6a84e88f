"""Memory tables derived from the generic test parquet files.

One SQL text per table, rendered for Spark or for an outside SQL engine used as
a check. All tables are made of every row of their source; those named ``arriving_`` are rows that come in
beside what is stored: a half as they are, a fourth a little longer, a fourth with other texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

_MACROS = {
    "spark": {
        "ARR": "array({0})",
        "DAYS": "make_dt_interval(cast({0} as int))",
        "MINS": "make_dt_interval(0, 0, cast({0} as int))",
        "JSONK": "get_json_object({0}, '$.k')",
        "S": "cast({0} as string)",
        "WORDS": "split({0}, ' ')",
        "T0": "timestamp_ntz '2024-01-01 00:00:00'",
        "NL": "char(10)",
        "ARGMIN": "min_by({0})",
                "LEN": "size({0})",
        "FIRST": "0",
    },
    "duckdb": {
        "ARR": "list_value({0})",
        "DAYS": "to_days(cast({0} as int))",
        "MINS": "to_minutes(cast({0} as int))",
        "JSONK": "json_extract_string({0}, '$.k')",
        "S": "cast({0} as varchar)",
        "WORDS": "string_split({0}, ' ')",
        "T0": "timestamp '2024-01-01 00:00:00'",
        "NL": "chr(10)",
        "ARGMIN": "arg_min_null({0})",
        "LEN": "len({0})",
        "FIRST": "1",
    },
}

_BRIEFS = """
        select source as project_id, concat('Project ', source) as project_name,
               max(case when doc_id % 4 = 0 then text end) as tech_stack,
               max(case when doc_id % 4 = 1 then text end) as module_map,
               max(case when doc_id % 4 = 2 then text end) as conventions,
               max(case when doc_id % 4 = 3 and n_chars > 1500 then text end) as critical_constraints,
               cast(null as varchar(9)) as entry_points,
               @T0() + @DAYS(count(*) % 28) as updated_at
        from documents group by source"""

# A project holds the rows of one document source; users, customers, conversations
# and vectors are dealt to projects by their id.
_SQL: dict[str, str] = {
    "projects": """
        select source as id, concat('Project ', source) as name, concat('/work/', source) as path,
               @T0() as created_at, @T0() + @DAYS(count(*) % 28) as last_accessed_at
        from documents group by source
        union all
        select concat(max(source), '/empty') as id, 'Empty' as name, '/work' as path, @T0() as created_at, @T0() as last_accessed_at
        from documents""",
    "project_brief": _BRIEFS + " having count(*) % 5 <> 0",
    "every_brief": _BRIEFS,
    "notes": """
        select doc_id as id, source as project_id, text as content,
               case doc_id % 5 when 0 then 'decision' when 1 then 'debug' when 2 then 'architecture'
                    when 3 then 'reference' else 'general' end as category,
               @ARR(lang, concat('t', @S(doc_id % 7))) as tags,
               @ARR(concat('src/f', @S(doc_id % 11), '.py')) as related_files,
               doc_id % 100 * 100 as snapshot_id,
               @T0() + @DAYS(doc_id % 30) + @MINS(doc_id % 1440) as created_at
        from documents""",
    "todos": """
        select o_orderkey as id, concat('src', @S(o_custkey % 20)) as project_id,
               concat('Order ', @S(o_orderkey)) as title,
               case when o_orderkey % 3 = 0 then concat('total ', @S(o_orderkey % 1000)) end as description,
               case o_orderstatus when 'F' then 'done' when 'O' then 'todo'
                    else case when o_orderkey % 5 = 0 then 'blocked' else 'in_progress' end end as status,
               case when o_orderkey % 97 = 0 then null when o_orderpriority = '1-URGENT' then 2
                    when o_orderpriority = '2-HIGH' then 1 else 0 end as priority,
               @ARR(concat('t', @S(o_orderkey % 7))) as tags,
               @ARR(concat('src/f', @S(o_orderkey % 11), '.py')) as related_files,
               case when o_orderstatus = 'P' and o_orderkey % 5 = 0
                    then concat('wait ', @S(o_orderkey % 4)) end as blocked_reason,
               o_orderdate as created_at, o_orderdate as updated_at,
               case when o_orderstatus = 'F' then o_orderdate + @DAYS(o_orderkey % 9 + 1) end as completed_at
        from orders""",
    "error_log": """
        select event_id as id, concat('src', @S(user_id % 20)) as project_id,
               concat(case event_id % 6
                        when 0 then 'TypeError: cannot read property '
                        when 1 then 'ECONNREFUSED: connect timeout to host '
                        when 2 then 'Module not found, failed to resolve package '
                        when 3 then 'AssertionError: expected snapshot to equal '
                        when 4 then 'Build failed with unknown symbol '
                        else 'Permission denied while opening ' end,
                      substr(md5(@S(event_id % 40)), 1, 8), ' ',
                      substr(md5(@S(user_id % 30)), 1, 8), ' k', @JSONK(props)) as error_message,
               case event_id % 9 when 0 then 'build' when 1 then 'runtime' when 2 then 'type'
                    when 3 then 'test' when 4 then 'dependency' when 5 then 'config'
                    when 6 then 'network' when 7 then 'general' else 'other' end as error_type,
               @ARR(concat('fix', @S(event_id % 4))) as attempted_fixes,
               case when event_id % 4 = 1 then concat('cause ', @S(event_id % 17)) end as root_cause,
               case when event_id % 3 = 0 then concat('resolved by r', @S(event_id % 13)) end as resolution,
               @ARR(concat('src/f', @S(event_id % 11), '.py')) as file_paths,
               @ARR(concat('t', @S(event_id % 7))) as tags,
               ts as seen_at
        from events where event_type = 'error'""",
    "error_patterns": """
        select min(id) as id, project_id, error_message,
               @ARGMIN(error_type, id) as error_type,
               @ARGMIN(attempted_fixes, id) as attempted_fixes,
               @ARGMIN(root_cause, id) as root_cause,
               @ARGMIN(resolution, id) as resolution,
               @ARGMIN(file_paths, id) as file_paths,
               @ARGMIN(tags, id) as tags,
               cast(count(*) as int) as occurrence_count,
               max(seen_at) as last_seen_at, min(seen_at) as created_at
        from error_log group by project_id, error_message""",
    "arriving_errors": """
        select id as seq, id + 1000000000 as id, project_id,
               case id % 4 when 1 then concat(error_message, ' again')
                    when 2 then concat('Timeout in step ', substr(md5(@S(id % 50)), 1, 8), ' of ', substr(error_message, 1, 20))
                    else error_message end as error_message,
               error_type, attempted_fixes, root_cause, resolution, file_paths, tags, seen_at
        from error_log""",
    "arriving_notes": """
        select id as seq, id + 1000000000 as id, project_id,
               case id % 4 when 1 then concat(content, ' and some words more')
                    when 2 then concat('Decided in meeting ', @S(id % 40), ': option ', @S(id % 3), ' for module ', @S(id % 6))
                    else content end as content,
               category, tags, related_files, snapshot_id, created_at
        from notes""",
    "arriving_instructions": """
        select id as seq, id + 1000000000 as id, project_id,
               case id % 4 when 1 then concat(content, ' as before')
                    when 2 then concat('Always run step ', @S(id % 30), ' before commit of part ', @S(id % 4))
                    else content end as content,
               category, active, priority, tags, created_at
        from instructions""",
    "snapshots": """
        select conv_id * 100 + turn as id, concat('src', @S(conv_id % 20)) as project_id,
               conv_id as session_id, text as summary,
               case when turn % 3 = 1 then concat('notes of turn ', @S(turn)) end as architecture_notes,
               concat('module', @S(turn % 4)) as module_focus,
               @ARR(concat('a', @S(turn % 2))) as assumptions,
               @ARR(concat('c', @S(conv_id % 3)), 'fixed') as constraints,
               @ARR(role, concat('t', @S(conv_id % 7))) as tags,
               @ARR(concat('src/f', @S(conv_id % 11), '.py')) as file_paths,
               lag(conv_id * 100 + turn) over (partition by conv_id order by turn) as parent_snapshot_id,
               @T0() + @DAYS(conv_id % 30) + @MINS(turn) as created_at
        from conversations where role <> 'system'""",
    "sessions": """
        select session_id as id, project_id, min(created_at) as started_at, max(created_at) as ended_at
        from snapshots group by session_id, project_id""",
    "instructions": """
        select conv_id as id, concat('src', @S(conv_id % 20)) as project_id, text as content,
               case conv_id % 8 when 0 then 'general' when 1 then 'build' when 2 then 'style'
                    when 3 then 'workflow' when 4 then 'constraint' when 5 then 'security'
                    when 6 then 'testing' else 'other' end as category,
               case when conv_id % 11 = 0 then null else conv_id % 10 <> 0 end as active,
               cast(conv_id % 3 as int) as priority,
               @ARR(role) as tags,
               @T0() + @DAYS(conv_id % 30) as created_at
        from conversations where turn = 0""",
    "memory": """
        select d.doc_id as id, d.source as project_id,
               case d.doc_id % 5 when 0 then 'snapshot' when 1 then 'note' when 2 then 'todo'
                    when 3 then 'error_pattern' else 'instruction' end as source_type,
               d.doc_id as source_id,
               case d.doc_id % 5 when 0 then 'summary' when 1 then 'note' when 2 then 'task'
                    when 3 then 'error' else 'instruction' end as content_type,
               d.text as content_text,
               case when d.doc_id % 41 <> 0 then e.embedding end as embedding,
               @T0() + @DAYS(d.doc_id % 30) + @MINS(d.doc_id % 1440) as created_at,
               case when d.doc_id % 17 <> 0 then @ARR(concat('t', @S(d.doc_id % 7))) end as tags
        from documents d
        left join embeddings e on e.vec_id = d.doc_id""",
    "search_queries": """
        select e.vec_id as query_id, concat('src', @S(e.vec_id % 20)) as project_id,
               @WORDS(d.text)[@FIRST() + e.vec_id % @LEN(@WORDS(d.text))] as query_text,
               e.embedding as query_vec
        from embeddings e
        left join documents d on d.doc_id = e.vec_id""",
    "error_queries": """
        select q.id as query_id, q.project_id, q.error_message as query_text, e.embedding as query_vec
        from error_log q
        left join embeddings e on e.vec_id = q.id""",
    "todo_changes": """
        select event_id as change_id, ts as changed_at, user_id * 10 + event_id % 10 as id,
               concat('src', @S(user_id % 20)) as project_id,
               case event_type when 'signup' then 'insert' when 'purchase' then 'complete'
                    when 'error' then 'delete' else 'update' end as op,
               case event_type when 'click' then @ARR('status')
                    when 'view' then @ARR('priority', 'blocked_reason')
                    else @ARR('title', 'status', 'priority') end as set_fields,
               concat('Task ', @S(event_id)) as title,
               case event_id % 3 when 0 then 'todo' when 1 then 'in_progress' else 'blocked' end as status,
               cast(event_id % 4 as int) as priority,
               case when event_id % 2 = 0 then concat('wait ', @S(event_id % 5)) end as blocked_reason
        from events""",
    "md_docs": """
        select doc_id, source as project_id,
               concat(case when doc_id % 3 = 0 then 'Project: p' when doc_id % 3 = 1 then 'intro ' else '# P' end,
                      @S(doc_id), @NL(), '# Overview', @NL(), text, @NL(),
                      '## Tech Stack', @NL(), lang, ' and ', source, @NL(),
                      '## Coding Rules', @NL(), '### Build', @NL(), 'make all', @NL(),
                      '#### not a heading', @NL(), '', @NL(), '## Overview', @NL(), 'last') as content
        from documents""",
}

_DEPENDS = {
    "error_patterns": ["error_log"], "sessions": ["snapshots"], "error_queries": ["error_log"],
    "arriving_errors": ["error_log"], "arriving_notes": ["notes"], "arriving_instructions": ["instructions"],
}


def _render(sql: str, dialect: str) -> str:
    """Fill in the ``@NAME(args)`` macros for one dialect."""
    macros = _MACROS[dialect]
    while (start := sql.rfind("@")) >= 0:  # the last macro holds no further macro
        opening = sql.index("(", start)
        depth, end = 1, opening + 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:start] + macros[sql[start + 1 : opening]].format(sql[opening + 1 : end - 1]) + sql[end:]
    return sql


def check_sql(*tables: str) -> str:
    """``WITH`` clause defining the named tables in the checking engine."""
    names: list[str] = []
    for table in tables:
        for name in [*_DEPENDS.get(table, []), table]:
            if name not in names:
                names.append(name)
    return "with recursive " + ",\n".join(f"{n} as ({_render(_SQL[n], 'duckdb')})" for n in names)


def derive(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Spark form of one derived table over the parquet files in ``sf_dir``."""
    inputs = {name: derive(spark, sf_dir, name) for name in _DEPENDS.get(table, [])}
    sql = _render(_SQL[table], "spark")
    for name in ("documents", "events", "embeddings", "conversations", "orders"):
        if re.search(rf"\b(from|join) {name}\b", sql):
            inputs[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            sql = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", sql)
    for name in _DEPENDS.get(table, []):
        sql = re.sub(rf"\bfrom {name}\b", f"from {{{name}}}", sql)
    return spark.sql(sql, **inputs)


class Tables:
    """Derived tables by name: ``Tables(spark, sf_dir).notes``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in _SQL:
            raise AttributeError(name)
        return derive(self._spark, self._dir, name)
