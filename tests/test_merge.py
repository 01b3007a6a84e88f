import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import memlake.operators.merge as M
import memlake.operators.similarity as Sim
from memlake.plans import fold
from memlake.plans.fold import numbered
from memlake.session import checkpointed
from tests import reference_loops as loops

T0 = dt.datetime(2024, 1, 1)
NOTE = ("id long, project_id string, content string, category string, tags array<string>, related_files array<string>, "
        "snapshot_id long, created_at timestamp_ntz")
ERROR = ("id long, project_id string, error_message string, error_type string, attempted_fixes array<string>, root_cause string, "
         "resolution string, file_paths array<string>, tags array<string>")


def text(rng, hot):
    if rng.random() < hot:  # one group of copies holds a large share of all rows
        return "connect timeout host server alpha"
    head = rng.choice([["connect", "timeout", "host", "server"], ["cannot", "read", "property", "value"], ["module", "not", "found", "path"]])
    words = head + [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) for _ in range(rng.choice([1, 2, 2, 3]))]
    return rng.choice(["!!!", ""]) if rng.random() < 0.03 else " ".join(words)


def frame(spark, rows, schema):
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@pytest.fixture
def small_tasks(monkeypatch):
    """Hot-key splitting and chunked scans already at test size."""
    monkeypatch.setattr(Sim, "POSTINGS_PER_TASK", 5)
    monkeypatch.setattr(M, "SEQ_CHUNK", 17)


def test_numbers_of_a_key_that_holds_most_rows(spark):
    rows = [(("hot" if i % 5 else f"k{i % 15}"), i * 7919 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "slot string, seq long, id long").repartition(8)
    got = {(r.slot, r.seq, r.id): r.n for r in numbered(df, ["slot"], [F.desc("seq"), F.asc("id")], "n").collect()}
    for slot in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == slot), key=lambda r: (-r[1], r[2])), 1):
            assert got[r] == n
    assert len(got) == 1000


@pytest.mark.parametrize("seed,hot,batch", [(1, 0.0, None), (2, 0.35, None), (2, 0.35, 60)])
def test_notes_equal_row_by_row(spark, small_tasks, seed, hot, batch):
    rng = random.Random(seed)

    def row(i, day):
        return dict(id=i, seq=i, project_id=f"p{rng.randrange(2)}", content=text(rng, hot), category=rng.choice(["a", "b"]),
                    tags=[f"t{i}"] if rng.random() < 0.8 else None, related_files=["f"], snapshot_id=None,
                    created_at=T0 + dt.timedelta(days=day, minutes=i))

    stored, seen = [], set()
    for r in (row(i, 0) for i in range(25)):
        key = (r["project_id"], r["category"], frozenset(loops.grams(r["content"])))
        if key not in seen:
            seen.add(key)
            stored.append(dict(r, tags=r["tags"] or []))
    incoming = [row(1000 + i, 1) for i in range(150)]
    out = M.merge_notes(frame(spark, stored, NOTE), frame(spark, incoming, NOTE + ", seq long"), batch_rows=batch)
    got = {(r.id, r.content, tuple(r.tags), r.created_at) for r in out.collect()}
    assert got == loops.merge_notes(stored, incoming)


def test_stored_copies_are_taken_over_one_by_one(spark):
    stored = [dict(id=i, project_id="p", content="same words here", category="a", tags=[], related_files=[], snapshot_id=None,
                   created_at=T0 + dt.timedelta(minutes=i)) for i in range(3)]
    other = "same words here now and here again too"
    incoming = [dict(stored[0], id=10 + i, seq=10 + i, content=c, created_at=T0 + dt.timedelta(days=1, minutes=i))
                for i, c in enumerate(["same words here"] * 4 + [other])]
    out = M.merge_notes(frame(spark, stored, NOTE), frame(spark, incoming, NOTE + ", seq long"))
    got = {(r.id, r.content, r.created_at) for r in out.collect()}
    last = T0 + dt.timedelta(days=1, minutes=3)
    assert got == {(0, "same words here", T0), (1, "same words here", T0 + dt.timedelta(minutes=1)), (2, "same words here", last),
                   (14, other, T0 + dt.timedelta(days=1, minutes=4))}


def test_rounds_do_not_grow_with_a_family(spark, monkeypatch):
    """Near texts that come in turn each take over the other: every row hangs on the one before."""
    steps = []
    for kept in ("checkpointed", "rewritten"):
        monkeypatch.setattr(fold, kept, lambda df: steps.append(1) or checkpointed(df), raising=False)
    say = "decided in meeting {} to take option one for every module"
    rows = [dict(id=i, seq=i, project_id="p", content=say.format("abc"[i % 3]) if i % 7 else "other words", category="a", tags=[f"t{i}"], related_files=[],
                 snapshot_id=None, created_at=T0 + dt.timedelta(minutes=i)) for i in range(63)]
    stored = [dict(rows[0], id=1000 + i, content=say.format("abcab"[i]), created_at=T0 - dt.timedelta(days=i)) for i in range(2)]
    out = M.merge_notes(frame(spark, stored, NOTE), frame(spark, rows, NOTE + ", seq long"))
    assert {(r.id, r.content, tuple(r.tags), r.created_at) for r in out.collect()} == loops.merge_notes(stored, rows)
    assert len(steps) < 40


def test_families_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (103, 105), (105, 100)]
    got = {(r.row, r["head"]) for r in fold.families(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(103, 100), (105, 100)}
    assert fold.families(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed,hot,first_batch", [(3, 0.0, 1000), (4, 0.35, 1000), (3, 0.0, 15), (4, 0.35, 15)])
def test_errors_equal_row_by_row(spark, small_tasks, monkeypatch, seed, hot, first_batch):
    monkeypatch.setattr(M, "FIRST_BATCH", first_batch)
    rng = random.Random(seed)

    def row(i):
        return dict(id=i, seq=i, project_id=f"p{rng.randrange(2)}", error_message=text(rng, hot), error_type="build",
                    attempted_fixes=rng.choice([None, ["a"], ["b", "a"], ["c"]]), root_cause=rng.choice([None, "", f"c{i}"]),
                    resolution=rng.choice([None, f"r{i}"]), file_paths=rng.choice([None, [], [f"f{i}"]]), tags=["t"],
                    seen_at=T0 + dt.timedelta(minutes=i))

    stored = [dict(row(i), occurrence_count=3, last_seen_at=T0, created_at=T0, root_cause="z", file_paths=["q"], attempted_fixes=["b"])
              for i in range(12)]
    incoming = [row(1000 + i) for i in range(180)]
    out = M.merge_errors(
        frame(spark, stored, ERROR + ", occurrence_count int, last_seen_at timestamp_ntz, created_at timestamp_ntz"),
        frame(spark, incoming, ERROR + ", seen_at timestamp_ntz, seq long"),
    )
    got = {(x.id, x.error_message, tuple(x.attempted_fixes), x.root_cause, x.resolution, tuple(x.file_paths), x.occurrence_count,
            x.last_seen_at) for x in out.collect()}
    want = loops.merge_errors(stored, incoming)
    assert got == {(a, b, c, d or None, e, f, g, h) for a, b, c, d, e, f, g, h in want}


def test_instructions_equal_row_by_row(spark, small_tasks):
    rng = random.Random(9)
    rows = [dict(id=i, seq=i, project_id="p", content=text(rng, 0.3), active=rng.choice([True, False, None])) for i in range(80)]
    stored, incoming = rows[:20], [dict(r, active=True) for r in rows[20:]]
    schema = "id long, project_id string, content string, active boolean"
    out = M.insert_instructions_if_new(frame(spark, stored, schema), frame(spark, incoming, schema + ", seq long"))
    assert {r.id for r in out.collect()} == loops.new_instructions(stored, incoming)


def test_string_ids_work(spark):
    schema = "id string, project_id string, content string, active boolean, seq long"
    rows = [("b1", "p", "always run the tests first", True, 1), ("a2", "p", "always run the tests first!", True, 2)]
    df = spark.createDataFrame(rows, schema)
    out = M.insert_instructions_if_new(df.limit(0).drop("seq"), df)
    assert [r.id for r in out.select("id").collect()] == ["b1"]


def test_repeat_text_for_embedding(spark):
    rows = [dict(id=i, seq=i, project_id="p", error_message="cannot read property value", error_type=None, attempted_fixes=None,
                 root_cause=None, resolution=r, file_paths=None, tags=None, seen_at=T0) for i, r in ((1, None), (2, "restart"))]
    incoming = frame(spark, rows, ERROR + ", seen_at timestamp_ntz, seq long")
    empty = incoming.limit(0).withColumns({"occurrence_count": F.lit(1), "last_seen_at": F.col("seen_at"), "created_at": F.col("seen_at")}).drop("seq", "seen_at")
    (row,) = M.merge_errors(empty, incoming).collect()
    assert row.error_type == "general" and row.occurrence_count == 2
    assert row.embed_text == "Error: cannot read property value. Cause: unknown. Fix: restart"


def test_queries_merge_into_whole_stored_tables(spark, sf):
    import __spark_entry__ as entry
    from memlake.sources.derived import Tables

    t = Tables(spark, sf)
    merged = entry.queries()["merge_errors"](spark, sf).collect()
    stored = {r["id"]: r["occurrence_count"] for r in t.error_patterns.select("id", "occurrence_count").collect()}
    assert stored.keys() <= {r["id"] for r in merged}
    assert sum(r["occurrence_count"] for r in merged) == sum(stored.values()) + t.error_log.count()
    notes = entry.queries()["import_documents"](spark, sf).filter("kind = 'note'").count()
    assert notes >= t.notes.count()
