import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import changes as C
from memlake.operators import reports as R
from memlake.plans.fold import chain_heads, running_max
from memlake.sources import tables as store
from memlake.streaming import sinks, windows

T0 = dt.datetime(2024, 1, 1)
LOG = ("change_id long, changed_at timestamp_ntz, id long, project_id string, op string, set_fields array<string>, title string, "
       "status string, priority int, blocked_reason string")
COLUMNS = ["title", "status", "priority", "blocked_reason"]


def changes(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = rng.choice(["insert", "update", "update", "complete", "delete"])
        fields = COLUMNS if op == "insert" else rng.choice([["status"], ["priority", "blocked_reason"], []])
        rows.append((i, T0 + dt.timedelta(minutes=i), rng.randrange(12), "p", op, fields, f"t{i}", rng.choice(["todo", "blocked"]),
                     rng.randrange(3), rng.choice([None, f"w{i}"])))
    return rows


def replay(rows):
    state = {}
    for _, at, id, p, op, fields, *values in rows:
        new = dict(zip(COLUMNS, values))
        if op == "insert":
            state[id] = dict(new, created=at, updated=at, completed=None)
        elif id in state:
            if op == "delete":
                del state[id]
                continue
            row = state[id]
            row["updated"] = at
            if op == "complete":
                row.update(status="done", completed=at)
            else:
                row.update({f: new[f] for f in fields})
    return {(i, *[r[c] for c in COLUMNS], r["created"], r["updated"], r["completed"]) for i, r in state.items()}


def rows_of(df):
    return {(r.id, *[r[c] for c in COLUMNS], r.created_at, r.updated_at, r.completed_at) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_state_and_compaction_equal_replay(spark, seed):
    rows = changes(150, seed)
    log = spark.createDataFrame(rows, LOG).repartition(5)
    assert rows_of(C.current_state(log, COLUMNS)) == replay(rows)
    assert rows_of(C.current_state(store.compacted_log(log, COLUMNS), COLUMNS)) == replay(rows)


def test_log_batches_and_compaction_on_disk(spark, tmp_path):
    rows, root = changes(120, 7), str(tmp_path)
    df = spark.createDataFrame(rows, LOG)
    store.append_changes(df.filter("change_id < 60"), root, "todos", "0")
    store.append_changes(df.filter("change_id >= 60"), root, "todos", "1")
    store.append_changes(df.filter("change_id >= 60"), root, "todos", "1")  # a retried batch
    assert store.read_log(spark, root, "todos").count() == 120
    assert store.compact(spark, root, "todos", COLUMNS) == 1
    assert rows_of(C.current_state(store.read_log(spark, root, "todos"), COLUMNS)) == replay(rows)


@pytest.mark.parametrize("seed", range(3))
def test_compaction_keeps_room_for_late_and_repeated_changes(spark, seed):
    rows = changes(150, seed)
    rng = random.Random(seed)
    early = [r for r in rows if rng.random() < 0.6]
    late = [r for r in rows if r not in early] + early[::3]
    folded = store.compacted_log(spark.createDataFrame(early, LOG), COLUMNS)
    assert rows_of(C.current_state(folded.unionByName(spark.createDataFrame(late, LOG)), COLUMNS)) == replay(rows)
    again = store.compacted_log(folded, COLUMNS)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, folded.collect()), key=repr)


def test_late_changes_after_compaction(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    row = lambda i, m, id, op, fields, title: (i, at(m), id, "p", op, fields, title, "todo", 1, None)
    log = [row(1, 0, 1, "insert", COLUMNS, "old"), row(2, 10, 1, "update", ["title"], "new"),
           row(3, 0, 2, "insert", COLUMNS, "gone"), row(4, 10, 2, "delete", [], None)]
    late = [row(5, 5, 1, "update", ["title"], "LATE"), row(6, 5, 2, "insert", COLUMNS, "back"), log[0]]
    folded = store.compacted_log(spark.createDataFrame(log, LOG), COLUMNS)
    got = C.current_state(folded.unionByName(spark.createDataFrame(late, LOG)), COLUMNS).collect()
    assert [(r.id, r.title, r.updated_at) for r in got] == [(1, "new", at(10))]


def test_compaction_up_to_a_time_keeps_later_states(spark):
    rows = changes(120, 4)
    df = spark.createDataFrame(rows, LOG)
    folded = store.compacted_log(df, COLUMNS, F.lit(rows[60][1]).cast("timestamp_ntz"))
    for last in (60, 90, 119):
        as_of = F.lit(rows[last][1]).cast("timestamp_ntz")
        assert rows_of(C.current_state(folded, COLUMNS, as_of)) == replay(rows[: last + 1])


def test_batches_around_compactions(spark, tmp_path, monkeypatch):
    rows, root = changes(160, 9), str(tmp_path)
    df = spark.createDataFrame(rows, LOG)
    part = [df.filter(F.col("change_id") % 4 == i) for i in range(4)]
    store.append_changes(part[0], root, "todos", "0")
    kept = store.compacted_log

    def meanwhile(*args):
        store.append_changes(part[1], root, "todos", "1")  # a batch that lands while compaction runs
        return kept(*args)

    monkeypatch.setattr(store, "compacted_log", meanwhile)
    assert store.compact(spark, root, "todos", COLUMNS) == 1
    monkeypatch.undo()
    store.append_changes(part[0], root, "todos", "0")  # a retry of a folded batch
    store.append_changes(part[2], root, "todos", "2")
    assert store.compact(spark, root, "todos", COLUMNS) == 2
    store.append_changes(part[3], root, "todos", "3")
    assert store.compact(spark, root, "todos", COLUMNS) == 3
    assert sorted(p.name for p in (tmp_path / "todos_log" / "batches").iterdir()) == ["batch=3"]
    assert rows_of(C.current_state(store.read_log(spark, root, "todos"), COLUMNS)) == replay(rows)


def test_scan_prunes_buckets_and_pushes_filters(spark, tmp_path):
    df = spark.range(200).select("id", F.concat(F.lit("p"), (F.col("id") % 50).cast("string")).alias("project_id"),
                                 F.lit(T0).cast("timestamp_ntz").alias("created_at"))
    store.write_version(df, str(tmp_path), "notes", 1)
    one = store.scan(spark, str(tmp_path), "notes", ["p7"])
    assert one.count() == 4
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [project_bucket" in plan.replace("isnotnull(project_bucket), ", "") or "project_bucket#" in plan.split("PartitionFilters")[1][:200]
    assert "EqualTo(project_id,p7)" in plan or "In(project_id, [p7])" in plan


def test_uncommitted_version_is_not_read(spark, tmp_path):
    df = spark.range(3).select("id", F.lit("p").alias("project_id"))
    store.write_version(df, str(tmp_path), "notes", 1)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{tmp_path}/notes/v=2")
    assert store.scan(spark, str(tmp_path), "notes").count() == 3


def test_chains(spark):
    links = [(f"r{i}", f"r{i - 1}") for i in range(1, 40)] + [("x2", "x1")]
    heads = chain_heads(spark.createDataFrame(links, "row string, target string")).collect()
    assert {(r.row, r.head) for r in heads} == {(f"r{i}", "r0") for i in range(1, 40)} | {("x2", "x1")}


def test_running_max_in_chunks(spark):
    rng = random.Random(1)
    rows = [("k", i, rng.choice([None, i])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    got = {r.seq: r.top for r in running_max(df, ["k"], ["seq"], F.floor(F.col("seq") / 7), "v", "top").collect()}
    best, want = None, {}
    for _, i, v in rows:
        best = max(x for x in (best, v, -1) if x is not None) if (best, v) != (None, None) else None
        want[i] = best
    assert got == want


def test_stream_drops_replays_across_batches(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz")
    source = tmp_path / "in"
    for part in (df.filter("event_id < 12"), df.filter("event_id >= 8")):
        part.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (
        windows.drop_replays(stream, "event_id", "ts", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))


def test_ingest_splits_rejects(spark, tmp_path):
    rows = changes(60, 3)
    bad = [(100, T0, 1, "p", "insert", COLUMNS, None, "todo", 0, None), (101, T0, 1, "p", "update", ["priority"], None, None, 9, None)]
    df = spark.createDataFrame(rows + bad, LOG)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sinks.ingest(stream, str(tmp_path / "root"), "todos", str(tmp_path / "cp")).start().awaitTermination()
    assert rows_of(C.current_state(store.read_log(spark, str(tmp_path / "root"), "todos"), COLUMNS)) == replay(rows)
    assert spark.read.parquet(str(tmp_path / "root/todos_rejects")).count() == 2


def test_late_rows_are_dropped(spark, tmp_path):
    times = [T0, T0 + dt.timedelta(hours=1), T0 + dt.timedelta(days=3),
             T0 + dt.timedelta(days=3, hours=1), T0 + dt.timedelta(hours=2), T0 + dt.timedelta(days=9)]
    for i, t in enumerate(times):
        spark.createDataFrame([("p", "note", t)], "project_id string, kind string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{i}"))
    schema = "project_id string, kind string, ts timestamp_ntz"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    timed = windows.with_event_time(stream, "ts", "1 hour")
    query = (
        windows.activity_windows(timed, "ts", "24 hours").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [r["items"] for r in rows] == [2, 2]  # the row two hours in came after its day was closed


def test_prune_splits_everything(spark):
    day = lambda n: T0 - dt.timedelta(days=n)
    df = spark.createDataFrame([(1, "p", day(9), ["k"]), (2, "p", day(9), None), (3, "p", day(9), ["x", None]), (4, "p", day(1), ["x"])],
                               "id long, project_id string, created_at timestamp_ntz, tags array<string>")
    kept, counts = C.prune(df, F.lit(T0).cast("timestamp_ntz"), 5, ["k"])
    assert {r.id for r in kept.collect()} == {1, 2, 4} and counts.collect()[0].pruned == 1


def test_reports_limit_before_shuffle(spark):
    time = F.timestamp_add("MINUTE", F.col("id"), F.lit(T0))
    df = spark.range(50).select("id", (F.col("id") % 2).cast("string").alias("project_id"), time.alias("created_at"))
    plan = R.list_notes(df, n=3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_task_changes_are_handled_row_by_row():
    # a pandas frame was built, sorted and returned for each task and batch
    from types import SimpleNamespace

    from pyspark.sql import Row

    from memlake.streaming.tasks import TaskLife

    held = {}
    state = SimpleNamespace(exists=lambda: "v" in held, get=lambda: held["v"], update=lambda v: held.update(v=v), clear=held.clear)
    life = TaskLife()
    life.init(SimpleNamespace(getValueState=lambda name, schema: state))
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    change = lambda i, s, op, status=None, fields=None: Row(change_id=i, changed_at=at(s), op=op, set_fields=fields, status=status)
    rows = [change(3, 9, "complete"), change(1, 1, "insert", "todo"), change(2, 4, "update", "blocked", ["status"]), change(4, 9, "update", "todo", None)]
    got = [(r.change_id, r.from_status, r.to_status, r.seconds_in_status) for r in life.handleInputRows((7,), iter(rows), None)]
    assert got == [(1, None, "todo", None), (2, "todo", "blocked", 3.0), (3, "blocked", "done", 5.0)]
    assert held["v"] == ("done", at(9), at(9))
    assert [r.to_status for r in life.handleInputRows((7,), iter([change(5, 20, "delete")]), None)] == [None] and not held
