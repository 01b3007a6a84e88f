import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import search as S
from memlake.operators import substring
from memlake.plans import probe
from memlake.plans.probe import nearest
from memlake.sources.derived import Tables


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8)).astype("float32")
    base[10:30] = base[5]  # a third of the rows are copies
    memory = [(i, f"p{0 if i % 3 else 1}", "note", f"text {i} Été 50%_x" if i % 2 else f"other {i}", [float(x) for x in base[i]] if i % 7 else None)
              for i in range(60)]
    queries = [(100 + j, f"p{j % 2}", "ÉTÉ 50%_", [float(x) for x in base[j]]) for j in range(9)]
    m = spark.createDataFrame(memory, "id long, project_id string, content_type string, content_text string, embedding array<float>")
    m = m.withColumns({"source_type": F.lit("note"), "source_id": F.col("id"), "tags": F.array(F.lit("t")),
                       "created_at": F.timestamp_add("MINUTE", F.col("id"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))})
    q = spark.createDataFrame(queries, "query_id long, project_id string, query_text string, query_vec array<float>")
    return q, m, queries, memory


def brute(queries, memory, k):
    out = set()
    for q, p, _, v in queries:
        scored = []
        for i, r, _, _, e in memory:
            if r == p and e is not None:
                a, b = np.array(v), np.array(e)
                scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 12), i))
        out |= {(q, i, n) for n, (_, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("max_shipped,rows_per_task", [(1000, 1000), (0, 1000), (0, 4)])
def test_every_plan_gives_the_exact_neighbours(vectors, max_shipped, rows_per_task):
    q, m, queries, memory = vectors
    hits, _ = nearest(q, m, 4, ["project_id"], max_shipped, rows_per_task)
    assert {(r.query_id, r.id, r["rank"]) for r in hits.collect()} == brute(queries, memory, 4)


def test_more_queries_than_a_tile(vectors, monkeypatch):
    q, m, queries, memory = vectors
    best, rng = probe._Best, np.random.default_rng(5)
    rows, asked = rng.integers(0, 3, (200, 4)).astype(float), rng.integers(0, 3, (50, 4)).astype(float)  # many ties
    found = {}
    for tile in (7, 1000):
        monkeypatch.setattr(probe, "QUERY_TILE", tile)
        state = best(asked, 6)
        for at in range(0, 200, 60):
            state.add(rows[at : at + 60], np.arange(at, min(at + 60, 200)))
        found[tile] = set(zip(*(x.tolist() for x in state.held)))
    want = {(i, s, -r) for i, a in enumerate(asked) for s, r in sorted(((float(a @ x), -j) for j, x in enumerate(rows)), reverse=True)[:6]}
    assert found[7] == found[1000] == want


@pytest.mark.parametrize("row_tile,waiting", [(9, 1 << 18), (2_048, 1), (9, 1)])
def test_tiles_of_rows_and_early_cuts(monkeypatch, row_tile, waiting):
    monkeypatch.setattr(probe, "QUERY_TILE", 7)
    monkeypatch.setattr(probe, "ROW_TILE", row_tile)
    monkeypatch.setattr(probe, "WAITING", waiting)
    rng = np.random.default_rng(6)
    rows, asked = rng.integers(0, 3, (200, 4)).astype(float), rng.integers(0, 3, (50, 4)).astype(float)  # many ties
    cells, bits = rng.integers(0, 11, 200), rng.random((50, 11)) < 0.5
    for some in (None, bits):
        state = probe._Best(asked, 6, None if some is None else np.packbits(some, axis=1))
        for at in range(0, 200, 60):
            own = slice(at, min(at + 60, 200))
            state.add(rows[own], np.arange(200)[own], None if some is None else cells[own])
        seen = lambda i, j: some is None or some[i, cells[j]]
        want = {(i, s, -r) for i, a in enumerate(asked) for s, r in sorted(((float(a @ x), -j) for j, x in enumerate(rows) if seen(i, j)), reverse=True)[:6]}
        assert set(zip(*(x.tolist() for x in state.held))) == want


@pytest.mark.parametrize("rows_per_task", [1000, 4])
def test_a_task_holds_a_bounded_number_of_queries(vectors, monkeypatch, rows_per_task):
    q, m, queries, memory = vectors
    most = max(sum(p == r[1] for r in queries) for p in {r[1] for r in queries})
    assert most > 3
    hits, _ = nearest(q, m, 4, ["project_id"], 0, rows_per_task, queries_per_task=3)
    assert {(r.query_id, r.id, r["rank"]) for r in hits.collect()} == brute(queries, memory, 4)


@pytest.mark.parametrize("max_shipped", [1000, 0])
def test_a_query_is_sent_once_whatever_the_cells(vectors, monkeypatch, max_shipped):
    q, m, queries, memory = vectors
    asked = []

    def watched(sent, *rest, **named):
        asked.append(sent.count())
        return nearest(sent, *rest, **named, max_shipped=max_shipped)

    monkeypatch.setattr(S, "nearest", watched)
    hits = S.ann_topk(q, m, 4, nlist=3, nprobe=3)
    assert {(r.query_id, r.id, r["rank"]) for r in hits.collect()} == brute(queries, memory, 4)
    assert asked == [len(queries)]


def test_string_ids(vectors):
    q, m, queries, memory = vectors
    q = q.withColumn("query_id", F.col("query_id").cast("string"))
    m = m.withColumn("id", F.lpad(F.col("id").cast("string"), 4, "0"))
    hits, _ = nearest(q, m, 4, ["project_id"])
    assert {(int(r.query_id), int(r.id), r["rank"]) for r in hits.collect()} == brute(queries, memory, 4)


def test_probing_all_cells_is_exact(vectors):
    q, m, queries, memory = vectors
    hits = S.ann_topk(q, m, 4, nlist=3, nprobe=3)
    assert {(r.query_id, r.id, r["rank"]) for r in hits.collect()} == brute(queries, memory, 4)
    few = S.ann_topk(q, m, 4, nlist=3, nprobe=1)
    exact, _ = nearest(q, m, 4, ["project_id"])
    (recall,) = S.recall_at_k(few, exact).collect()
    assert 0.3 < recall.recall <= 1


def test_recall_of_the_registered_search(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    exact, _ = nearest(t.search_queries, t.memory, 5, ["project_id"])
    (recall,) = S.recall_at_k(S.ann_topk(t.search_queries, t.memory), exact).collect()
    assert recall.recall >= 0.9


def test_keyword_takes_wildcards_literally_and_newest_first(vectors):
    q, m, queries, memory = vectors
    got = {(r.query_id, r.id, r["rank"]) for r in S.keyword_search(q, m, 3).collect()}
    want = set()
    for qid, p, _, _ in queries:
        ids = sorted((i for i, r, _, t, _ in memory if r == p and "été 50%_" in t.lower()), reverse=True)[:3]
        want |= {(qid, i, n) for n, i in enumerate(ids, 1)}
    assert got == want


@pytest.mark.parametrize("per_task, sent", [(20_000, 1 << 18), (3, 1 << 18), (3, 0)])
def test_substrings_equal_brute_force(spark, monkeypatch, per_task, sent):
    monkeypatch.setattr(substring, "MAX_SENT_PIECES", sent)
    rng = np.random.default_rng(4)
    letters = np.array(list("abcé 😀.%_\\n"))
    rows = [(i, f"p{i % 3 // 2}", None if i == 5 else "".join(rng.choice(letters, rng.integers(0, 14)))) for i in range(200)]
    rows += [(1000 + i, "p0", "common passage") for i in range(100)]  # a third of all rows hold the same pieces
    texts = ["", "a", "é", "ab", "😀é", "abc", "a b", "%_", "common", "mon pas", "passage!", "\\", "never", None, " ", "."] + [(rows[i][2] or "")[2:7] for i in range(0, 60, 3)]
    asked = sorted({(p, t) for t in texts for p in ("p0", "p1", "p2")}, key=str)
    found = substring.holding(
        spark.createDataFrame(rows, "id long, project_id string, text string"), spark.createDataFrame(asked, "project_id string, _text string"), ["project_id"], "text", per_task)
    want = sorted((p, t, i) for p, t in asked if t is not None for i, r, x in rows if p == r and x is not None and t in x)
    assert sorted((r["project_id"], r["_text"], r["id"]) for r in found.collect()) == want


@pytest.mark.parametrize("tested", [(2, 5), (64, 4_096)])
def test_newest_rows_are_tested_first(spark, monkeypatch, tested):
    # every row that holds a text's rarest piece was read and tested, however few were wanted
    monkeypatch.setattr(substring, "NEWEST_TESTED", tested)
    words = ["anaconda", "condor", "cone", "éo", "x"]
    rows = [(i, f"p{i % 2}", i * 7 % 40, " ".join(w for j, w in enumerate(words) if i % (j + 2) == 0) + f" con {i}") for i in range(80)]
    asked = [(f"p{p}", w) for p in range(2) for w in [*words, "con", "a", "con 7", "nothing", ""]]
    low = spark.createDataFrame(rows, "id long, project_id string, at int, _low string")
    texts = spark.createDataFrame(asked, "project_id string, _text string")
    found = substring.holding(low, texts, ["project_id"], "_low", newest=(3, "at")).collect()
    for p, text in asked:
        want = sorted(((-t, i) for i, q, t, low_ in rows if q == p and text in low_))
        got = sorted((-r["at"], r.id) for r in found if (r.project_id, r._text) == (p, text))
        assert got[:3] == want[:3] and set(got) <= set(want) and len(got) == len(set(got))
        if tested[0] == 2 and text == "con":
            assert len(got) <= 5 < len(want)


def test_keyword_plan_joins_no_project_with_all_its_texts(vectors):
    q, m, _, _ = vectors
    plan = S.keyword_search(q, m, 3)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("id#" in line or "_piece" in line or "_text" in line for line in joins)


def test_hybrid_has_no_repeats_and_semantic_first(vectors):
    q, m, _, _ = vectors
    rows = S.hybrid_search(q, m, 25).collect()
    for qid in {r.query_id for r in rows}:
        mine = sorted((r["rank"], r.search_mode, r.id) for r in rows if r.query_id == qid)
        assert len({i for _, _, i in mine}) == len(mine) <= 25
        modes = [mode for _, mode, _ in mine]
        assert modes == sorted(modes, key=lambda x: x != "semantic")
    assert {r.search_mode for r in rows} == {"semantic", "keyword"}


def test_topk_is_cut_before_the_shuffle(vectors):
    q, m, _, _ = vectors
    hits, _ = nearest(q, m, 4, ["project_id"])
    plan = hits._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_mode_switch(vectors):
    q, m, _, _ = vectors
    assert {r.search_mode for r in S.search(q, m, "semantic").collect()} == {"semantic"}
    with pytest.raises(KeyError):
        S.search(q, m, "other")


@pytest.mark.parametrize("sent", [1 << 19, 0])
def test_substrings_of_every_length_sent_or_joined(spark, monkeypatch, sent):
    monkeypatch.setattr(substring, "MAX_SENT_TEXTS", sent)
    rng = np.random.default_rng(5)
    rows = [(i, f"p{i % 3 // 2}" if i % 50 else None, "".join(rng.choice(list("abé😀"), rng.integers(0, 30)))) for i in range(150)]
    asked = sorted({(p, rows[i][2][3 : 3 + n]) for i in range(0, 150, 5) for n in range(9) for p in ("p0", "p1", None)}, key=str)
    found = substring.holding(
        spark.createDataFrame(rows, "id long, project_id string, text string"), spark.createDataFrame(asked, "project_id string, _text string"), ["project_id"], "text")
    want = sorted((p, t, i) for p, t in asked for i, r, x in rows if p and p == r and t in x)
    assert sorted((r["project_id"], r["_text"], r["id"]) for r in found.collect()) == want


def test_stored_texts_stay_where_they_are_read(spark, monkeypatch):
    # stored texts and what they hold were shuffled for each number of newest rows tested
    low = spark.createDataFrame([(i, "p", i, "one two three" if i % 2 else "four") for i in range(40)], "id long, project_id string, at int, _low string")
    texts = spark.createDataFrame([("p", w) for w in ("one", "two th", "hre", "four")], "project_id string, _text string")
    written = []
    monkeypatch.setattr(substring, "checkpointed", lambda df, keep=substring.checkpointed: written.append(df.columns) or keep(df))
    found = substring.holding(low, texts, ["project_id"], "_low", newest=(3, "at"))
    assert all("_low" not in line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line)
    assert not any("id" in columns for columns in written)
    assert sorted((r["_text"], r["id"]) for r in found.collect()) == sorted((w, i) for w, ids in (("one", (39, 37, 35)), ("two th", (39, 37, 35)), ("hre", (39, 37, 35)), ("four", (38, 36, 34))) for i in ids)
