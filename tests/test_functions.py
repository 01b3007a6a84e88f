import time

import pytest
from pyspark.sql import functions as F

from memlake.functions import text as X
from memlake.functions.predicates import has_any_tag, has_no_tag, is_active
from memlake.functions.vectors import cosine
from memlake.operators import imports as I
from memlake.operators.validate import coerce, validate


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).collect()[0].asDict()


def test_summary_line(spark):
    r = one(
        spark, lead=X.summary_line(F.lit("\nabc")), exact=X.summary_line(F.lit("x" * 120)), over=X.summary_line(F.lit("x" * 121)),
        null=X.summary_line(F.lit(None).cast("string")), space=X.summary_line(F.lit(" \t a b  \rrest")),
    )
    assert r == {"lead": "", "exact": "x" * 120, "over": "x" * 117 + "...", "null": "", "space": "a b"}


def test_cuts(spark):
    r = one(spark, t=X.truncate_text(F.lit("abcdef"), 5), e=X.ellipsis(F.lit("abcdef"), 5), p=X.preview(F.lit("abcdef"), 5), s=X.ellipsis(F.lit("abc"), 5))
    assert r == {"t": "ab...", "e": "abcde...", "p": "abcde", "s": "abc"}


def test_escape_and_literal_match(spark):
    r = one(spark, e=X.escape_like(F.lit("a%b_c\\d")), yes=X.icontains(F.lit("X 100%_Y"), F.lit("100%_y")), no=X.icontains(F.lit("100ab"), F.lit("100%")))
    assert r == {"e": "a\\%b\\_c\\\\d", "yes": True, "no": False}


def test_tags_with_nulls(spark):
    df = spark.createDataFrame([(["a", None],), ([],), (None,), (["k"],)], "tags array<string>")
    rows = df.select(has_any_tag(["k"]).alias("a"), has_no_tag(["k"]).alias("n")).collect()
    assert [(r.a, r.n) for r in rows] == [(False, True), (False, True), (None, None), (True, False)]


def test_null_active_is_inactive(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "active boolean")
    assert df.filter(is_active()).count() == 1


def test_cosine_of_zero_vector_is_null(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>")
    assert one(spark, c=cosine(zero, zero))["c"] is None


def test_hours_and_tokens(spark):
    r = one(spark, low=X.window_hours(F.lit(0.4)), cut=X.window_hours(F.lit(7.9)), tok=X.token_estimate(F.lit(2001)))
    assert r == {"low": 1, "cut": 7, "tok": 501}


def test_validation(spark):
    rows = [(1, "p", "t", None, None), (2, "p", None, "todo", 0), (3, "p", "t", "odd", 3), (4, "p", "t", "", 2)]
    df = spark.createDataFrame(rows, "id long, project_id string, title string, status string, priority int")
    ok, bad = validate(df, "todos")
    assert {(r.id, r.status, r.priority) for r in ok.collect()} == {(1, "todo", 0), (4, "todo", 2)}
    assert {r.id: r.reasons for r in bad.collect()} == {2: ["title missing"], 3: ["status not allowed", "priority out of range"]}


def test_lenient_input(spark):
    df = spark.createDataFrame([(1, "3", '["a","b"]'), (2, " ", "[]"), (3, "x", "[1]"), (4, None, None)], "id long, n string, l string")
    ok, bad = coerce(df, ["n"], ["l"])
    assert {(r.id, r.n, tuple(r.l) if r.l is not None else None) for r in ok.collect()} == {(1, 3.0, ("a", "b")), (2, 0.0, ()), (4, None, None)}
    assert [r.reasons for r in bad.collect()] == [["n not readable", "l not readable"]]


@pytest.mark.parametrize("content,want", [
    ("# A\n## B\ntext\n# A\nmore", [("B", "text"), ("A", "more")]),
    ("# A\n\n# B", [("A", "")]),
    ("intro\n# A\none\n# B\ntwo\n# A\nthree", [("__preamble__", "intro"), ("A", "three"), ("B", "two")]),
    ("#### deep\n#nospace", [("__preamble__", "#### deep\n#nospace")]),
])
def test_sections(spark, content, want):
    df = spark.createDataFrame([(1, content)], "doc_id long, content string")
    assert [(r.heading, r.body) for r in I.split_sections(df).orderBy("pos").collect()] == want


def test_brief_from_sections(spark):
    doc = "Name: Zed\n# Tech tools\npy\n# Project rules\nr\n# Setup script\ns\n# Tooling framework\nf"
    few = "# Only\nbody"
    df = spark.createDataFrame([(1, doc), (2, few), (3, "plain")], "doc_id long, content string")
    a, b, c = I.extract_brief(df).orderBy("doc_id").collect()
    assert (a.project_name, a.tech_stack, a.conventions, a.entry_points, a.module_map) == ("Zed", "py", "r", "s", None)
    assert (b.project_name, b.module_map) == ("Only", few)
    assert (c.project_name, c.module_map) == ("Unknown Project", "plain")


def test_chunks_keep_the_whole_text(spark):
    df = spark.createDataFrame([(1, "x" * 9001), (2, "y" * 4000)], "doc_id long, content string")
    rows = I.chunk(df).orderBy("doc_id", "part").collect()
    assert [(r.part, r.parts) for r in rows] == [(1, 3), (2, 3), (3, 3), (1, 1)]
    assert "".join(r.content.split("]\n\n")[1] for r in rows[:3]) == "x" * 9001
    assert rows[3].tags == ["migrated-from-claude-md", "original-full"]


def test_import_skips_blank_and_marked(spark):
    df = spark.createDataFrame([(1, " \n"), (2, "has MARK"), (3, "ok")], "doc_id long, content string")
    assert [r.doc_id for r in I.importable(df, "content", "MARK").collect()] == [3]


def test_trigrams_of_a_brief_are_taken_before_the_join(spark, sf):
    import __spark_entry__ as entry

    plan = entry.queries()["trigram_similarity"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "_stack" in above and "tech_stack" not in above and "content" not in above


def test_sections_of_a_long_document_in_linear_time(spark):
    # 60,000 lines and 6,000 different headings, each twice; one cut of the text for each line took minutes
    lines = [f"# part {i % 6000}" if i % 5 == 0 else f"line {i}" for i in range(60_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "doc_id long, content string")
    began = time.monotonic()
    rows = I.split_sections(df).orderBy("doc_id", "pos").collect()
    assert time.monotonic() - began < 30
    found = [(r.heading, r.body) for r in rows if r.doc_id == 1]
    want = {}
    for at in range(0, len(lines), 5):
        want[lines[at][2:]] = "\n".join(lines[at + 1 : at + 5])
    assert found == list(want.items())
    assert [(r.doc_id, r.pos, r.heading, r.body) for r in rows if r.doc_id != 1] == [(3, 0, "__preamble__", "")]
