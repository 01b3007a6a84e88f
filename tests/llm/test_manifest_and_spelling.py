"""Merkle manifest and spelling variants against brute force, on whole small tables and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from memlake.llm import merkle, spelling

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int, grp string, part int, word string, key string, n long"
ROWS = [
    (None, "a", "x", 5, "null id"), (None, "a", "x", 5, "null id"), (7, None, None, None, None), (7, "ü", "x", 2**63 - 1, ""), (0, "s", "é", 0, "long text " * 30_000),
    (7, "ü", "x", 2**63 - 1, ""), (14, "s", "-", None, "-"), *[(i, "s", "x" if i % 3 else "y", i, f"text {i % 5}") for i in range(70)], *[(99, "s", "x", 1, "again")] * 40,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "l", 1, "g", 2, "w", "k", 3) for r in ROWS], SCHEMA)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, more=0):
    values = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(hashes):
    """For each leaf its siblings and on which side it stands, and the root."""
    paths, at, now = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(now) > 1:
        for i, path in enumerate(paths):
            other = at[i] ^ 1
            path.append((now[other] if other < len(now) else None, at[i] & 1))
            at[i] >>= 1
        now = [sha(*now[i : i + 2]) for i in range(0, len(now), 2)]
    return paths, now[0]


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    held = [sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r))) for g in order]
    trees = [brute_tree([brute_leaf(r) for r in rows]) for rows in held]
    above, root = brute_tree([t for _, t in trees]) if trees else ([], None)
    for rows, (paths, subroot), more in zip(held, trees, above):
        for r, path in zip(rows, paths):
            leaf = folded = brute_leaf(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                folded = brute_leaf(r, 1)
            for sibling, right in path + more:
                folded = sha(folded) if sibling is None else sha(sibling, folded) if right else sha(folded, sibling)
            yield r[0], leaf, subroot, root, sha(*[s for s, _ in path + more if s]), folded, folded == root


SMALL = {"stride": 3, "top_nodes": 6, "rows_per_salt": 4}


@pytest.mark.parametrize("rows, options", [
    (ROWS, {}), (ROWS, SMALL), (ROWS, {"stride": 1, "top_nodes": 0, "rows_per_salt": 16}), (ROWS[:1], {}), (ROWS[:2], {}), (ROWS[2:5], SMALL),
], ids=["all", "salted", "by one", "one", "equal", "lone"])
def test_manifest(spark, rows, options):
    docs = spark.createDataFrame([(*r, "l", 1, "g", 2, "w", "k", 3) for r in rows], SCHEMA)
    found = merkle.manifest(docs, **options)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, found.collect())) == Counter(brute_manifest(rows))


def test_manifest_of_many_languages_and_of_none(spark, docs):
    rows = [(i, "s", f"l{i % 90}" if i % 4 else "one", i, "t") for i in range(400)]
    wide = spark.createDataFrame([(*r, "l", 1, "g", 2, "w", "k", 3) for r in rows], SCHEMA)
    assert Counter(map(tuple, merkle.manifest(wide, stride=2, top_nodes=8, rows_per_salt=8).collect())) == Counter(brute_manifest(rows))
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_manifest_leaves_the_session_as_it_was(spark):
    name = "spark.sql.cteRecursionRowLimit"
    before, views = spark.conf.get(name), len(spark.catalog.listTables())
    merkle.manifest(spark.createDataFrame([(*ROWS[6], "l", 1, "g", 2, "w", "k", 3)], SCHEMA)).collect()
    assert spark.conf.get(name) == before and len(spark.catalog.listTables()) == views


def brute_words(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k > 1}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n, by, near, form = brute_words(rows), defaultdict(set), defaultdict(set), {}
    for w in n:
        for k in range(len(w) + 1):
            by[w[:k] + w[k + 1 :]].add(w)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_edit(a, b)}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None


WORDS = ["abcdefg", "abcdefh", "abcdef", "abcdefgh", "bcdefgh", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÀÉîôûüÿ", "Àéîôûüÿ", "àéîôûüÿ", "ABCDEFG×", "abcdefg÷x", "q" * 5000, "q" * 5001, "q" * 2500 + "r" + "q" * 2499]
TEXTS = [
    (None, None), (1, ""), (2, "   "), (3, "abcdefg " * 2000), (3, "abcdefg " * 2000), (4, "abcdefh abcdefh " * 30), (5, " ".join(WORDS)), (6, ",".join(WORDS)), (None, " ".join(WORDS)),
    (7, "abcdeff abcdeff abcdeff1abcdeffx abcdeffx"), (8, "x" * 300_000), (8, "x" * 300_000), *[(10 + i, "Letters letters, lettres! Lettering letterings") for i in range(40)],
]


@pytest.mark.parametrize("rows_per_key", [spelling.ROWS_PER_KEY, 3])
def test_variants(spark, sf, rows_per_key, monkeypatch):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (spelling.LEAST_LENGTH, rows_per_key))
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    awkward = spark.createDataFrame([(*r, "w", "k", 1) for r in TEXTS], "doc_id long, text string, word string, key string, n int")
    real = spark.read.parquet(f"{sf}/documents.parquet")
    for df, rows in ((awkward, TEXTS), (real, [tuple(r) for r in real.select("doc_id", "text").collect()])):
        assert Counter(map(tuple, spelling.variants(df).select(*columns).collect())) == Counter(brute_variants(rows))
    assert spelling.variants(awkward.limit(0)).count() == 0


def test_every_edit_shares_exactly_one_key(spark):
    words = {"abcdefg", "aaaaaaa", "aabbaabb", "abababababa"}
    words |= {w[:i] + c + w[j:] for w in list(words) for i in range(len(w) + 1) for j in (i, i + 1) for c in ("", "a", "b", "é")}
    words = sorted(w for w in words if len(w) >= 7)
    found = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()]
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(found) == len(set(found)) and set(found) == want


def test_keys_are_not_sent_through_the_driver(spark):
    words = spark.createDataFrame([(f"abcdefg{chr(97 + i)}", 1) for i in range(9)], "word string, n long")
    plan = spelling.near_pairs(words)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_salt" in line]
    assert joins and not any("Broadcast" in line for line in joins)
