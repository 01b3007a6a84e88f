"""Repetition inside a document from a suffix array over its words.

All documents of a piece share one suffix array, built by prefix doubling: ranks begin
with (document, word), so suffixes of different documents never compare equal. The ranks
of every doubling step are kept; walking them from the widest to the narrowest gives the
longest common prefix of neighbouring suffixes. A position's longest repeat is the larger
of the prefixes it shares with its two neighbours, which is the widest interval of the
prefix array it lies in; the union of these spans is what maximal repeats cover.

Words are maximal runs of other characters than space and U+0009 to U+000D. Words, lines
and repeats compare by 64-bit hashes inside one document.

Defined results: a null or empty text has no words and all counts 0; repeated rows are
judged one by one; equal lines and words count as such by 64-bit hashes; an empty table gives an empty result; further columns of
the input are ignored. One document is worked on by one task, in memory of some 40 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import SPACE, per_row, pieces, prefix, range_hashes, text_bytes

MIN_WORDS = 20
BASE_SHARE = 30
#: Repeats of fewer words count as chance.
MIN_REPEAT = 8
#: Share of words that repeats may cover, and words of the longest one.
MAX_COVERED = 0.3
MAX_REPEAT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, longest_repeat long, spans array<struct<start:long,end:long>>"


def suffix_levels(first: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; in the last, every suffix has its own.

    A rank is the number of suffixes before the group, so refining a group leaves all others alone.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = first[order][1:] != first[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            return levels
        after = tied + step
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[tied[inside]]
        follow = np.zeros(len(tied), np.int64)
        follow[inside] = rank[after[inside]] + 1
        key = rank[tied] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        key, at, old = key[order], tied[order], rank[tied[order]]
        i = np.arange(len(key))
        starts_old = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], i, 0))
        starts_new = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], i, 0))
        rank = rank.copy()
        rank[at] = old + starts_new - starts_old
        levels.append(rank)
        step *= 2


def longest_repeats(levels: list[np.ndarray]) -> np.ndarray:
    """For each suffix, the words it shares with a neighbour in the suffix array at most."""
    n = len(levels[0])
    if n < 2:
        return np.zeros(n, np.int64)
    sa = np.empty(n, np.int64)
    sa[levels[-1]] = np.arange(n)
    pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b = sa[pair].copy(), sa[pair + 1].copy()
    shared = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(pair), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        shared[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    out = np.zeros(n, np.int64)
    np.maximum.at(out, sa[pair], shared)
    np.maximum.at(out, sa[pair + 1], shared)
    return out


def unite(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans sorted by start; touching spans become one."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    first = np.r_[True, start[1:] > reach[:-1]]
    last = np.r_[first[1:], True]
    return start[first], reach[last]


def _profile(data: np.ndarray, bounds: np.ndarray, min_repeat: int) -> dict[str, np.ndarray | list]:
    rows, n = len(bounds) - 1, len(data)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    broken = np.r_[True, ~word[:-1]] | edge[:-1] if n else np.zeros(0, bool)
    ends_here = np.r_[~word[1:], True] | edge[1:] if n else np.zeros(0, bool)
    start = np.flatnonzero(word & broken)
    end = np.flatnonzero(word & ends_here) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    out = {
        "n_words": np.bincount(doc, minlength=rows),
        "word_chars": per_row(prefix(word & ((data & 0xC0) != 0x80)), bounds),
        "n_symbols": per_row(prefix(_SYMBOL[data]), bounds),
    }
    hashed = range_hashes(data)
    apart = np.uint64(0xA24BAED4963EE407)
    # lines: from one newline or document start to the next newline or document end
    newline = np.flatnonzero(data == 10)
    a = np.r_[bounds[:-1], newline + 1]
    b = np.r_[bounds[1:], newline]
    a.sort()
    b.sort()
    words_before = np.searchsorted(start, a), np.searchsorted(start, b)
    held = words_before[1] > words_before[0]
    a, b = a[held], b[held]
    line_doc = np.searchsorted(bounds, a, "right") - 1
    _, first = np.unique(hashed(a, b) ^ (line_doc.astype(np.uint64) * apart), return_index=True)
    out["n_dup_lines"] = np.bincount(line_doc, minlength=rows) - np.bincount(line_doc[first], minlength=rows)
    # repeats
    reach = longest_repeats(suffix_levels(hashed(start, end) ^ (doc.astype(np.uint64) * apart), doc))
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, doc, reach)
    out["longest_repeat"] = longest
    at = np.flatnonzero(reach >= min_repeat)
    s, e = unite(at, at + reach[at])  # spans never leave their document; those of two documents may touch
    cut = np.searchsorted(start, bounds)  # first word of each document
    spans: list[list[dict]] = [[] for _ in range(rows)]
    for x, y in zip(s.tolist(), e.tolist()):
        while x < y:
            d = int(doc[x])
            stop = min(y, int(cut[d + 1]))
            spans[d].append({"start": x - int(cut[d]), "end": stop - int(cut[d])})
            x = stop
    out["spans"] = spans
    return out


def repetition(docs: DataFrame, text: str = "text", key: str = "doc_id", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """Per document: counts, words of the longest repeat, and united word spans of all repeats of ``min_repeat`` words or more."""
    wanted = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for i, j in pieces(bounds):
                got = _profile(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], min_repeat)
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "longest_repeat"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(got[x].astype(np.int64)) for x in names), pa.array(got["spans"], spans)],
                    ["doc_id", *names, "spans"],
                )

    return wanted.mapInArrow(run, f"doc_id {kind}, {_COLUMNS}")


def covered_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def judged(found: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``n_repeat_words``, ``base_failed`` and ``kept``.

    Kept are documents that pass the base rule, whose repeats cover ``max_covered`` of the
    words at most, and whose longest repeat has ``max_repeat`` words at most.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_SHARE * F.col("n_words"))
    fine = (F.col("n_repeat_words") <= F.lit(max_covered) * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return (
        found.withColumn("n_repeat_words", covered_words(F.col("spans")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & fine)
    )
