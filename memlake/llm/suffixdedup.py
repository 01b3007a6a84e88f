"""Exact removal of byte strings that start in more than one place, by prefix doubling.

A suffix array over every byte would sort as many rows as the corpus has bytes. Here the
sorted positions are anchors, chosen by content: the window of ``length`` bytes at p has
as its anchor the smallest hashed 8-gram that begins in its first ``length - CORE + 1``
bytes. Equal windows have their anchors in equal places, so

1. a window whose anchor's ``CORE`` bytes occur once can't repeat; those anchors go;
2. prefix doubling runs over the anchors that stay: an anchor's first rank orders the
   string from it to the end of the core of its follower, the first anchor ``CORE`` bytes on
   or more; each round pairs it with the rank 1, 2, 4, ... followers further on, sorts the
   distinct pairs, and reranks. A string that is unique leaves; one that repeats and has
   reached ``length`` bytes is removed, and where a document of smaller number has it, its windows
   are left out from then on: what they could tell others that document tells;
3. what doubling leaves open are windows that reach past the ends of those strings. What
   ``STEP`` neighbouring windows of an anchor have in common is compared first; where that
   repeats, the outermost of these windows; and where bytes are still open, all of them.

Ranks are given to distinct pairs after a map-side combined count, so a string that a
third of all documents share is one row to the sort. Anchor contents and windows compare
by 64-bit hashes inside their group, documents by a 64-bit hash of key and text.

Defined results: a null text is empty; texts under ``length`` bytes lose nothing; a row
repeated with the same key and text loses everything if it is long enough; a null key is
a key like any other; texts of any length are gone through whole, in overlapping stretches; of equal strings all go, wherever
they stand; empty tables give empty results; columns of the input stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import PIECE_BYTES, discard, pieces, prefix, range_hashes, text_bytes, written
from memlake.plans.skew import MAX_HOT_KEYS, SALT, SPLITS, repeat, spread

LENGTH = 200
#: Bytes of content by which anchors are compared first.
CORE = 50
#: Windows whose common bytes are compared at once.
STEP = 25

#: Rows of one key that a task joins; more are split by salt.
ROWS_PER_KEY = 8192

_PLACE = np.uint64((1 << 24) - 1)
_CORE_SEED, _REACH_SEED = 1, 2


def _smallest(data: np.ndarray, width: int) -> np.ndarray:
    """For each p, where the smallest hashed 8-gram beginning in [p, p + width) begins; the first, if equal."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    key = np.ndarray((n,), "<u8", padded, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key &= ~_PLACE
    key |= np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(back[:count], ahead[width - 1 : width - 1 + count]) & _PLACE).astype(np.int64)


def _anchors_in(data: np.ndarray, bounds: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows that lie inside one document, with their first and last window."""
    empty = np.zeros(0, np.int64)
    open_ = np.zeros(len(data) + 1, np.int8)
    long_enough = bounds[1:] - bounds[:-1] >= length
    if not long_enough.any():
        return empty, empty, empty
    np.add.at(open_, bounds[:-1][long_enough], 1)
    np.add.at(open_, bounds[1:][long_enough] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(open_[:-1], dtype=np.int8))
    anchor = _smallest(data, length - core + 1)[window]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(window)] - 1
    return anchor[first], window[first], window[last]


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for texts of any size: long ones are gone through in overlapping stretches."""
    if len(data) <= 2 * PIECE_BYTES:
        return _anchors_in(data, bounds, length, core)
    parts = []  # a piece of this size is a single document
    for at in range(0, len(data) - length + 1, PIECE_BYTES):
        part = data[at : at + PIECE_BYTES + length - 1]
        parts.append([x + at for x in _anchors_in(part, np.array([0, len(part)]), length, core)])
    a, lo, hi = (np.concatenate(x) for x in zip(*parts))
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return a[first], lo[first], hi[np.r_[first[1:], len(a)] - 1]


def _chiefs(a: np.ndarray, new: np.ndarray, core: int) -> np.ndarray:
    """The anchors that doubling runs over: of those that crowd together, as in periodic text, one in 1.5 cores."""
    at = np.arange(len(a))
    apart = new | np.r_[True, np.diff(a) >= core // 2]
    stretch = (a - a[np.maximum.accumulate(np.where(apart, at, 0))]) // (core + core // 2)
    return apart | np.r_[True, np.diff(stretch) != 0]


def _anchor_rows(docs: DataFrame, length: int, core: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            uid = batch.column("uid").to_numpy()
            for i, j in pieces(bounds):
                part, cut = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                a, lo, hi = anchors(part, cut, length, core)
                if not len(a):
                    continue
                raw = part.tobytes()
                doc = np.searchsorted(cut, a, "right") - 1
                at = a.tolist()
                new = np.r_[True, doc[1:] != doc[:-1]]
                chief = _chiefs(a, new, core)
                heads = np.append(a[chief], a[-1] + 2 * core)
                follower = np.searchsorted(heads, a + core)
                onward = heads[follower]
                has = chief & (follower < len(heads) - 1) & (onward < cut[doc + 1])
                stop = np.where(has, onward, a) + core
                content = np.array([digest(raw[x : x + core], _CORE_SEED) for x in at], np.uint64)
                reach = np.array([digest(raw[x:y], _REACH_SEED) for x, y in zip(at, stop.tolist())], np.uint64)
                base = cut[doc]
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid[i:j][doc]), pa.array(content.view(np.int64)), pa.array(reach.view(np.int64)),
                    *(pa.array(x.astype(np.int32)) for x in (a - base, np.where(has, onward - base, -1), lo - base, hi - base, stop - a)),
                ], ["uid", "core", "reach", "a", "next", "lo", "hi", "len"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, core long, reach long, a int, next int, lo int, hi int, len int")


def _sharing(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``known`` (one row a key, ``_n`` of ``rows`` each); keys of many rows are split by salt."""
    hot = known.filter(F.col("_n") > ROWS_PER_KEY).orderBy(F.desc("_n"), *keys).limit(MAX_HOT_KEYS)
    hot = hot.select(*keys, F.ceil(F.col("_n") / ROWS_PER_KEY).cast("int").alias(SPLITS))
    return spread(rows, hot, keys, F.hash(*rows.columns)).join(repeat(known, hot, keys), [*keys, SALT]).drop(SALT, "_n")


def _reranked(rows: DataFrame, pair: list[str], level: int) -> DataFrame:
    """Rows whose pair occurs more than once, with the pair's rank in sorted order as ``rank``.

    ``in_uid`` and ``in_a`` say where the string stands in the document of smallest number that has it.
    Ranks of different levels differ in their top bits.
    """
    twice = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n"), F.min("uid").alias("in_uid"), F.min_by("a", "uid").alias("in_a")).filter("_n > 1")
    sorted_pairs = twice.orderBy(*pair).withColumn("rank", F.monotonically_increasing_id() + F.lit(level << 56))
    ranks = written(sorted_pairs, "doubling-ranks")
    ranked = written(_sharing(rows, ranks, pair).select("uid", "a", "next", "len", "rank", "in_uid", "in_a"), "doubling-rows")
    discard(ranks)
    return ranked


def doubled(kept: DataFrame, length: int) -> DataFrame:
    """Strings between anchors that repeat and have ``length`` bytes or more: ``uid``, ``start``, ``end``, and where else they stand."""
    level = 0
    now = _reranked(kept.filter(F.col("next") >= 0).select("uid", "a", "next", "len", "core", "reach"), ["core", "reach"], level)
    done = now.filter(F.col("len") >= length)
    # few strings stay short for long; as a table of their own, Spark knows their size when it plans the join
    short = written(now.filter(F.col("len") < length).drop("in_uid", "in_a"), "doubling-short")
    while not short.isEmpty():
        # a string that is long enough keeps its rank, as the right half of those before it
        right = short.unionByName(done.drop("in_uid", "in_a")).select("uid", F.col("a").alias("next"), F.col("next").alias("_next"), F.col("len").alias("_len"), F.col("rank").alias("right"))
        pairs = short.join(right, ["uid", "next"]).select(
            "uid", "a", F.col("_next").alias("next"), (F.col("next") - F.col("a") + F.col("_len")).alias("len"), F.col("rank").alias("left"), "right")
        level += 1
        now = _reranked(pairs, ["left", "right"], level)
        last, short = short, written(now.filter(F.col("len") < length).drop("in_uid", "in_a"), "doubling-short")
        done = done.unionByName(now.filter(F.col("len") >= length))
        discard(last)
    return done.select("uid", F.col("a").alias("start"), (F.col("a") + F.col("len")).alias("end"), "in_uid", (F.col("a") - F.col("in_a")).alias("shift"))


_SPAN = "array<struct<start:int,end:int>>"


def united(spans: np.ndarray) -> np.ndarray:
    """Union of (start, end) rows, sorted; touching spans become one."""
    if len(spans) < 2:
        return spans.reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.c_[spans[first, 0], reach[np.r_[first[1:], True]]]


def _lists(column: pa.Array, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where each row's list of structs begins (one entry more), and the fields of all of them; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    held = column.flatten()
    return prefix(sizes), {x: held.field(x).to_numpy().astype(np.int64) for x in names}


class _Piece:
    """Documents of a batch side by side, with their anchors and covers counted from the first byte of all."""

    def __init__(
        self, bounds: np.ndarray, i: int, j: int, anchors: tuple[np.ndarray, dict], covers: tuple[np.ndarray, dict], echoes: tuple[np.ndarray, dict] | None = None,
    ) -> None:
        at, fields = anchors
        own = slice(at[i], at[j])
        self.doc = np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))
        base = bounds[self.doc] - bounds[i]
        self.fields = {x: (v[own] if x == "core" else v[own] + base) for x, v in fields.items()}
        at, fields = covers
        own = slice(at[i], at[j])
        base = bounds[np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))] - bounds[i]
        self.covers = united(np.c_[fields["start"][own] + base, fields["end"][own] + base])
        self.base = bounds[self.doc] - bounds[i]
        self.echoes = np.zeros((0, 2), np.int64)
        if echoes is not None:
            at, fields = echoes
            own = slice(at[i], at[j])
            base = bounds[np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))] - bounds[i]
            held = np.c_[fields["start"][own] + base, fields["end"][own] + base]
            held = held[np.argsort(held[:, 0], kind="stable")]
            self.echoes = np.c_[held[:, 0], np.maximum.accumulate(held[:, 1])] if len(held) else held

    def echoed(self, p: np.ndarray, length: int) -> np.ndarray:
        """Whether the windows at p lie inside one string that doubling has found in a document of smaller number."""
        if not len(self.echoes):
            return np.zeros(len(p), bool)
        at = np.searchsorted(self.echoes[:, 0], p, "right") - 1
        return (at >= 0) & (self.echoes[np.maximum(at, 0), 1] >= p + length)

    def open(self, p: np.ndarray, length: int) -> np.ndarray:
        """Whether the windows at p have bytes outside every cover."""
        if not len(self.covers):
            return np.ones(len(p), bool)
        at = np.searchsorted(self.covers[:, 0], p, "right") - 1
        return (at < 0) | (self.covers[np.maximum(at, 0), 1] < p + length)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from each first to its last, and which pair each comes from."""
    n = last - first + 1
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - prefix(n)[:-1][of] + first[of], of


def _pieces_of(batch: pa.RecordBatch, text: str, names: list[str]) -> Iterator[tuple[_Piece, np.ndarray]]:
    data, bounds = text_bytes(batch.column("row").field(text))
    anchors, covers = _lists(batch.column("anchors"), names), _lists(batch.column("covers"), ["start", "end"])
    echoes = _lists(batch.column("echoes"), ["start", "end"]) if "echoes" in batch.schema.names else None
    for i, j in pieces(bounds):
        yield _Piece(bounds, i, j, anchors, covers, echoes), data[bounds[i] : bounds[j]]


def _steps(joined: DataFrame, text: str, length: int) -> DataFrame:
    """For every ``STEP`` windows of the given anchors: a hash of the bytes they share, and whether one of them asks.

    Windows inside a string whose rank is also that of a document of smaller number need no hash: doubling has settled
    their own bytes, and to others they are what the same window is there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for piece, data in _pieces_of(batch, text, ["lo", "hi", "a", "core"]):
                lo, hi, a = (piece.fields[x] for x in ("lo", "hi", "a"))
                q, of = _spread((a - hi) // STEP, (a - lo) // STEP)
                begin = a[of] - STEP * q
                first, last = np.maximum(lo[of], begin - STEP + 1), np.minimum(hi[of], begin)
                p, group = _spread(first, last)
                asks, stays = np.zeros(len(q), bool), np.zeros(len(q), bool)
                asks[group[piece.open(p, length)]] = True
                stays[group[~piece.echoed(p, length)]] = True
                asks, q, of, begin, first, last = (x[stays] for x in (asks, q, of, begin, first, last))
                hashes = range_hashes(data)(begin, begin + length - STEP + 1) ^ (q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                base, window = piece.base[of], range_hashes(data)
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid[piece.doc[of]]), pa.array(piece.fields["core"][of]), pa.array(hashes.view(np.int64)),
                    pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array(asks),
                    pa.array(window(first, first + length).view(np.int64)), pa.array(window(last, last + length).view(np.int64)),
                ], ["uid", "core", "hash", "lo", "hi", "asks", "at_lo", "at_hi"])

    return joined.mapInArrow(run, "uid long, core long, hash long, lo int, hi int, asks boolean, at_lo long, at_hi long")


def _still_open(grouped: DataFrame, length: int) -> DataFrame:
    """The steps of each document, and whether one of their windows has bytes outside every cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            steps, covers = _lists(batch.column("steps"), ["lo", "hi", "core", "hash"]), _lists(batch.column("covers"), ["start", "end"])
            room = np.zeros(batch.num_rows, np.int64)  # no text is needed, only room for each document
            for (at, fields), name, more in ((steps, "hi", length), (covers, "end", 0)):
                full = np.diff(at) > 0
                if full.any():
                    room[full] = np.maximum(room[full], np.maximum.reduceat(fields[name], at[:-1][full]) + more)
            piece = _Piece(prefix(room), 0, batch.num_rows, (steps[0], {x: v for x, v in steps[1].items() if x != "hash"}), covers)
            p, of = _spread(piece.fields["lo"], piece.fields["hi"])
            asks = np.zeros(len(piece.doc), bool)
            asks[of[piece.open(p, length)]] = True
            yield pa.RecordBatch.from_arrays([
                pa.array(uid[piece.doc]), pa.array(piece.fields["core"]), pa.array(steps[1]["hash"]),
                pa.array((piece.fields["lo"] - piece.base).astype(np.int32)), pa.array((piece.fields["hi"] - piece.base).astype(np.int32)), pa.array(asks),
            ], ["uid", "core", "hash", "lo", "hi", "asks"])

    return grouped.select("uid", "steps", "covers").mapInArrow(run, "uid long, core long, hash long, lo int, hi int, asks boolean")


def _windows(joined: DataFrame, text: str, length: int) -> DataFrame:
    """Every window of the given anchors with its hash, and whether it asks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            for piece, data in _pieces_of(batch, text, ["lo", "hi", "core"]):
                p, of = _spread(piece.fields["lo"], piece.fields["hi"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid[piece.doc[of]]), pa.array(piece.fields["core"][of]), pa.array(range_hashes(data)(p, p + length).view(np.int64)),
                    pa.array((p - piece.base[of]).astype(np.int32)), pa.array(piece.open(p, length)),
                ], ["uid", "core", "hash", "p", "asks"])

    return joined.mapInArrow(run, "uid long, core long, hash long, p int, asks boolean")


def repeated_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, core: int = CORE) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and ``removed``, its sorted, disjoint byte spans that repeated strings cover."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    uid = F.xxhash64(F.col(key), body)
    carried = docs.select(uid.alias("uid"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    # each step is written: what it read and shuffled can go before the next one shuffles, and no step runs twice
    rows = written(_anchor_rows(docs.select(uid.alias("uid"), body.alias("text")), length, core), "suffix-anchors")
    twice = written(rows.groupBy("core").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "suffix-cores")
    # a row for each document: the anchors whose content occurs again (those of a repeated row once)
    fields = ["core", "reach", "a", "next", "lo", "hi", "len"]
    kept = written(_sharing(rows, twice, ["core"]).groupBy("uid").agg(F.collect_set(F.struct(*fields)).alias("anchors")), "doubling-anchors")
    discard(rows, twice)
    found = doubled(kept.select("uid", F.explode("anchors").alias("_x")).select("uid", "_x.*"), length)
    certain = written(_settled(found), "doubling-covers")
    discard(found)
    asked = kept.select("uid", F.transform("anchors", lambda x: F.struct(*[x[f].alias(f) for f in ("core", "a", "lo", "hi")])).alias("anchors"))
    every = written(_steps(carried.select("uid", F.struct(F.col(f"row.{text}").cast("string").alias(text)).alias("row")).join(asked.join(certain, "uid", "left"), "uid"), text, length), "all-steps")
    discard(kept)
    again = every.groupBy("core", "hash").agg(F.count(F.lit(1)).alias("_n"), F.max("asks").alias("_asked")).filter("_n > 1 and _asked").drop("_asked")
    again = written(again, "shared-steps")
    steps = written(_sharing(every, again, ["core", "hash"]), "doubling-steps")
    discard(every, again)
    # the outermost windows of each step
    ends = F.explode(F.array_distinct(F.array(F.struct(F.col("lo").alias("p"), F.col("at_lo").alias("hash")), F.struct(F.col("hi").alias("p"), F.col("at_hi").alias("hash")))))
    outer = steps.select("uid", "core", ends.alias("_x")).select("uid", "core", "_x.*")
    outer, again = _hits(outer, outer, length)
    covers = written(_united(certain.select("uid", F.explode("covers").alias("_x")).select("uid", "_x.*").union(outer)), "all-covers")
    discard(certain, again)
    # all windows of the steps that still have open bytes, and of those with the same content
    grouped = steps.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", "core", "hash")).alias("steps"))
    held = written(_still_open(grouped.join(covers, "uid", "left"), length), "open-steps")
    discard(steps)
    again = written(held.groupBy("core", "hash").agg(F.count(F.lit(1)).alias("_n"), F.max("asks").alias("_asked")).filter("_asked").drop("_asked"), "shared-steps")
    left = written(_sharing(held, again, ["core", "hash"]).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", "core")).alias("anchors")), "open-anchors")
    discard(held, again)
    windows = written(_windows(carried.select("uid", F.struct(F.col(f"row.{text}").cast("string").alias(text)).alias("row")).join(left.join(covers, "uid", "left"), "uid"), text, length), "open-windows")
    discard(left)
    edges, again = _hits(windows, windows.filter("asks"), length)
    removed = written(_united(covers.select("uid", F.explode("covers").alias("_x")).select("uid", "_x.*").union(edges)).withColumnRenamed("covers", "removed"), "repeated-spans")
    discard(covers, windows, again)
    return carried.join(removed, "uid", "left").select("row", F.coalesce("removed", F.array().cast(_SPAN)).alias("removed"))


def _hits(windows: DataFrame, asking: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans of the asking windows whose content other windows have as well, and the table of such contents."""
    again = written(windows.groupBy("core", "hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "shared-windows")
    return _sharing(asking, again, ["core", "hash"]).select("uid", F.col("p").alias("start"), (F.col("p") + length).alias("end")), again


def _united(spans: DataFrame) -> DataFrame:
    """``uid`` and ``covers``: the sorted, disjoint spans that those of a document cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, fields = _lists(batch.column("spans"), ["start", "end"])
            out = [united(np.c_[fields["start"][a:b], fields["end"][a:b]]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), _span_lists(out)], ["uid", "covers"])

    lists = spans.select("uid", "start", "end").groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return lists.mapInArrow(run, f"uid long, covers {_SPAN}")


def _settled(found: DataFrame) -> DataFrame:
    """``uid``, ``covers`` (the sorted, disjoint spans of its strings) and ``echoes``: spans that a document of smaller number has whole.

    Strings that overlap and stand in the other document at the same distance are one longer string of both.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column("uid").to_numpy()
            at, fields = _lists(batch.column("spans"), ["start", "end", "in_uid", "shift"])
            spans = np.c_[fields["start"], fields["end"]]
            covers, echoes = [], []
            for own, a, b in zip(uid.tolist(), at, at[1:]):
                covers.append(united(spans[a:b]))
                mine = np.flatnonzero(fields["in_uid"][a:b] < own) + a
                order = mine[np.lexsort((spans[mine, 0], fields["shift"][mine], fields["in_uid"][mine]))]
                same = np.r_[False, (np.diff(fields["in_uid"][order]) == 0) & (np.diff(fields["shift"][order]) == 0)] if len(order) else np.zeros(0, bool)
                group = np.flatnonzero(~same)
                echoes.append(np.concatenate([united(spans[x]) for x in np.split(order, group[1:])]) if len(order) else np.zeros((0, 2), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), _span_lists(covers), _span_lists(echoes)], ["uid", "covers", "echoes"])

    lists = found.groupBy("uid").agg(F.collect_list(F.struct("start", "end", "in_uid", "shift")).alias("spans"))
    return lists.mapInArrow(run, f"uid long, covers {_SPAN}, echoes {_SPAN}")


def _span_lists(rows: list[np.ndarray]) -> pa.Array:
    size = prefix(np.array([len(x) for x in rows], np.int64))
    both = np.concatenate(rows).astype(np.int32) if rows else np.zeros((0, 2), np.int32)
    return pa.ListArray.from_arrays(pa.array(size.astype(np.int32)), pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["start", "end"]))


def kept_parts(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, end in removed:
        parts.append(text[at:start])
        at = end
    parts.append(text[at:])
    return b"".join(parts)


def digests(found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts of what is removed from each row, and the SHA-256 of what stays."""
    slim = found.select(F.col(f"row.{key}").alias("doc_id"), F.col(f"row.{text}").cast("string").alias("text"), "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            at, fields = _lists(batch.column("removed"), ["start", "end"])
            gone, spans, sums = [], [], []
            for r in range(batch.num_rows):
                cut = np.c_[fields["start"][at[r] : at[r + 1]], fields["end"][at[r] : at[r + 1]]]
                stays = kept_parts(data[bounds[r] : bounds[r + 1]].tobytes(), cut.tolist())
                gone.append(int((cut[:, 1] - cut[:, 0]).sum()))
                spans.append(len(cut))
                sums.append(hashlib.sha256(stays).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows with repeated strings cut out of their text. Bytes of a character that a cut has torn go with it."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([
            t if t is None or not len(s) else kept_parts(t.encode(), [(x["start"], x["end"]) for x in s]).decode(errors="ignore") for t, s in zip(texts, spans)
        ], dtype=object)

    names = found.schema["row"].dataType.names
    return found.select(*[(cut(F.col(f"row.{c}").cast("string"), "removed") if c == text else F.col(f"row.`{c}`")).alias(c) for c in names])
