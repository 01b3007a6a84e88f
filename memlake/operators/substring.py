"""Which stored texts hold which asked texts, without a pair of them sent anywhere.

Asked texts of bounded number and length go to every task. Each is looked up by one of its runs of ``LONGEST`` characters (a
shorter one is a run itself), the one that the fewest asked texts of its block have; a stored text gives the numbers
of its runs, and is searched only for the asked texts whose run it has. It stays where it was read: what leaves a task are hits,
of each asked text no more than are wanted.

More asked texts than that are found by an equi-join on rare trigrams. A text that holds another holds all its pieces of three characters (a shorter one is a piece itself). Stored
texts give the pieces that are asked for, each once; an asked text is looked up by the one of its pieces that the fewest texts
of its block hold. Only ids and pieces are joined; the texts come back once, by id, to test
their candidates. Pieces that many texts hold are split by salt. Where only the newest rows of each asked text are
wanted, the newest that hold its piece are tested first, and further ones only for texts that have too few hits among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions.trigram import distinct
from memlake.plans.ranking import top_n
from memlake.plans.skew import SALT, hot_keys, repeat, spread
from memlake.session import checkpointed

PIECE = 3
POSTINGS_PER_TASK = 20_000
#: Asked texts and their characters that may be sent to every task; asked pieces likewise.
MAX_SENT_TEXTS = 1 << 19
MAX_SENT_CHARS = 1 << 24
MAX_SENT_PIECES = 1 << 18
#: Characters of the run that an asked text is looked up by; bits of the table that drops other runs.
LONGEST = 6
_TABLE_BITS = 22
#: Rows of a piece that are tested, newest first, before all of them are.
NEWEST_TESTED = (64, 4_096)


def pieces(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of each of ``sizes`` (1 to 3) characters of a text as longs: 21 bits hold a character, none is 0."""
    @F.pandas_udf("array<bigint>")
    def runs(texts: pd.Series) -> pd.Series:
        out = []
        for one in texts:
            letters = np.frombuffer((one or "").encode("utf-32-le"), np.uint32).astype(np.int64) + 1
            parts = [sum(letters[k : max(0, len(letters) - n + 1) + k] << (21 * k) for k in range(n)) for n in sizes]
            out.append(np.unique(np.concatenate(parts)))
        return pd.Series(out)

    return runs(text)


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BEFORE_ALL = np.iinfo(np.int64).min


def _runs(text: str, longest: int) -> list[np.ndarray]:
    """Numbers of the runs of 1, 2 ... ``longest`` characters; equal runs have equal numbers, few others do."""
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = [letters]
    for n in range(1, min(longest, len(letters))):
        out.append((out[-1][:-1] ^ (out[-1][:-1] >> np.uint64(31))) * _FACTOR + letters[n:])
    return out


def _places(numbers: np.ndarray) -> np.ndarray:
    return (numbers * _FACTOR) >> np.uint64(64 - _TABLE_BITS)


def run_numbers(text: Column) -> Column:
    """Numbers of the longest runs of a text, up to ``LONGEST`` characters."""
    longest = LONGEST

    @F.pandas_udf("array<bigint>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_runs(one, longest)[-1]).view(np.int64) for one in texts])

    return numbers(text)


class _Asked:
    """Asked texts by block and run, in a task."""

    def __init__(self, asked: pa.Table, block: list[str]):
        self.named, self.texts = asked.column("_text"), asked.column("_text").to_pylist()
        runs = asked.column("_run").to_numpy().view(np.uint64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_places(runs)] = True
        keys = list(zip(*[asked.column(c).to_pylist() for c in block]))
        bounds = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        self.of = {}
        for a, b in zip(bounds, bounds[1:]):
            own = np.sort(runs[a:b])
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            # sent in the order of numbers with a sign
            order = a + np.argsort(runs[a:b], kind="stable")
            self.of[keys[a]] = own[first], first, np.diff(np.r_[first, len(own)]), order
        self.longest = min(LONGEST, max(map(len, self.texts), default=0))

    def with_runs(self, text: str, key: tuple) -> np.ndarray:
        """Which asked texts of a block have their run in ``text``."""
        numbers = np.concatenate(_runs(text, self.longest))
        numbers = distinct(numbers[self.table[_places(numbers)]])
        own, first, count, order = self.of[key]
        at = np.minimum(np.searchsorted(own, numbers), len(own) - 1)
        at = at[own[at] == numbers]
        first, count = first[at], count[at]
        return order[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def _held(rows: DataFrame, sent: Broadcast, block: list[str], text: str, newest: tuple[int, str] | None) -> DataFrame:
    """Rows with the sent texts that they hold; with ``newest`` each task leaves out rows that have enough before them."""
    kept = [c for c in rows.columns if c not in (*block, text)]
    out = T.StructType([*[rows.schema[c] for c in block], T.StructField("_text", T.StringType()), *[rows.schema[c] for c in kept]])
    moment = rows.schema[newest[1]].dataType if newest else None
    compared = isinstance(moment, (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(sent.value, block)
        last = np.full(len(asked.texts), _BEFORE_ALL)  # time of the last row wanted among those seen
        for batch in batches:
            rows_ = pa.Table.from_batches([batch])
            if newest:
                rows_ = rows_.take(pc.sort_indices(rows_, sort_keys=[(newest[1], "descending"), ("id", "ascending")], null_placement="at_end"))
            times = [_BEFORE_ALL] * len(rows_)
            if compared:
                column = rows_.column(newest[1])
                column = column.cast(pa.int32()) if pa.types.is_date32(column.type) else column
                times = column.cast(pa.int64()).fill_null(_BEFORE_ALL).to_pylist()
            found, full = np.zeros(len(asked.texts), np.int64), np.zeros(len(asked.texts), bool)
            at, of = [], []
            for i, (key, one, time) in enumerate(zip(zip(*[rows_.column(c).to_pylist() for c in block]), rows_.column(text).to_pylist(), times)):
                if not one or key not in asked.of:
                    continue
                maybe = asked.with_runs(one, key)
                if newest:
                    maybe = maybe[~full[maybe] & (last[maybe] <= time)]
                here = [j for j in maybe.tolist() if asked.texts[j] in one]
                at += [i] * len(here)
                of += here
                if newest and here:
                    found[here] += 1
                    done = np.array(here)[found[here] == newest[0]]
                    full[done] = True
                    last[done] = np.maximum(last[done], time)
            at, of = pa.array(at, pa.int64()), pa.array(of, pa.int64())
            columns = [*[rows_.column(c).take(at) for c in block], asked.named.take(of), *[rows_.column(c).take(at) for c in kept]]
            yield from pa.table(columns, names=out.names).combine_chunks().to_batches()

    return rows.filter(F.col(text).isNotNull() & F.col("id").isNotNull()).select(*block, text, *kept).mapInArrow(run, out)


def _held_by_run(rows: DataFrame, asked: DataFrame, block: list[str], text: str, newest: tuple[int, str] | None) -> DataFrame:
    """``holding`` for asked texts that go to every task."""
    runs = asked.select(*block, "_text", F.explode(run_numbers(F.col("_text"))).alias("_run"))
    counts = runs.groupBy(*block, "_run").agg(F.count(F.lit(1)).alias("_n"))
    rare = F.min(F.struct("_n", "_run"))["_run"].alias("_run")
    chosen = runs.join(counts, [*block, "_run"]).groupBy(*block, "_text").agg(rare).select(*block, "_run", "_text").toArrow()
    chosen = chosen.sort_by([(c, "ascending") for c in (*block, "_run", "_text")]).combine_chunks()
    hits = _held(rows, rows.sparkSession.sparkContext.broadcast(chosen), block, text, newest)
    if newest:
        hits = top_n(hits, newest[0], [*block, "_text"], [F.col(newest[1]).desc(), F.col("id").asc()], "_place").drop("_place")
    # rows of one id count for each other
    copies = F.count(F.lit(1)).over(Window.partitionBy(*block, "_text", "id"))
    return hits.withColumn("_copies", copies).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies", "_copy")


def holding(rows: DataFrame, asked: DataFrame, block: list[str], text: str, postings_per_task: int = POSTINGS_PER_TASK, newest: tuple[int, str] | None = None) -> DataFrame:
    """``block``, ``_text`` and the columns of ``rows`` but its text: every row with every asked text of its block that it holds.

    ``rows`` has a unique ``id``; ``asked`` has ``block`` and ``_text``, distinct. Letter case counts. With ``newest`` (a number
    and a column of ``rows``) only so many rows of each asked text are sure to be there, the last by that column, then by id.
    """
    asked = checkpointed(asked.filter(F.col("_text").isNotNull()))
    given = asked.filter("_text <> ''")
    n, chars = given.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()
    columns = [*block, "_text", *[c for c in rows.columns if c not in (*block, text)]]
    every = rows.filter(F.col(text).isNotNull()).join(asked.filter("_text = ''"), block).select(*columns)
    if n <= MAX_SENT_TEXTS and chars <= MAX_SENT_CHARS:
        return every.unionByName(_held_by_run(rows, given, block, text, newest)) if n else every
    return every.unionByName(_joined(rows, given, block, text, postings_per_task, newest))


def _joined(rows: DataFrame, asked: DataFrame, block: list[str], text: str, postings_per_task: int, newest: tuple[int, str] | None) -> DataFrame:
    """``holding`` for any number of asked texts: an equi-join on rare trigrams."""
    size = F.least(F.length("_text"), F.lit(PIECE))
    sizes = [r[0] for r in asked.select(size).distinct().collect()]  # 1 to 3
    wanted = [asked.filter(size == n).select(*block, "_text", F.explode(pieces(F.col("_text"), [n])).alias("_piece")) for n in sizes]
    none = asked.limit(0).select(*block, "_text", F.lit(0).cast("long").alias("_piece"))
    wanted = checkpointed(reduce(DataFrame.unionByName, [*wanted, none]))
    known = checkpointed(wanted.select("_piece").distinct())
    few = known.limit(MAX_SENT_PIECES + 1).count() <= MAX_SENT_PIECES
    stored = pieces(F.col(text), sizes) if sizes else F.array().cast("array<long>")
    found = rows.filter(F.col(text).isNotNull()).select(*block, "id", *(newest or ())[1:], F.explode(stored).alias("_piece"))
    found = checkpointed(found.join(F.broadcast(known) if few else known, "_piece", "left_semi"))

    key = [*block, "_piece"]
    held = found.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    # a piece that no text holds rules its text out
    rare = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_piece").alias("piece")))
    by = checkpointed(wanted.join(held, key, "left").groupBy(*block, "_text").agg(rare.alias("_rare")).filter("_rare.n > 0").select(
        *block, F.col("_rare.piece").alias("_piece"), "_text"))
    columns = [*block, "_text", *[c for c in rows.columns if c not in (*block, text)]]

    def tested(candidates: DataFrame) -> DataFrame:
        return rows.join(candidates, "id").filter(F.contains(F.col(text), F.col("_text"))).select(*columns)

    hits = []
    for most in NEWEST_TESTED if newest else ():
        k, time = newest
        last = top_n(found.join(by.select(*key).distinct(), key, "left_semi"), most, key, [F.col(time).desc(), F.col("id").asc()], "_place")
        some = checkpointed(tested(last.join(by, key).select("id", "_text")))
        enough = some.groupBy(*block, "_text").agg(F.count(F.lit(1)).alias("_hits")).filter(F.col("_hits") >= k).drop("_hits")
        whole = by.join(held.filter(F.col("_n") <= most), key).select(*block, "_text")
        settled = checkpointed(enough.unionByName(whole).distinct())
        hits.append(some.join(settled, [*block, "_text"], "left_semi"))
        by = checkpointed(by.join(settled, [*block, "_text"], "left_anti"))
        if by.isEmpty():
            break
    else:
        postings = found.join(by.select(*key).distinct(), key, "left_semi")
        hot = checkpointed(hot_keys(postings, key, postings_per_task))
        hits.append(tested(spread(postings, hot, key, F.col("id")).join(repeat(by, hot, key), [*key, SALT]).select("id", "_text")))
    return reduce(DataFrame.unionByName, hits)
