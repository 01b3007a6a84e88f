"""Nearest memory rows per query vector without ever emitting all pairs.

Each task scores its memory rows against the query vectors of the same group with
one matrix product per batch and keeps only the best ``k`` per query, so what leaves
a task is at most ``k`` rows per query. Two ways to bring queries and rows together:

* few queries (count checked): they travel to the tasks, memory is not shuffled;
* many queries: both sides are shuffled by group and each task streams its group with the
  queries in front. Groups of many rows are split by salt; those of many queries too, so that
  a task holds ``QUERIES_PER_TASK`` of them at most, whatever the size of the tables.

Rows may be dealt to cells of which a query asks some only: a query still travels once, the cells it
asks are found in the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.plans.ranking import top_n
from memlake.plans.skew import SALT, hot_keys, repeat, spread

MAX_SHIPPED_QUERIES = 20_000
ROWS_PER_TASK = 2_000_000
#: Queries of a group that a task holds when they are shuffled.
QUERIES_PER_TASK = 100_000
#: Queries and memory rows that one matrix product takes; with fewer rows it takes more queries.
QUERY_TILE, ROW_TILE = 1_024, 2_048
#: Hits that wait to be cut, at least.
WAITING = 1 << 18
_DIGITS = 12  # scores closer than this count as equal, then the lower id wins


def _rows(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _array(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


class _Best:
    """Running best ``k`` memory rows per query of one group.

    ``asked`` tells of each query which cells it asks, as packed bits; without it a query asks all rows.
    """

    def __init__(self, queries: np.ndarray, k: int, asked: np.ndarray | None = None):
        self.queries, self.k, self.asked = queries, k, asked
        self.bar = np.full(len(queries), -np.inf)  # score that a further row must reach
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, cells: np.ndarray | None = None) -> None:
        """Score ``rows`` against the queries that ask their cells; memory grows with neither number."""
        if cells is None:
            parts = [np.arange(len(rows))]
        else:
            order = np.argsort(cells, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(cells[order])) + 1)
        for part in parts:
            which = None
            if cells is not None:
                cell = int(cells[part[0]])
                which = np.flatnonzero(self.asked[:, cell >> 3] >> (7 - (cell & 7)) & 1)
            for at in range(0, len(part), ROW_TILE):
                some = part[at : at + ROW_TILE]
                self._score(rows[some], ids[some], which)

    def _score(self, rows: np.ndarray, ids: np.ndarray, which: np.ndarray | None) -> None:
        number, tile = len(self.queries) if which is None else len(which), QUERY_TILE * max(1, ROW_TILE // len(rows))
        for at in range(0, number, tile):
            mine = slice(at, min(at + tile, number)) if which is None else which[at : at + tile]
            scores = np.round(self.queries[mine] @ rows.T, _DIGITS)
            bar = self.bar[mine]
            if scores.shape[1] > self.k:
                bar = np.maximum(bar, np.partition(scores, -self.k, axis=1)[:, -self.k])
                q, m = np.nonzero(scores >= bar[:, None])
            else:
                q, m = np.nonzero(~(scores < bar[:, None]))
            self.found.append((q + at if which is None else mine[q], scores[q, m], ids[m]))
            self.waiting += len(q)
            if self.waiting > max(WAITING, self.k * len(self.queries)):
                self._cut()

    def _cut(self) -> None:
        found = tuple(np.concatenate(parts) for parts in zip(*self.found))
        order = np.lexsort((found[2], -found[1], found[0]))
        q = found[0][order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        held = tuple(part[order[place < self.k]] for part in found)
        last = order[place == self.k - 1]
        self.bar[found[0][last]] = np.where(np.isnan(found[1][last]), -np.inf, found[1][last])
        self.found, self.waiting = [held], 0

    @property
    def held(self) -> tuple[np.ndarray, ...] | None:
        if self.found:
            self._cut()
        return self.found[0] if self.found else None


def _result(query_ids: np.ndarray, best: _Best, types: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    q, score, ids = best.held
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query_ids[q], type=types[0]),
            pa.array(ids, type=types[1]),
            pa.array(score, type=pa.float64()),
        ],
        names=["query_id", "id", "similarity"],
    )


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    """Row positions of each distinct ``_key`` in a batch."""
    codes = batch.column("_key").dictionary_encode()
    index = codes.indices.to_numpy()
    order = np.argsort(index, kind="stable")
    bounds = np.flatnonzero(np.diff(index[order])) + 1
    for part in np.split(order, bounds):
        yield codes.dictionary[index[part[0]]].as_py(), part


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return pa.int64() if isinstance(df.schema[column].dataType, T.LongType) else pa.string()


def nearest(
    queries: DataFrame,
    memory: DataFrame,
    k: int,
    keys: list[str],
    max_shipped: int = MAX_SHIPPED_QUERIES,
    rows_per_task: int = ROWS_PER_TASK,
    queries_per_task: int = QUERIES_PER_TASK,
    cells: Callable[[np.ndarray], np.ndarray] | None = None,
) -> tuple[DataFrame, bool]:
    """Best ``k`` rows per query among the rows with the same ``keys``.

    ``queries`` has ``query_id`` and ``query_vec``, ``memory`` has ``id`` and ``embedding``;
    ids are long or string. With ``cells``, which tells of query vectors the cells they ask as packed bits, ``memory``
    has a number ``_cell`` too. Also tells whether the result is bounded by the query check.
    """
    key: Column = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in keys])
    cell = (F.col("_cell") if cells else F.lit(None)).cast("int").alias("_cell")
    q = queries.filter(F.col("query_vec").isNotNull()).select(*keys, "query_id", "query_vec")
    m = memory.filter(F.col("embedding").isNotNull()).select(*keys, "id", "embedding", cell)
    types = (_arrow_type(q, "query_id"), _arrow_type(m, "id"))
    out = T.StructType([q.schema["query_id"], m.schema["id"], T.StructField("similarity", T.DoubleType())])

    def in_cells(batch: pa.RecordBatch) -> np.ndarray | None:
        return batch.column("_cell").to_numpy() if cells else None

    probe = q.select(key.alias("_key"), "query_id", "query_vec").limit(max_shipped + 1).toArrow()
    shipped = probe.num_rows <= max_shipped
    if shipped:
        by_key: dict[str, tuple[np.ndarray, ...]] = {}
        if probe.num_rows:
            batch = probe.combine_chunks().to_batches()[0]
            raw, ids = _rows(batch.column("query_vec")), _array(batch.column("query_id"))
            vectors = _unit(raw)
            by_key = {k_: (ids[rows], vectors[rows], cells(raw[rows]) if cells else None) for k_, rows in _groups(batch)}
        held = memory.sparkSession.sparkContext.broadcast(by_key)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[str, _Best] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors, ids, own = _unit(_rows(batch.column("embedding"))), _array(batch.column("id")), in_cells(batch)
                for name, rows in _groups(batch):
                    if name in held.value:
                        if name not in best:
                            best[name] = _Best(held.value[name][1], k, held.value[name][2])
                        best[name].add(vectors[rows], ids[rows], own[rows] if cells else None)
            for name, state in best.items():
                if state.held is not None:
                    yield _result(held.value[name][0], state, types)

        scored = m.select(key.alias("_key"), "id", "embedding", "_cell").mapInArrow(score, out)
    else:
        # a query meets all parts of its group's rows, a row all blocks of its group's queries
        hot, crowded = hot_keys(m, keys, rows_per_task), hot_keys(q, keys, queries_per_task)
        rows = repeat(spread(m, hot, keys, F.col("id")).withColumnRenamed(SALT, "_part"), crowded, keys).select(
            key.alias("_key"), "_part", F.col(SALT).alias("_block"), F.lit(1).alias("_side"),
            F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), "id", F.col("embedding").alias("_vec"), "_cell",
        )
        asked = repeat(spread(q, crowded, keys, F.col("query_id")).withColumnRenamed(SALT, "_block"), hot, keys).select(
            key.alias("_key"), F.col(SALT).alias("_part"), "_block", F.lit(0).alias("_side"), "query_id",
            F.lit(None).cast(m.schema["id"].dataType).alias("id"), F.col("query_vec").alias("_vec"), F.lit(None).cast("int").alias("_cell"),
        )

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, ids, vectors, bits, best = None, [], [], [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = batch.append_column("_group", pa.array(
                    ["\x1f".join(map(str, g)) for g in zip(*(batch.column(c).to_pylist() for c in ("_key", "_part", "_block")))]))
                side = batch.column("_side").to_numpy()
                codes = table.column("_group").dictionary_encode()
                for code in dict.fromkeys(codes.indices.to_pylist()):
                    part = np.flatnonzero(codes.indices.to_numpy() == code)
                    group = codes.dictionary[code].as_py()
                    if group != current:
                        if best is not None and best.held is not None:
                            yield _result(np.concatenate(ids), best, types)
                        current, ids, vectors, bits, best = group, [], [], [], None
                    for wanted in (0, 1):
                        some = batch.take(pa.array(part[side[part] == wanted]))
                        if not some.num_rows:
                            continue
                        raw = _rows(some.column("_vec"))
                        if wanted == 0:
                            ids.append(_array(some.column("query_id")))
                            vectors.append(_unit(raw))
                            if cells:
                                bits.append(cells(raw))
                        elif best is not None or vectors:
                            if best is None:
                                best = _Best(np.concatenate(vectors), k, np.concatenate(bits) if cells else None)
                                vectors, bits = [], []
                            best.add(_unit(raw), _array(some.column("id")), in_cells(some))
            if best is not None and best.held is not None:
                yield _result(np.concatenate(ids), best, types)

        dealt = ["_key", "_part", "_block"]
        scored = asked.unionByName(rows).repartition(*dealt).sortWithinPartitions(*dealt, "_side", "_cell").mapInArrow(stream, out)
    order = [F.col("similarity").desc(), F.col("id").asc()]
    return top_n(scored, k, ["query_id"], order), shipped
