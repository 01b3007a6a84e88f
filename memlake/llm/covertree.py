"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to shards. A shard's vectors come to one task, followed by the queries in blocks
of ``PER_BLOCK``; the task indexes its vectors in a cover tree once and each block of queries
in another: the centres of a node's children cover its points within ``SHRINK`` of its radius and lie
apart from one another by more than that. Both trees are descended together: for a node of queries
and a node of vectors no inner product exceeds that of their centres plus what the two covering radii
allow, and the pair is pruned when that is below the worst k-th score of the queries under the node; else
the node of the larger radius is split. All pairs of a step are handled side by side. Every leaf of queries first meets
the ``BEAM`` leaves of vectors that its centre leads to, so that bars are there to prune with; pairs of leaves are compared by
falling bound, and the risen bars prune the rest.

Each query is searched in one shard first. Its k-th score there is the bar it takes to all other shards,
which hand on what reaches it. Vectors are copied once, queries once for each shard.

Components are integers after scaling, so scores are exact. Defined results: vectors that
are null or hold null or non-finite components take no part, neither do empty ones; only
vectors of a query's length are its candidates; ties go to the smaller id; repeated vector rows
are candidates of their own, a repeated query row is answered once for each row, and a row is never its own answer, nor is
one with its id; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import written
from memlake.plans.ranking import top_n

K = 5
PER_SHARD = 8192
PER_BLOCK = 2048
#: Points of a leaf, for queries and for vectors.
QUERY_LEAF, LEAF = 2, 8
#: A child's reach as a share of its parent's.
SHRINK = 1 / 1.3
#: Leaves that a group of queries meets before anything is pruned.
BEAM = 6
#: Pairs of leaves compared, and pairs of centres multiplied, at once.
PAIRS, CENTRES = 1 << 12, 1 << 15


def _away(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = points - centre
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class CoverTree:
    """Nested covers of points, node by node in arrays; the points under a node lie side by side in ``order``.

    A leaf has ``leaf`` points at most; more of them, if they are equal, are leaves of their own.
    """

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.leaf, order, nodes = leaf, [], [[0, len(points), 0, 0.0, 0, 0]]  # low, high, centre, radius, first child, children
        waiting = [(0, np.arange(len(points)), 0)]
        held: dict[int, np.ndarray] = {}
        while waiting:
            at, rows, first = waiting.pop()
            own = points[rows]
            away = _away(own, own[first])
            nodes[at][2:4] = [int(rows[first]), float(away.max())]
            parts = []
            if len(rows) > leaf and nodes[at][3] == 0:
                parts = [(rows[i : i + leaf], 0) for i in range(0, len(rows), leaf)]
            elif len(rows) > leaf:
                left, c = np.arange(len(rows)), first
                while len(left):
                    # the first child keeps its parent's centre; further centres are out of reach of those before
                    near = (away if c == first else _away(own[left], own[c])) <= nodes[at][3] * SHRINK
                    mine, left = left[near], left[~near]
                    parts.append((rows[mine], int(np.flatnonzero(mine == c)[0])))
                    c = int(left[0]) if len(left) else -1
            held[at] = rows
            nodes[at][4:6] = [len(nodes), len(parts)]
            for i, (mine, centre) in enumerate(parts):
                waiting.append((len(nodes), mine, centre))
                nodes.append([0, 0, 0, 0.0, 0, 0])
        stack = [0]
        while stack:  # depth first, so that a node's points follow one another
            at = stack.pop()
            if at < 0:
                nodes[~at][1] = len(order)
                continue
            nodes[at][0] = len(order)
            stack.append(~at)
            if nodes[at][5]:
                stack += range(nodes[at][4], nodes[at][4] + nodes[at][5])
            else:
                order += held[at].tolist()
        low, high, centre, self.radius, self.child, self.children = (np.array(x) for x in zip(*nodes))
        self.low, self.high, self.order = low, high, np.array(order, np.int64)
        self.centre = points[centre]
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        place = low[:, None] + np.arange(leaf)
        self.held = np.where((self.children[:, None] == 0) & (place < high[:, None]), self.order[np.minimum(place, len(order) - 1)], -1)

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of some nodes, one node's after the other's, and which node each comes from."""
        n = self.children[nodes]
        of = np.repeat(np.arange(len(nodes)), n)
        return self.child[nodes][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of], of

    def lowest(self, values: np.ndarray) -> np.ndarray:
        """For every node the smallest of the values of the points below it."""
        ends = np.c_[self.low, self.high].ravel()
        return np.minimum.reduceat(np.r_[values[self.order], np.inf], ends)[::2]


class Search:
    """Blocks of queries against one indexed shard; ``compared`` counts the pairs whose product was taken."""

    def __init__(self, data: np.ndarray, data_ids: np.ndarray, k: int) -> None:
        self.data, self.data_ids, self.k = data, data_ids, k
        self.tree = CoverTree(data, LEAF)
        self.compared = 0

    def run(self, queries: np.ndarray, query_ids: np.ndarray, bars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best k scores and ids for each query, padded with minus infinity; those below a query's bar may be left out."""
        self.queries, self.query_ids = queries, query_ids
        self.score = np.full((len(queries), self.k), -np.inf)
        self.found = np.full((len(queries), self.k), np.iinfo(np.int64).max)
        self.bar = np.full(len(queries), -np.inf) if bars is None else bars.astype(float)
        groups, tree = CoverTree(queries, QUERY_LEAF), self.tree
        q, d = self.nearby(groups, tree)
        met = np.sort(q * len(tree.radius) + d)
        self.compare(groups, q, d)
        q, d, most = self.descend(groups, tree)
        new = met[np.minimum(np.searchsorted(met, q * len(tree.radius) + d), len(met) - 1)] != q * len(tree.radius) + d
        order = np.argsort(-most[new], kind="stable")
        q, d, most = q[new][order], d[new][order], most[new][order]
        while len(q):  # the most promising pairs first; what falls below the risen bars goes
            self.compare(groups, q[:PAIRS], d[:PAIRS])
            q, d, most = q[PAIRS:], d[PAIRS:], most[PAIRS:]
            open_ = most >= groups.lowest(self.worst())[q]
            q, d, most = q[open_], d[open_], most[open_]
        return self.score, self.found

    def worst(self) -> np.ndarray:
        """The bar of each query: below it no inner product counts."""
        return np.maximum(self.score[:, -1], self.bar)

    def dots(self, groups: CoverTree, q: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Inner products of the centres of pairs of nodes."""
        out = np.empty(len(q))
        for i in range(0, len(q), CENTRES):
            out[i : i + CENTRES] = np.einsum("ij,ij->i", groups.centre[q[i : i + CENTRES]], self.tree.centre[d[i : i + CENTRES]])
        return out

    def nearby(self, groups: CoverTree, tree: CoverTree) -> tuple[np.ndarray, np.ndarray]:
        """Some leaves that the centre of each leaf of queries leads to, ``BEAM`` nodes wide."""
        q = np.flatnonzero(groups.children == 0)
        d = np.zeros(len(q), np.int64)
        while True:
            inner = tree.children[d] > 0
            if not inner.any():
                return q, d
            down, of = tree.below(d[inner])
            q, d = np.r_[q[~inner], q[inner][of]], np.r_[d[~inner], down]
            order = np.lexsort((-self.dots(groups, q, d), q))
            q, d = q[order], d[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            q, d = q[rank < BEAM], d[rank < BEAM]

    def descend(self, groups: CoverTree, tree: CoverTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of leaves that the bars don't prune, with their bounds. Of a pair the node of the larger radius is split."""
        worst = groups.lowest(self.worst())
        q, d = np.zeros(1, np.int64), np.zeros(1, np.int64)
        found = []
        while len(q):
            most = self.dots(groups, q, d) + groups.radius[q] * tree.norm[d] + tree.radius[d] * groups.norm[q] + groups.radius[q] * tree.radius[d]
            most += np.abs(most) * 1e-12 + 1e-6
            open_ = most >= worst[q]
            q, d, most = q[open_], d[open_], most[open_]
            ends = (groups.children[q] == 0) & (tree.children[d] == 0)
            found.append((q[ends], d[ends], most[ends]))
            q, d = q[~ends], d[~ends]
            data = (tree.children[d] > 0) & ((groups.children[q] == 0) | (tree.radius[d] >= groups.radius[q]))
            down, of = tree.below(d[data])
            below, by = groups.below(q[~data])
            q, d = np.r_[q[data][of], below], np.r_[down, d[~data][by]]
        return tuple(np.concatenate(x) for x in zip(*found))

    def compare(self, groups: CoverTree, q: np.ndarray, d: np.ndarray) -> None:
        """All pairs of points of pairs of leaves, merged into the best k of each query."""
        for i in range(0, len(q), PAIRS):
            rows, points = groups.held[q[i : i + PAIRS]], self.tree.held[d[i : i + PAIRS]]
            s = np.einsum("pad,pbd->pab", self.queries[rows], self.data[points], optimize=True)
            fits = (rows[:, :, None] >= 0) & (points[:, None, :] >= 0)
            self.compared += int(fits.sum())
            fits &= self.query_ids[rows][:, :, None] != self.data_ids[points][:, None, :]
            p, a, b = np.nonzero(fits & (s >= self.worst()[rows][:, :, None]))
            row, at = rows[p, a], points[p, b]
            hit = np.unique(row)
            row_all = np.r_[row, np.repeat(hit, self.k)]
            s_all = np.r_[s[p, a, b], self.score[hit].ravel()]
            id_all = np.r_[self.data_ids[at], self.found[hit].ravel()]
            order = np.lexsort((id_all, -s_all, row_all))
            best = order[np.searchsorted(row_all[order], hit)[:, None] + np.arange(self.k)]
            self.score[hit], self.found[hit] = s_all[best], id_all[best]


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k scores and ids for each query, padded with minus infinity."""
    if not len(queries) or not len(data):
        return np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    return Search(data, data_ids, k).run(queries, query_ids)


_FOUND = "number long, query_id long, vec_id long, score long"


def _streamed(asked: DataFrame, held: DataFrame, k: int, scale: float) -> DataFrame:
    """Answers of each shard to the queries sent there (``number``, ``id``, ``v``, ``dim``, ``bar``, ``shard``)."""
    names = ["number", "query_id", "vec_id", "score"]
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names)

    def grid(parts: list[pa.RecordBatch]) -> np.ndarray:
        column = pa.concat_arrays([p.column("v") for p in parts])
        return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))

    def numbers(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
        return pa.concat_arrays([p.column(name) for p in parts]).to_numpy(zero_copy_only=False)

    def answers(index: Search | None, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        if index is None or not parts:
            return none
        ids, bars = numbers(parts, "id"), pa.concat_arrays([p.column("bar") for p in parts]).to_numpy(zero_copy_only=False).astype(float)
        score, found = index.run(grid(parts), ids, np.where(np.isnan(bars), -np.inf, bars))
        r, c = np.nonzero(np.isfinite(score))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (numbers(parts, "number")[r], ids[r], found[r, c], score[r, c].astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vectors, waiting, index = None, [], [], None
        for batch in batches:
            keys = np.c_[batch.column("dim").to_numpy(), batch.column("shard").to_numpy(), batch.column("asks").to_numpy()]
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key != tuple(keys[a, :2]):
                    yield answers(index, waiting)
                    key, vectors, waiting, index = tuple(keys[a, :2]), [], [], None
                if not keys[a, 2]:
                    vectors.append(batch.slice(a, b - a))
                    continue
                if vectors:  # the first queries: all vectors of the shard are there
                    index, vectors = Search(grid(vectors), numbers(vectors, "id"), k), []
                for at in range(a, b, PER_BLOCK):
                    waiting.append(batch.slice(at, min(PER_BLOCK, b - at)))
                    if sum(p.num_rows for p in waiting) >= PER_BLOCK:
                        yield answers(index, waiting)
                        waiting = []
        yield answers(index, waiting)

    both = held.select("dim", "shard", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("number"), "id", "v", F.lit(None).cast("long").alias("bar")).unionByName(
        asked.select("dim", "shard", F.lit(1).alias("asks"), "number", "id", "v", "bar"))
    return both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks").mapInArrow(run, _FOUND)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k vectors with the largest integer inner product."""
    def whole(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector), lambda x: x.cast("double"))
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        kept = df.select(F.col(key).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull())
        # the number tells rows of one id apart, and spreads them
        return kept.withColumns({"dim": F.size("v"), "number": F.monotonically_increasing_id()})

    asked, held = written(whole(queries), "cover-queries"), written(whole(vectors), "cover-vectors")
    shards = max(1, -(-held.count() // PER_SHARD))
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(shards)).cast("int")
    held = held.withColumn("shard", place("id", "number"))
    home = asked.withColumn("home", place("number", "id"))
    none = F.lit(None).cast("long")
    found = written(_streamed(home.withColumns({"shard": F.col("home"), "bar": none}), held, k, scale), "cover-found")
    if shards > 1:
        bars = found.groupBy("number").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bar"))
        others = home.join(bars, "number", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
        found = found.unionByName(_streamed(others, held, k, scale))
    best = top_n(found, k, ["number"], [F.desc("score"), F.col("vec_id").asc()])
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
