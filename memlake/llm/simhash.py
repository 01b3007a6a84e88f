"""Near-duplicates by SimHash fingerprints, found with vantage-point trees.

Fingerprints of 64 bits over 4-word shingles link at 4 or fewer differing bits. The
distinct fingerprints are dealt to shards by the top of a vantage-point tree: a node
splits by the Hamming distance to its vantage point. By the triangle inequality a
fingerprint whose distance is within the radius of a node's boundary may have links on
the other side, so it is also asked there; every other branch is pruned. Each shard
holds its own fingerprints in a deeper tree of the same kind and asks all visitors in
blocks. A shard hands on a spanning forest of the links it found, not the links, and
connected components grow from the forests by star contraction.

The top of the tree is built from a sample of ``SAMPLE`` fingerprints; it only decides
where a fingerprint lies, never whether a link is found.

Defined results: texts without words (null, empty, blank) have fingerprint zero and link
like any other; fewer than four words make one shingle; repeated rows and ids come back
one by one; texts of any length are hashed whole; a null id never names a component that has another id; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import discard, text_bytes, written

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints the top of the tree is built from, at least.
SAMPLE = 1 << 17
#: Fingerprints of a shard, and of a leaf inside one.
PER_SHARD = 1 << 16
PER_LEAF = 64
#: Visitors compared with a leaf at once, and fingerprints that ask in one task.
BLOCK = 1 << 14
PER_BLOCK = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # on bytes both act on ASCII only, and split at 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 15):
        bits = np.unpackbits(values[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    set_bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(set_bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every document."""
    wanted = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            at = bounds.tolist()
            found = [fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return wanted.mapInArrow(run, f"doc_id {kind}, fp long")


def _away(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Vantage point and inner radius that halve ``points`` best, or None where no distance does.

    Of a few candidates the one whose boundary has the fewest points within the radius wins.
    """
    best = None
    for i in np.linspace(0, len(points) - 1, 5).astype(int):
        d = _away(points, points[i])
        edge = int(np.median(d))
        inner = int((d <= edge).sum())
        if inner in (0, len(points)):
            continue
        cost = int((np.abs(d - edge - 0.5) < RADIUS).sum()) + abs(2 * inner - len(points))
        if best is None or cost < best[0]:
            best = cost, points[i], edge
    return best and (best[1], best[2])


def build_top(sample: np.ndarray, depth: int) -> list[tuple[int, int] | None]:
    """Nodes of the top in heap order: (vantage, inner radius), or None below a leaf."""
    nodes: list[tuple[int, int] | None] = [None] * ((1 << depth) - 1)
    held = {0: sample}
    for i in range(len(nodes)):
        mine = held.pop(i, None)
        cut = _split(mine) if mine is not None and len(mine) > 8 else None
        if cut:
            d = _away(mine, cut[0])
            nodes[i] = (int(cut[0]), cut[1])
            held[2 * i + 1], held[2 * i + 2] = mine[d <= cut[1]], mine[d > cut[1]]
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int] | None], radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, the indexes of the points that visit it, and which of them live there."""
    waiting = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while waiting:
        node, at, home = waiting.pop()
        if not len(at):
            continue
        if node >= len(nodes) or nodes[node] is None:
            yield node, at, home
            continue
        vantage, edge = nodes[node]
        d = _away(points[at], np.uint64(vantage))
        inner, outer = d <= edge + radius, d > edge - radius
        waiting.append((2 * node + 1, at[inner], (home & (d <= edge))[inner]))
        waiting.append((2 * node + 2, at[outer], (home & (d > edge))[outer]))


class _Sets:
    """Union-find over the indexes of one shard."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def shard_forest(points: np.ndarray, home: np.ndarray, radius: int, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Points and the representative of the set that links inside the shard put them in; only those that ask are looked up."""
    sets = _Sets(len(points))
    waiting = [(np.flatnonzero(home), np.arange(len(points)) if asks is None else np.flatnonzero(asks))]
    while waiting:
        own, asked = waiting.pop()
        if not len(own) or not len(asked):
            continue
        cut = _split(points[own]) if len(own) > PER_LEAF else None
        if cut:
            vantage, edge = cut
            d, e = _away(points[own], vantage), _away(points[asked], vantage)
            waiting.append((own[d <= edge], asked[e <= edge + radius]))
            waiting.append((own[d > edge], asked[e > edge - radius]))
            continue
        for at in range(0, len(asked), BLOCK):
            some = asked[at : at + BLOCK]
            near = np.bitwise_count(points[own][:, None] ^ points[some][None, :]) <= radius
            hit = np.flatnonzero(near.sum(axis=0) > (np.isin(some, own)))  # all but those that found only themselves
            if not len(hit):
                continue
            near, some = near[:, hit], some[hit]
            first = near.argmax(axis=0)
            for q, h in zip(some.tolist(), own[first].tolist()):
                sets.join(q, h)
            for h in np.unique(first):  # what else the visitors of one point have found
                for other in own[near[:, first == h].any(axis=1)].tolist():
                    sets.join(int(own[h]), other)
    root = np.array([sets.root(i) for i in range(len(points))], np.int64)
    linked = root != np.arange(len(points))
    return points[linked], points[root[linked]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``a``, ``b`` of fingerprints that span every group linked within ``radius`` bits.

    A shard's own fingerprints meet its visitors block by block: a block holds all of the shard's own and at most some
    ``PER_BLOCK`` of those that ask, so a task stays as large as it is however many visitors a shard has.
    """
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / PER_SHARD)))))
    nodes: list[tuple[int, int] | None] = []
    if depth:
        # 16 fingerprints for each shard at least
        sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, 16 << depth)).toArrow().column("fp").to_numpy()
        nodes = build_top(sample.view(np.uint64), depth)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy()
            for shard, at, home in route(points.view(np.uint64), nodes, radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), shard, np.int32)), pa.array(points[at]), pa.array(home)], ["shard", "fp", "home"])

    def search(held: pa.Table) -> pa.Table:
        order = np.argsort(held.column("fp").to_numpy(), kind="stable")
        points = held.column("fp").to_numpy()[order].view(np.uint64)
        home, asks = (held.column(c).to_numpy(zero_copy_only=False)[order] for c in ("home", "asks"))
        a, b = shard_forest(points, home, radius, asks)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = written(distinct.select("fp").mapInArrow(visit, "shard int, fp long, home boolean"), "simhash-visits")
    blocks = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PER_BLOCK).cast("int").alias("blocks"))
    spread = placed.join(F.broadcast(blocks), "shard").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))  # a row for each shard
    everywhere = F.when(F.col("home"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    dealt = spread.withColumn("block", F.explode(everywhere)).select("shard", "block", "fp", "home", (F.col("block") == F.col("own")).alias("asks"))
    found = written(dealt.groupBy("shard", "block").applyInArrow(search, "a long, b long"), "simhash-links")
    discard(placed)
    return found


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and the smallest node of its component, for nodes that are not the smallest.

    Alternating large and small stars: each step is a map-side combined minimum per node
    and an equi-join, written out, until the edges no longer change.
    """
    stars = written(
        pairs.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low")).distinct(), "simhash-edges")
    before = None
    while True:
        both = stars.union(stars.select(F.col("low").alias("node"), F.col("node").alias("low")))
        least = both.groupBy("node").agg(F.least("node", F.min("low")).alias("least"))
        large = both.join(least, "node").filter("low > node").select(F.col("low").alias("node"), F.col("least").alias("low"))
        large = large.filter("node <> low").distinct()
        least = large.groupBy("node").agg(F.min("low").alias("least"))
        joined = large.join(least, "node")
        small = joined.filter("low <> least").select(F.col("low").alias("node"), F.col("least").alias("low"))
        last, stars = stars, written(small.union(least.select("node", F.col("least").alias("low"))).distinct(), "simhash-edges")
        discard(last)
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first())
        if now == before:
            return stars.select("node", F.col("low").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (smallest id reachable over links) of every document."""
    prints = written(fingerprints(docs, text, key, shingle), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct, radius))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = placed.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")
