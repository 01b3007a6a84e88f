"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of the labelled rows, ``PER_LABEL`` of each label in hash
order, near copies included. Terms are all words of the examples, whichever label they lean
to; inverse document frequency is multiplied by how far a word leans (absolute log-odds of
the labels), so whole texts are compared and what tells labels apart counts most. Postings
lie in blocks of ``BLOCK`` examples with the largest weight of each term and block; the ``FREQUENT`` terms that most examples
have are a matrix. A batch of texts is multiplied with the matrix first. The k-th best of these partial scores is a bar: a block
is left out where its best partial score and the largest weights of the other terms together stay below it, so the k nearest are exact. Neighbours vote with their squared similarity against a prior vote, and a
logistic curve fitted to leave-one-out votes of the examples, weighted to the share of
labels in all labelled rows, makes the vote a probability.

Defined results: null and empty texts, and texts without a word of any example, have no
neighbour and get the calibrated prior; without examples of both labels every score is 0; a
document with conflicting labels is no example; of a labelled id with several texts, the one
with the smallest hash is the example; repeated rows are scored one by one; texts of any length are compared whole; of examples
equally near the first in index order counts; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import held_out, written

PER_LABEL = 3000
NEIGHBOURS = 15
BLOCK = 512
#: Terms most examples have; their weights are kept as one matrix.
FREQUENT = 256
#: Texts that are searched for at once.
TEXTS = 64
PRIOR_VOTE = 0.5
REJECT = 0.7

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Index:
    """Block-max inverted index of the examples, and the curve from votes to probabilities."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray  # of the examples, in index order
    label: np.ndarray
    cells: np.ndarray  # term -> its first cell; one entry more than terms. A cell is a term in a block that has it
    block: np.ndarray  # of a cell
    largest: np.ndarray  # of a cell
    pointer: np.ndarray  # cell -> its first posting; one entry more than cells
    place: np.ndarray  # of a posting: the example
    weight: np.ndarray
    column: np.ndarray  # of a frequent term in ``dense``, else -1
    dense: np.ndarray  # weights of the frequent terms in all examples
    prior: float
    curve: tuple[float, float]

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the index that a text has, and their weights, to length one."""
        at = np.fromiter(map(self.terms.get, counts, repeat(-1)), np.int64, len(counts))
        n = np.fromiter(counts.values(), float, len(counts))
        return self.weighted(at[at >= 0], n[at >= 0])

    def weighted(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.idf[at]
        return at, w / (np.sqrt((w * w).sum()) or 1.0)

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, leave: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest cosine above zero, as (score, position); ties to the lower position."""
        return self.nearest_all([(at, w)], k, [leave])[0]

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, leave: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """The same for several vectors. What frequent terms add is one product for all examples; of the rest, blocks that can't reach the bar are left out."""
        dense = np.zeros((len(vectors), len(self.dense)))
        for row, (at, w) in zip(dense, vectors):
            column = self.column[at]
            row[column[column >= 0]] = w[column >= 0]
        return [self._search(at, w, score, k, -1 if leave is None else leave[i]) for i, ((at, w), score) in enumerate(zip(vectors, dense @ self.dense))]

    def _search(self, at: np.ndarray, w: np.ndarray, score: np.ndarray, k: int, leave: int) -> list[tuple[float, int]]:
        n = len(self.ids)
        # frequent terms have no cells
        cell, q = _spread(self.cells[at], self.cells[at + 1], w)
        block = self.block[cell]
        most = np.zeros(-(-n // BLOCK) * BLOCK)
        most[:n] = score
        most = most.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, q * self.largest[cell], minlength=-(-n // BLOCK))
        if leave >= 0:
            score[leave] = 0
        # what the frequent terms alone give the k-th best is a bar for all
        bar = np.partition(score, n - k)[n - k] if n > k else 0.0
        mine = np.flatnonzero((most >= bar - 1e-9)[block])
        posting, x = _spread(self.pointer[cell[mine]], self.pointer[cell[mine] + 1], q[mine])
        if len(posting):
            score += np.bincount(self.place[posting], x * self.weight[posting], minlength=n)
        if leave >= 0:
            score[leave] = 0
        bar = np.partition(score, n - k)[n - k] - 1e-9 if n > k else 0.0
        found = np.flatnonzero((score >= bar) & (score > 0))
        return sorted(zip(score[found].tolist(), found.tolist()), key=lambda x: (-round(x[0], 12), x[1]))[:k]

    def near(self, texts: list[str | None]) -> list[list[tuple[float, int]]]:
        """The nearest examples of each text."""
        vectors = [self.vector(Counter(words(text or ""))) for text in texts]
        return self.nearest_all(vectors, NEIGHBOURS)

    def vote(self, near: list[tuple[float, int]]) -> float:
        weights = [s * s for s, _ in near]
        return (sum(x * self.label[i] for x, (_, i) in zip(weights, near)) + PRIOR_VOTE * self.prior) / (sum(weights) + PRIOR_VOTE)

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.curve[0] * vote + self.curve[1]))))


def _spread(start: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, one range after the other, and the value of each one's range."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(value, n)


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``toxic`` of the rows a model may learn from, one for each document."""
    clear = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    return clear.filter((F.col("toxic") == F.col("_most")) & ~held_out()).select("doc_id", "toxic")


def _examples(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Term counts of the sample's documents, one text for each id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words(text or "")) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array([list(n) for n in found], pa.list_(pa.string())), pa.array([list(n.values()) for n in found], pa.list_(pa.int64()))],
                ["doc_id", "toxic", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # the sample has a bounded number of ids
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return found.mapInArrow(run, f"doc_id {kind}, toxic int, terms array<string>, counts array<long>")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Index | None:
    """Index over the labelled documents, or None if one of the labels has no example."""
    known = written(training_labels(labels), "toxicity-labels")
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # one sorted limit for each label: every task hands on per_label rows at most
    first = [known.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    examples = written(_examples(docs, first[0].union(first[1])), "toxicity-examples").toArrow().sort_by("doc_id")
    label = examples.column("toxic").to_pylist()
    if len(set(label)) < 2:
        return None
    ids, texts = examples.column("doc_id").to_pylist(), examples.column("terms").combine_chunks()
    counts = examples.column("counts").combine_chunks().flatten().to_numpy().astype(float)
    # terms become numbers outside Python, whose objects for all words of all examples would fill the driver
    ends = np.cumsum(texts.value_lengths().to_numpy())[:-1]
    coded = texts.flatten().dictionary_encode()
    del examples, texts
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    number = {t: i for i, t in enumerate(coded.dictionary.take(pa.array(order)).to_pylist())}
    held = list(zip(np.split(rank[coded.indices.to_numpy()], ends), np.split(counts, ends)))
    del coded, counts
    pa.default_memory_pool().release_unused()
    return _indexed(number, weigh(len(number), label, held), ids, label, held, shares)


Held = tuple[np.ndarray, np.ndarray]  #: numbers of a text's terms, and how often it has them


def weigh(terms: int, label: list[int], held: list[Held]) -> np.ndarray:
    """Weight of every term: inverse document frequency times absolute log-odds."""
    fine, bad = (sum((np.bincount(at, minlength=terms) for v, (at, _) in zip(label, held) if v == kind), np.zeros(terms)) for kind in (0, 1))
    n = [label.count(v) for v in (0, 1)]
    idf = np.log((1 + len(label)) / (1 + fine + bad)) + 1
    return idf * np.abs(np.log((bad + 0.5) / (n[1] + 1)) - np.log((fine + 0.5) / (n[0] + 1)))


def build(number: dict[str, int], idf: np.ndarray, rows: list[tuple], shares: dict[int, int]) -> Index:
    """Index of rows of id, label and term counts."""
    held = [(np.array([number[t] for t in counts], np.int64), np.array(list(counts.values()), float)) for _, _, counts in rows]
    return _indexed(number, idf, [r[0] for r in rows], [r[1] for r in rows], held, shares)


def _indexed(number: dict[str, int], idf: np.ndarray, ids: list, label: list[int], held: list[Held], shares: dict[int, int]) -> Index:
    none = np.zeros(0)
    index = Index(number, idf, *[none] * 10, 0.0, (0.0, 0.0))
    vectors = [index.weighted(at, n) for at, n in held]
    # examples that lean on the same term lie in the same blocks, which keeps block bounds tight
    order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else len(number), i))
    vectors = [vectors[i] for i in order]
    index.ids, index.label = np.array([ids[i] for i in order]), np.array([label[i] for i in order], float)
    blocks = -(-len(ids) // BLOCK)
    term = np.concatenate([v[0] for v in vectors])
    example = np.repeat(np.arange(len(ids)), [len(v[0]) for v in vectors])
    weight = np.concatenate([v[1] for v in vectors])
    top = np.argsort(-np.bincount(term, minlength=len(number)), kind="stable")[:FREQUENT]
    index.column = np.full(len(number), -1, np.int32)
    index.column[top] = np.arange(len(top))
    column = index.column[term]
    index.dense = np.zeros((len(top), len(ids)))
    index.dense[column[column >= 0], example[column >= 0]] = weight[column >= 0]
    term, example, weight = (x[column < 0] for x in (term, example, weight))
    at = np.lexsort((example, term))
    term, example, index.weight = term[at], example[at], weight[at]
    index.place = example.astype(np.int32)
    cell = term * blocks + example // BLOCK
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    index.pointer = np.r_[first, len(cell)]
    index.block = (cell[first] % blocks).astype(np.int32)
    index.largest = np.maximum.reduceat(index.weight, first) if len(cell) else none
    index.cells = np.searchsorted(term[first], np.arange(len(number) + 1))
    total = shares.get(0, 0) + shares.get(1, 0)
    index.prior = shares.get(1, 0) / total
    near = [x for i in range(0, len(ids), TEXTS) for x in index.nearest_all(vectors[i : i + TEXTS], NEIGHBOURS, list(range(i, min(i + TEXTS, len(ids)))))]
    votes = np.array([index.vote(x) for x in near])
    balance = np.where(index.label == 1, index.prior / index.label.sum(), (1 - index.prior) / (1 - index.label).sum()) * len(ids)
    index.curve = _logistic(votes, index.label, balance)
    return index


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Weighted logistic curve in one variable by Newton steps; a light ridge keeps separable data finite."""
    design = np.c_[x, np.ones_like(x)]
    theta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ theta))
        slope = design.T @ (weight * (p - y)) + ridge * theta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(bend, slope)
        theta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def score(docs: DataFrame, index: Index | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``score`` and ``evidence`` (nearest examples with similarity and label) of every document."""
    wanted = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    evidence = pa.list_(pa.struct([("example", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the words of 2 * PER_LABEL examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            scores, why = [0.0] * batch.num_rows, [[]] * batch.num_rows
            if index:
                found = [x for i in range(0, batch.num_rows, TEXTS) for x in index.near(batch.column("text").slice(i, TEXTS).to_pylist())]
                scores = [index.probability(index.vote(near)) for near in found]
                why = [[{"example": int(index.ids[i]), "similarity": s, "label": int(index.label[i])} for s, i in near[:3]] for near in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(why, evidence)], ["doc_id", "score", "evidence"])

    return wanted.mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<example:long,similarity:double,label:int>>")


def below(docs: DataFrame, index: Index | None, text: str = "text", bar: float = REJECT) -> DataFrame:
    """The rows, with all their columns, whose text scores below ``bar``."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the words of 2 * PER_LABEL examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if index is None:
                yield batch
                continue
            found = [x for i in range(0, batch.num_rows, TEXTS) for x in index.near(batch.column(at).slice(i, TEXTS).to_pylist())]
            yield batch.filter(pa.array([index.probability(index.vote(near)) < bar for near in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
