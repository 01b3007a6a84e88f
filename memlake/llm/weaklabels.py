"""Quality classifier from weak labels: heuristic labellers, their accuracies by
expectation-maximisation, and a hashed linear scorer trained on the posteriors.

Each labeller votes good, bad or not at all. Votes are combined under the model that
labellers err independently given the true label; the rates of each vote under each label
come from expectation-maximisation over the counts of all vote patterns of all documents
(at most 3 to the number of labellers). A logistic model on hashed byte 3-grams and hashed
levels of the measures learns the posteriors of ``TRAINED_ON`` documents in hash order, so
it also judges what no labeller has an opinion on.

Defined results: null and empty texts have no words, which is a bad vote; a table in which
all documents vote alike keeps the starting rates; repeated rows are judged one by one; texts of any length are
measured whole; a score of exactly 0.5 is kept; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import SPACE, per_row, pieces, prefix, range_hashes, text_bytes, written
from memlake.llm.grams import BUCKETS, gram_rows, logistic

TRAINED_ON = 3000
KEEP = 0.5

MEASURES = ("words", "word_length", "upper", "symbols", "shouts", "bars", "stutter", "variety", "dull_lines")
#: Labeller: measure, at most this is good, from this on is bad (None: never says so).
LABELLERS = (
    ("upper", None, 0.5), ("symbols", None, 0.3), ("shouts", None, 0.3), ("bars", None, 0.05), ("stutter", 0.05, 0.2), ("dull_lines", None, 0.5), ("word_length", None, 20.0),
)
#: The same for measures of which little is bad: from this on good, at most this is bad.
LOW_LABELLERS = (("words", None, 8.0), ("variety", 0.35, 0.1))
N = len(LABELLERS) + len(LOW_LABELLERS)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&<>@^~{}")] = True


def measures(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each text."""
    rows, n = len(bounds) - 1, len(data)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | edge[:-1])) if n else np.zeros(0, int)
    end = np.flatnonzero(word & (np.r_[~word[1:], True] | edge[1:])) + 1 if n else np.zeros(0, int)
    doc = np.searchsorted(bounds, start, "right") - 1
    words = np.bincount(doc, minlength=rows).astype(float)
    some = np.maximum(words, 1)
    total = lambda mask: per_row(prefix(mask), bounds).astype(float)
    hashed = range_hashes(data)
    h = hashed(start, end)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    apart = doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    _, first = np.unique(h ^ apart, return_index=True)
    newline = np.flatnonzero(data == 10)
    a, b = np.sort(np.r_[bounds[:-1], newline + 1]), np.sort(np.r_[bounds[1:], newline])
    held = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b = a[held], b[held]
    line = np.searchsorted(bounds, a, "right") - 1
    _, own = np.unique(hashed(a, b) ^ (line.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_index=True)
    lines = np.maximum(np.bincount(line, minlength=rows), 1)
    # a long text repeats its words more, so variety is scaled to what 100 words would show
    distinct = np.bincount(doc[first], minlength=rows) / some * np.sqrt(np.maximum(some, 100) / 100)
    return np.stack([
        words, total(word) / some, total(_UPPER[data]) / np.maximum(total(_LETTER[data]), 1), total(_SYMBOL[data]) / some, total(data == 33) / some, total(data == 124) / some,
        np.bincount(doc[same], minlength=rows) / some, np.minimum(distinct, 1.0), 1 - np.bincount(line[own], minlength=rows) / lines,
    ], axis=1)


def votes(m: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 no vote; a column for each labeller."""
    out = np.full((len(m), N), 2, np.int8)
    for k, (name, good, bad) in enumerate(LABELLERS):
        x = m[:, MEASURES.index(name)]
        if good is not None:
            out[x <= good, k] = 1
        out[x >= bad, k] = 0
    for k, (name, good, bad) in enumerate(LOW_LABELLERS, len(LABELLERS)):
        x = m[:, MEASURES.index(name)]
        if good is not None:
            out[x >= good, k] = 1
        out[x <= bad, k] = 0
    return out


#: Starting rates of a bad and a good vote among bad and among good documents: labellers are taken
#: to be better than chance, and to cry wolf rarely.
START = np.array([[0.5, 0.5], [0.005, 0.995]])
#: Weight of the starting rates, as a share of all documents.
TRUST = 0.2


def agree(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of good documents, and rates[label, labeller, vote], by expectation-maximisation.

    A labeller that does not vote says nothing. The starting rates stay as a prior, which keeps
    the labels from trading places and a labeller that is often alone from being argued away.
    """
    share = 0.8
    rates = np.repeat(START[:, None, :], N, axis=1)
    weight = TRUST * counts.sum()
    for _ in range(rounds):
        post = posterior(patterns, share, rates)
        for label, w in ((1, post * counts), (0, (1 - post) * counts)):
            for k in range(N):
                seen = np.bincount(patterns[:, k], w, minlength=3)[:2]
                rates[label, k] = (seen + weight * START[label]) / (seen.sum() + weight)
        new = float((post * counts).sum() + 8) / (counts.sum() + 10)
        if abs(new - share) < 1e-10:
            break
        share = new
    return share, rates


def posterior(patterns: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    """Probability of good for each row of votes."""
    logs = np.concatenate([np.log(rates), np.zeros((2, N, 1))], axis=2)
    ll = [np.log(p) + sum(logs[label, k, patterns[:, k]] for k in range(N)) for label, p in ((0, 1 - share), (1, share))]
    return 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -500, 500)))


def _levels(m: np.ndarray) -> np.ndarray:
    """Bucket of each measure's level, hashed into the space of the n-grams."""
    level = np.floor(4 * np.log2(1 + 16 * m)).astype(np.uint32)
    code = (level * np.uint32(len(MEASURES)) + np.arange(len(MEASURES), dtype=np.uint32)) * np.uint32(0x9E3779B1)
    return (code ^ np.uint32(0x5BD1E995)) >> np.uint32(20)


def _inputs(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, model inputs and measures, a block of rows at a time."""
    for first, last in pieces(bounds):
        m = measures(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        for i, j, x in gram_rows(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], (3,), lower=False):
            own = m[i:j]
            np.add.at(x, (np.arange(j - i)[:, None], _levels(own)), np.float32(0.4))
            yield first + i, first + j, x, own


def _votes_of(docs: DataFrame, text: str, key: str) -> DataFrame:
    wanted = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for i, j in pieces(bounds):
                v = votes(measures(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(["".join(map(str, r)) for r in v.tolist()], pa.string())], ["doc_id", "votes"])

    return wanted.mapInArrow(run, f"doc_id {kind}, votes string")


def classify(docs: DataFrame, text: str = "text", key: str = "doc_id", trained_on: int = TRAINED_ON) -> DataFrame:
    """``doc_id``, ``votes``, ``posterior`` (of the labellers), ``score`` and ``kept`` of every document."""
    spark = docs.sparkSession
    voted = written(_votes_of(docs, text, key), "quality-votes")
    found = voted.groupBy("votes").count().orderBy("votes").collect()  # 3 ** N rows at most
    patterns = np.array([[int(c) for c in r["votes"]] for r in found], np.int64).reshape(-1, N)
    share, rates = agree(patterns, np.array([r["count"] for r in found], float)) if found else (0.5, np.full((2, N, 2), 0.5))
    chosen = voted.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trained_on).select(F.col("doc_id").alias(key))
    held = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen.select(F.col(key).alias("_id"))), "_id")  # trained_on ids at most
    # one row for each chosen id and text, trained_on at most
    own = held.groupBy("_id", F.xxhash64("text").alias("_h")).agg(F.min("text").alias("text"))
    sample = own.orderBy(F.xxhash64("_id"), "_id", "_h").limit(trained_on).select("text")

    def learn_from(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for _, _, x, m in _inputs(data, bounds):
                yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), pa.array(posterior(votes(m).astype(np.int64), share, rates))], ["x", "y"])

    rows = sample.mapInArrow(learn_from, "x binary, y double").toArrow().sort_by([("x", "ascending"), ("y", "ascending")])
    weights = np.zeros(BUCKETS + 1, np.float32)
    if rows.num_rows:
        x = np.stack([np.frombuffer(r, np.float16) for r in rows.column("x").to_pylist()]).astype(np.float32)
        weights = logistic(x, rows.column("y").to_numpy())
    shared = spark.sparkContext.broadcast((share, rates, weights))  # of fixed size
    wanted = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, rates, weights = shared.value
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            for i, j, x, m in _inputs(data, bounds):
                v = votes(m)
                p = 1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1]).astype(float)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i), pa.array(["".join(map(str, r)) for r in v.tolist()], pa.string()),
                    pa.array(posterior(v.astype(np.int64), share, rates)), pa.array(p), pa.array(p >= KEEP),
                ], ["doc_id", "votes", "posterior", "score", "kept"])

    return wanted.mapInArrow(run, f"doc_id {kind}, votes string, posterior double, score double, kept boolean")
