"""Secrets in texts: fixed patterns, and a character convolutional network over every candidate.

Candidates are runs of the characters keys are made of, ``LONG`` or more of them, or ``SHORT`` or more with
letters and digits among them. The network reads a candidate with what stands before and
behind it: character embeddings, one convolution, its largest and mean answers, a small dense layer. It is
trained on all labelled findings: by default those that the patterns
label (a candidate inside a match is a secret, any other isn't), or rows of the caller's own. Findings are dealt by hash to parts of some ``PART``; in
each round every part trains the network once over its own findings, and the weights of all parts are averaged. Each is shown
as it stands and in capitals, secrets also in letters and digits drawn at random, each in its surroundings,
in those of an ordinary candidate and in none, so that the look of a value counts as much as the word before it. A fourth of the findings, told by their content, is kept from training: a logistic curve fitted to it makes
scores probabilities, and the thresholds, one for each shape of value, find ``RECALL`` of its secrets
with the best precision, and are not below ``LEAST_SCORE``; curve and thresholds come from sums and ranks over all of that fourth.

One scan finds the labelled findings, a second applies patterns and network to whole texts; only the network, sums and
at most ``STATES`` averaged networks a round pass through the driver.

Defined results: a null text is empty; texts of any length are read whole, a long candidate by stretches whose mean counts;
repeated rows and ids come back one by one; where the findings don't hold both labels there is no network and the
patterns alone decide; a candidate that a match covers in part isn't reported again; equal starts are ordered by kind;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from memlake.llm.common import pieces, prefix, text_bytes, written
from memlake.plans.fold import numbered

KINDS = ("assign", "access", "hex", "learned")
LEARNED = 3
LONG, SHORT = 16, 8
BEFORE, BODY, AFTER = 24, 40, 12
WIDTH = BEFORE + BODY + AFTER
#: Findings that a task trains on, about; networks that the driver averages, the rest is averaged before.
PART = 4096
STATES = 64
BATCH = 128
RECALL = 0.98
LEAST_SCORE = 0.8
#: Calibration secrets of one shape that a threshold of its own needs.
LEAST_FINDINGS = 20
EMBEDDING, KERNEL, FILTERS, HIDDEN = 8, 5, 24, 16
#: Rounds over the findings, more of them where they would make fewer steps than that.
ROUNDS, LEAST_STEPS = 8, 500
#: Windows the network reads at once: what it holds of them stays in a core's cache.
WINDOWS = 32

_NAMES = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES < 58)
_LETTER = (_BYTES >= 65) & (_BYTES < 91) | (_BYTES >= 97) & (_BYTES < 123)
_HEX = _DIGIT | (_BYTES >= 97) & (_BYTES < 103)
_ANY_HEX = _HEX | (_BYTES >= 65) & (_BYTES < 71)
_VALUE = _DIGIT | _LETTER | np.isin(_BYTES, list(b"+/_.=-"))
#: Printable characters have numbers of their own, 96 is any other; beyond the ends of a text stand spaces.
_CODE = np.where((_BYTES >= 32) & (_BYTES < 127), _BYTES - 31, 96).astype(np.uint8)
_CODE[[9, 10, 13]] = _CODE[32]
_UPPER = np.arange(97, dtype=np.uint8)
_UPPER[97 - 31 : 123 - 31] -= 32
_SPACE = int(_CODE[32])
_LETTERS = _CODE[_DIGIT | _LETTER]


def _runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of ``mask``; none goes on over a byte where ``first`` is set."""
    before = np.r_[False, mask[:-1]]
    behind = np.r_[mask[1:], False] & ~np.r_[first[1:], True]
    return np.flatnonzero(mask & (first | ~before)), np.flatnonzero(mask & ~behind) + 1


def _texts_with(words: list[bytes], raw: bytes, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Where the texts lie that hold one of the words."""
    rows = set()
    for word in words:
        at = raw.find(word)
        while at >= 0:
            row = int(np.searchsorted(bounds, at, "right")) - 1
            rows.add(row)
            at = raw.find(word, int(bounds[row + 1]))
    return [(int(bounds[r]), int(bounds[r + 1])) for r in sorted(rows)]


@dataclass
class Found:
    """Spans in a piece of several texts, by byte: matches of the patterns and candidates."""

    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    candidate: np.ndarray  # starts
    stop: np.ndarray
    known: np.ndarray  # whether a match overlaps the candidate


def find(data: np.ndarray, bounds: np.ndarray) -> Found:
    first = np.zeros(len(data), bool)
    first[bounds[:-1][bounds[:-1] < len(data)]] = True
    raw = data.tobytes()
    rows: list[tuple[int, int, int]] = []
    for a, b in _texts_with(_NAMES, raw.lower(), bounds):
        rows += [(*m.span(), 0) for m in _ASSIGN.finditer(raw, a, b) if m.end(1) - m.start(1) >= 6]
    for a, b in _texts_with([b"AKIA"], raw, bounds):
        rows += [(*m.span(), 1) for m in _ACCESS.finditer(raw, a, b) if m.end() - m.start() >= 20]
    start, end = _runs(_HEX[data], first)
    enough = end - start >= 24
    held = np.array(rows, np.int64).reshape(-1, 3)
    held = np.r_[held, np.c_[start[enough], end[enough], np.full(int(enough.sum()), 2)]]
    held = held[np.lexsort((held[:, 2], held[:, 0]))]
    start, end = _runs(_VALUE[data], first)
    wide = end - start >= SHORT
    start, end = start[wide], end[wide]
    digits, letters = prefix(_DIGIT[data]), prefix(_LETTER[data])
    mixed = (digits[end] > digits[start]) & (letters[end] > letters[start])
    wide = mixed | (end - start >= LONG)
    start, end = start[wide], end[wide]
    # of the matches that start before a candidate ends, the one that reaches furthest
    reach = np.maximum.accumulate(np.r_[0, held[:, 1]])
    known = reach[np.searchsorted(held[:, 0], end, "left")] > start
    return Found(held[:, 0], held[:, 1], held[:, 2], start, end, known)


def windows(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray, all_of: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Character numbers around each stretch of ``BODY`` bytes of each candidate, its part in them, and whose it is."""
    n = -(-(end - start) // BODY) if all_of else np.ones(len(start), np.int64)
    of = np.repeat(np.arange(len(start)), n)
    at = start[of] + BODY * (np.arange(len(of)) - prefix(n)[:-1][of])
    place = at[:, None] - BEFORE + np.arange(WIDTH)
    row = np.searchsorted(bounds, start, "right") - 1
    inside = (place >= bounds[row][of][:, None]) & (place < bounds[row + 1][of][:, None])
    codes = np.where(inside, _CODE[data[np.clip(place, 0, max(0, len(data) - 1))]], _SPACE).astype(np.uint8)
    low, high = np.maximum(start[of] - at + BEFORE, 0), np.minimum(end[of] - at + BEFORE, WIDTH)
    return codes, low, high, of


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """0: digits and letters to F only; 1: letters and digits; 2: any other value."""
    counts = [prefix(m[data]) for m in (_ANY_HEX, _DIGIT, _LETTER)]
    hexes, digits, letters = (c[end] - c[start] for c in counts)
    return np.where(hexes == end - start, 0, np.where((digits > 0) & (letters > 0), 1, 2)).astype(np.int32)


@dataclass
class Network:
    """Convolutional network over windows, the curve of its scores, and a threshold for each shape."""

    weights: dict[str, np.ndarray]
    curve: tuple[float, float] = (1.0, 0.0)
    thresholds: list[float] = field(default_factory=lambda: [LEAST_SCORE] * 3)
    #: Moments of the slopes and steps made, while it is trained.
    mean: dict[str, np.ndarray] = field(default_factory=dict)
    square: dict[str, np.ndarray] = field(default_factory=dict)
    step: int = 0

    @classmethod
    def fresh(cls, seed: int = 0) -> "Network":
        rng = np.random.default_rng(seed)
        shape = {
            "letters": (97, EMBEDDING), "conv": (KERNEL * (EMBEDDING + 1), FILTERS), "conv0": (FILTERS,),
            "dense": (2 * FILTERS, HIDDEN), "dense0": (HIDDEN,), "out": (HIDDEN, 1), "out0": (1,),
        }
        return cls({k: (rng.normal(size=s) * (0.3 if k == "letters" else (2 / s[0]) ** 0.5) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shape.items()})

    def _answers(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the convolution sees at each place, and what it answers."""
        w, at = self.weights, np.arange(codes.shape[1])
        x = np.empty((*codes.shape, EMBEDDING + 1), w["letters"].dtype)
        x[:, :, :EMBEDDING] = w["letters"].take(codes, axis=0)
        x[:, :, EMBEDDING] = (at >= low[:, None]) & (at < high[:, None])
        columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2)).reshape(-1, KERNEL * (EMBEDDING + 1))
        answer = columns @ w["conv"]
        answer += w["conv0"]
        return columns, np.maximum(answer, 0, out=answer).reshape(len(x), -1, FILTERS)

    def _above(self, largest: np.ndarray, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled answers, the dense layer's and the score."""
        w, share = self.weights, np.full((1, answer.shape[1]), 1 / answer.shape[1], answer.dtype)
        pooled = np.concatenate([largest, (share @ answer)[:, 0]], axis=1)
        hidden = np.maximum(pooled @ w["dense"] + w["dense0"], 0)
        return pooled, hidden, (hidden @ w["out"] + w["out0"])[:, 0]

    def forward(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, tuple]:
        columns, answer = self._answers(codes, low, high)
        best = answer.argmax(axis=1)
        pooled, hidden, score = self._above(np.take_along_axis(answer, best[:, None], 1)[:, 0], answer)
        return score, (columns, answer, best, pooled, hidden)

    def slopes(self, codes: np.ndarray, held: tuple, error: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of the loss, of which ``error`` is that by the score of each window."""
        columns, answer, best, pooled, hidden = held
        w, n = self.weights, answer.shape[1]
        d_hidden = error[:, None] * w["out"][:, 0] * (hidden > 0)
        d_pooled = d_hidden @ w["dense"].T
        d_answer = np.repeat(d_pooled[:, None, FILTERS:] / n, n, axis=1)
        rows, filters = np.arange(len(best))[:, None], np.arange(FILTERS)
        d_answer[rows, best, filters] += d_pooled[:, :FILTERS]
        d_answer *= answer > 0
        d_answer = d_answer.reshape(-1, FILTERS)
        d_x = np.zeros((len(codes), codes.shape[1] * EMBEDDING), d_answer.dtype)
        for k, own in enumerate(w["conv"].reshape(KERNEL, EMBEDDING + 1, FILTERS)):
            d_x[:, k * EMBEDDING : (k + n) * EMBEDDING] += (d_answer @ own[:EMBEDDING].T).reshape(len(codes), -1)
        d_x, letter = d_x.reshape(-1, EMBEDDING), codes.ravel()
        return {
            "letters": np.stack([np.bincount(letter, d_x[:, i], 97) for i in range(EMBEDDING)], axis=1).astype(d_x.dtype), "conv": columns.T @ d_answer, "conv0": np.ones(len(d_answer), d_answer.dtype) @ d_answer,
            "dense": pooled.T @ d_hidden, "dense0": d_hidden.sum(axis=0), "out": hidden.T @ error[:, None], "out0": error.sum(keepdims=True),
        }

    def train(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray, label: np.ndarray, weigh: tuple[float, float], rounds: int, seed: int, rate: float = 3e-3) -> None:
        """Adam over shuffled batches, from the moments so far on; ``weigh`` has the weight of each label."""
        weight, rng = np.array(weigh)[label], np.random.default_rng(seed)
        for moment in (self.mean, self.square):
            moment.update({k: np.zeros_like(v) for k, v in self.weights.items() if k not in moment})
        for _ in range(rounds):
            order = rng.permutation(len(label))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                slopes: dict[str, np.ndarray] = {}
                for j in range(0, len(some), WINDOWS):
                    part = some[j : j + WINDOWS]
                    score, held = self.forward(codes[part], low[part], high[part])
                    error = (weight[part] * (1 / (1 + np.exp(-score)) - label[part]) / len(some)).astype(np.float32)
                    slopes = {k: g + slopes.get(k, 0) for k, g in self.slopes(codes[part], held, error).items()}
                self.step += 1
                for k, g in slopes.items():
                    self.mean[k] += 0.1 * (g - self.mean[k])
                    self.square[k] += 0.001 * (g * g - self.square[k])
                    self.weights[k] -= rate * (self.mean[k] / (1 - 0.9**self.step)) / (np.sqrt(self.square[k] / (1 - 0.999**self.step)) + 1e-8)

    def state(self) -> np.ndarray:
        """Weights, moments and steps in a row, for averaging."""
        return np.concatenate([part[k].ravel() for part in (self.weights, self.mean, self.square) for k in self.weights] + [[self.step]]).astype(np.float64)

    def set_state(self, state: np.ndarray) -> None:
        at, shapes_ = 0, {k: w.shape for k, w in self.weights.items()}
        for part in (self.weights, self.mean, self.square):
            for k, shape in shapes_.items():
                n = int(np.prod(shape))
                part[k], at = state[at : at + n].reshape(shape).astype(np.float32), at + n
        self.step = int(round(state[at]))

    def scores(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(codes), WINDOWS):
            _, answer = self._answers(codes[i : i + WINDOWS], low[i : i + WINDOWS], high[i : i + WINDOWS])
            parts.append(self._above(answer.max(axis=1), answer)[-1])
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * score + self.curve[1], -50, 50)))

    def _set_curve(self, n: tuple[int, int], sums: Callable[[np.ndarray, tuple[float, float]], np.ndarray]) -> None:
        """Newton steps, with targets a little inside 0 and 1; ``sums`` gives those of the bend (3) and of the slope (2)."""
        target, theta = (1 / (n[0] + 2), (n[1] + 1) / (n[1] + 2)), np.array([1.0, 0.0])
        for _ in range(50):
            ss, s1, one, slope_s, slope = sums(theta, target)
            step = np.linalg.solve(np.array([[ss, s1], [s1, one]]) + 1e-3 * np.eye(2), np.array([slope_s, slope]) + 1e-3 * (theta - [1.0, 0.0]))
            step *= min(1.0, 1 / max(1e-9, np.abs(step).max()))
            theta -= step
            if np.abs(step).max() < 1e-9:
                break
        self.curve = float(theta[0]), float(theta[1])

    def _bar(self, top: float, other: float | None) -> float:
        return max(LEAST_SCORE, float(self.probability(top if other is None else (top + other) / 2)))

    def calibrate(self, score: np.ndarray, label: np.ndarray, shape: np.ndarray, recall: float = RECALL) -> None:
        """Curve, and thresholds that keep ``recall`` with the best precision.

        All thresholds between the score that ``recall`` asks for and that of the first finding below it which is no secret are as good;
        the middle of them is taken.
        """
        def sums(theta: np.ndarray, target: tuple[float, float]) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(theta[0] * score + theta[1], -50, 50)))
            w, e = p * (1 - p), p - np.array(target)[label]
            return np.array([(w * score * score).sum(), (w * score).sum(), w.sum(), (e * score).sum(), e.sum()])

        self._set_curve(((label == 0).sum(), (label == 1).sum()), sums)

        def bar(mine: np.ndarray) -> float:
            held = np.sort(score[mine])
            if not len(held):
                return LEAST_SCORE
            top = held[int((1 - recall) * len(held))]
            other = score[(label == 0) & (score < top)]
            return self._bar(top, other.max() if len(other) else None)

        secret = label == 1
        self.thresholds = [bar(secret & (shape == k) if (secret & (shape == k)).sum() >= LEAST_FINDINGS else secret) for k in range(3)]

    def calibrate_on(self, scored: DataFrame, recall: float = RECALL) -> None:
        """``calibrate`` for a table of any size: ``score``, ``label``, ``shape``."""
        counts = {(r["label"], r["shape"]): r["count"] for r in scored.groupBy("label", "shape").count().collect()}
        total = [sum(c for (v, _), c in counts.items() if v == of) for of in (0, 1)]
        s = F.col("score")

        def sums(theta: np.ndarray, target: tuple[float, float]) -> np.ndarray:
            z = F.least(F.greatest(s * float(theta[0]) + float(theta[1]), F.lit(-50.0)), F.lit(50.0))
            p = 1 / (1 + F.exp(-z))
            w, e = p * (1 - p), p - F.when(F.col("label") == 1, float(target[1])).otherwise(float(target[0]))
            return np.array(scored.agg(*[F.sum(c) for c in (w * s * s, w * s, w, e * s, e)]).first(), float)

        self._set_curve((total[0], total[1]), sums)
        secrets = scored.filter("label = 1")
        large = [k for k in range(3) if counts.get((1, k), 0) >= LEAST_FINDINGS]
        pools = secrets.filter(F.col("shape").isin(large)).select("shape", "score")
        if len(large) < 3:
            pools = pools.unionByName(secrets.select(F.lit(-1).alias("shape"), "score"))  # all secrets, for shapes with few
        place = {k: int((1 - recall) * (total[1] if k < 0 else counts[1, k])) + 1 for k in (-1, *large)}
        asked = F.coalesce(*[F.when((F.col("shape") == k) & (F.col("_n") == n), True) for k, n in place.items()], F.lit(False))
        tops = {r["shape"]: r["score"] for r in numbered(pools, ["shape"], ["score"], "_n").filter(asked).collect()}
        others = scored.agg(*[F.max(F.when((F.col("label") == 0) & (s < top), s)).alias(str(k)) for k, top in tops.items()]).first() if tops else {}
        bars = {k: self._bar(top, others[str(k)]) for k, top in tops.items()}
        self.thresholds = [bars.get(k, bars.get(-1, LEAST_SCORE)) for k in range(3)]


def findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every different candidate of the texts, labelled by the patterns: ``codes``, ``low``, ``high``, ``shape``, ``label``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            for i, j in pieces(bounds):
                part, cut = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                found = find(part, cut)
                codes, low, high, _ = windows(part, cut, found.candidate, found.stop, all_of=False)
                yield pa.RecordBatch.from_arrays([
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                    pa.array(shapes(part, found.candidate, found.stop)), pa.array(found.known.astype(np.int32)),
                ], ["codes", "low", "high", "shape", "label"])

    held = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "codes binary, low int, high int, shape int, label int")
    return held.groupBy("codes", "low", "high", "shape").agg(F.max("label").alias("label"))


def _views(part: pa.Table, seed: int) -> tuple[np.ndarray, ...]:
    """Each finding of a part in all its views: codes, low, high, label, shape."""
    part = part.sort_by([(c, "ascending") for c in ("codes", "low", "high", "shape")])
    label, shape, low, high = (part.column(c).to_numpy() for c in ("label", "shape", "low", "high"))
    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(-1, WIDTH)
    own = (np.arange(WIDTH) >= low[:, None]) & (np.arange(WIDTH) < high[:, None])
    secret, rng, every = label == 1, np.random.default_rng(seed), np.ones(len(label), bool)
    drawn = _LETTERS[rng.integers(0, len(_LETTERS), codes.shape)]
    elsewhere = codes[rng.choice(np.flatnonzero(~secret), len(codes))] if not secret.all() else np.full_like(codes, _SPACE)
    views = [(np.where(own, value, around).astype(np.uint8), some) for value, some in ((codes, every), (_UPPER[codes], every), (drawn, secret)) for around in (codes, elsewhere, _SPACE)]
    of = np.concatenate([np.flatnonzero(some) for _, some in views])
    return np.concatenate([c[some] for c, some in views]), low[of], high[of], label[of], shape[of]


def _dealt(known: DataFrame, rows: int) -> DataFrame:
    """Findings in parts of some ``PART`` by hash."""
    return known.withColumn("_part", F.pmod(F.xxhash64("codes", F.lit(11)), F.lit(max(1, -(-rows // PART)))).cast("int")).groupBy("_part")


def _trained(network: Network, parts: GroupedData, weigh: tuple[float, float], rounds: int, seed: int) -> np.ndarray:
    """Average of the states to which the parts train the network."""
    def run(part: pa.Table) -> pa.Table:
        own, at = copy.deepcopy(network), part.column("_part")[0].as_py()
        codes, low, high, label, _ = _views(part, at)
        own.train(codes, low, high, label, weigh, rounds, seed + at)
        return pa.table({"_part": pa.array([at], pa.int32()), "n": pa.array([len(label)], pa.int64()), "state": [own.state().tobytes()]})

    def average(some: pa.Table) -> pa.Table:
        some = some.sort_by("_part")
        n = some.column("n").to_numpy()
        state = sum(np.frombuffer(b, np.float64) * k for b, k in zip(some.column("state").to_pylist(), n)) / n.sum()
        return pa.table({"_part": some.column("_part")[:1], "n": pa.array([n.sum()], pa.int64()), "state": [state.tobytes()]})

    schema = "_part int, n long, state binary"
    states = parts.applyInArrow(run, schema).groupBy(F.pmod("_part", F.lit(STATES))).applyInArrow(average, schema).toArrow()
    return np.frombuffer(average(states).column("state")[0].as_py(), np.float64)


def fit(labelled: DataFrame) -> Network | None:
    """Network trained on all labelled findings, or None if one of the labels has none to train on."""
    known = written(labelled, "secret-findings").withColumn("held", F.pmod(F.xxhash64("codes", F.lit(7)), F.lit(4)) == 0)
    n = {(r["label"], r["held"]): r["count"] for r in known.groupBy("label", "held").count().collect()}
    own = [n.get((v, False), 0) for v in (0, 1)]
    if not all(own):
        return None
    shown = 6 * own[0], 9 * own[1]  # each finding in six views, a secret in nine
    weigh = tuple(0.5 * sum(shown) / k for k in shown)
    parts = -(-sum(own) // PART)
    rounds, network = max(ROUNDS, -(-LEAST_STEPS * BATCH * parts // sum(shown))), Network.fresh()
    learnt = _dealt(known.filter("not held").drop("held"), sum(own))
    at_once = rounds if parts == 1 else 1  # a single part needs no averaging between rounds
    for i in range(0, rounds, at_once):
        network.set_state(_trained(network, learnt, weigh, at_once, i * 1_000_003 + 1))
    network.mean, network.square = {}, {}
    apart = known.filter("held") if all(n.get((v, True), 0) for v in (0, 1)) else known  # too few to keep some apart

    def score(part: pa.Table) -> pa.Table:
        codes, low, high, label, shape = _views(part, part.column("_part")[0].as_py())
        return pa.table({"score": pa.array(network.scores(codes, low, high).astype(np.float64)), "label": pa.array(label.astype(np.int32)), "shape": pa.array(shape.astype(np.int32))})

    network.calibrate_on(written(_dealt(apart.drop("held"), sum(n.values())).applyInArrow(score, "score double, label int, shape int"), "secret-scores"))
    return network


def scan(docs: DataFrame, network: Network | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``spans``: kind, start, end (code points, end exclusive) and, where learned, probability."""
    wanted = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    spans = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    names = np.array(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for i, j in pieces(bounds):
                part, cut = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                found = find(part, cut)
                start, end, kinds, score = found.start, found.end, found.kind, np.full(len(found.start), np.nan)
                open_ = ~found.known
                if network is not None and open_.any():
                    a, b = found.candidate[open_], found.stop[open_]
                    codes, low, high, of = windows(part, cut, a, b)
                    own = np.bincount(of, network.scores(codes, low, high), len(a)) / np.bincount(of, minlength=len(a))
                    p = network.probability(own)
                    secret = p >= np.array(network.thresholds)[shapes(part, a, b)]
                    start, end = np.r_[start, a[secret]], np.r_[end, b[secret]]
                    kinds, score = np.r_[kinds, np.full(int(secret.sum()), LEARNED)], np.r_[score, p[secret]]
                order = np.lexsort((kinds, start))
                start, end, kinds, score = start[order], end[order], kinds[order], score[order]
                row = np.searchsorted(cut, start, "right") - 1
                points = prefix((part & 0xC0) != 0x80)
                base = points[cut[row]]
                held = pa.StructArray.from_arrays([
                    pa.array(names[kinds]), pa.array(points[start] - base), pa.array(points[end] - base), pa.array(score, from_pandas=True)], fields=list(spans))
                sizes = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(sizes), held)], ["doc_id", "spans"])

    return wanted.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the patterns' matches, the SHA-256 of their list, and the list of all spans."""
    base = F.filter("spans", lambda s: s["kind"] != KINDS[LEARNED])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:LEARNED]], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), count(KINDS[LEARNED]).alias("n_learned"))
