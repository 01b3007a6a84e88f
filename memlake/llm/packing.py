"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents become token ids and are cut: whole windows of ``CAPACITY`` ids first, then
what is left in cuts of at most ``CUT`` ids. Whole windows are sequences of their own.
The other cuts go to shards by a hash; each shard deals its cuts to windows: the two
partial partitions with the largest imbalance merge, the largest sums of one onto the
smallest of the other, until one is left. The window count begins at what the ids need
and rises by one whenever a window would exceed its capacity.

Defined results: a null or empty text is the end id alone; repeated rows and ids are
packed one by one and spread over the shards by a number of their own; texts of any length are
encoded whole, a piece of text at a time; among equal lengths the order is by id, start and content; an empty
table gives an empty result; further columns of the input are ignored. A shard has some
``WINDOWS`` windows whatever the size of the corpus.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import discard, pieces, prefix, text_bytes, written

CAPACITY = 4096
CUT = 512
WINDOWS = 64
END_ID = 2
#: Words, and pieces of words, whose ids a worker remembers.
REMEMBERED = 400_000
#: How the tokenizer's own file splits lower-cased text before it merges (fixed values).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
#: Words without these characters are composed and lower-cased one character at a time.
_ODD = regex.compile(r"[^\x21-\x7e\u00c0-\u00ff\n]|<\|")


#: The letter a byte-level model has for each byte: its own where that is printed, else the next from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class _Encoder:
    """A tokenizer that remembers words, one for each worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        held = {w: w.decode() for w in words}
        if _ODD.search("\n".join(held.values())):
            for w in [w for w, text in held.items() if _ODD.search(text)]:
                self.words[w] = np.array(self.tokenizer.encode(held.pop(w), add_special_tokens=False).ids, "<u4").tobytes()
        if not held:
            return
        # all words at once, each on a line of its own
        parts = _PIECES.findall("\n".join(held.values()).lower())
        tokenize = self.tokenizer.model.tokenize  # pieces are units to the model; all that comes before it has been done here
        for piece in set(parts).difference(self.pieces, "\n"):
            ids = [t.id for t in tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS))]
            self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        ids = list(map(self.pieces.get, parts))
        ends = [i for i, piece in enumerate(parts) if piece == "\n"] + [len(parts)]
        for w, a, b in zip(held, [0, *(i + 1 for i in ends)], ends):
            self.words[w] = ids[a] if b - a == 1 else b"".join(ids[a:b])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        The tokenizer drops white space before it merges anything, so a text's ids are those of
        its runs between ASCII white space, one after the other.
        """
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        split = [t.split() for t in texts]
        ids = list(map(self.words.get, chain.from_iterable(split)))
        if None in ids:
            self.learn({w for w, held in zip(chain.from_iterable(split), ids) if held is None})
            ids = list(map(self.words.__getitem__, chain.from_iterable(split)))
        ends = list(accumulate(map(len, split)))
        return [b"".join(ids[i:j]) for i, j in zip([0, *ends], ends)]


_ENCODERS: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def cuts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, cut: int = CUT) -> DataFrame:
    """The pieces of every document: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``."""
    wanted = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = wanted.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            for i, j in pieces(bounds):
                raw = data[bounds[i] : bounds[j]].tobytes()
                at = (bounds[i : j + 1] - bounds[i]).tolist()
                ids = encoder(path).encode([raw[a:b] for a, b in zip(at, at[1:])])
                total = np.fromiter(map(len, ids), np.int64, len(ids)) // 4 + 1
                full, rest = total // capacity, total % capacity
                n = full + -(-rest // cut)
                row = np.repeat(np.arange(len(ids)), n)
                nth = np.arange(len(row)) - prefix(n)[:-1][row]
                whole = full[row]
                start = np.minimum(nth, whole) * capacity + np.maximum(nth - whole, 0) * cut
                length = np.where(nth < whole, capacity, np.minimum(cut, total[row] - start))
                held = memoryview(end.join([*ids, b""]))
                first = 4 * (prefix(total)[:-1][row] + start)
                crc = [zlib.crc32(held[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + i)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[row]))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return wanted.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def difference(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Sums and members of ``k`` windows. A partial partition lists its used windows, largest sum first."""
    waiting = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(waiting)
    serial = len(sizes)
    while len(waiting) > 1:
        a, b = heapq.heappop(waiting)[2], heapq.heappop(waiting)[2]
        free = k - len(b)
        merged = a[:free]
        for i, (s, members) in enumerate(reversed(b), free):
            merged.append((a[i][0] + s, a[i][1] + members) if i < len(a) else (s, members))
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(waiting, (-spread, serial, merged))
        serial += 1
    return waiting[0][2] if waiting else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Members of near-equal windows of at most ``capacity``; as few as differencing fills."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = difference(sizes, k)
        if not dealt or dealt[0][0] <= capacity:
            return [members for _, members in dealt]
        k += 1


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, cut: int = CUT) -> DataFrame:
    """The pieces with the sequence they lie in and where: ``sequence_id``, ``offset``."""
    # the row number spreads equal pieces of repeated rows over the shards
    found = written(cuts(docs, path, text, key, capacity, cut).withColumn("_row", F.monotonically_increasing_id()), "packing-cuts")
    tokens = found.agg(F.sum("length")).first()[0] or 0
    shards = max(1, round(tokens / (capacity * WINDOWS)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def deal(held: pa.Table) -> pa.Table:
        held = held.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = held.column("length").to_numpy()
        full = int((sizes == capacity).sum())
        sequence, offset = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        for w, members in enumerate(windows(sizes[full:].tolist(), capacity), full):
            at = 0
            for m in members:
                sequence[full + m], offset[full + m] = w, at
                at += int(sizes[full + m])
        first = held.column("shard")[0].as_py() << 31
        return pa.table({**{n: held.column(n) for n in names}, "sequence_id": sequence.astype(np.int64) + first, "offset": offset})

    kind = found.schema["doc_id"].dataType.simpleString()
    return (
        found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "_row"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(deal, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )
