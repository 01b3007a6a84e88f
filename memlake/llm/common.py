"""What several operators of this folder share: splits, written intermediates, byte views of texts."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.session import discard, ensure_checkpoint_dir, release  # noqa: F401

WORDS = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one round of array work takes at once (a longer document is taken alone).
PIECE_BYTES = 1 << 20
#: Bytes from which on a range is digested as a whole.
LONG_RANGE = 256
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder, and read again.

    Later jobs read the files, so a lost executor costs no recomputation of what
    stands before, and values that depend on task order stay fixed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of all ids that no model may learn from; a null id is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and where each begins (one entry more); null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), bounds


def pieces(bounds: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    at, rows = 0, len(bounds) - 1
    while at < rows:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, min(stop, rows)
        at = min(stop, rows)


def per_row(running: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum over each row of what ``running`` (a prefix sum with a leading zero) has added up."""
    return running[bounds[1:]] - running[bounds[:-1]]


def prefix(values: np.ndarray, dtype=np.int64) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype)
    np.cumsum(values, dtype=dtype, out=out[1:])
    return out


_POWERS: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, kept by each worker for the next piece."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def range_hashes(data: np.ndarray):
    """Function giving 64-bit hashes of byte ranges of ``data``; equal ranges have equal hashes.

    A polynomial modulo 2**64 gives different ranges of ``LONG_RANGE`` bytes or less one hash only by chance; certain
    longer ones it would confuse (Thue-Morse words from 1,024 bytes on), so those are digested byte by byte.
    """
    up, down = _powers(len(data) + 1)
    sums = prefix((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], np.uint64)

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * down[start]
        h ^= (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        for i in np.flatnonzero(end - start > LONG_RANGE).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest())
        return h

    return of
