"""Hashed byte n-grams of texts, and linear models over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from memlake.llm.common import PIECE_BYTES, pieces

BUCKETS = 1 << 12
#: Texts whose counts are held at once.
ROWS = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def gram_rows(data: np.ndarray, bounds: np.ndarray, sizes: tuple[int, ...] = (2, 3), lower: bool = True) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row range and, for each row, the square roots of its n-gram counts, to length one.

    n-grams never cross from one text to the next; texts of any length are counted whole, by stretches.
    """
    for first, last in pieces(bounds):
        for i in range(first, last, ROWS):
            j = min(i + ROWS, last)
            counts = np.zeros((j - i) * BUCKETS, np.int64)
            for start in range(int(bounds[i]), int(bounds[j]), PIECE_BYTES):
                part = data[start : min(start + PIECE_BYTES + max(sizes) - 1, int(bounds[j]))]
                part = LOWER[part] if lower else part
                row = np.searchsorted(bounds[i : j + 1] - start, np.arange(len(part)), "right") - 1
                for n in sizes:
                    m = min(PIECE_BYTES, len(part) - n + 1)
                    if m <= 0:
                        continue
                    code = np.full(m, n, np.uint32)
                    for k in range(n):
                        code = code * np.uint32(0x01000193) ^ part[k : k + m]
                    code *= np.uint32(0x9E3779B1)
                    inside = row[:m] == row[n - 1 : n - 1 + m]
                    at = (row[:m] * BUCKETS + (code >> np.uint32(20)))[inside]
                    counts += np.bincount(at, minlength=len(counts))
            x = np.sqrt(counts.reshape(j - i, BUCKETS).astype(np.float32))
            yield i, j, x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine with squared hinge loss; y is +1 or -1.

    Accelerated gradient steps in the span of the examples; rare labels weigh as much as frequent ones.
    """
    x = np.c_[x, np.ones(len(x), np.float32)]
    weight = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) / len(y)
    gram = (x @ x.T).astype(np.float64)
    step = 1 / (1 + 2 * weight.max() * np.linalg.norm(gram, 2)) if len(y) < 1500 else 1 / (1 + 2 * weight.max() * gram.trace())
    alpha = old = np.zeros(len(y))
    for t in range(rounds):
        ahead = alpha + t / (t + 3) * (alpha - old)
        slack = np.maximum(0, 1 - y * (gram @ ahead))
        old, alpha = alpha, ahead - step * (ahead - 2 * weight * y * slack)
    return (x.T @ alpha).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the offset) of a logistic model; y holds probabilities."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    step = 4 / (4 * ridge + 2.0)
    w = old = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        ahead = w + np.float32(t / (t + 3)) * (w - old)
        p = 1 / (1 + np.exp(-(x @ ahead)))
        old, w = w, (ahead - step * (x.T @ (p - y).astype(np.float32) / len(y) + ridge * ahead)).astype(np.float32)
    return w
