"""URL filter: longest-prefix rules, and a logistic model of host and path for what no rule fits.

The model is a logistic regression on hashed character n-grams of host and path. It is
trained on a small table of labelled URLs, ``MAX_LABELLED`` rows in hash order at most.

Defined results: a null URL or one without ``://`` has empty host and path and fits no
rule; without labelled rows of both verdicts every URL without a rule is allowed; repeated
rows are judged one by one; of rules of one length the first listed counts, and a probability of exactly 0.5 allows; an
empty table gives an empty result; further columns of the input are ignored. Very long URLs are judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.grams import logistic

#: Verdict, domain and path prefix.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
SIZES = (2, 3, 4)
BUCKETS = 1 << 13
MAX_LABELLED = 4000


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rules(urls: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (domain and path prefix, the longest that fits) and ``ruled`` (its verdict)."""
    out = urls.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((F.col("host") == d) | F.col("host").endswith("." + d)) & F.col("path").startswith(p) for _, d, p in ordered]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values)])
    return out.withColumn("rule", pick([d + p for _, d, p in ordered])).withColumn("ruled", pick([v for v, _, _ in ordered]))


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every character n-gram; grams of host and of path differ."""
    rows, at = [], []
    for part, texts in enumerate((hosts, paths)):
        for r, text in enumerate(texts):
            codes = np.frombuffer(f"^{text}$".encode("utf-32-le"), np.uint32)
            for n in SIZES:
                m = len(codes) - n + 1
                if m <= 0:
                    continue
                h = np.full(m, 31 * part + n, np.uint32)
                for k in range(n):
                    h = h * np.uint32(0x01000193) ^ codes[k : k + m]
                h = (h * np.uint32(0x9E3779B1)) >> np.uint32(19)
                at.append(h)
                rows.append(np.full(m, r))
    return (np.concatenate(rows), np.concatenate(at)) if rows else (np.zeros(0, int), np.zeros(0, int))


def train(labelled: DataFrame, limit: int = MAX_LABELLED) -> np.ndarray | None:
    """Weights from rows of ``host``, ``path`` and ``verdict``; None unless both verdicts occur."""
    distinct = labelled.select("host", "path", "verdict").distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(limit)
    rows = distinct.toArrow()
    y = np.array([v == "allow" for v in rows.column("verdict").to_pylist()], float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.zeros((len(y), BUCKETS), np.float32)
    r, at = features(rows.column("host").to_pylist(), rows.column("path").to_pylist())
    x[r, at] = 1
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    return logistic(x, y)


def judge(ruled: DataFrame, weights: np.ndarray | None, key: str = "page_id") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (the model's probability of allow)."""
    wanted = ruled.select(F.col(key).alias("page_id"), "host", "path", "rule", "ruled")
    kind = wanted.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score = np.ones(n)
            if weights is not None and n:
                r, at = features(batch.column("host").to_pylist(), batch.column("path").to_pylist())
                cell = np.unique(r.astype(np.int64) * BUCKETS + at)
                r, at = cell // BUCKETS, cell % BUCKETS
                held = np.bincount(r, minlength=n)
                total = np.bincount(r, weights[at], minlength=n) / np.sqrt(np.maximum(held, 1)) + weights[-1]
                score = 1 / (1 + np.exp(-total))
            verdict = [v or ("allow" if s >= 0.5 else "block") for v, s in zip(batch.column("ruled").to_pylist(), score)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(score)],
                ["page_id", "host", "path", "rule", "verdict", "score"])

    return wanted.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, url: str = "url", key: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Verdicts for all URLs. Without a labelled table, the URLs that rules decide are the labelled ones."""
    ruled = with_rules(pages.select(key, url), url, rules)
    if labelled is None:
        labelled = ruled.filter(F.col("ruled").isNotNull()).select("host", "path", F.col("ruled").alias("verdict"))
    return judge(ruled, train(labelled), key)
