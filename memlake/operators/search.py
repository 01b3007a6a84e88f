"""Vector, keyword and hybrid search for many queries at once.

``queries``: query_id, project_id, query_text, query_vec. ``memory``: the vector rows.
Results carry a ``rank`` per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions.predicates import all_of, eq, has_any_tag
from memlake.operators.similarity import topk_similar
from memlake.operators.substring import holding
from memlake.plans.probe import MAX_SHIPPED_QUERIES, ROWS_PER_TASK, nearest
from memlake.plans.ranking import top_n
from memlake.session import checkpointed

#: Share of cells that finds 0.9 of the nearest of vectors without clusters; clustered ones need fewer.
PROBED_SHARE = 0.75
#: Hits (ids and scores) that may be sent to every task.
MAX_SENT_HITS = 200_000
PAYLOAD = ["source_type", "source_id", "content_type", "content_text", "tags", "created_at"]


def _filtered(memory: DataFrame, content_type: str | None, tags: Sequence[str] | None) -> DataFrame:
    return memory.filter(all_of(eq(content_type=content_type), has_any_tag(tags) if tags else None))


def semantic_hits(
    queries: DataFrame,
    memory: DataFrame,
    k: int = 5,
    content_type: str | None = None,
    tags: Sequence[str] | None = None,
    max_shipped: int = MAX_SHIPPED_QUERIES,
    rows_per_task: int = ROWS_PER_TASK,
) -> tuple[DataFrame, bool]:
    """(query_id, id, similarity, rank) of the exact ``k`` nearest rows in the query's project."""
    rows = _filtered(memory, content_type, tags)
    return nearest(queries, rows, k, ["project_id"], max_shipped, rows_per_task)


def with_payload(hits: DataFrame, memory: DataFrame, bounded: bool) -> DataFrame:
    """Add the stored columns to the hits; bounded hits travel to memory instead of shuffling it."""
    return memory.select("id", *PAYLOAD).join(F.broadcast(hits) if bounded else hits, "id")


def semantic_topk(
    queries: DataFrame,
    memory: DataFrame,
    k: int = 5,
    content_type: str | None = None,
    tags: Sequence[str] | None = None,
    max_shipped: int = MAX_SHIPPED_QUERIES,
) -> DataFrame:
    """Nearest rows per query, no score threshold; rows without vector never match."""
    hits, bounded = semantic_hits(queries, memory, k, content_type, tags, max_shipped)
    return with_payload(hits, memory, bounded and k * max_shipped <= MAX_SENT_HITS).withColumn("search_mode", F.lit("semantic"))


def _closest_cells(centres: np.ndarray, nprobe: int) -> Callable[[np.ndarray], np.ndarray]:
    """Which cells query vectors ask, as packed bits: the ``nprobe`` closest; the centres (``nlist`` vectors) go to every task."""
    norms = np.linalg.norm(centres, axis=1, keepdims=True)
    held = np.divide(centres, norms, out=np.zeros_like(centres), where=norms > 0)

    def cells(vectors: np.ndarray) -> np.ndarray:
        asked = []
        for at in range(0, len(vectors), 1_024):
            scores = vectors[at : at + 1_024] @ held.T
            mine = np.zeros(scores.shape, bool)
            np.put_along_axis(mine, np.argsort(-scores, axis=1, kind="stable")[:, :nprobe], True, axis=1)
            asked.append(np.packbits(mine, axis=1))
        return np.concatenate(asked)

    return cells


def ann_topk(
    queries: DataFrame, memory: DataFrame, k: int = 5, nlist: int | None = None, nprobe: int | None = None, share: float = PROBED_SHARE, seed: int = 7
) -> DataFrame:
    """Approximate nearest rows: only the ``nprobe`` closest of ``nlist`` cells are scored.

    The cell of a row comes from k-means over all vectors, by default as many cells as the root of their number; a ``share`` of
    them is probed. Inside the probed cells the scoring is exact. A query is sent to its project's rows once, not to each cell.
    """
    rows = memory.filter(F.col("embedding").isNotNull())
    nlist = nlist or max(2, round(rows.count() ** 0.5))
    nprobe = nprobe or math.ceil(share * nlist)
    points = rows.withColumn("_point", array_to_vector("embedding"))
    model = KMeans(
        k=nlist, seed=seed, distanceMeasure="cosine", featuresCol="_point", predictionCol="_cell"
    ).fit(points)
    cells = _closest_cells(np.array(model.clusterCenters()), nprobe)
    hits, _ = nearest(queries, model.transform(points).drop("_point"), k, ["project_id"], cells=cells)
    return hits


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits the approximate search found."""
    found = exact.join(approximate.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return found.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def _newest_holding(rows: DataFrame, text: str, asked: DataFrame, k: int, time: str) -> DataFrame:
    """``project_id``, ``_text``, ``id`` and ``rank`` of the ``k`` newest rows that hold each asked text, letter case aside."""
    low = rows.select("project_id", "id", time, F.lower(text).alias("_low"))
    return top_n(holding(low, asked, ["project_id"], "_low", newest=(k, time)), k, ["project_id", "_text"], [F.col(time).desc(), F.col("id").asc()]).drop(time)


def keyword_search(
    queries: DataFrame,
    memory: DataFrame,
    k: int = 5,
    content_type: str | None = None,
    tags: Sequence[str] | None = None,
) -> DataFrame:
    """Newest rows whose text contains the query text, score 0.

    Equal texts asked in one project are looked up once; what is stored beside the text joins the hits only.
    """
    rows = _filtered(memory, content_type, tags)
    named = queries.select("query_id", "project_id", F.lower("query_text").alias("_text")).filter("_text is not null")
    asked = named.select("project_id", "_text").distinct()
    hits = named.join(_newest_holding(rows, "content_text", asked, k, "created_at"), ["project_id", "_text"])
    return rows.select("id", *PAYLOAD).join(hits.select("id", "query_id", "rank"), "id").withColumns(
        {"similarity": F.lit(0.0), "search_mode": F.lit("keyword")})


def hybrid_search(
    queries: DataFrame,
    memory: DataFrame,
    k: int = 5,
    content_type: str | None = None,
    tags: Sequence[str] | None = None,
) -> DataFrame:
    """Semantic hits, then keyword hits not among them, cut to ``k`` per query.

    A query with ``k`` semantic hits has no place left, so its text is not searched for.
    """
    semantic = checkpointed(semantic_topk(queries, memory, k, content_type, tags))
    short = queries.join(semantic.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    lists = semantic.withColumn("_list", F.lit(0)).unionByName(
        keyword_search(short, memory, k, content_type, tags).withColumn("_list", F.lit(1))
    )
    once = top_n(lists, 1, ["query_id", "id"], [F.col("_list").asc()], "_first")
    order = [F.col("_list").asc(), F.col("_place").asc()]
    ranked = top_n(once.withColumnRenamed("rank", "_place"), k, ["query_id"], order)
    return ranked.drop("_list", "_place", "_first")


def search(queries: DataFrame, memory: DataFrame, mode: str = "hybrid", **options: object) -> DataFrame:
    """Dispatch on mode: semantic, keyword or hybrid."""
    modes = {"semantic": semantic_topk, "keyword": keyword_search, "hybrid": hybrid_search}
    return modes[mode](queries, memory, **options)


def match_errors_keyword(queries: DataFrame, errors: DataFrame, k: int = 3) -> DataFrame:
    """Known errors holding the first 100 characters of the asked text, last seen first."""
    named = queries.select("query_id", "project_id", F.lower(F.substring("query_text", 1, 100)).alias("_text"))
    asked = named.select("project_id", "_text").filter("_text is not null").distinct()
    best = _newest_holding(errors, "error_message", asked, k, "last_seen_at")
    return named.join(best, ["project_id", "_text"]).select(
        "query_id", "id", "rank", F.lit(0.0).alias("match_score"), F.lit("keyword").alias("match_type")
    )


def match_errors(
    queries: DataFrame, errors: DataFrame, memory: DataFrame | None, k: int = 3, mode: str = "trigram"
) -> DataFrame:
    """Known errors like each asked message: (query_id, rank, id, match_score, match_type).

    Text matches come first; if they are fewer than ``k``, the ``k`` nearest error vectors
    fill up, without patterns already listed or no longer stored.
    """
    if mode == "keyword":
        text = match_errors_keyword(queries, errors, k)
    else:
        text = topk_similar(queries, errors, "error_message", k, 0.3).select(
            "query_id", "id", "rank", F.col("similarity").alias("match_score"), F.lit("text").alias("match_type")
        )
    if memory is None:
        return text
    text = checkpointed(text)
    full = text.filter(F.col("rank") == k).select("query_id")
    hits, bounded = semantic_hits(queries.join(full, "query_id", "left_anti"), memory, k, content_type="error")
    sources = memory.filter(F.col("content_type") == "error").select("id", "source_id")
    fill = (
        sources.join(F.broadcast(hits) if bounded and k * MAX_SHIPPED_QUERIES <= MAX_SENT_HITS else hits, "id")
        .select("query_id", F.col("source_id").alias("id"), (F.col("rank") + k).alias("rank"),
                F.col("similarity").alias("match_score"), F.lit("semantic").alias("match_type"))
        .join(text.select("query_id", "id"), ["query_id", "id"], "left_anti")
        .join(errors.select("id"), "id", "left_semi")
    )
    # two vector rows may point to one pattern: the nearer counts
    fill = top_n(fill, 1, ["query_id", "id"], [F.col("rank").asc()], "_first").drop("_first")
    merged = text.unionByName(fill).withColumnRenamed("rank", "_place")
    return top_n(merged, k, ["query_id"], [F.col("_place").asc()]).drop("_place")
