"""Mixing sources to target weights by capped water-filling.

Every source has a weight; all sources share a total. A source may be repeated
``max_epochs`` times at most, so its target stops there; what it can't take is shared
again among the others by weight, until no target is above its cap. Targets become
repetitions of documents: the whole part for every document of the source, the
fractional part for the documents that come first in a seeded order; the last of these
is repeated in part, so a source's words meet its target to the word.

Defined results: a null or empty text has size 0 and is taken 0 times; a source of
size 0 has target 0; a null source is a source of its own, the last one; repeated
rows, rows of one id and rows without one are documents of their own; texts of any length are counted whole;
of rows that tie in the seeded order the shorter comes first, equal ones are interchangeable; an empty table gives
an empty result; columns of the input whose names clash with results are not carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import discard, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3


def ranked_sources(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Sources with their weight: the weights repeat over the sources by code point, null last.

    Numbered by a range-partitioned sort and the row counts of the partitions before,
    so a long list of sources is never in one task. Spark compares strings by bytes,
    which is code point order for UTF-8.
    """
    placed = (
        sizes.repartitionByRange(F.col("source").isNull(), F.col("source"))
        .sortWithinPartitions(F.col("source").isNull(), "source")
        .withColumn("_id", F.monotonically_increasing_id())
        .select("source", "source_size", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row"))
    )
    placed = written(placed, "mixing-sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    turn = (F.col("_before") + F.col("_row")) % len(weights)
    return placed.join(F.broadcast(parts), "_part").select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int")).alias("weight"),
    )


def water_fill(sources: DataFrame, total: int, max_epochs: float) -> tuple[float, float]:
    """Water level: a source's target is the smaller of its cap and weight times level.

    Each round clamps the sources above their cap and shares the rest by weight again; the
    level only rises, and every round clamps at least one more source, or is the last.
    A round is one aggregate over the table of sources. Returns level and cap factor.
    """
    level = 0.0
    cap = F.col("source_size") * F.lit(float(max_epochs))
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        got = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("clamped"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not got["open"]:
            return level, float(max_epochs)
        risen = (total - got["clamped"]) / got["open"]
        if risen <= level * (1 + 1e-15):
            return level, float(max_epochs)
        level = risen


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0, key: str = "doc_id", row: str | None = None,
) -> DataFrame:
    """Every document with its size, its source's size and target, and how often it is taken.

    Returns ``key``, ``row`` (a column that numbers the rows, if given), ``source``, ``size``, ``source_size``, ``target`` and
    ``taken`` (words, repeats counted). Documents stand in a seeded order: by a digest of seed and key, rows of one key by size and
    text. The order is a range-partitioned sort down to the row, so rows of one source or one key are as many partitions as
    they need; sums of a source over the partitions before carry the running sizes on.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = written(docs.select(
        F.col(key).alias("_key"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), number.alias("_number"),
        digest.alias("_digest"), F.xxhash64("text").alias("_text")), "mixing-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = ranked_sources(totals, weights)
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    level, factor = water_fill(sources.filter(F.col("source_size") > 0), total, max_epochs)
    target = F.least(F.col("source_size") * F.lit(factor), F.col("weight") * F.lit(level))
    sources = sources.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0)).drop("weight")

    order = ["source", "_digest", "_key", "size", "_text", "_number"]
    placed = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ordered = written(placed.withColumn("_part", F.shiftright("_id", 33)).drop("_digest", "_text"), "mixing-order")
    discard(sized)
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that holds the source
    starts = ordered.groupBy("source", "_part").agg(F.sum("size").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    shares = starts.join(sources, starts["source"].eqNullSafe(sources["source"])).select(
        starts["source"].alias("_s"), starts["_part"].alias("_p"), "_start", "source_size", "target")
    within = Window.partitionBy("_part", "source").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    full = ordered.withColumn("_up", F.sum("size").over(within)).join(shares, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    whole = F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")))
    rest = F.floor(F.col("target") + F.lit(1e-6)) - whole * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - (F.col("_start") + F.col("_up") - F.col("size"))))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(whole * F.col("size") + part)
    numbers = [F.col("_number").alias(row)] if row else []
    return full.select(F.col("_key").alias(key), *numbers, "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeat_documents(docs: DataFrame, mixed: DataFrame, row: str) -> DataFrame:
    """The mix itself: every document as often as it is taken; a part repeat has its first words.

    ``row`` numbers the rows of ``docs`` and tells in ``mixed`` which is meant, so rows of one id, or without one, are
    documents of their own. The words of a part are joined by single spaces.
    """
    taken = mixed.filter(F.col("taken") > 0).select(F.col(row).alias("_k"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    rows = docs.join(taken, docs[row] == F.col("_k")).withColumn(
        "_left", F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.col("_taken") / F.col("_size")).cast("int") - 1), lambda i: F.col("_taken") - i * F.col("_size"))))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("_left") >= F.col("_size"), docs["text"]).otherwise(F.array_join(F.slice(words, 1, F.col("_left").cast("int")), " "))
    return rows.select(*[(text.alias(c) if c == "text" else docs[c]) for c in docs.columns])
