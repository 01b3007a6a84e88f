"""A corpus pipeline: toxic documents go, near-duplicates go, repeated strings are cut out,
sources are mixed to their weights, and what stays is packed into sequences.

Every stage takes the documents that its predecessor kept; its result is written as Parquet
and read again for the next one. All but the last return the columns of documents.

Defined results, stage by stage: a null or empty text is kept by toxicity (its score is the calibrated prior, which is
below the bar unless nearly all labels are toxic), is one group with all texts without words in near-duplicates, loses nothing, is
taken no time by the mix (it has no words), and so doesn't reach packing. A null id is never learnt from; rows of one id, or
of none, are documents of their own in every stage. Of a group of near-duplicates the smallest id stays, of its rows the one of smallest
hash. Texts of any length go through whole. Columns beside those of documents, whatever their names, are carried along up to
packing; a name that a stage uses inside begins with an underscore. An empty table, or one whose rows all go, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import mixing, packing, simhash, suffixdedup, toxicity
from memlake.llm.common import discard, table, written
from memlake.llm.registry import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text scores below the bar; ids play no part in it."""
    return toxicity.below(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest id, no id last; rows of one id by the hash of the row.

    Rows go by a number of their own, so a null or repeated id loses nothing but its near copies.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    found = simhash.near_duplicates(rows, key="_row").select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*docs.columns).alias("hash"), "_row")
    stays = rows.select("_row", order.alias("_order")).join(found, "_row").groupBy("component_id").agg(F.min("_order")["_row"].alias("_row"))
    return rows.join(stays.select("_row"), "_row", "left_semi").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings that start in more than one place; ``n_chars`` follows the text."""
    found = suffixdedup.without_repeats(suffixdedup.repeated_bytes(docs))
    return found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, whatever its id: rows go by a number of their own."""
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    found = mixing.repeat_documents(rows, mixing.mix(rows, row="_row"), "_row")
    return found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Scores of the nearest examples, fingerprints and tokens can't be told in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if at:  # what the stage before wrote has been read
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
