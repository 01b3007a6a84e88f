"""Micro-batch sinks. Every sink writes a folder named after the batch, so a batch that
is run again after a failure replaces its own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from memlake.operators.embedding import Encoder, embed
from memlake.operators.merge import merge_errors
from memlake.operators.search import match_errors
from memlake.operators.validate import validate, validate_updates
from memlake.sources.tables import append_changes, scan, write_version


def _sink(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle)


def ingest(stream: DataFrame, root: str, table: str, checkpoint: str) -> DataStreamWriter:
    """Validate change rows and append them to the log; rejects go to ``<table>_rejects``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        inserts, others = batch.filter(F.col("op") == "insert"), batch.filter(F.col("op") != "insert")
        good, bad = validate(inserts, table)
        good_updates, bad_updates = validate_updates(others, table)
        append_changes(good.unionByName(good_updates), root, table, str(batch_id))
        bad.unionByName(bad_updates).write.mode("overwrite").parquet(f"{root}/{table}_rejects/batch={batch_id}")
        batch.unpersist()

    return _sink(stream, checkpoint, handle)


def merge_error_stream(stream: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Merge each batch of logged errors into the pattern table; a version per batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = scan(spark, root, "error_patterns", before=batch_id + 1)
        if current is None:
            current = _no_patterns(batch)
        merged = merge_errors(current, batch.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz")))
        write_version(merged.drop("embed_text"), root, "error_patterns", batch_id + 1)

    return _sink(stream, checkpoint, handle)


def _no_patterns(batch: DataFrame) -> DataFrame:
    time = F.col("seen_at").cast("timestamp_ntz")
    return batch.limit(0).withColumns(
        {"occurrence_count": F.lit(1), "last_seen_at": time, "created_at": time}
    ).drop("seq", "seen_at")


def embed_stream(stream: DataFrame, make_encoder: Callable[[], Encoder], root: str, checkpoint: str) -> DataStreamWriter:
    """Encode arriving vector rows (``embed_text``) and store them."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = embed(batch, "embed_text", make_encoder).drop("embed_text")
        rows.write.mode("overwrite").parquet(f"{root}/memory_embeddings/batch={batch_id}")

    return _sink(stream, checkpoint, handle)


def match_error_stream(
    stream: DataFrame, errors: Callable[[], DataFrame], memory: Callable[[], DataFrame] | None, root: str, checkpoint: str, k: int = 3
) -> DataStreamWriter:
    """Known patterns for each arriving error; what is stored is read anew for each batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        match_errors(batch, errors(), memory() if memory else None, k).write.mode("overwrite").parquet(f"{root}/error_matches/batch={batch_id}")

    return _sink(stream, checkpoint, handle)
