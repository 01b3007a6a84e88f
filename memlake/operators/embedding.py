"""Which text of which row becomes a vector row, and the encoding itself."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.text import empty_to_null, join_non_empty, strip

Encoder = Callable[[list[str]], np.ndarray]


class HashingEncoder:
    """Offline encoder: hashed word counts, unit length."""

    def __init__(self, dims: int = 384):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for row, text in zip(out, texts):
            slots = [zlib.crc32(word.encode()) % self.dims for word in text.lower().split()]
            np.add.at(row, slots, 1.0)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def embed(df: DataFrame, text: str, make_encoder: Callable[[], Encoder] | None, out: str = "embedding") -> DataFrame:
    """Add the vector of a text column, NULL without an encoder.

    ``make_encoder`` runs once per Python worker call chain, so a model is loaded once for
    all batches of a task.
    """
    if make_encoder is None:
        return df.withColumn(out, F.lit(None).cast("array<float>"))

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            yield pd.Series(list(encoder(texts.fillna("").tolist())))

    return df.withColumn(out, F.when(F.col(text).isNotNull(), encode(text)))


def _rows(
    df: DataFrame, source_type: str, content_type: Column, stored: Column, embedded: Column, tags: Column
) -> DataFrame:
    return df.select(
        "project_id", F.lit(source_type).alias("source_type"), F.col("id").alias("source_id"),
        content_type.alias("content_type"), stored.alias("content_text"), embedded.alias("embed_text"),
        tags.alias("tags"), "created_at",
    )


def embedding_rows(
    snapshots: DataFrame | None = None, todos: DataFrame | None = None, notes: DataFrame | None = None,
    errors: DataFrame | None = None, instructions: DataFrame | None = None, briefs: DataFrame | None = None,
) -> DataFrame:
    """Vector rows of new table rows, before encoding ``embed_text``."""
    parts: list[DataFrame] = []
    none = F.array().cast("array<string>")
    tags = F.coalesce(F.col("tags"), none)
    if snapshots is not None:
        for column, kind in (("summary", "summary"), ("architecture_notes", "architecture")):
            parts.append(_rows(snapshots.filter(F.length(column) > 0), "snapshot", F.lit(kind), F.col(column), F.col(column), tags))
    if todos is not None:
        description = F.coalesce("description", F.lit(""))
        parts.append(_rows(
            todos, "todo", F.lit("task"), F.concat("title", F.lit(": "), description),
            F.concat(F.lit("Task: "), "title", F.lit(". "), description), tags,
        ))
    if notes is not None:
        kind = F.when(F.col("category").isin("decision", "debug"), F.col("category")).otherwise("note")
        parts.append(_rows(notes, "note", kind, F.col("content"), F.col("content"), tags))
    if errors is not None:
        text = strip(F.concat(
            F.lit("Error: "), "error_message", F.lit(". "), F.coalesce("root_cause", F.lit("")), F.lit(" "),
            F.coalesce("resolution", F.lit("")),
        ))
        parts.append(_rows(errors, "error_pattern", F.lit("error"), text, text, tags))
    if instructions is not None:
        parts.append(_rows(instructions, "instruction", F.lit("instruction"), F.col("content"), F.col("content"), tags))
    if briefs is not None:
        text = join_non_empty("project_name", "tech_stack", "module_map", "conventions", "critical_constraints", "entry_points")
        base = briefs.withColumns({"id": F.lit(None).cast("long"), "created_at": F.col("updated_at")})
        parts.append(_rows(base, "snapshot", F.lit("brief"), text, text, F.array(F.lit("project-brief"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def error_embed_text(message: str = "error_message") -> Column:
    """Text of an edited error."""
    return F.concat(
        F.lit("Error: "), message, F.lit(". Cause: "), F.coalesce(empty_to_null("root_cause"), F.lit("unknown")),
        F.lit(". Fix: "), F.coalesce(empty_to_null("resolution"), F.lit("unknown")),
    )


def replace_briefs(vectors: DataFrame, brief_rows: DataFrame) -> DataFrame:
    """Swap the brief vector rows of the projects in ``brief_rows``."""
    old = (F.col("content_type") == "brief") & F.col("_new").isNotNull()
    marked = vectors.join(brief_rows.select("project_id", F.lit(True).alias("_new")).distinct(), "project_id", "left")
    return marked.filter(~old).drop("_new").unionByName(brief_rows, allowMissingColumns=True)


def refresh(
    vectors: DataFrame, changed: DataFrame, as_of: Column, make_encoder: Callable[[], Encoder] | None
) -> DataFrame:
    """Re-encode vector rows whose source text changed: (source_type, source_id, content_text).

    Only rows with a really different text are encoded; tags and type stay. Without an
    encoder nothing is refreshed.
    """
    if make_encoder is None:
        return vectors
    keys = ["source_type", "source_id"]
    news = changed.select(*keys, F.col("content_text").alias("_text"))
    joined = vectors.join(news, keys, "left")
    differs = F.col("_text").isNotNull() & ~F.col("_text").eqNullSafe(F.col("content_text"))
    encoded = embed(joined.withColumn("_todo", F.when(differs, F.col("_text"))), "_todo", make_encoder, "_vector")
    return encoded.withColumns({
        "content_text": F.coalesce("_todo", "content_text"),
        "embedding": F.coalesce("_vector", "embedding"),
        "created_at": F.when(F.col("_todo").isNotNull(), as_of).otherwise(F.col("created_at")),
    }).select(*vectors.columns)
