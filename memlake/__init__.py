"""memlake: multi-project knowledge tables (snapshots, tasks, notes, errors,
instructions, embeddings) ingested, merged, searched and reported on with Spark."""

from memlake.session import configure

__all__ = ["configure"]
