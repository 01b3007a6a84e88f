"""Parquet storage: an append-only change log per table, versioned full tables, compaction.

A version is a folder that Spark commits with its success marker; readers take the
highest committed one, so a rewrite never touches what is being read and a failed job
leaves nothing visible.

A log is a folder of named batches. A retried batch writes the same folder again. Compaction
folds the batches it finds into a version of its own and names them; readers take that version
and the batches that it doesn't name. So a batch written meanwhile counts, and one that is
folded counts once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.changes import fold_changes
from memlake.schemas import schema

BUCKETS = 64
BUCKET = "project_bucket"


def bucket_of(project_id: Column) -> Column:
    return F.pmod(F.xxhash64(project_id), F.lit(BUCKETS)).cast("int")


def _laid_out(df: DataFrame) -> DataFrame:
    """Bucket column added and rows gathered by bucket; an oversized bucket is split again."""
    return df.withColumn(BUCKET, bucket_of(F.col("project_id"))).hint("rebalance", BUCKET)


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of the committed folders below ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [(status.getPath().getName(), status.getPath()) for status in fs.listStatus(folder)]
    return [n[len(prefix):] for n, p in names if n.startswith(prefix) and fs.exists(hadoop.Path(p, "_SUCCESS"))]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in map(hadoop.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _committed(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(v) for v in _folders(spark, path, "v="))


def _only_projects(df: DataFrame, project_ids: list[str] | None) -> DataFrame:
    if not project_ids:
        return df
    # the bucket test folds to constants and prunes folders; the id test is pushed to the files
    buckets = [bucket_of(F.lit(p)) for p in project_ids]
    return df.filter(F.col(BUCKET).isin(*buckets) & F.col("project_id").isin(*project_ids))


def write_version(df: DataFrame, root: str, table: str, version: int) -> None:
    """Write a whole table as one version, sorted for pruning inside files."""
    laid_out = _laid_out(df)
    order = [c for c in (BUCKET, "project_id", "created_at") if c in laid_out.columns]
    laid_out.sortWithinPartitions(*order).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/{table}/v={version}")


def scan(
    spark: SparkSession, root: str, table: str, project_ids: list[str] | None = None,
    columns: list[str] | None = None, before: int | None = None,
) -> DataFrame | None:
    """Latest committed version of a table (below ``before``), None if there is none."""
    versions = [v for v in _committed(spark, f"{root}/{table}") if before is None or v < before]
    if not versions:
        return None
    df = _only_projects(spark.read.parquet(f"{root}/{table}/v={versions[-1]}"), project_ids)
    return df.select(*columns) if columns else df.drop(BUCKET)


def scan_external(spark: SparkSession, path: str, table: str, project_ids: list[str] | None = None) -> DataFrame:
    """Plain parquet of a table with the declared schema."""
    df = spark.read.schema(schema(table)).parquet(path)
    return df.filter(F.col("project_id").isin(*project_ids)) if project_ids else df


def _folded(spark: SparkSession, log: str, version: int) -> set[str]:
    """Names of the batches that a compacted version holds: a few bytes for each micro-batch ever written."""
    return {r.batch for r in spark.read.parquet(f"{log}/folded/v={version}").collect()}


def append_changes(changes: DataFrame, root: str, table: str, batch: str) -> None:
    """Add change rows as one named batch of the log; writing a batch again replaces it.

    Names are for one batch each: a name that compaction has folded is a retry, and does nothing.
    """
    spark, log = changes.sparkSession, f"{root}/{table}_log"
    versions = _committed(spark, f"{log}/compacted")
    if versions and not spark.read.parquet(f"{log}/folded/v={versions[-1]}").filter(F.col("batch") == batch).isEmpty():
        return
    _laid_out(changes).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{log}/batches/batch={batch}")


def _log_of(spark: SparkSession, log: str, version: int | None, batches: list[str]) -> DataFrame:
    """A compacted version, if there is one, and the given batches."""
    parts = [spark.read.parquet(f"{log}/compacted/v={version}")] if version is not None else []
    if batches:
        parts.append(spark.read.option("basePath", f"{log}/batches").parquet(*[f"{log}/batches/batch={b}" for b in batches]).drop("batch"))
    return reduce(DataFrame.unionByName, parts)


def read_log(spark: SparkSession, root: str, table: str, project_ids: list[str] | None = None) -> DataFrame:
    """All changes that still count, in no order."""
    log = f"{root}/{table}_log"
    versions = _committed(spark, f"{log}/compacted")
    version = versions[-1] if versions else None
    held = _folded(spark, log, version) if versions else set()
    batches = sorted(set(_folders(spark, f"{log}/batches", "batch=")) - held)
    return _only_projects(_log_of(spark, log, version, batches), project_ids).drop(BUCKET)


def insert_rows(rows: DataFrame, columns: list[str], at: Column, change_id: Column) -> DataFrame:
    """Change rows that insert table rows."""
    return rows.select(
        change_id.alias("change_id"), at.alias("changed_at"), "id", "project_id", F.lit("insert").alias("op"),
        F.array(*[F.lit(c) for c in columns]).alias("set_fields"), *columns,
    )


def compacted_log(log: DataFrame, columns: list[str], as_of: Column | None = None) -> DataFrame:
    """A log that folds as ``log`` does, alone and with any further changes, late or repeated ones too.

    Changes after ``as_of`` stay as they are, so states from then on can still be asked for. Of the
    others each id keeps what comes from its last insert or delete on: that change with its own
    time, the last value set of each column, completion and touch. A deleted id keeps its deletion.
    """
    order = ("changed_at", "change_id")
    old = log if as_of is None else log.filter(F.col("changed_at") <= as_of)
    folded = fold_changes(old, columns, order)
    start = F.greatest("_base.at", "_deleted")
    sets = {c: F.col(f"_set_{c}") for c in columns}
    kind = dict(log.dtypes)

    def change(op: str, at: Column, fields: Column, values: dict[str, Column]) -> Column:
        own = F.struct(*[at[o].alias(o) for o in order], F.lit(op).alias("op"), fields.cast("array<string>").alias("set_fields"),
                       *[values.get(c, F.lit(None)).cast(kind[c]).alias(c) for c in columns])
        return F.when(at.isNotNull() & (start.isNull() | (at >= start)), own)

    def update(at: Column) -> Column:
        fields = F.array_compact(F.array(*[F.when(sets[c]["at"] == at, F.lit(c)) for c in columns]))
        return change("update", at, fields, {c: F.when(sets[c]["at"] == at, sets[c]["value"]) for c in columns})

    none = F.array()
    every = F.array(*[F.lit(c) for c in columns])
    set_times = F.array_distinct(F.array(F.col("_touched"), *[sets[c]["at"] for c in columns]))
    kept = F.concat(
        F.array(
            change("insert", F.col("_base.at"), every, {c: F.col(f"_base.{c}") for c in columns}),
            change("delete", F.col("_deleted"), none, {}),
            change("complete", F.col("_completed"), none, {}),
        ),
        F.transform(set_times, update),
    )
    rows = folded.select("id", "project_id", F.explode(F.array_compact(kept)).alias("_c"))
    out = rows.select("_c.change_id", "_c.changed_at", "id", "project_id", "_c.op", "_c.set_fields", *[f"_c.{c}" for c in columns])
    if as_of is None:
        return out
    return out.unionByName(log.filter(F.col("changed_at") > as_of).select(*out.columns))


def compact(spark: SparkSession, root: str, table: str, columns: list[str], as_of: Column | None = None) -> int:
    """Fold the log of a table, up to ``as_of``, into a new version.

    Two compactions of one log must not run at once. What the version before had folded or
    replaced is deleted; the batches folded now stay for those who still read them.
    """
    log = f"{root}/{table}_log"
    versions = _committed(spark, f"{log}/compacted")
    last = versions[-1] if versions else None
    held = _folded(spark, log, last) if versions else set()
    found = set(_folders(spark, f"{log}/batches", "batch="))
    fresh = sorted(found - held)
    target = 1 if last is None else last + 1
    names = spark.createDataFrame([(b,) for b in sorted(held | found)], "batch string")
    names.coalesce(1).write.mode("overwrite").parquet(f"{log}/folded/v={target}")
    whole = compacted_log(_log_of(spark, log, last, fresh).drop(BUCKET), columns, as_of)
    _laid_out(whole).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{log}/compacted/v={target}")
    _delete(spark, [f"{log}/batches/batch={b}" for b in sorted(found & held)])
    _delete(spark, [f"{log}/{part}/v={v}" for v in versions[:-1] for part in ("compacted", "folded")])
    return target
