"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # trigram work is far heavier than its bytes: do not merge partitions down to a megabyte each
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # split a skewed join even if the next operator then needs its own shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # merge session windows before the shuffle, so a busy project does not land whole in one task
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator here is planned for."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the cluster (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder: on a cluster it
    would vanish with the machine it is on.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="memlake-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` out once and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the checkpoint folder and read again.

    A checkpoint keeps the size that was estimated for its plan, a product of sizes after each join. Here it is that of the files.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of jobs that are over.

    Spark removes them when the driver has collected the objects that stand for them, which an
    idle driver may not do for half an hour. Nothing happens where the session has no JVM of its own.
    """
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Delete the tables in the checkpoint folder that ``frames`` read, once nothing that is still to run reads them."""
    for df in frames:
        spark = df.sparkSession
        jvm = getattr(spark, "_jvm", None)
        if jvm is None:
            continue
        path = jvm.org.apache.hadoop.fs.Path
        top = path(ensure_checkpoint_dir(spark)).toUri().getPath().rstrip("/") + "/"
        for name in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
            folder = path(name)
            if folder.toUri().getPath().startswith(top):
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
