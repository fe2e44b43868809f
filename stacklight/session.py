"""Session settings, shared checkpoints and the layout of small inputs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(app: str = "stacklight", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STACKLIGHT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share, so data there outlives any of them.

    Only where that setting is absent, as in local tests, a folder of this machine is used.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stacklight-")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and go on from there.

    Unlike a checkpoint, the table has its true size in the planner's statistics (a checkpoint carries the estimate of
    its plan along, and estimates of joins multiply from round to round), and is stored by column. It is deleted
    when the session's process ends, or by ``forget``. With ``by``, a folder per value of that column (few values).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote; nothing may read it afterwards."""
    spark = df.sparkSession
    for path in {m[0] for m in (re.match(r".*/table-[0-9a-f]{32}(?=/)", f) for f in df.inputFiles()) if m}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_parts(df: DataFrame, growth: float, part_bytes: int = 64 << 20) -> int:
    """Partitions for a shuffle of rows that grow the frame's estimated bytes ``growth`` times: the session's number, or more if a part would pass ``part_bytes``."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # Spark's way of saying that it doesn't know
        size = 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, int(size * growth / part_bytes) + 1))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few files at least one task per core before per-row work.

    For scans with filters and projections only: counting the splits of anything else would run its shuffles. Large
    inputs already have more splits than cores and are left alone, so this never shuffles them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
