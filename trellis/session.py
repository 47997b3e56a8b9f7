"""Spark session and shared-folder helpers.

The engine never picks a machine-local folder on a cluster: lineage is cut with
``checkpoint()`` into the folder the cluster names in ``spark.checkpoint.dir``.
Only a local session without that setting (tests) gets one under /tmp.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "trellis", cpus: int | str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution and UTC.

    Master, memory and partition counts are the submitter's; ``cpus`` (a local master)
    and ``shuffle_partitions`` are set only where a caller names them, as the bench does.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if os.environ.get("TRELLIS_DRIVER_MEMORY"):
        builder = builder.config("spark.driver.memory", os.environ["TRELLIS_DRIVER_MEMORY"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; a local session without one gets a scratch
    folder, a cluster without one is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="trellis-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def shared_path(spark: SparkSession, name: str) -> str:
    """A path inside the shared checkpoint folder (for written intermediate tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin rows over the cluster when the input has fewer splits than cores.

    A single large file with one row group scans as one task; CPU-heavy row work
    that follows (hashing, the run explode) would then use one core.  On a big
    input the scan already has thousands of splits and this is a no-op, so no
    shuffle is added where it is not needed.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    # only scan-level plans: after an exchange the rows are already spread, and
    # counting partitions there would run the upstream stages
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    if df.rdd.getNumPartitions() >= target:
        return df
    # by the row's place, not by its values, so copies of a row go to all tasks; unlike a
    # round-robin deal this needs no sort of every task's rows to be repeatable
    return df.withColumn("_place", F.monotonically_increasing_id()).repartition(target, "_place").drop("_place")
