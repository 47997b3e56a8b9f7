"""Timed fit, score and explain (E11-E13) and part shapes.

Wall-clock seconds are measured on the driver around a Spark action.  Inputs are
materialised first, so the time is the fit, not the scan; scoring and explaining are
timed into Spark's no-op sink, so nothing is collected.  Each row of the table is one job
that ran, with its scope: run 0 is a job for all runs at once.  Times are their own table
and never compared by an oracle.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


def timed(fn, *args, **kw):
    """``(result, seconds)`` of any call."""
    t0 = time.perf_counter()
    out = fn(*args, **kw)
    return out, time.perf_counter() - t0


def written(df: DataFrame) -> float:
    """Seconds to work out all rows of ``df``, into the no-op sink."""
    return timed(df.write.format("noop").mode("overwrite").save)[1]


def timing_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``(run, model, phase, seconds)`` rows as a table."""
    return spark.createDataFrame(rows, "run long, model string, phase string, seconds double")


def shape(df: DataFrame, group_cols: list[str]) -> DataFrame:
    """Rows per group and the column count."""
    from pyspark.sql import functions as F
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("bigint"))
