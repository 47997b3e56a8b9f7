"""Readers and writers of result tables.

CSV sinks write one file per task unless a caller asks for a single one, which is for
result tables of a few rows (runs x models); row-level tables go to parquet.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_results_csv(spark: SparkSession, path: str,
                     schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; declared schema when given, inference otherwise."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the cluster's file system (works for any Hadoop URI)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def try_read(spark: SparkSession, paths: list[str], reader=None, name_col: str = "source"):
    """Read every path that exists, stacked with a ``source`` column; the
    status table ``(path, found)`` says which were skipped."""
    reader = reader or (lambda p: read_results_csv(spark, p))
    found = [(p, path_exists(spark, p)) for p in paths]
    frames = [reader(p).withColumn(name_col, F.lit(os.path.basename(p)))
              for p, ok in found if ok]
    data = None
    for f in frames:
        data = f if data is None else data.unionByName(f, allowMissingColumns=True)
    status = spark.createDataFrame(found, "path string, found boolean")
    return data, status


def read_or_else(spark: SparkSession, path: str, fallback: DataFrame, reader=None) -> DataFrame:
    """S3: the stored table, or the fallback table if there is none at ``path``.  A table
    that is there and cannot be read is an error."""
    reader = reader or (lambda p: spark.read.parquet(p))
    return reader(path) if path_exists(spark, path) else fallback


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """K1: header, overwrite; ``single_file`` is for small summaries only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K1 for row-level results: parquet, overwrite, optional partition columns."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def show(df: DataFrame, n: int = 50) -> None:
    """K2: console table."""
    df.show(n, truncate=False)
