"""Readers and sinks of result tables."""

import os
import tempfile

from pyspark.sql import functions as F

from trellis.sources import readers as RD
from trellis.sources import runlog as RL


def test_csv_roundtrip_and_guarded_read(spark):
    d = tempfile.mkdtemp(prefix="trellis-csv-")
    df = spark.createDataFrame([(1, "A", 0.5), (2, "B", float("inf"))],
                               "run long, model string, overfitting double")
    RD.write_csv(df, f"{d}/a")
    back = RD.read_results_csv(spark, f"{d}/a", "run long, model string, overfitting double")
    assert sorted(r["overfitting"] for r in back.collect()) == [0.5, float("inf")]
    data, status = RD.try_read(spark, [f"{d}/a", f"{d}/missing"],
                               lambda p: RD.read_results_csv(spark, p, df.schema))
    assert data.count() == 2
    assert {r["path"]: r["found"] for r in status.collect()} == {f"{d}/a": True,
                                                                 f"{d}/missing": False}


def test_read_or_else_falls_back(spark):
    fb = spark.createDataFrame([(1,)], "x int")
    assert RD.read_or_else(spark, "/nonexistent/table", fb).collect()[0]["x"] == 1


def test_parquet_table_partitioned(spark):
    d = tempfile.mkdtemp(prefix="trellis-pq-")
    df = spark.range(10).withColumn("run", F.col("id") % 2)
    RD.write_table(df, f"{d}/t", ["run"])
    assert {"run=0", "run=1"} <= set(os.listdir(f"{d}/t"))
    assert spark.read.parquet(f"{d}/t").where("run = 1").count() == 5


def test_append_status_rows(spark):
    d = tempfile.mkdtemp(prefix="trellis-status-")
    RL.append_status(spark, f"{d}/log", "exp_a.py", "INFO", "started")
    RL.append_status(spark, f"{d}/log", "exp_a.py", "SUCCESS", "finished")
    rows = spark.read.parquet(f"{d}/log")
    assert rows.count() == 2 and set(r["level"] for r in rows.collect()) == {"INFO", "SUCCESS"}
