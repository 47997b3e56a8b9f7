"""Run-log source and analytics.

A batch runner appends lines ``[yyyy-MM-dd HH:mm:ss] LEVEL: message`` with rule
lines of ``=`` between batches.  Here the log is a table: parsed by
``regexp_extract`` (L1), numbered into batches by a running count of batch
starts (L3), and reduced per (batch, program) to a duration (L2) and a final
status (L4).  Running counts use the bucketed prefix sums of
:mod:`trellis.operators.ranking`, so one huge log never sits in one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.operators.ranking import weighted_positions
from trellis.session import cut_lineage

LINE_RE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] ([A-Z]+): (.*)$"
PROGRAM_RE = r"([A-Za-z0-9_]+\.py)"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines ``value`` with their ``file`` and ``line``, numbered from 0 in the file.

    Files are read in splits by many tasks.  A line's place is its split's start in the
    file and its place in the split; lines are counted per split, a running sum over the
    splits of a file gives each split's first number, and nothing is sorted.
    """
    lines = cut_lineage(spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id")))
    splits = lines.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(splits, ["file", "_start"]).select(
        "value", "file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line"))


def parse_log(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """L1: ``ts, level, message, program``; rule lines and blanks are dropped."""
    t = F.col(text_col)
    parsed = lines.select(
        *[c for c in lines.columns if c != text_col],
        F.to_timestamp(F.regexp_extract(t, LINE_RE, 1), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.regexp_extract(t, LINE_RE, 2).alias("level"),
        F.regexp_extract(t, LINE_RE, 3).alias("message"))
    parsed = parsed.where(F.col("level") != "")
    prog = F.regexp_extract("message", PROGRAM_RE, 1)
    return parsed.withColumn("program", F.when(prog != "", prog))


def number_batches(events: DataFrame, group_cols: list[str], ts_col: str,
                   is_start, batch_col: str = "batch", line_col: str | None = None) -> DataFrame:
    """L3: batch = number of batch starts at or before each row (per group).

    Rows are in the order of ``ts_col``; with a ``line_col`` equal stamps keep the order of
    their lines, without one they are one place: a start counts for all of them.  Rows
    carry the running count through a range partitioning; nothing is joined back.
    """
    order = [ts_col] + ([line_col] if line_col else [])
    flagged = events.withColumn("_start", F.when(is_start, 1).otherwise(0).cast("bigint"))
    flagged = flagged.withColumn("_o", F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)]))
    pos = weighted_positions(flagged, group_cols, "_o", "_start", ties=True)
    return pos.withColumn(batch_col, F.col("lo")).drop("_o", "_start", "lo")


def program_status(parsed: DataFrame, group_cols: list[str], order_cols: list[str]) -> DataFrame:
    """L2 + L4: per group: first and last stamp, duration in seconds, final level."""
    last = F.struct(*[F.col(c) for c in order_cols])
    return parsed.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
        ((F.unix_micros(F.max("ts").cast("timestamp"))
          - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("duration_s"),
        F.max_by("level", last).alias("final_status"),
        F.sum(F.when(F.col("level") == "ERROR", 1).otherwise(0)).cast("bigint")
         .alias("n_errors"))


def append_status(spark: SparkSession, path: str, program: str, level: str, message: str,
                  when: _dt.datetime | None = None) -> None:
    """K3: append one status row per program run to a ``run_log`` table."""
    when = when or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    row = [(when, level, f"{program} {message}", program)]
    df = spark.createDataFrame(row, "ts timestamp, level string, message string, "
                                    "program string")
    df.write.mode("append").parquet(path)
