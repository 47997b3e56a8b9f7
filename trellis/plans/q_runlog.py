"""Registered query: run-log analytics over an event table read as a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.plans.registry import query, rounded
from trellis.plans.sqlbits import r6
from trellis.session import table
from trellis.sources import runlog as RL

PROGRAM_SQL = f"""
WITH e AS (
  SELECT user_id, event_id, ts,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'SUCCESS' ELSE 'INFO' END
           AS level,
         CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS s
  FROM events),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts
                             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS batch FROM e),
l AS (SELECT user_id, batch, level AS final_status FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, batch ORDER BY ts DESC, event_id DESC)
          AS rn FROM b) WHERE rn = 1)
SELECT user_id, CAST(batch AS BIGINT) AS batch, count(*) AS n_lines,
       {r6('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6', 'duration_s')}, final_status,
       CAST(sum(CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors
FROM b JOIN l USING (user_id, batch) GROUP BY user_id, batch, final_status
"""


@query("program_durations", PROGRAM_SQL)
def program_durations(spark, sf_dir):
    """L1-L4 on events read as a log: a signup opens a new batch per user; per
    batch the duration, final status (error / success / info) and error count."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    lines = ev.select("user_id", "event_id", "ts",
                      F.when(F.col("event_type") == "error", "ERROR")
                      .when(F.col("event_type") == "purchase", "SUCCESS")
                      .otherwise("INFO").alias("level"), "event_type")
    numbered = RL.number_batches(lines, ["user_id"], "ts", F.col("event_type") == "signup")
    st = RL.program_status(numbered, ["user_id", "batch"], ["ts", "event_id"])
    return rounded(st.select("user_id", "batch", "n_lines", "duration_s", "final_status",
                             "n_errors"))
