"""Run-log parsing."""

import os
import tempfile

from pyspark.sql import functions as F

from trellis.sources import runlog as RL

LOG_A = """==================================================
[2025-01-02 10:00:00] INFO: batch started
==================================================
[2025-01-02 10:00:00] INFO: exp_a.py started
[2025-01-02 10:05:30] SUCCESS: exp_a.py finished
[2025-01-02 10:05:30] INFO: exp_b.py started
[2025-01-02 10:06:10] ERROR: exp_b.py failed
"""
LOG_B = """[2025-01-02 10:06:10] INFO: exp_c.py started
[2025-01-02 11:06:10] SUCCESS: exp_c.py finished
"""


def _write(d, name, text):
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_parse_and_durations(spark):
    d = tempfile.mkdtemp(prefix="trellis-log-")
    _write(d, "a.log", LOG_A + LOG_B)
    parsed = RL.parse_log(RL.read_log(spark, d))
    st = RL.program_status(parsed.where(F.col("program").isNotNull()), ["program"], ["ts"])
    got = {r["program"]: (r["duration_s"], r["final_status"]) for r in st.collect()}
    assert got == {"exp_a.py": (330.0, "SUCCESS"), "exp_b.py": (40.0, "ERROR"),
                   "exp_c.py": (3600.0, "SUCCESS")}


def test_lines_are_numbered_over_splits_and_files(spark):
    d = tempfile.mkdtemp(prefix="trellis-log-")
    texts = {"a.log": [f"line {k} {'x' * (k % 37)}" for k in range(4000)], "b.log": ["one", "", "three"]}
    for name, lines in texts.items():
        _write(d, name, "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = RL.read_log(spark, d).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in rows:
        got.setdefault(os.path.basename(r["file"]), {})[r["line"]] = r["value"]
    assert {n: [got[n][k] for k in range(len(got[n]))] for n in got} == texts


def test_equal_stamps_keep_their_order(spark):
    d = tempfile.mkdtemp(prefix="trellis-log-")
    _write(d, "a.log", LOG_A + LOG_A + LOG_B)               # the second run has the stamps of the first
    parsed = RL.parse_log(RL.read_log(spark, d)).withColumn("g", F.lit(1))
    start = F.col("message") == "batch started"
    # all in one file, lines in order: the file's order is the order
    by_line = RL.number_batches(parsed, ["g"], "line", start)
    got = [(r["line"], r["batch"]) for r in by_line.orderBy("line").collect()]
    assert [b for _, b in got] == [1] * 5 + [2] * 7
    # by stamp, then line: lines of a stamp follow each other, a later start does not reach back
    by_ts = RL.number_batches(parsed, ["g"], "ts", start, line_col="line")
    rows = sorted((r["ts"], r["line"], r["batch"], r["message"] == "batch started") for r in by_ts.collect())
    count = 0
    for _, _, batch, first in rows:
        count += first
        assert batch == count
    # by stamp alone a start counts for all lines of its stamp
    rows = RL.number_batches(parsed, ["g"], "ts", start).collect()
    first = min(r["ts"] for r in rows)
    assert {r["batch"] for r in rows if r["ts"] == first} == {2}
