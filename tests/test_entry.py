"""The driver contract without the training-data subpackage, and the paired guard."""

import importlib.util

from pyspark.sql import functions as F

import __spark_entry__ as E
from trellis.operators import paired as P


def test_entry_works_without_the_training_data_parts(monkeypatch):
    real = importlib.util.find_spec
    hidden = lambda name, *a: None if name.startswith(("trellis.llm", "corpus_pipeline")) else real(name, *a)
    whole = set(E.queries())
    monkeypatch.setattr(importlib.util, "find_spec", hidden)
    assert {"holdout_compare", "signed_rank"} <= set(E.queries()) <= whole
    assert not [q for q in E.queries() if q.startswith("op") or q == "pipeline"]


def _runs(spark, a: int, b: int):
    rows = [(r, "A", 1.0 + r) for r in range(a)] + [(r, "B", 0.5 * r) for r in range(b)]
    return spark.createDataFrame(rows, "run int, model string, rmse double")


def test_paired_guard(spark):
    for a, b, tested in ((30, 30, True), (30, 20, False), (1, 1, False), (0, 5, False)):
        d = P.paired_differences(_runs(spark, a, b), ["run"], "model", "rmse", "A", "B")
        r = P.signed_rank(d.withColumn("t", F.lit(1)), ["t"]).first()
        assert (r["p_value"] is not None) == (r["z"] is not None) == tested
        assert r["n_pairs"] == min(a, b)


def test_exact_tail_against_enumeration(spark):
    from itertools import product
    for n in (1, 2, 5, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product((0, 1), repeat=n)]
        top = n * (n + 1) // 2
        df = spark.range(top + 1).select(F.lit(n).alias("n"), F.col("id").cast("double").alias("w"))
        for r in df.withColumn("p", P.exact_sf(F.col("n"), F.col("w"))).collect():
            want = sum(s >= r["w"] for s in sums) / len(sums)
            assert abs(r["p"] - want) < 1e-12 and abs(P.exact_upper_tail(n, r["w"]) - want) < 1e-12
