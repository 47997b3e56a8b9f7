"""What one task, one job or the driver gets stays bounded where the tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.operators import explain as X
from trellis.operators import leaves as LV
from trellis.operators import splits as S
from trellis.plans import q_models


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_rows_meet_their_feature_by_broadcast(spark):
    """Also where Spark knows no size: a join by feature leaves all rows to one task a feature."""
    phi = spark.range(200).select(F.array(F.lit("a"), F.lit("b"))[(F.col("id") % 2).cast("int")].alias("feature"),
                                  F.col("id").cast("double").alias("value"), (F.col("id") % 7).cast("double").alias("phi"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = X.contribution_spread(phi)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [feature" in plan
        assert out.agg(F.sum("n")).first()[0] == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_parts_of_fitted_rows_follow_the_cores(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    if cores < 2:
        pytest.skip("one core")
    rows = spark.range(40 * cores, numPartitions=4 * cores)
    for bounds, parts in (((10, 1_000_000), max(1, cores // 2)), ((10, 10), 4 * cores), ((50_000, 1_000_000), 1)):
        monkeypatch.setattr(q_models, "PART_ROWS", bounds)
        out = q_models._small(rows)
        assert out.rdd.getNumPartitions() == parts and out.count() == 40 * cores
        out.unpersist()


@pytest.mark.parametrize("cells", [10, 10_000])
def test_distinct_counts_like_a_sort(monkeypatch, cells):
    monkeypatch.setattr(LV, "CELLS", cells)
    keys = np.random.default_rng(3).integers(0, 50, 400) * 3
    for some in (keys, keys[:0]):
        for got, want in zip(LV.distinct(some, 200), np.unique(some, return_inverse=True, return_counts=True)):
            assert (got == want).all()


def test_patterns_are_counted_without_a_sort(spark, monkeypatch):
    """A background of many rows is counted; sorting (leaf, pattern) pairs took most of the time."""
    from pyspark.ml.functions import array_to_vector
    leaves = LV.Model([{"value": 1.0, "conditions": [(0, -np.inf, 2.0, 0.5, None), (1, 1.0, np.inf, 0.5, None)]},
                       {"value": 2.0, "conditions": [(0, 2.0, np.inf, 0.5, None)]}, {"value": 3.0, "conditions": []}], 2)
    d = spark.range(100).select(array_to_vector(F.array((F.col("id") % 5).cast("double"), (F.col("id") % 3).cast("double"))).alias("features"))
    got = {(r["leaf"], r["pattern"]): r["n"] for r in LV.background_patterns(d, leaves).collect()}
    want: dict = {}
    for k in range(100):
        a, b = k % 5, k % 3
        for key in ((0, (a <= 2) + 2 * (b > 1)), (1, int(a > 2)), (2, 0)):
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_masks_of_all_runs_are_compiled(spark):
    d = S.add_key_hash(spark.range(60).select((F.col("id") % 20).alias("k"), F.col("id").alias("v")), "k")
    for masked in (d.withColumn("m", S.draw_mask("key_hash", 5, 0.2)), S.exact_mask(d, "key_hash", "k", 0.2, 5)):
        assert "lambda" not in _plan(masked)
    test = S.exact_mask(d, "key_hash", "k", 0.2, 5).select("k", "key_hash", S.runs_of("test_mask", 5).alias("run"))
    assert {r["run"]: r["count"] for r in test.groupBy("run").count().collect()} == {k: 12 for k in range(1, 6)}


def test_repeated_keys_are_joined_before_runs(spark, tmp_path):
    """Lines are copied once a run only after those of a key became one row; a cut key, null
    keys and null flags count as rows ranked one by one do."""
    from trellis.plans.q_holdout import exact_split_repeated_keys
    rows = [(1 + k % 7, k, 1, 1, "A") for k in range(70)] + [(None, k, 1, 1, "A") for k in range(9)] + [(5, k, 1, 1, None) for k in range(11)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = exact_split_repeated_keys(spark, str(tmp_path))
    assert out.columns == ["run", "l_returnflag", "n_rows", "n_test", "test_key_sum", "keys_on_both_sides"]
    got = {(r["run"], r["l_returnflag"]): tuple(r)[2:] for r in out.collect()}
    split = S.exact_split(S.with_runs(S.add_key_hash(li, "l_orderkey"), 30), "key_hash", "l_orderkey", 0.2, "seed", by=["run", "l_returnflag"])
    want: dict = {}
    for r in split.collect():
        key = want.setdefault((r["run"], r["l_returnflag"]), {}).setdefault(r["l_orderkey"], [0, 0])
        key[0] += 1
        key[1] += r["role"] == "test"
    assert got == {g: (sum(n for n, _ in k.values()), sum(t for _, t in k.values()), sum(t * (o or 0) for o, (_, t) in k.items()),
                       sum(0 < t < n for n, t in k.values())) for g, k in want.items()}
