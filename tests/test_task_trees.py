"""Trees grown in one task against those of Spark ML on the same rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trellis.operators import splits as S
from trellis.operators import task_trees as TT
from trellis.operators import trees as TR
from trellis.plans import q_models as Q


def _rows(spark, n, parts):
    """Rows with a feature of few values, one with zeros, one constant, and roles of two runs."""
    r = np.random.default_rng(n)
    x = np.column_stack([r.normal(size=n), r.integers(0, 5, n), np.where(r.random(n) < 0.4, 0.0, r.random(n)), np.full(n, 2.0),
                         r.integers(-300, 300, n)])
    y = np.sin(2 * x[:, 0]) * x[:, 1] + 3 * x[:, 2] + 0.01 * x[:, 4] + r.normal(0, 0.2, n)
    t, v = r.integers(0, 4, n), r.integers(0, 4, n)
    df = spark.createDataFrame([(*map(float, a), float(b), int(c), int(d), int(h)) for a, b, c, d, h in zip(
        x, y, t, v, r.integers(0, 2**32, n))], "a double, b double, c double, d double, e double, label double, "
        "test_mask long, valid_mask long, draw_hash long").repartition(parts, "draw_hash")
    return VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(df).persist()


def _gathered(rows, role, max_bins, seed, run=1):
    cuts = TT.all_cuts([TT.sampled_cuts(S.role_rows(rows, run, role), max_bins, seed)])[0]
    return TT.gathered(rows, cuts.every, "draw_hash"), cuts


def _predicted(model, rows):
    return np.array([r[0] for r in model.transform(rows).select("prediction").collect()])


@pytest.mark.parametrize("n, parts, settings", [
    (700, 1, {"max_iter": 12, "step_size": 0.2, "max_depth": 4}),
    (700, 3, {"max_iter": 8, "step_size": 0.3, "num_leaves": 8, "feature_subset": "0.8"}),
    (900, 2, {"max_iter": 6, "step_size": 0.1, "max_depth": 6, "subsampling_rate": 0.6, "min_instances": 3}),
    (40_000, 2, {"max_iter": 3, "step_size": 0.1, "max_depth": 4, "subsampling_rate": 0.8})])      # cuts of a sample
def test_boosted_trees_are_those_of_spark_ml(spark, n, parts, settings):
    rows = _rows(spark, n, parts)
    est = TR.boosted("regression", seed=43, **settings)
    model, rounds = TR.fit_boosted_early_stop(est, S.role_rows(rows, 2, "fit"), S.role_rows(rows, 2, "valid"))
    have, cuts = _gathered(rows, "fit", 32, 43, run=2)
    trees, kept = TT.fit_boosted(have, cuts, 2, TT.boosted_settings(est, 5), TR.best_rounds)
    mine = TT.score(trees, cuts.bins(have.codes[have.where(2, "test")]))
    assert kept == rounds and np.allclose(mine, _predicted(model, S.role_rows(rows, 2, "test")), rtol=1e-9, atol=1e-9)
    rows.unpersist()


def test_a_deep_tree_is_that_of_spark_ml(spark):
    rows = _rows(spark, 3000, 1)
    train = S.role_rows(rows, 1, "train")
    model = TR.forest_regressor(num_trees=1, max_depth=10, bootstrap=False).fit(train)
    have, cuts = _gathered(rows, "train", 64, 42)
    at = have.where(1, "train")
    tree = TT.grow(cuts.bins(have.codes[at]), cuts.widths, have.label[at], None, 10)
    for role in ("train", "test"):
        assert np.allclose(tree.predict(cuts.bins(have.codes[have.where(1, role)])), _predicted(model, S.role_rows(rows, 1, role)), rtol=1e-9)
    rows.unpersist()


def test_trees_of_odd_rows():
    one = np.zeros((4, 1), np.uint8)
    assert TT.grow(one, [1], np.arange(4.0), None, 3).predict(one).tolist() == [1.5] * 4               # nothing to split by
    assert TT.grow(one, [1], np.arange(4.0), np.array([0, 0, 1, 3]), 3).value[0] == 2.75
    assert TT.grow(one, [1], np.arange(4.0), np.zeros(4, np.uint8), 3).value[0] == 0.0                 # no row drawn
    two = np.array([[0], [0], [1], [1]], np.uint8)
    assert TT.grow(two, [2], np.array([5.0, 5.0, 5.0, 5.0]), None, 3).feature.tolist() == [-1]         # no gain
    assert TT.grow(two, [2], np.array([1.0, 1.0, 7.0, 7.0]), None, 3).predict(two).tolist() == [1.0, 1.0, 7.0, 7.0]
    assert TT.thresholds(np.array([3.0, 3.0]), 2, 32).tolist() == [] and TT.thresholds(np.array([1.0, 0.0, 2.0]), 3, 32).tolist() == [0.5, 1.5]


def test_bootstrap_draws_are_of_the_row():
    h = np.random.default_rng(1).integers(0, 2**32, 200_000).astype(np.uint32)
    a, b = TT.bootstrap(h, 4200), TT.bootstrap(h, 4201)
    assert abs(a.mean() - 1) < 0.01 and abs(a.var() - 1) < 0.02 and abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert abs((a == 0).mean() - np.exp(-1)) < 0.005 and abs((a == 3).mean() - np.exp(-1) / 6) < 0.003
    assert (TT.bootstrap(h[::-1], 4200) == a[::-1]).all()


def _tables(spark, folder, parts=400):
    r = np.random.default_rng(5)
    spark.createDataFrame([(i, int(r.integers(1, 51)), float(r.integers(900, 1000))) for i in range(parts)],
                          "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    spark.range(parts * 8).select((F.col("id") % parts).alias("l_partkey"), (F.rand(1) * 50 + 1).cast("int").cast("double").alias("l_quantity"),
                                  (F.rand(2) / 10).alias("l_discount"), (F.rand(3) / 10).alias("l_tax"),
                                  (F.rand(4) * 9000 + 900).alias("l_extendedprice")).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def _jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_boosted_fits_take_no_job_a_level(spark, tmp_path):
    before = _jobs(spark)
    rows = Q.boosted_regression(spark, _tables(spark, tmp_path)).collect()
    assert _jobs(spark) - before < 300                     # 60 fits of 30 rounds of 3 or 4 levels
    assert sorted((r["model"], r["run"]) for r in rows) == sorted((m, r) for m in Q.BOOSTED for r in range(1, 31))
    assert all(1 <= r["rounds"] <= 30 and r["rmse"] > 0 for r in rows)


def test_trials_take_a_job_each(spark, tmp_path):
    before = _jobs(spark)
    rows = Q.search_best_trial(spark, _tables(spark, tmp_path)).collect()
    assert len(rows) == 100 and _jobs(spark) - before < 300
    assert sum(r["best_by"].count("rmse_test") for r in rows) == 2


def test_large_forests_take_no_job_a_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "FOREST", {"num_trees": 20, "max_depth": 6})
    folder = _tables(spark, tmp_path)
    small = {r["run"]: r for r in Q.forest_regression(spark, folder).collect()}
    monkeypatch.setattr(Q, "PART_ROWS", (100, 1_000_000))
    before = _jobs(spark)
    large = {r["run"]: r for r in Q.forest_regression(spark, folder).collect()}
    assert _jobs(spark) - before < 150
    assert sorted(large) == sorted(small) == list(range(1, 31))
    assert all(large[r]["n"] == small[r]["n"] and large[r]["rounds"] is None for r in large)
    rmse = lambda rows: np.mean([r["rmse"] for r in rows.values()])
    assert 0.97 < rmse(large) / rmse(small) < 1.03
