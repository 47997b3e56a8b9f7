"""End-to-end comparison on small synthetic tables (few runs, small models)."""

from pyspark.sql import functions as F

from trellis.plans import scenarios as SC


def test_extrapolation_scenario_small(spark):
    out = SC.extrapolation(spark, runs=2, n=500, forest={"num_trees": 10, "max_depth": 6},
                           boosted={"max_iter": 5, "max_depth": 2})
    res = out["results"].toPandas()
    assert set(res["model"]) == {"Linear Regression", "Ridge", "Lasso", "Random Forest",
                                 "Boosted Trees"}
    assert len(res) == 10
    s = out["summary"].toPandas().set_index("model")
    # lines extrapolate, trees stay flat: linear test RMSE is lower
    assert s.loc["Linear Regression", "rmse_mean"] < s.loc["Random Forest", "rmse_mean"]
    assert out["test"].count() == 1


def test_linearity_scenario_linear_only(spark):
    from trellis.plans.compare import compare
    from trellis.sources import synthetic as SY
    df = SY.linear_table(spark, n=400, p=6, informative=4, rank=3)
    feats = [c for c in df.columns if c.startswith("feature_")]
    out = compare(df, feats, runs=2, test_pair=("Lasso", "Ridge"))
    r = out["results"].where(F.col("model") == "Linear Regression").toPandas()
    assert (r["r2"] > 0).all()


def test_interpretability_scenario_small(spark):
    out = SC.interpretability(spark, runs=2, n=300, forest={"num_trees": 5, "max_depth": 4},
                              boosted={"max_iter": 5, "max_depth": 2})
    res = out["results"].toPandas()
    assert len(res) == 8 and res["roc_auc"].between(0, 1).all()
    s = out["summary"].toPandas().set_index("model")
    # informative features shift by class: logistic AUC well above chance
    assert s.loc["Logistic Regression (L2)", "roc_auc_mean"] > 0.8
    coefs = out["coefficients"].toPandas()
    assert len(coefs) == 10 + 10 * 3 and coefs["coefficient"].is_monotonic_decreasing
    assert out["test"].count() == 1


def test_compare_timings_table(spark):
    from trellis.plans.compare import compare
    from trellis.sources import synthetic as SY
    df = SY.friedman1(spark, n=300)
    feats = [c for c in df.columns if c.startswith("feature_")]
    out = compare(df, feats, runs=2, forest={"num_trees": 3, "max_depth": 3},
                  test_pair=("Random Forest", "Lasso"), explain=True)
    t = out["timings"].toPandas()
    assert set(t["phase"]) == {"train", "inference", "explanation"}
    assert (t["seconds"] >= 0).all() and len(t[t["model"] == "Random Forest"]) == 6
    assert sorted(t[t["model"] == "all linear models"]["phase"]) == ["explanation", "inference", "train"]


def test_compare_custom_estimator(spark):
    from pyspark.ml.regression import DecisionTreeRegressor
    from trellis.plans.compare import compare
    from trellis.sources import synthetic as SY
    df = SY.friedman1(spark, n=300)
    feats = [c for c in df.columns if c.startswith("feature_")]
    out = compare(df, feats, runs=2, linear=("ols",), test_pair=("Linear Regression", "Tree"),
                  custom={"Tree": DecisionTreeRegressor(maxDepth=4)})
    res = out["results"].toPandas()
    assert set(res["model"]) == {"Linear Regression", "Tree"} and len(res) == 4


def test_small_sample_scenario_wide(spark):
    from trellis.operators.linear import logspace_alphas
    out = SC.small_sample(spark, runs=2, n=50, p=60, forest={"num_trees": 3, "max_depth": 3},
                          boosted={"max_iter": 3, "max_depth": 2},
                          alphas=logspace_alphas(-1, 3, 12))
    s = out["summary"].toPandas().set_index("model")
    # least squares interpolates the training rows when features outnumber rows
    assert s.loc["Linear Regression", "rmse_train_mean"] < 1e-3
    assert s.loc["Linear Regression", "overfitting_mean"] > 100
