"""``compare()``: repeated-holdout comparison of models on one table.

One long prediction table ``(run, model, role, label, prediction)`` sits in the
middle.  Linear models for all runs come from grouped sufficient statistics
(one aggregate for OLS; fold sums for the ridge / lasso CV paths); tree models
are Spark ML fits per run.  Downstream everything is a grouped query: metrics by
``(run, model)``, mean and deviation by model, and a paired signed-rank test.

The presets in :mod:`trellis.plans.scenarios` call this with the five
experiments' tables and model catalogues.
"""

from __future__ import annotations

import time

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators import explain as X
from trellis.operators import leaves as LV
from trellis.operators import linear as L
from trellis.operators import metrics as M
from trellis.operators import paired as P
from trellis.operators import splits as S
from trellis.operators import summary as U
from trellis.operators import trees as TR
from trellis.operators.timing import timing_table, written
from trellis.session import cut_lineage

BOOSTED = "Boosted Trees"
LINEAR_MODELS = {"Linear Regression": "ols", "Ridge": "ridge", "Lasso": "lasso"}


def prepare(df: DataFrame, key: str, runs: int, test_frac: float = 0.2,
            valid_frac: float = 0.2, folds: int = 5, predicate=None) -> DataFrame:
    """Roles ``fit / valid / test`` (or a predicate split) and CV folds per run."""
    d = S.add_key_hash(df, key)
    d = S.add_key_hash(d, key, "valid_hash", salt="valid")
    d = S.add_key_hash(d, key, "fold_hash", salt="fold")
    d = S.with_runs(d, runs)
    if predicate is not None:     # test = outside the predicate; valid cut from inside
        from trellis.functions.random import TWO32, seeded_hash
        d = d.withColumn("role", F.when(~predicate, "test")
                         .when(seeded_hash("valid_hash", "seed") < F.lit(valid_frac * TWO32),
                               "valid").otherwise("fit"))
    else:
        d = S.nested_holdout(d, "key_hash", "valid_hash", test_frac, valid_frac, "seed")
    return S.kfold(d, "fold_hash", folds, "seed")


def linear_predictions(d: DataFrame, features: list[str], label: str,
                       models: list[str], alphas: list[float]) -> DataFrame:
    """All runs of OLS / ridge / lasso from sums of the training rows (fit+valid)."""
    train = d.where(F.col("role") != "test")
    p = len(features)
    fits = []
    if "ols" in models:
        fits.append(L.ols_qr(train, features, label, ["run"]).withColumn("model", F.lit("Linear Regression")))
    if "ridge" in models or "lasso" in models:
        fold_sums = L.sums(train, features, label, ["run", "fold"])
        for kind, name in (("ridge", "Ridge"), ("lasso", "Lasso")):
            if kind in models:
                f = L.cv_fit(fold_sums, p, ["run"], alphas, kind).drop("alpha")
                fits.append(f.withColumn("model", F.lit(name)))
    allfits = fits[0]
    for f in fits[1:]:
        allfits = allfits.unionByName(f)
    # runs x models coefficient rows: bounded; fitted once (timed), then broadcast
    spark = d.sparkSession
    t0 = time.perf_counter()
    allfits = spark.createDataFrame(allfits.collect(), allfits.schema)
    secs = time.perf_counter() - t0
    pred = d.join(F.broadcast(allfits), "run").withColumn(
        "prediction", L.linear_prediction(features))
    out = pred.select("run", "model", "role", F.col(label).alias("label"), "prediction")
    return out, allfits, secs


def tree_rows(df: DataFrame, features: list[str], label: str, key: str, runs: int, test_frac: float = 0.2,
              valid_frac: float = 0.2, predicate=None) -> DataFrame:
    """(features, label, test_mask, valid_mask): the roles of :func:`prepare` for all runs as
    two bits a run, so that one copy of the rows serves all fits."""
    d = S.add_key_hash(df, key)
    d = S.add_key_hash(d, key, "valid_hash", salt="valid")
    every = F.lit((1 << runs) - 1).cast("bigint")
    test = S.draw_mask("key_hash", runs, test_frac) if predicate is None else F.when(predicate, F.lit(0).cast("bigint")).otherwise(every)
    d = d.withColumn("test_mask", test).withColumn("valid_mask", S.draw_mask("valid_hash", runs, valid_frac))
    d = VectorAssembler(inputCols=features, outputCol="features").transform(d.withColumnRenamed(label, "label"))
    return d.select("features", "label", "test_mask", "valid_mask")


def tree_predictions(data: DataFrame, features: list[str], runs: int, forest: dict | None, boosted: dict | None,
                     timings: list, custom: dict | None = None, explain: bool = False) -> DataFrame:
    """Fits per run on ``data`` of :func:`tree_rows`, which is materialised and released here;
    fit, scoring and, if ``explain``, explanation seconds go to ``timings``."""
    data = data.persist()
    data.count()
    spark = data.sparkSession

    def fit_one(args):
        run, kind = args
        t0 = time.perf_counter()
        if kind in (custom or {}):          # N3: any Spark ML estimator, fit on train rows
            model, name = custom[kind].copy().fit(S.role_rows(data, run, "train")), kind
        elif kind == "forest":
            model = TR.forest_regressor(seed=41 + run, **(forest or {})).fit(S.role_rows(data, run, "train"))
            name = "Random Forest"
        else:
            est = TR.boosted("regression", seed=41 + run, **(boosted or {}))
            model, _ = TR.fit_boosted_early_stop(est, S.role_rows(data, run, "fit"), S.role_rows(data, run, "valid"))
            name = BOOSTED
        timings.append((run, name, "train", time.perf_counter() - t0))
        test = S.role_rows(data, run, "test")
        timings.append((run, name, "inference", written(model.transform(test).select("prediction"))))
        if explain and kind in ("forest", "boosted"):
            timings.append((run, name, "explanation", written(LV.explain_path_dependent(test, model, features, []))))
        role = F.when(S.in_mask("test_mask", run), "test").when(S.in_mask("valid_mask", run), "valid").otherwise("fit")
        scored = model.transform(data).select(F.lit(run).cast("bigint").alias("run"), F.lit(name).alias("model"),
                                              role.alias("role"), "label", "prediction")
        return cut_lineage(scored)           # written at once, so the rows can be released

    kinds = [k for k, cfg in (("forest", forest), ("boosted", boosted)) if cfg is not None]
    kinds += list(custom or {})
    outs = TR.fit_per_run([(r, k) for r in range(1, runs + 1) for k in kinds], fit_one)
    data.unpersist()
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def compare(df: DataFrame, features: list[str], label: str = "label", key: str = "row_id",
            runs: int = 30, linear=("ols", "ridge", "lasso"), forest: dict | None = None,
            boosted: dict | None = None, alphas: list[float] | None = None,
            predicate=None, test_pair=("Lasso", "Boosted Trees"), metric: str = "r2",
            alternative: str = "greater", custom: dict | None = None, explain: bool = False) -> dict[str, DataFrame]:
    """Returns ``predictions``, ``results`` (run x model metrics, train and test),
    ``summary`` (mean / std by model), ``test`` (signed-rank on ``metric``) and
    ``timings``.  ``custom`` maps a model name to any Spark ML estimator reading
    ``features`` / ``label``; it is fitted per run like the forest.  ``explain`` also times
    the explanation of each model's test rows."""
    alphas = alphas or L.logspace_alphas()
    t0 = time.time()
    d = prepare(df, key, runs, predicate=predicate)
    preds = []
    timings: list = []
    if linear:
        lin, fits, secs = linear_predictions(d, features, label, list(linear), alphas)
        preds.append(lin)
        # one grouped job fits all runs and models: one row, under run 0
        every = "all linear models"
        timings.append((0, every, "train", secs))
        timings.append((0, every, "inference", written(lin.where(F.col("role") == "test"))))
        if explain:
            means = d.where(F.col("role") != "test").groupBy("run").agg(*[F.avg(f).alias(f) for f in features])
            models = fits.join(means.select("run"), "run")
            phi = X.linear_contributions(d.where(F.col("role") == "test"), models, means, features, ["run"])
            timings.append((0, every, "explanation", written(phi)))
    if forest is not None or boosted is not None or custom:
        preds.append(tree_predictions(tree_rows(df, features, label, key, runs, predicate=predicate), features, runs,
                                      forest, boosted, timings, custom, explain))
    pred = preds[0]
    for p in preds[1:]:
        pred = pred.unionByName(p)
    # Boosted models train on the fit rows only, the others on fit and valid rows
    stopped = (F.col("model") == BOOSTED) & (F.col("role") == "valid")
    scored = pred.where(~stopped).withColumn(
        "role", F.when(F.col("role") == "test", "test").otherwise("train"))
    results = M.train_test_metrics(scored, ["run", "model"])
    test_metrics = M.regression_metrics(scored.where(F.col("role") == "test"),
                                        ["run", "model"])
    results = results.join(test_metrics.select("run", "model", "rmse", "mae", "r2"),
                           ["run", "model"])
    summary = U.summarize(results, ["rmse", "mae", "r2", "rmse_train", "overfitting"],
                          ["model"], None)
    a, b = test_pair
    diffs = P.paired_differences(results, ["run"], "model", metric, a, b)
    test = P.signed_rank(diffs.withColumn("test", F.lit(f"{a} vs {b}")), ["test"], "d",
                         alternative)
    test = test.drop("_max_tie")
    return {"predictions": pred, "results": results, "summary": summary, "test": test,
            "timings": timing_table(df.sparkSession, timings),
            "setup_seconds": time.time() - t0}
