"""Tree ensembles on Spark ML (M6-M12) and the seeded trial search.

Forests and boosted models are Spark ML estimators: each fit is a distributed
job over the rows (histogram aggregation per tree level).  Runs are independent,
so a small driver thread pool submits the runs' fits concurrently.

Early stopping with patience (M12): fit ``max_iter`` boosting rounds on the
``fit`` rows, read the validation loss after every round with
``evaluateEachIteration`` (one pass), keep the best round with a patience of 10:
the model of the first rounds' trees and weights, with no second fit.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.random import uniform


def forest_regressor(num_trees: int = 100, max_depth: int = 30, seed: int = 42,
                     max_bins: int = 64, **kw) -> RandomForestRegressor:
    """M6: all features considered at every split (the regression default)."""
    return RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                 featureSubsetStrategy="all", maxBins=max_bins,
                                 labelCol="label", featuresCol="features", **kw)


def forest_classifier(num_trees: int = 100, max_depth: int = 30, seed: int = 42,
                      max_bins: int = 64, **kw) -> RandomForestClassifier:
    """M7: square-root feature sampling at every split."""
    return RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                  featureSubsetStrategy="sqrt", maxBins=max_bins,
                                  labelCol="label", featuresCol="features", **kw)


def boosted(kind: str = "regression", max_iter: int = 100, step_size: float = 0.1,
            max_depth: int = 6, subsampling_rate: float = 1.0, min_instances: int = 1,
            feature_subset: str = "all", seed: int = 42, num_leaves: int | None = None):
    """M8-M11.  A leaf-count limit maps to depth ``min(max_depth, ceil(log2 leaves))``."""
    if num_leaves:
        max_depth = max(1, min(max_depth, math.ceil(math.log2(max(2, int(num_leaves))))))
    cls = GBTRegressor if kind == "regression" else GBTClassifier
    return cls(maxIter=max_iter, stepSize=step_size, maxDepth=max_depth,
               subsamplingRate=subsampling_rate, minInstancesPerNode=min_instances,
               featureSubsetStrategy=feature_subset, seed=seed, labelCol="label",
               featuresCol="features")


def best_rounds(losses: list[float], patience: int = 10) -> int:
    """Number of rounds to keep: best validation loss, stop after ``patience``
    rounds without improvement."""
    best, best_i = float("inf"), -1
    for i, v in enumerate(losses):
        if v < best:
            best, best_i = v, i
        elif i - best_i >= patience:
            break
    return best_i + 1


def fit_boosted_early_stop(est, fit_rows: DataFrame, valid_rows: DataFrame,
                           patience: int = 10):
    """Returns ``(model, rounds)`` after the patience rule on validation loss."""
    model = est.fit(fit_rows)
    if isinstance(est, GBTRegressor):
        losses = model.evaluateEachIteration(valid_rows, "squared")
    else:
        losses = model.evaluateEachIteration(valid_rows)
    k = best_rounds(list(losses), patience)
    return (model if k >= model.getNumTrees else first_rounds(model, k)), k


def first_rounds(model, k: int):
    """The boosted model of the first ``k`` trees of ``model`` and their weights."""
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.regression import GBTRegressionModel
    gateway, java = SparkContext._active_spark_context._gateway, model._java_obj
    trees, weights = java.trees(), java.treeWeights()
    kind = gateway.jvm.java.lang.Class.forName(trees.getClass().getComponentType().getName())
    some = gateway.jvm.java.lang.reflect.Array.newInstance(kind, k)
    for i in range(k):
        some[i] = trees[i]
    own = gateway.new_array(gateway.jvm.double, k)
    for i in range(k):
        own[i] = weights[i]
    regression = isinstance(model, GBTRegressionModel)
    java_class = (gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel if regression
                  else gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel)
    part = java_class(java.uid(), some, own)
    part = java.copyValues(part, java.extractParamMap())
    return (GBTRegressionModel if regression else GBTClassificationModel)(part)


def fit_per_run(runs: list, fit_one, threads: int = 4) -> list:
    """Fit one model per run from a small driver thread pool (independent jobs)."""
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(runs)))) as pool:
        return list(pool.map(fit_one, runs))


# ---------------------------------------------------------------- search

def trial_table(spark, n_trials: int, space: dict, seed: int = 42) -> DataFrame:
    """Seeded trials from ``spark.range``: one hashed uniform per (trial, parameter).

    ``space`` maps a name to ``("int", lo, hi)``, ``("float", lo, hi)``,
    ``("log", lo, hi)`` or ``("cat", [choices])``.
    """
    df = spark.range(n_trials).withColumnRenamed("id", "trial")
    for name, spec in space.items():
        u = uniform("trial", F.lit(seed), F.lit(name))
        kind = spec[0]
        if kind == "int":
            lo, hi = spec[1], spec[2]
            col = (F.lit(lo) + F.floor(u * (hi - lo + 1))).cast("int")
        elif kind == "float":
            col = F.lit(float(spec[1])) + u * (float(spec[2]) - float(spec[1]))
        elif kind == "log":
            a, b = math.log(spec[1]), math.log(spec[2])
            col = F.exp(F.lit(a) + u * (b - a))
        else:
            choices = spec[1]
            col = F.element_at(F.array(*[F.lit(c) for c in choices]),
                               (F.floor(u * len(choices)) + 1).cast("int"))
        df = df.withColumn(name, col)
    return df


def search(spark, spaces: dict[str, dict], n_trials: int, losses, threads: int = 4, seed: int = 42,
           folder: str | None = None) -> DataFrame:
    """``n_trials`` seeded trials of each flavour of ``spaces``, scored by
    ``losses(flavour, params) -> {name: number}``: (flavour, trial, one column a parameter,
    one a loss).

    Trials are few and each is a distributed fit; they run from a small pool.  With a
    ``folder`` in shared storage every finished trial is written there at once, and a search
    that is started again takes up those it finds, so a lost driver costs the trials under
    way only and the winner is the same.
    """
    jobs = []
    for flavour, space in spaces.items():
        for r in trial_table(spark, n_trials, space, seed).collect():                  # n_trials rows
            jobs.append((flavour, {k: v for k, v in r.asDict().items()}))
    done = {}
    if folder and _exists(spark, folder):
        done = {(r["flavour"], r["trial"]): json.loads(r["losses"]) for r in spark.read.parquet(f"{folder}/*").collect()}

    def one(job):
        flavour, params = job
        key = (flavour, params["trial"])
        if key in done:
            return done[key]
        found = losses(flavour, params)
        if folder:
            spark.createDataFrame([(flavour, params["trial"], json.dumps(found))], "flavour string, trial bigint, losses string").coalesce(
                1).write.mode("overwrite").parquet(f"{folder}/{len(key[0])}-{key[0].replace(' ', '_')}-{key[1]}")
        return found

    found = fit_per_run(jobs, one, threads)
    names = sorted({k for _, p in jobs for k in p if k != "trial"})
    scores = list(found[0]) if found else []
    rows = [(flavour, int(p["trial"]), *[None if p.get(k) is None else float(p[k]) for k in names], *[float(f[k]) for k in scores])
            for (flavour, p), f in zip(jobs, found)]
    return spark.createDataFrame(rows, ", ".join(["flavour string", "trial bigint", *[f"`{k}` double" for k in [*names, *scores]]]))


def _exists(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def best_trial(scored: DataFrame) -> DataFrame:
    """The trial with the smallest loss (ties to the lowest trial id)."""
    params = [c for c in scored.columns if c not in ("loss",)]
    best = scored.agg(F.min_by(F.struct(*params), F.struct("loss", "trial")).alias("b"))
    return best.select("b.*")
