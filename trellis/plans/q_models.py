"""Registered queries whose fits are iterative (logistic Newton steps, tree
ensembles, trial search, tree explanations).  They have no SQL twin; the driver
checks rows, and tests/ check laws (convergence, additivity, patience rule)."""

from __future__ import annotations

from functools import reduce
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.random import hash32
from trellis.operators import explain as X
from trellis.operators import leaves as LV
from trellis.operators import logistic as LG
from trellis.operators import metrics as M
from trellis.operators import splits as S
from trellis.operators import task_trees as TT
from trellis.operators import trees as TR
from trellis.operators.features import levels
from trellis.plans.registry import query, rounded
from trellis.session import cut_lineage, table

RUNS = 30
#: one forest of 100 trees without a depth limit over 16,000 rows takes minutes in Spark ML,
#: which makes a pass for each group of nodes; the README has the figures
FOREST = {"num_trees": 100, "max_depth": 10}
#: two boosted flavours: trees bounded by depth, and by leaves with a part of the features a split
BOOSTED = {"Boosted Trees (depth)": {"max_iter": 30, "step_size": 0.2, "max_depth": 4},
           "Boosted Trees (leaves)": {"max_iter": 30, "step_size": 0.2, "num_leaves": 8, "feature_subset": "0.8"}}
#: fits submitted at a time
THREADS = 6
#: rows of a part: at least, and at most once the parts are half as many as cores
PART_ROWS = (50_000, 1_000_000)


def _doc_rows(spark, sf_dir):
    """Labelled rows with the test mask of all runs, and the names of their features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    langs = levels(docs, "lang")
    j = docs.join(labels, "doc_id").select(
        "doc_id", "label", F.log1p(F.col("n_chars").cast("double")).alias("log_chars"),
        *[F.coalesce((F.col("lang") == x).cast("double"), F.lit(0.0)).alias(f"lang_{x}")
          for x in langs])
    j = j.withColumn("key_hash", hash32(F.col("doc_id")))
    rows = S.exact_mask(j, "key_hash", "doc_id", 0.2, RUNS, by=["label"])
    return rows, ["log_chars", *[f"lang_{x}" for x in langs]]


def _logistic(spark, sf_dir, penalty: str, name: str):
    rows, features = _doc_rows(spark, sf_dir)
    rows = cut_lineage(rows)                                 # one row a document, whatever the runs
    fits = LG.fit_logistic_runs(rows, features, "label", RUNS, "test_mask", penalty)
    test = LG.predict_logistic(rows.select("label", *features, S.runs_of("test_mask", RUNS).alias("run")), fits, features, ["run"])
    cm = M.classification_metrics(test, ["run"])
    auc = M.roc_auc(test, ["run"], "label", "probability")
    out = cm.join(auc, "run").join(fits.select("run", "converged"), "run").select(
        F.lit(name).alias("model"), "run", "n", "accuracy", "f1", "roc_auc", "brier", "converged")
    return rounded(out)


@query("logistic_l2")
def logistic_l2(spark, sf_dir):
    """L2 logistic on document length and language, 30 stratified
    runs fitted together by grouped Newton steps."""
    return _logistic(spark, sf_dir, "l2", "Logistic Regression (L2)")


@query("logistic_l1")
def logistic_l1(spark, sf_dir):
    """M5: the same with an L1 penalty (proximal Newton steps)."""
    return _logistic(spark, sf_dir, "l1", "Logistic Regression (L1)")


# ------------------------------------------------------------ tree ensembles

PRICE_FEATURES = ["p_retailprice", "p_size", "n_lines", "quantity", "discount", "tax"]


def _part_rows(spark, sf_dir):
    """Every part with what its lines sold for, and the role masks of all runs: one row a
    part, persisted once for all fits."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").cast("double").alias("quantity"),
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("label"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("p_retailprice"),
                                               F.col("p_size").cast("double").alias("p_size")).join(li, "p_partkey")
    return _masked(VectorAssembler(inputCols=PRICE_FEATURES, outputCol="features").transform(rows), "p_partkey")


def _embedding_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding")).alias("features"), (F.col("label") >= 5).cast("double").alias("label"))
    return _masked(rows, "vec_id")


def _masked(rows, key: str):
    """(key, features, label) with ``test_mask`` and ``valid_mask``, two bits a run, and the hash
    that bootstrap draws come from."""
    rows = rows.withColumn("key_hash", hash32(F.col(key))).withColumn("valid_hash", hash32(F.col(key), F.lit("valid")))
    return rows.select(key, "features", "label", S.draw_mask("key_hash", RUNS, 0.2).alias("test_mask"),
                       S.draw_mask("valid_hash", RUNS, 0.2).alias("valid_mask"), hash32(F.col(key), F.lit("draw")).alias("draw_hash"))


def _small(rows):
    """``rows`` persisted in as few parts as their number needs: a fit is many short jobs.

    Every task of a job sends its result to the driver and, for a forest, the sums of all
    open nodes to a shuffle, however few its rows.  Fits run ``THREADS`` at a time, so parts
    for half the cores keep all busy; there are more only where one held too many rows."""
    rows = rows.persist()
    n = rows.count()
    few, many = PART_ROWS
    busy = max(1, rows.sparkSession.sparkContext.defaultParallelism // 2)
    parts = min(rows.rdd.getNumPartitions(), max(min(n // few + 1, busy), n // many + 1))
    out = rows.coalesce(parts).persist()
    out.count()
    rows.unpersist()
    return out


def _tree_fits(rows, kind: str, task: str, runs=range(1, RUNS + 1)):
    """Predictions (model, run, rounds, label, prediction[, probability]) on the test rows of
    all runs: forests train on all other rows, boosted models on the fit rows and stop on
    the validation rows.  One copy of the rows serves all fits; it is released here."""

    def fit_one(job):
        name, run = job
        if kind == "forest":
            make = TR.forest_regressor if task == "regression" else TR.forest_classifier
            model, rounds = make(seed=41 + run, **FOREST).fit(S.role_rows(rows, run, "train")), None
        else:
            est = TR.boosted(task, seed=41 + run, **BOOSTED[name])
            model, rounds = TR.fit_boosted_early_stop(est, S.role_rows(rows, run, "fit"), S.role_rows(rows, run, "valid"))
        scored = model.transform(S.role_rows(rows, run, "test"))
        more = [] if task == "regression" else [vector_to_array("probability")[1].alias("probability")]
        # written at once, so that no model is kept for later
        return cut_lineage(scored.select(F.lit(name).alias("model"), F.lit(run).cast("bigint").alias("run"),
                                         F.lit(rounds).cast("int").alias("rounds"), "label", "prediction", *more))

    names = ["Random Forest"] if kind == "forest" else list(BOOSTED)
    parts = TR.fit_per_run([(n, r) for n in names for r in runs], fit_one, THREADS)
    rows.unpersist()
    return reduce(DataFrame.unionByName, parts)


def _cuts(rows, role: str, seeds: dict[int, int], max_bins: int):
    """The cuts of each run's fit, by run."""
    runs = list(seeds)
    found = TR.fit_per_run(runs, lambda run: TT.sampled_cuts(S.role_rows(rows, run, role), max_bins, seeds[run]), THREADS)
    return dict(zip(runs, TT.all_cuts(found)))


def _task_fits(rows, kind: str, runs=range(1, RUNS + 1)):
    """The predictions of :func:`_tree_fits` for regression, each fit in one task over the arrays
    of all rows, which every worker gets once."""
    spark = rows.sparkSession
    cuts = _cuts(rows, "train" if kind == "forest" else "fit", {run: 41 + run for run in runs}, 64 if kind == "forest" else 32)
    names = ["Random Forest"] if kind == "forest" else list(BOOSTED)
    jobs = [(n, r) for n in names for r in runs]
    every = cuts[jobs[0][1]].every
    settings = {} if kind == "forest" else {(n, r): TT.boosted_settings(TR.boosted("regression", seed=41 + r, **BOOSTED[n]), len(every))
                                            for n, r in jobs}
    data = spark.sparkContext.broadcast(TT.gathered(rows, every, "draw_hash" if kind == "forest" else None))

    def fit(batches):
        have = data.value
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            name, run = jobs[k]
            if kind == "forest":
                at = np.flatnonzero(have.where(run, "train"))
                trees = TT.forest_trees(cuts[run].bins(have.codes[at]), cuts[run].widths, have.label[at], have.row_hash[at], seed=41 + run, **FOREST)
                rounds = None
            else:
                trees, rounds = TT.fit_boosted(have, cuts[run], run, settings[name, run], TR.best_rounds)
            at = np.flatnonzero(have.where(run, "test"))
            for some in np.array_split(at, len(at) // 100_000 + 1):
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(name), n), pa.repeat(pa.scalar(run, pa.int64()), n), pa.repeat(pa.scalar(rounds, pa.int32()), n),
                     pa.array(have.label[some]), pa.array(TT.score(trees, cuts[run].bins(have.codes[some])))],
                    names=["model", "run", "rounds", "label", "prediction"])

    return spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(
        fit, "model string, run bigint, rounds int, label double, prediction double"), data


def _tree_regression(spark, sf_dir, kind: str):
    rows = _small(_part_rows(spark, sf_dir))
    n = rows.count()
    metrics = lambda preds: rounded(preds.groupBy("model", "run", "rounds").agg(*M.regression_aggs()).select(
        "model", "run", "rounds", "n", "rmse", "mae", "r2"))
    # small forests stay with Spark ML and its stream of draws, which is fixed for rows in one part
    if n > TT.TASK_ROWS or (kind == "forest" and n < PART_ROWS[0]):
        return metrics(_tree_fits(rows, kind, "regression"))
    preds, data = _task_fits(rows, kind)
    out = cut_lineage(metrics(preds))                       # fitted once: a row a fit
    data.unpersist()
    rows.unpersist()
    return out


@query("forest_regression")
def forest_regression(spark, sf_dir):
    """Random forest of 100 trees, of parts' sales on six columns of
    part and lineitem, 30 runs."""
    return _tree_regression(spark, sf_dir, "forest")


@query("boosted_regression")
def boosted_regression(spark, sf_dir):
    """Both boosted flavours with patience-10 early stopping on validation
    rows, 30 runs."""
    return _tree_regression(spark, sf_dir, "boosted")


def _tree_classification(spark, sf_dir, kind: str):
    preds = _tree_fits(_small(_embedding_rows(spark, sf_dir)), kind, "classification")
    cm = M.classification_metrics(preds, ["model", "run"])
    auc = M.roc_auc(preds, ["model", "run"], "label", "probability")
    return rounded(cm.join(auc, ["model", "run"]).select("model", "run", "n", "accuracy", "f1", "roc_auc", "brier"))


@query("forest_classification")
def forest_classification(spark, sf_dir):
    """Forest classifier of 100 trees on 64-dim embeddings
    (label >= 5), 30 runs."""
    return _tree_classification(spark, sf_dir, "forest")


@query("boosted_classification")
def boosted_classification(spark, sf_dir):
    """Both boosted flavours with patience stopping, 30 runs."""
    return _tree_classification(spark, sf_dir, "boosted")


TRIALS = 50
SEARCH_SPACE = {
    "Boosted Trees (depth)": {"max_depth": ("int", 2, 6), "step_size": ("log", 1e-2, 0.5),
                              "subsampling_rate": ("float", 0.5, 1.0), "max_iter": ("int", 5, 20)},
    "Boosted Trees (leaves)": {"num_leaves": ("int", 2, 64), "step_size": ("log", 1e-2, 0.5),
                               "subsampling_rate": ("float", 0.5, 1.0), "max_iter": ("int", 5, 20)}}


def _trial(p: dict):
    return TR.boosted("regression", seed=42, **{k: v for k, v in p.items() if k != "trial"})


def _judged(rounds: int, test: float, train: float) -> dict:
    return {"rounds": rounds, "rmse_test": test, "rmse_train": train, "overfitting": test / train if train else inf}


def _spark_losses(rows):
    """Losses of a trial by Spark ML, whose fits are spread over tasks."""
    fit, valid, test = (S.role_rows(rows, 1, role) for role in ("fit", "valid", "test"))
    rmse = F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))

    def losses(flavour: str, p: dict) -> dict:
        model, rounds = TR.fit_boosted_early_stop(_trial(p), fit, valid)
        return _judged(rounds, *(float(model.transform(r).agg(rmse).first()[0]) for r in (test, fit)))

    return losses, THREADS, None


def _task_losses(rows):
    """The same, a trial in one task: trials are submitted for all cores."""
    spark = rows.sparkSession
    cuts = _cuts(rows, "fit", {1: 42}, 32)[1]
    data = spark.sparkContext.broadcast(TT.gathered(rows, cuts.every))

    def losses(flavour: str, p: dict) -> dict:
        settings = TT.boosted_settings(_trial(p), len(cuts.every))

        def fit(batches):
            have = data.value
            for _ in batches:
                trees, rounds = TT.fit_boosted(have, cuts, 1, settings, TR.best_rounds)
                rmse = []
                for role in ("test", "fit"):
                    at = np.flatnonzero(have.where(1, role))
                    rmse.append(float(np.sqrt(np.mean((have.label[at] - TT.score(trees, cuts.bins(have.codes[at]))) ** 2))))
                yield pa.RecordBatch.from_arrays([pa.array([rounds], pa.int32()), *(pa.array([x]) for x in rmse)], names=["r", "test", "train"])

        return _judged(*spark.range(0, 1, 1, 1).mapInArrow(fit, "r int, test double, train double").first())

    return losses, max(THREADS, spark.sparkContext.defaultParallelism), data


@query("search_best_trial")
def search_best_trial(spark, sf_dir):
    """50 seeded trials of each boosted flavour, scored by test RMSE, train RMSE
    and their ratio on run 1; the best trial of each flavour and loss flagged."""
    rows = _small(_part_rows(spark, sf_dir))
    losses, threads, data = (_task_losses if rows.count() <= TT.TASK_ROWS else _spark_losses)(rows)
    scored = TR.search(spark, SEARCH_SPACE, TRIALS, losses, threads)
    if data is not None:
        data.unpersist()
    rows.unpersist()
    best = reduce(DataFrame.unionByName, [
        scored.groupBy("flavour").agg(F.min_by("trial", F.struct(loss, "trial")).alias("trial")).select(
            "flavour", "trial", F.lit(loss).alias("best_by")) for loss in ("rmse_test", "rmse_train", "overfitting")])
    best = best.groupBy("flavour", "trial").agg(F.array_join(F.array_sort(F.collect_list("best_by")), ",").alias("best_by"))
    return rounded(scored.join(F.broadcast(best), ["flavour", "trial"], "left")
                   .withColumn("best_by", F.coalesce("best_by", F.lit(""))))


# ------------------------------------------------------------ tree explanations

def _explained_forest(spark, sf_dir, **forest):
    """Every run's rows and forest, one after the other."""
    rows = _small(_embedding_rows(spark, sf_dir))
    names = [f"emb_{j}" for j in range(64)]

    def fit_one(run):
        return run, TR.forest_classifier(seed=41 + run, **forest).fit(S.role_rows(rows, run, "train"))

    return rows, names, TR.fit_per_run(list(range(1, RUNS + 1)), fit_one, THREADS)


def _contribution_report(parts, rows):
    """X4 by run: importance order and the spread of each feature's contributions."""
    def summed(item):
        run, phi = item
        return cut_lineage(X.contribution_summary(phi).withColumn("run", F.lit(run).cast("bigint")))

    summ = reduce(DataFrame.unionByName, TR.fit_per_run(parts, summed, THREADS))
    rows.unpersist()
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.col("mean_abs_phi").desc(), "feature"))   # features of a run
    return rounded(summ.withColumn("importance_rank", rank.cast("bigint")))


@query("tree_contributions")
def tree_contributions(spark, sf_dir):
    """Path-dependent contributions of a forest classifier of 100 trees (class-1
    probability) for the test rows of 30 runs, summarised by run and feature."""
    rows, names, models = _explained_forest(spark, sf_dir, num_trees=100, max_depth=5)
    return _contribution_report([(run, LV.explain_path_dependent(S.role_rows(rows, run, "test"), model, names, ["vec_id"]))
                                 for run, model in models], rows)


@query("tree_contributions_background")
def tree_contributions_background(spark, sf_dir):
    """Contributions against all training rows as the background, for the test rows of 30
    runs."""
    rows, names, models = _explained_forest(spark, sf_dir, num_trees=20, max_depth=4)
    return _contribution_report([(run, LV.explain_interventional(S.role_rows(rows, run, "test"), model, names, ["vec_id"],
                                                                 S.role_rows(rows, run, "train"))) for run, model in models], rows)
