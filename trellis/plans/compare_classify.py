"""Classification comparison with mixed columns (the credit-style experiment).

Per run: an exact stratified 80/20 split (a validation cut inside train for the
boosted model's early stop), numeric columns scaled with the population
deviation of the run's training rows, categoricals one-hot encoded.  The roles of all
runs are two bit masks a row.  Logistic L2 and L1 for all runs come from Newton steps
over one copy of the rows; forests and boosted trees are Spark ML fits per run.  Scored by
accuracy, F1, exact AUC and Brier, summarised by model, tested pairwise on AUC,
and the L2 model of run 1 gives the coefficient table by encoded name.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators import logistic as LG
from trellis.operators import metrics as M
from trellis.operators import paired as P
from trellis.operators import splits as S
from trellis.operators import summary as U
from trellis.operators import trees as TR
from trellis.operators.features import levels
from trellis.operators.timing import timed, timing_table, written
from trellis.session import cut_lineage


BOOSTED, FOREST = "Boosted Trees", "Random Forest"


def _prepare(df, key, runs, test_frac, valid_frac):
    """One row a row, with the test and validation masks of all runs: both cuts are exact
    within each class, the second among what the first left."""
    d = S.add_key_hash(df, key)
    d = S.add_key_hash(d, key, "valid_hash", salt="valid")
    d = S.exact_mask(d, "key_hash", key, test_frac, runs, by=["label"])
    return S.exact_mask(d, "valid_hash", key, valid_frac, runs, by=["label"], among="test_mask", mask_col="valid_mask")


def encode_for_linear(d: DataFrame, num_cols: list[str], cat_cols: list[str]):
    """Numeric columns and a one-hot column for every level.  Returns (table, feature names)."""
    cols, names = [F.col(c).cast("double").alias(c) for c in num_cols], list(num_cols)
    for c in cat_cols:
        for level in levels(d, c):                           # bounded, an error beyond
            cols.append(F.coalesce((F.col(c) == F.lit(level)).cast("double"), F.lit(0.0)).alias(f"{c}_{level}"))
            names.append(f"{c}_{level}")
    return d.select(*[x for x in d.columns if x not in num_cols], *cols), names


def compare_classification(df: DataFrame, num_cols: list[str], cat_cols: list[str],
                           label: str = "label", key: str = "row_id", runs: int = 30,
                           test_frac: float = 0.2, valid_frac: float = 0.25,
                           forest: dict | None = None, boosted: dict | None = None,
                           test_pair=("Logistic Regression (L2)", "Boosted Trees")) -> dict:
    """``timings`` has one row per real job: run 0 stands for a fit of all runs at once."""
    # one checkpoint of one row a row, whatever the runs: the many fits plan against it
    d = cut_lineage(_prepare(df.withColumnRenamed(label, "label"), key, runs, test_frac, valid_frac))
    enc, names = encode_for_linear(d, num_cols, cat_cols)
    timings, preds, fits = [], [], {}
    tests = enc.select("label", *names, S.runs_of("test_mask", runs).alias("run"))
    for pen, name in (("l2", "Logistic Regression (L2)"), ("l1", "Logistic Regression (L1)")):
        fit, secs = timed(LG.fit_logistic_runs, enc, names, "label", runs, "test_mask", pen, scale=list(num_cols))
        fits[name] = fit
        timings.append((0, name, "train", secs))
        p = LG.predict_logistic(tests, fit, names, ["run"])
        preds.append(p.select("run", F.lit(name).alias("model"), "label", "prediction", "probability"))
        timings.append((0, name, "inference", written(preds[-1])))
    idx = [f"{c}__i" for c in cat_cols]
    pipe_stages = [StringIndexer(inputCols=cat_cols, outputCols=idx, handleInvalid="keep"),
                   OneHotEncoder(inputCols=idx, outputCols=[f"{c}__o" for c in cat_cols],
                                 dropLast=True),
                   VectorAssembler(inputCols=[*num_cols, *[f"{c}__o" for c in cat_cols]],
                                   outputCol="features")]

    def fit_one(args):
        run, kind = args
        if kind == "forest":
            est = TR.forest_classifier(seed=41 + run, **(forest or {}))
            pm, secs = timed(Pipeline(stages=[*pipe_stages, est]).fit, S.role_rows(d, run, "train"))
            name = FOREST
        else:
            prep = Pipeline(stages=pipe_stages).fit(S.role_rows(d, run, "fit"))
            est = TR.boosted("classification", seed=41 + run, **(boosted or {}))
            (model, _), secs = timed(TR.fit_boosted_early_stop, est, prep.transform(S.role_rows(d, run, "fit")),
                                     prep.transform(S.role_rows(d, run, "valid")))
            pm = PipelineModel(stages=[prep, model])
            name = BOOSTED
        out = pm.transform(S.role_rows(d, run, "test")).select(
            F.lit(run).cast("bigint").alias("run"), F.lit(name).alias("model"), "label", "prediction",
            vector_to_array("probability")[1].alias("probability"))
        return out, [(run, name, "train", secs), (run, name, "inference", written(out))]

    jobs = [(r, k) for r in range(1, runs + 1)
            for k, cfg in (("forest", forest), ("boosted", boosted)) if cfg is not None]
    for out, t in TR.fit_per_run(jobs, fit_one):
        preds.append(out)
        timings += t
    pred = preds[0]
    for p in preds[1:]:
        pred = pred.unionByName(p)
    cm = M.classification_metrics(pred, ["run", "model"])
    auc = M.roc_auc(pred, ["run", "model"], "label", "probability")
    results = cm.join(auc, ["run", "model"])
    summary = U.summarize(results, ["accuracy", "f1", "roc_auc", "brier"], ["model"], None)
    a, b = test_pair
    diffs = P.paired_differences(results, ["run"], "model", "roc_auc", a, b)
    test = P.signed_rank(diffs.withColumn("test", F.lit(f"{a} vs {b}")), ["test"], "d").drop(
        "_max_tie")
    l2 = fits["Logistic Regression (L2)"].where(F.col("run") == 1)
    coefs = l2.select(F.posexplode("coef").alias("pos", "coefficient")).select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1).alias("feature"),
        "coefficient").orderBy(F.col("coefficient").desc())
    return {"predictions": pred, "results": results, "summary": summary, "test": test,
            "coefficients": coefs, "timings": timing_table(df.sparkSession, timings)}
