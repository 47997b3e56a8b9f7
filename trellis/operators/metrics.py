"""Grouped model metrics over a long prediction table.

Every metric is an aggregate keyed by the caller's group columns (usually
``run, model`` or ``run, model, role``), so all runs and models are scored in one
hash aggregate with partial (map-side) combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators.ranking import weighted_positions

LOG_EPS = 1e-15


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def regression_aggs(label="label", pred="prediction") -> list[Column]:
    """E1-E3 as aggregate expressions: n, rmse, mae, r2.

    R2 = 1 - SSE / (n * var_pop(y)); a constant label gives 1 when the fit is
    exact and 0 otherwise (the usual finite convention).
    """
    y, p = _c(label), _c(pred)
    err = y - p
    sse = F.sum(err * err)
    sst = F.var_pop(y) * F.count(F.lit(1))
    return [
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.when(sst > 0, F.lit(1.0) - sse / sst)
         .when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("r2"),
    ]


def regression_metrics(df: DataFrame, group_cols: list[str], label="label",
                       pred="prediction") -> DataFrame:
    return df.groupBy(*group_cols).agg(*regression_aggs(label, pred))


def classification_aggs(label="label", pred="prediction", prob="probability") -> list[Column]:
    """Accuracy, F1 of class 1 (0 when undefined), Brier, log loss."""
    y, yhat, p = _c(label).cast("double"), _c(pred).cast("double"), _c(prob)
    tp = F.sum(F.when((y == 1) & (yhat == 1), 1).otherwise(0))
    fp = F.sum(F.when((y == 0) & (yhat == 1), 1).otherwise(0))
    fn = F.sum(F.when((y == 1) & (yhat == 0), 1).otherwise(0))
    pc = F.least(F.greatest(p, F.lit(LOG_EPS)), F.lit(1.0 - LOG_EPS))
    denom = 2 * tp + fp + fn
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg((y == yhat).cast("double")).alias("accuracy"),
        F.when(denom > 0, (2.0 * tp) / denom).otherwise(F.lit(0.0)).alias("f1"),
        F.avg((p - y) * (p - y)).alias("brier"),
        (-F.avg(y * F.log(pc) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - pc))).alias("logloss"),
    ]


def classification_metrics(df: DataFrame, group_cols: list[str], label="label",
                           pred="prediction", prob="probability") -> DataFrame:
    return df.groupBy(*group_cols).agg(*classification_aggs(label, pred, prob))


def roc_auc(df: DataFrame, group_cols: list[str], label: str = "label",
            score: str = "score", out: str = "roc_auc") -> DataFrame:
    """Exact ROC AUC with ties averaged (Mann-Whitney rank-sum form).

    AUC = (sum of average ranks of positives - P(P+1)/2) / (P * N).  The rows are summed
    once per score, with their positives; positions come from a range partitioning, so one
    (run, model) group holding most rows is still spread over tasks.
    Groups with one class only give null.
    """
    counts = (df.groupBy(*group_cols, F.col(score).cast("double").alias("_s"))
              .agg(F.count(F.lit(1)).alias("_c"), F.sum(F.col(label).cast("double")).alias("_pos")))
    placed = weighted_positions(counts, group_cols, "_s", "_c")
    agg = placed.groupBy(*group_cols).agg(
        F.sum(F.col("_pos") * (F.col("lo") + (F.col("_c") + 1) / 2.0)).alias("_rs"),
        F.sum("_pos").alias("_p"), F.sum("_c").alias("_n"))
    neg = F.col("_n") - F.col("_p")
    return agg.select(*group_cols, F.when((F.col("_p") > 0) & (neg > 0),
                      (F.col("_rs") - F.col("_p") * (F.col("_p") + 1) / 2.0)
                      / (F.col("_p") * neg)).alias(out))


def train_test_metrics(df: DataFrame, group_cols: list[str], role_col: str = "role",
                       label="label", pred="prediction",
                       roles=("train", "test")) -> DataFrame:
    """E9 + E10: RMSE and R2 for each role side by side, and overfitting factor.

    ``overfitting = rmse_test / rmse_train`` with +inf when train RMSE is 0 (P7).
    """
    m = regression_metrics(df, [*group_cols, role_col], label, pred)
    wide = m.groupBy(*group_cols).pivot(role_col, list(roles)).agg(
        F.first("rmse").alias("rmse"), F.first("r2").alias("r2"))
    tr, te = roles
    out = wide.select(*group_cols,
                      F.col(f"{tr}_rmse").alias("rmse_train"), F.col(f"{te}_rmse").alias("rmse_test"),
                      F.col(f"{tr}_r2").alias("r2_train"), F.col(f"{te}_r2").alias("r2_test"))
    return out.withColumn("overfitting", overfitting_factor("rmse_test", "rmse_train"))


def overfitting_factor(test_col="rmse_test", train_col="rmse_train") -> Column:
    return F.when(_c(train_col) > 0, _c(test_col) / _c(train_col)).otherwise(F.lit(float("inf")))
