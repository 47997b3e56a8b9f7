"""Additive explanations of predictions.

* Linear models (X1): ``phi_j = coef_j * (x_j - mean_j)`` with means over the
  fitting rows; ``base + sum(phi) = prediction`` exactly.  A column expression
  with the per-group coefficients joined in (runs x features numbers).
* Tree ensembles (X2, X3): array arithmetic over the leaves of a fitted Spark ML
  forest or boosted model; see :mod:`trellis.operators.leaves`.
* Summary (X4): long ``(row, feature, phi)`` table grouped by feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.ranking import exact_quantiles


def linear_contributions(df: DataFrame, fits: DataFrame, means: DataFrame,
                         features: list[str], group_cols: list[str],
                         keep_cols: list[str] | None = None) -> DataFrame:
    """Long table ``(group..., keep..., feature, value, phi, base_value)``.

    ``fits`` has ``intercept`` and ``coef`` (array) per group; ``means`` has one
    column per feature with the fitting-row means.  Both are one row per group.
    """
    m = means.select(*group_cols, *[F.col(f).alias(f"_m_{f}") for f in features])
    j = df.join(F.broadcast(fits.select(*group_cols, "intercept", "coef")), group_cols) \
          .join(F.broadcast(m), group_cols)
    base = F.col("intercept")
    for i, f in enumerate(features):
        base = base + F.col("coef")[i] * F.col(f"_m_{f}")
    items = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                 (F.col("coef")[i] * (F.col(f) - F.col(f"_m_{f}"))).alias("phi"))
        for i, f in enumerate(features)])
    keep = list(keep_cols or [])
    return j.select(*group_cols, *keep, base.alias("base_value"), F.inline(items))


def contribution_summary(phi: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Per feature: rows, mean |phi| (the importance order), mean, min, max."""
    g = list(group_cols or [])
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.abs("phi")).alias("mean_abs_phi"),
            F.avg("phi").alias("mean_phi"), F.min("phi").alias("min_phi"),
            F.max("phi").alias("max_phi")]
    if "base_value" in phi.columns:
        aggs.append(F.min("base_value").alias("base_value"))
    return phi.groupBy(*g, "feature").agg(*aggs)


def contribution_spread(phi: DataFrame, value_bins: int = 5, phi_bins: int = 5) -> DataFrame:
    """Per feature a grid of value bins (by exact quantiles of the value, so each
    holds about as many rows) and equal ranges of the contribution: rows, smallest and
    largest value and contribution, mean contribution.  Bounded by features x bins; the rows
    are summed per task.  A value at a quantile lies in the bin below it."""
    cuts = exact_quantiles(phi, ["feature"], "value", [k / value_bins for k in range(1, value_bins)])
    edges = F.array(*[F.col(f"q_{k}") for k in range(value_bins - 1)])
    ends = phi.groupBy("feature").agg(F.min("phi").alias("_lo"), F.max("phi").alias("_hi"))
    known = cuts.select("feature", edges.alias("_cuts")).join(ends, "feature")      # a row a feature
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(phi_bins))
    value_bin = (F.size(F.filter("_cuts", lambda c: F.col("value") > c)) + 1).cast("bigint")
    phi_bin = F.when(width > 0, F.least(F.floor((F.col("phi") - F.col("_lo")) / width) + 1, F.lit(phi_bins))).otherwise(1).cast("bigint")
    # a row a feature, so a broadcast: a join by feature would leave each feature's rows to one task
    return (phi.join(F.broadcast(known), "feature").groupBy("feature", value_bin.alias("value_bin"), phi_bin.alias("phi_bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
                 F.min("phi").alias("min_phi"), F.max("phi").alias("max_phi"), F.avg("phi").alias("mean_phi")))
