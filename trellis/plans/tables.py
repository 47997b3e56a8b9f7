"""Plot-ready tables (V1-V9): the data behind each figure, as queries.

Drawing is not part of the engine; every figure's data is a bounded table:
distributions by model (quantiles and a fixed-bin density), the dots of the
overlay, train-vs-test pairs, log-axis bins, top/bottom bars, extrapolation
curves on a fixed grid, and contribution dots.  :data:`FIGURES` dispatches by
figure name (V9) and :mod:`trellis.plans.labels` gives titles per language (V8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators import summary as U
from trellis.operators.explain import contribution_spread
from trellis.operators.ranking import exact_quantiles


def distribution(long: DataFrame, group_cols=("model", "metric"), value_col: str = "value",
                 bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """V1: per group five quantiles, and counts in ``bins`` equal-width bins over
    the group's [min, max] (min in bin 1, max in the last bin)."""
    g = list(group_cols)
    q = exact_quantiles(long, g, value_col, [0.0, 0.25, 0.5, 0.75, 1.0])
    q = q.select(*g, *[F.col(f"q_{i}").alias(n) for i, n in
                       enumerate(["min", "q25", "median", "q75", "max"])])
    rng = long.groupBy(*g).agg(F.min(value_col).alias("_lo"), F.max(value_col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor((F.col(value_col) - F.col("_lo")) / width) + 1,
                                  F.lit(bins))).otherwise(F.lit(1)).cast("bigint")
    # groups are models x metrics: a bounded broadcast
    dens = (long.join(F.broadcast(rng), g).withColumn("bin", b)
            .groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("n"),
                                     F.min("_lo").alias("lo"), F.min("_hi").alias("hi")))
    return q, dens


def train_test_long(results: DataFrame, ids=("run", "model")) -> DataFrame:
    """``rmse_train`` and ``rmse_test`` to ``(type, rmse)`` rows."""
    return U.to_long(results.select(*ids, "rmse_train", "rmse_test"), list(ids),
                     ["rmse_train", "rmse_test"], "type", "rmse")


def log_axis(long: DataFrame, value_col: str = "value", lower: float = 1e-3,
             per_decade: int = 10) -> DataFrame:
    """V4: rows above the axis' lower limit with their log10 bin."""
    return (long.where(F.col(value_col) >= lower)
            .withColumn("log_bin", F.floor(F.log10(value_col) * per_decade) / float(per_decade)))


def extrapolation_curve(points: DataFrame, fits: dict, x_col: str = "x",
                        label_col: str = "label", role_col: str = "role",
                        grid: int = 101) -> DataFrame:
    """V6: long ``(series, x, y)`` -- model curves on a fixed grid over the data's
    x range (``fits`` maps a series name to a Column expression of ``x``), the
    largest training label as a flat line, and the split limits as markers.
    Bounded: ``grid x (models + 1)`` rows plus the limit rows."""
    spark = points.sparkSession
    lo = points.select(F.min(x_col)).scalar()
    hi = points.select(F.max(x_col)).scalar()
    g = spark.range(grid).select((lo + (hi - lo) * F.col("id") / F.lit(float(grid - 1)))
                                 .alias("x"))
    parts = [g.select(F.lit(name).alias("series"), "x", expr.alias("y"))
             for name, expr in fits.items()]
    ymax = points.where(F.col(role_col) == "train").select(F.max(label_col)).scalar()
    parts.append(g.select(F.lit("max train label").alias("series"), "x", ymax.alias("y")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coefficient_bars(coefs: DataFrame, k: int = 10) -> DataFrame:
    """V5 / O3: top and bottom ``k`` coefficients."""
    return U.top_bottom(coefs, "coefficient", k, ["feature"])


def contribution_dots(phi: DataFrame) -> DataFrame:
    """V7: ``(feature, value, phi)`` dots with the feature order by mean |phi|."""
    from pyspark.sql import Window
    order = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("_imp")).withColumn(
        "feature_rank", F.row_number().over(Window.orderBy(F.col("_imp").desc(), "feature")))
    return phi.join(F.broadcast(order.drop("_imp")), "feature")   # features: bounded


def metric_dots(results: DataFrame, metrics: list[str], ids=("run", "model")) -> DataFrame:
    """V2: every (run, model) point of each metric."""
    return U.to_long(results.select(*ids, *metrics), list(ids), metrics, "metric", "value")


FIGURES = {                     # V9: figure name -> builder of its table(s)
    "distribution": distribution,
    "dots": metric_dots,
    "train_test": train_test_long,
    "log_axis": log_axis,
    "extrapolation": extrapolation_curve,
    "coefficients": coefficient_bars,
    "contributions": contribution_dots,
    "contribution_spread": contribution_spread,
}


def figure_table(name: str, *args, **kw):
    """V9: dispatch by figure name."""
    if name not in FIGURES:
        raise KeyError(f"unknown figure {name!r}; known: {sorted(FIGURES)}")
    return FIGURES[name](*args, **kw)
