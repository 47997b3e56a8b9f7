"""The five experiment presets as calls of :func:`trellis.plans.compare.compare`.

Defaults follow the experiments (30 runs, 100-tree forests, 100 penalties,
5 folds); pass smaller settings for quick checks.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trellis.plans.compare import compare
from trellis.sources import synthetic as SY

FOREST = {"num_trees": 100, "max_depth": 30}
BOOSTED = {"max_iter": 100, "step_size": 0.1, "max_depth": 6}


def linearity(spark: SparkSession, runs: int = 30, n: int = 10000, **kw):
    """Low-rank linear data; linear models should win."""
    df = SY.linear_table(spark, n=n)
    feats = [c for c in df.columns if c.startswith("feature_")]
    return compare(df, feats, runs=runs, forest=kw.get("forest", FOREST),
                   boosted=kw.get("boosted", BOOSTED), test_pair=("Lasso", "Boosted Trees"))


def low_interaction(spark: SparkSession, runs: int = 30, n: int = 10000, **kw):
    """Friedman-1; boosted trees should beat the forest."""
    df = SY.friedman1(spark, n=n)
    feats = [c for c in df.columns if c.startswith("feature_")]
    return compare(df, feats, runs=runs, forest=kw.get("forest", FOREST),
                   boosted=kw.get("boosted", BOOSTED),
                   test_pair=("Boosted Trees", "Random Forest"))


def extrapolation(spark: SparkSession, runs: int = 30, n: int = 500, **kw):
    """Train on |x| <= 1, test outside; trees stay flat, lines do not."""
    df = SY.grid_line(spark, n=n).drop("region")
    return compare(df, ["feature_0"], runs=runs, forest=kw.get("forest", FOREST),
                   boosted=kw.get("boosted", BOOSTED),
                   predicate=F.abs(F.col("feature_0")) <= 1,
                   test_pair=("Lasso", "Boosted Trees"))


def small_sample(spark: SparkSession, runs: int = 30, n: int = 100, p: int = 200, **kw):
    """More features than rows; compare overfitting factors."""
    df = SY.wide_table(spark, n=n, p=p)
    df = df.select("row_id", "label", *[F.col("features")[j].alias(f"feature_{j}")
                                        for j in range(p)])
    feats = [f"feature_{j}" for j in range(p)]
    return compare(df, feats, runs=runs, forest=kw.get("forest", FOREST),
                   boosted=kw.get("boosted", BOOSTED), metric="overfitting",
                   test_pair=("Lasso", "Boosted Trees"), alternative="less",
                   alphas=kw.get("alphas"))


def interpretability(spark: SparkSession, runs: int = 30, n: int = 1000, **kw):
    """Two classes, numeric and binned categorical columns; logistic models
    against forests and boosting on AUC, plus the coefficient table."""
    from trellis.plans.compare_classify import compare_classification
    df = SY.two_class_mixed(spark, n=n)
    num = [c for c in df.columns if c.startswith("num_feature_")]
    cat = [c for c in df.columns if c.startswith("cat_feature_")]
    return compare_classification(df, num, cat, runs=runs,
                                  forest=kw.get("forest", {"num_trees": 100, "max_depth": 30}),
                                  boosted=kw.get("boosted", BOOSTED))
