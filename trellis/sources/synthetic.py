"""Seeded synthetic tables (S4-S8) built from ``spark.range``.

Every random number is an md5 draw of ``(row, seed, column)`` (see
:mod:`trellis.functions.random`), so a table is the same on any cluster size
and any retry.  Numbers differ from other generators' streams; distributions
and signal/noise levels are what carry over.  These tables feed library tests
and scenario presets; registered queries only read the given tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.random import normal, uniform


def _coefs(seed: int, p: int, informative: int, scale: float = 100.0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    w = np.zeros(p)
    idx = rng.permutation(p)[:informative]
    w[idx] = scale * rng.random(informative)
    return w


def linear_table(spark: SparkSession, n: int = 10000, p: int = 20, informative: int = 15,
                 rank: int = 10, noise: float = 25.0, seed: int = 42) -> DataFrame:
    """Features from ``rank`` latent normals (low effective rank), label =
    weighted sum of the informative features + N(0, noise)."""
    rng = np.random.default_rng(seed)
    load = rng.normal(size=(rank, p)) / np.sqrt(rank)
    w = _coefs(seed, p, informative)
    df = spark.range(n).withColumnRenamed("id", "row_id")
    z = [normal("row_id", F.lit(seed), F.lit(f"z{k}")) for k in range(rank)]
    cols = []
    for j in range(p):
        e = F.lit(0.0)
        for k in range(rank):
            e = e + F.lit(float(load[k, j])) * z[k]
        cols.append(e.alias(f"feature_{j}"))
    df = df.select("row_id", *cols)
    y = F.lit(0.0)
    for j in range(p):
        if w[j]:
            y = y + F.lit(float(w[j])) * F.col(f"feature_{j}")
    return df.withColumn("label", y + F.lit(noise) * normal("row_id", F.lit(seed), F.lit("eps")))


def wide_table(spark: SparkSession, n: int = 100, p: int = 200, informative: int = 10,
               noise: float = 30.0, seed: int = 42) -> DataFrame:
    """``features array<double>`` of length p, more features than rows."""
    w = _coefs(seed, p, informative)
    df = spark.range(n).withColumnRenamed("id", "row_id")
    feats = F.transform(F.sequence(F.lit(0), F.lit(p - 1)),
                        lambda j: normal(F.col("row_id"), F.lit(seed), j))
    df = df.withColumn("features", feats)
    wl = F.array(*[F.lit(float(v)) for v in w])
    dot = F.aggregate(F.zip_with(F.col("features"), wl, lambda a, b: a * b), F.lit(0.0),
                      lambda acc, v: acc + v)
    return df.withColumn("label", dot + F.lit(noise) * normal("row_id", F.lit(seed),
                                                              F.lit("eps")))


def friedman1(spark: SparkSession, n: int = 10000, p: int = 10, noise: float = 5.0,
              seed: int = 42) -> DataFrame:
    """``10 sin(pi x0 x1) + 20 (x2 - .5)^2 + 10 x3 + 5 x4 + N(0, noise)``."""
    df = spark.range(n).withColumnRenamed("id", "row_id")
    df = df.select("row_id", *[uniform("row_id", F.lit(seed), F.lit(f"x{j}"))
                               .alias(f"feature_{j}") for j in range(p)])
    x = [F.col(f"feature_{j}") for j in range(5)]
    y = (F.lit(10.0) * F.sin(F.lit(np.pi) * x[0] * x[1])
         + F.lit(20.0) * (x[2] - 0.5) * (x[2] - 0.5) + F.lit(10.0) * x[3] + F.lit(5.0) * x[4])
    return df.withColumn("label", y + F.lit(noise) * normal("row_id", F.lit(seed),
                                                            F.lit("eps")))


def grid_line(spark: SparkSession, n: int = 500, lo: float = -2.0, hi: float = 2.0,
              noise: float = 10.0, seed: int = 42) -> DataFrame:
    """S7 + P5: even grid, ``y = 2x + 30 + N(0, noise)``, train where |x| <= 1."""
    df = spark.range(n).withColumnRenamed("id", "row_id")
    x = F.lit(lo) + F.lit(hi - lo) * F.col("row_id") / F.lit(float(n - 1))
    df = df.withColumn("feature_0", x)
    y = F.lit(2.0) * F.col("feature_0") + F.lit(30.0) + F.lit(noise) * normal(
        "row_id", F.lit(seed), F.lit("eps"))
    return (df.withColumn("label", y)
            .withColumn("region", F.when(F.abs("feature_0") <= 1, "train").otherwise("test")))


def two_class_mixed(spark: SparkSession, n: int = 1000, informative: int = 15,
                    redundant: int = 5, n_binned: int = 10, seed: int = 42) -> DataFrame:
    """Two classes; informative normals shifted by class, redundant columns
    as sums of informative ones, the last ``n_binned`` columns binned to
    low / medium / high by equal width (F5)."""
    from trellis.operators.features import equal_width_bins_many
    df = spark.range(n).withColumnRenamed("id", "row_id")
    y = (uniform("row_id", F.lit(seed), F.lit("y")) < 0.5).cast("int")
    df = df.select("row_id", y.alias("label"))
    shift = F.col("label") * 2 - 1
    df = df.select("row_id", "label", *[
        (normal("row_id", F.lit(seed), F.lit(f"f{j}")) + F.lit(0.5) * shift).alias(f"f{j}")
        for j in range(informative)])
    df = df.select("*", *[(F.col(f"f{r}") + F.col(f"f{r + 1}")).alias(f"f{informative + r}")
                          for r in range(redundant)])
    total = informative + redundant
    binned = [f"f{j}" for j in range(total - n_binned, total)]
    df = equal_width_bins_many(df, binned, 3, ["low", "medium", "high"])
    return df.select("row_id", "label",
                     *[F.col(f"f{j}").alias(f"num_feature_{j}") for j in range(total - n_binned)],
                     *[F.col(f"{c}_bin").alias(f"cat_feature_{i}") for i, c in enumerate(binned)])


def settings(spark: SparkSession, runs: int = 30, test_frac: float = 0.2, noise: float = 25.0,
             seed_base: int = 42) -> DataFrame:
    """Experiment settings as rows (run, seed, test share, noise)."""
    return (spark.range(1, runs + 1).withColumnRenamed("id", "run")
            .withColumn("seed", F.col("run") + F.lit(seed_base - 1))
            .withColumn("test_frac", F.lit(test_frac)).withColumn("noise", F.lit(noise)))
