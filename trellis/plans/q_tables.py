"""Registered queries: plot-ready tables and the coefficient table."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import logistic as LG
from trellis.operators import splits as S
from trellis.plans import price_models as PM
from trellis.plans import tables as TB
from trellis.plans.q_holdout import _PER_RUN_SQL, _PRICE_SQL_CTES, holdout_per_run
from trellis.operators.features import levels
from trellis.plans.registry import query, rounded
from trellis.plans.sqlbits import r6
from trellis.session import table

_LONG_SQL = f"""
WITH {_PRICE_SQL_CTES}, {_PER_RUN_SQL},
long AS (
  SELECT model, metric, round(value, 6) + 0.0 AS value FROM (
    SELECT model, 'rmse' AS metric, rmse AS value FROM per_run
    UNION ALL SELECT model, 'mae', mae FROM per_run
    UNION ALL SELECT model, 'r2', r2 FROM per_run))
"""

DISTRIBUTION_SQL = f"""{_LONG_SQL}
SELECT model, metric, {r6('min(value)', 'min', 8)}, {r6('quantile_cont(value, 0.25)', 'q25', 8)},
       {r6('quantile_cont(value, 0.5)', 'median', 8)},
       {r6('quantile_cont(value, 0.75)', 'q75', 8)}, {r6('max(value)', 'max', 8)}
FROM long GROUP BY model, metric
"""

DENSITY_SQL = f"""{_LONG_SQL},
rng AS (SELECT model, metric, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1, 2)
SELECT model, metric,
       CAST(CASE WHEN (hi - lo) / 10.0 > 0
                 THEN LEAST(floor((value - lo) / ((hi - lo) / 10.0)) + 1, 10) ELSE 1 END AS BIGINT)
         AS bin,
       count(*) AS n, {r6('min(lo)', 'lo')}, {r6('min(hi)', 'hi')}
FROM long JOIN rng USING (model, metric) GROUP BY 1, 2, 3
"""


def _metric_long(spark, sf_dir):
    per_run = holdout_per_run(spark, sf_dir)
    long = TB.metric_dots(per_run, ["rmse", "mae", "r2"], ("run", "model"))
    return long.withColumn("value", F.round("value", 6))


@query("metric_distribution", DISTRIBUTION_SQL)
def metric_distribution(spark, sf_dir):
    """V1: five exact quantiles of each metric by model over the 30 runs."""
    q, _ = TB.distribution(_metric_long(spark, sf_dir))
    # inputs have 6 decimals, quartiles of them at most 8: rounding at 8 has no ties
    return rounded(q, 8)


@query("metric_density", DENSITY_SQL)
def metric_density(spark, sf_dir):
    """V1: ten equal-width bins of each metric by model (the violin's density)."""
    _, dens = TB.distribution(_metric_long(spark, sf_dir), bins=10)
    return rounded(dens)


CURVE_SQL = f"""
WITH base AS (
  SELECT l_extendedprice AS x, l_extendedprice * (1 - l_discount) AS label,
         LEAST(CAST(floor(l_extendedprice / 10000.0) AS BIGINT), 10) AS bucket,
         CASE WHEN l_extendedprice <= 50000 THEN 'train' ELSE 'test' END AS role
  FROM lineitem),
bb AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS n, sum(label) AS sy, sum(x) AS sx,
              sum(x * x) AS sxx, sum(x * label) AS sxy
       FROM base WHERE role = 'train' GROUP BY bucket),
g AS (SELECT sum(n) AS n, sum(sy) AS sy, sum(sx) AS sx, sum(sxx) AS sxx, sum(sxy) AS sxy FROM bb),
line AS (SELECT sy / n AS mean_label, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS slope,
                sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx / n AS intercept FROM g),
mm AS (SELECT min(x) AS lo, max(x) AS hi,
              max(CASE WHEN role = 'train' THEN label END) AS ymax FROM base),
grid AS (SELECT lo + (hi - lo) * range / 100.0 AS x, ymax FROM mm, range(0, 101)),
gb AS (SELECT x, ymax, LEAST(CAST(floor(x / 10000.0) AS BIGINT), 10) AS bucket FROM grid)
SELECT series, {r6('x', 'x')}, {r6('y', 'y')} FROM (
  SELECT 'Least Squares' AS series, x, intercept + slope * x AS y FROM gb, line
  UNION ALL
  SELECT 'Bucket Mean', gb.x, coalesce(bb.sy / bb.n, line.mean_label)
  FROM gb CROSS JOIN line LEFT JOIN bb ON gb.bucket = bb.bucket
  UNION ALL
  SELECT 'max train label', x, ymax FROM gb)
"""


@query("extrapolation_curve", CURVE_SQL)
def extrapolation_curve(spark, sf_dir):
    """V6: line and bucket-model curves on a 101-point grid over the price range,
    fitted on price <= 50,000, with the largest training label."""
    rows = PM.price_rows(table(spark, sf_dir, "lineitem")).drop(*PM.LINEITEM_KEY)
    rows = S.range_split(rows, F.col("x") <= 50000).withColumn("split", F.lit("price"))
    line, buckets = PM.fit_tables(rows.where(F.col("role") == "train"), ["split"])
    ln = line.first()                                   # one row: the fitted line
    bmap = {r["bucket"]: r["bucket_mean"] for r in buckets.collect()}   # <= 11 buckets
    bucket = F.least(F.floor(F.col("x") / 10000.0), F.lit(PM.N_BUCKETS - 1)).cast("bigint")
    bexpr = F.lit(ln["mean_label"])
    for k in sorted(bmap, reverse=True):
        bexpr = F.when(bucket == k, F.lit(bmap[k])).otherwise(bexpr)
    fits = {"Least Squares": F.lit(ln["intercept"]) + F.lit(ln["slope"]) * F.col("x"),
            "Bucket Mean": bexpr}
    return rounded(TB.extrapolation_curve(rows, fits, "x", "label", "role", 101))


@query("logistic_coefficients")
def logistic_coefficients(spark, sf_dir):
    """L2 logistic on length, language and source one-hots
    (run 1, seed 42); coefficients by encoded name, sorted downward, with the
    top and bottom ten flagged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    one_hot = [F.coalesce((F.col(c) == x).cast("double"), F.lit(0.0)).alias(f"{c}_{x}")
               for c in ("lang", "source") for x in levels(docs, c)]
    j = docs.join(labels, "doc_id").select(
        "doc_id", "label", F.log1p(F.col("n_chars").cast("double")).alias("log_chars"), *one_hot)
    features = [c for c in j.columns if c not in ("doc_id", "label")]
    j = S.stratified_split(S.with_runs(S.add_key_hash(j, "doc_id"), 1), "key_hash", "doc_id",
                           "label", 0.2, "seed", extra_by=["run"])
    fit = LG.fit_logistic(j.where(F.col("role") == "train"), features, "label", ["run"],
                          "l2")
    coefs = fit.select(F.posexplode("coef").alias("pos", "coefficient")).select(
        F.element_at(F.array(*[F.lit(f) for f in features]), F.col("pos") + 1)
        .alias("feature"), "coefficient")
    bars = TB.coefficient_bars(coefs, 10).select("feature", "side")
    out = coefs.join(bars.groupBy("feature").agg(F.concat_ws("+", F.collect_set("side"))
                                                 .alias("bar")), "feature", "left")
    return rounded(out.orderBy(F.col("coefficient").desc()))


# ------------------------------------------------------------ V3 / U3 and O4

from trellis.plans.q_holdout import OVERFITTING_SQL as _OVERFIT_SQL  # noqa: E402

TRAIN_TEST_LONG_SQL = f"""
WITH w AS ({_OVERFIT_SQL})
SELECT run, model, type, rmse FROM (
  SELECT run, model, 'rmse_train' AS type, rmse_train AS rmse FROM w
  UNION ALL SELECT run, model, 'rmse_test', rmse_test FROM w)
"""


@query("train_test_long", TRAIN_TEST_LONG_SQL)
def train_test_long(spark, sf_dir):
    """Train and test RMSE of every run and model as (type, rmse) rows."""
    from trellis.operators import metrics as M
    preds = PM.holdout_predictions(table(spark, sf_dir, "lineitem"), 30,
                                   score_roles=("train", "test"))
    tt = rounded(M.train_test_metrics(preds, ["run", "model"]))
    return TB.train_test_long(tt)


METRIC_RANKS_SQL = f"""
WITH {_PRICE_SQL_CTES}, {_PER_RUN_SQL},
long AS (
  SELECT run, model, metric, round(value, 6) + 0.0 AS value FROM (
    SELECT run, model, 'rmse' AS metric, rmse AS value FROM per_run
    UNION ALL SELECT run, model, 'mae', mae FROM per_run
    UNION ALL SELECT run, model, 'r2', r2 FROM per_run))
SELECT model, metric, run, value,
       row_number() OVER (PARTITION BY model, metric ORDER BY value, run) AS value_rank
FROM long
"""


@query("metric_ranks", METRIC_RANKS_SQL)
def metric_ranks(spark, sf_dir):
    """Every run's metric value listed in ascending order within its model
    (the window holds one model's runs: 30 rows, bounded by the design)."""
    from pyspark.sql import Window
    long = _metric_long(spark, sf_dir)
    w = Window.partitionBy("model", "metric").orderBy("value", "run")
    return long.select("model", "metric", "run", "value",
                       F.row_number().over(w).cast("bigint").alias("value_rank"))
