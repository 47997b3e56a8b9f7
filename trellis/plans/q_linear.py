"""Registered queries: least squares, ridge and lasso paths, extrapolation and
linear contributions, all from grouped sufficient statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trellis.functions.random import key_string
from trellis.operators import explain as X
from trellis.operators import linear as L
from trellis.operators import metrics as M
from trellis.operators import splits as S
from trellis.plans import price_models as PM
from trellis.plans.registry import query, rounded
from trellis.plans.sqlbits import (LINEITEM_KEY, RUNS, RUNS_CTE, TEST_CUT, h32, keyed, r6,
                                   seeded)
from trellis.session import table

ALPHAS = L.logspace_alphas(-4.0, 4.0, 100)

# ------------------------------------------------------------ one-feature OLS by segment

OLS_SEGMENT_SQL = f"""
WITH j AS (
  SELECT c.c_mktsegment AS segment, c.c_acctbal AS x, o.o_totalprice AS y
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
s AS (SELECT segment, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy,
             sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM j GROUP BY segment),
f AS (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS slope FROM s)
SELECT segment, CAST(n AS BIGINT) AS n, {r6('sy / n - slope * sx / n', 'intercept')},
       {r6('slope', 'slope')},
       {r6('slope * (sxy - sx * sy / n) / (syy - sy * sy / n)', 'r2')}
FROM f
"""


@query("ols_by_segment", OLS_SEGMENT_SQL)
def ols_by_segment(spark, sf_dir):
    """M1 grouped: order total on customer balance, one least-squares fit per segment."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    j = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("x"),
        F.col("o_totalprice").alias("label"))
    return rounded(j.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.regr_intercept("label", "x").alias("intercept"),
        F.regr_slope("label", "x").alias("slope"), F.regr_r2("label", "x").alias("r2")))


# ------------------------------------------------------------ two-feature OLS per run

_TWO_FEATURE_CTES = f"""
{RUNS_CTE},
mu AS (SELECT avg(l_extendedprice) AS g1, avg(l_discount) AS g2,
              avg(l_extendedprice * (1 - l_discount)) AS gy FROM lineitem),
base AS (
  SELECT {h32(LINEITEM_KEY)} AS kh, l_extendedprice - g1 AS x1, l_discount - g2 AS x2,
         l_extendedprice * (1 - l_discount) - gy AS y FROM lineitem CROSS JOIN mu),
r AS (
  SELECT run, x1, x2, y,
         CASE WHEN {seeded('kh')} < {TEST_CUT} THEN 'test' ELSE 'train' END AS role
  FROM base CROSS JOIN runs),
s AS (
  SELECT run, CAST(count(*) AS DOUBLE) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy,
         sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22,
         sum(x1 * y) AS s1y, sum(x2 * y) AS s2y
  FROM r WHERE role = 'train' GROUP BY run),
c AS (
  SELECT run, n, s1, s2, sy, s11 - s1 * s1 / n AS c11, s12 - s1 * s2 / n AS c12,
         s22 - s2 * s2 / n AS c22, s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y FROM s),
b AS (
  SELECT run, n, s1, s2, sy,
         (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS b1,
         (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS b2 FROM c),
fit AS (SELECT run, b1, b2, sy / n - b1 * s1 / n - b2 * s2 / n AS a, s1 / n AS m1, s2 / n AS m2
        FROM b)
"""

OLS_TWO_SQL = f"""
WITH {_TWO_FEATURE_CTES}
SELECT run, {r6('min(a + gy - b1 * g1 - b2 * g2)', 'intercept')}, {r6('min(b1)', 'coef_price')},
       {r6('min(b2)', 'coef_discount')},
       {r6('sqrt(avg((y - a - b1 * x1 - b2 * x2) * (y - a - b1 * x1 - b2 * x2)))', 'rmse_test')}
FROM r JOIN fit USING (run) CROSS JOIN mu WHERE role = 'test' GROUP BY run
"""

TWO_FEATURES = ["l_extendedprice", "l_discount"]


def _two_feature_rows(spark, sf_dir, runs: int = RUNS):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(*PM.LINEITEM_KEY, *TWO_FEATURES,
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("label"))
    rows, shifts = L.shifted(rows, [*TWO_FEATURES, "label"])    # means of raw columns
    rows = S.add_key_hash(rows, key_string(*PM.LINEITEM_KEY)).drop(*PM.LINEITEM_KEY)
    return S.holdout(S.with_runs(rows, runs), "key_hash", 0.2, "seed"), shifts


def _two_feature_fit(rows):
    sums = L.gram_sums(rows.where(F.col("role") == "train"), TWO_FEATURES, "label", ["run"])
    return L.ols_from_sums(sums, 2, ["run"])


@query("ols_two_features", OLS_TWO_SQL)
def ols_two_features(spark, sf_dir):
    """Two-feature least squares per run from grouped sums; test RMSE."""
    rows, shifts = _two_feature_rows(spark, sf_dir)
    fits = _two_feature_fit(rows)                 # in shifted units
    test = rows.where(F.col("role") == "test").join(F.broadcast(fits), "run")  # runs rows
    pred = test.withColumn("prediction", L.linear_prediction(TWO_FEATURES))
    rm = M.regression_metrics(pred, ["run"])
    fits = L.unshift_intercept(fits, TWO_FEATURES, shifts, "label")
    out = fits.join(rm, "run").select(
        "run", "intercept", F.col("coef")[0].alias("coef_price"),
        F.col("coef")[1].alias("coef_discount"), F.col("rmse").alias("rmse_test"))
    return rounded(out)


# ------------------------------------------------------------ ridge and lasso paths

def _path_sql(kind: str) -> str:
    if kind == "ridge":
        slope = "(sxy - sx * sy / n) / ((sxx - sx * sx / n) + alpha)"
    else:
        z = "((sxy - sx * sy / n) / n)"
        slope = (f"sign({z}) * greatest(abs({z}) - alpha, 0) / ((sxx - sx * sx / n) / n)")
    return f"""
WITH {RUNS_CTE},
base AS (
  SELECT {h32(LINEITEM_KEY)} AS kh, {h32(keyed(LINEITEM_KEY, "'fold'"))} AS fh,
         l_extendedprice / 1000.0 AS x,
         l_extendedprice * (1 - l_discount) / 1000.0 AS y FROM lineitem),
r AS (
  SELECT run, x, y, {seeded('kh')} AS h, CAST({seeded('fh')} % 5 AS INTEGER) AS fold
  FROM base CROSS JOIN runs),
fs AS (
  SELECT run, fold, CAST(count(*) AS DOUBLE) AS fn, sum(x) AS fsx, sum(y) AS fsy,
         sum(x * x) AS fsxx, sum(x * y) AS fsxy, sum(y * y) AS fsyy
  FROM r WHERE h >= {TEST_CUT} GROUP BY run, fold),
tot AS (SELECT run, sum(fn) AS tn, sum(fsx) AS tsx, sum(fsy) AS tsy, sum(fsxx) AS tsxx,
               sum(fsxy) AS tsxy FROM fs GROUP BY run),
alphas AS (SELECT CAST(range AS INTEGER) AS alpha_idx,
                  pow(10.0, -4.0 + 8.0 * range / 99.0) AS alpha FROM range(0, 100)),
tr AS (
  SELECT fs.*, tn - fn AS n, tsx - fsx AS sx, tsy - fsy AS sy, tsxx - fsxx AS sxx,
         tsxy - fsxy AS sxy FROM fs JOIN tot USING (run)),
fit AS (SELECT tr.*, alpha_idx, alpha, {slope} AS b FROM tr CROSS JOIN alphas),
fit2 AS (SELECT *, sy / n - b * sx / n AS a0 FROM fit),
ev AS (
  SELECT run, fold, alpha_idx, alpha, fn,
         fsyy - 2 * a0 * fsy - 2 * b * fsxy + fn * a0 * a0 + 2 * a0 * b * fsx + b * b * fsxx
           AS sse,
         fsyy - fsy * fsy / fn AS sst
  FROM fit2)
SELECT run, alpha_idx, {r6('alpha', 'alpha')}, {r6('avg(1 - sse / sst)', 'cv_r2')},
       {r6('avg(sse / fn)', 'cv_mse')}
FROM ev GROUP BY run, alpha_idx, alpha
"""


def _fold_sums(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(*PM.LINEITEM_KEY, (F.col("l_extendedprice") / 1000.0).alias("x"),
                     (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000.0)
                     .alias("label"))
    key = key_string(*PM.LINEITEM_KEY)
    rows = S.add_key_hash(rows, key)
    rows = S.add_key_hash(rows, key, "fold_hash", salt="fold").drop(*PM.LINEITEM_KEY)
    r = S.holdout(S.with_runs(rows, RUNS), "key_hash", 0.2, "seed")
    r = S.kfold(r.where(F.col("role") == "train"), "fold_hash", 5, "seed")
    return L.gram_sums(r, ["x"], "label", ["run", "fold"])


@query("ridge_path", _path_sql("ridge"))
def ridge_path(spark, sf_dir):
    """M2: 100 penalties x 5 folds x 30 runs from one pass of fold sums."""
    path = L.cv_path(_fold_sums(spark, sf_dir), 1, ["run"], ALPHAS, "ridge")
    return rounded(path)


@query("lasso_path", _path_sql("lasso"))
def lasso_path(spark, sf_dir):
    """M3: lasso path by coordinate descent on fold sums (soft threshold for one feature)."""
    path = L.cv_path(_fold_sums(spark, sf_dir), 1, ["run"], ALPHAS, "lasso")
    return rounded(path)


def _choice_sql(kind: str) -> str:
    """The path's best penalty of each run and its refit on all training rows."""
    path = _path_sql(kind)
    at = path.rindex("SELECT run, alpha_idx")
    score = "-round(avg(1 - sse / sst), 6)" if kind == "ridge" else "round(avg(sse / fn), 6)"
    if kind == "ridge":
        slope = "(tsxy - tsx * tsy / tn) / ((tsxx - tsx * tsx / tn) + alpha)"
    else:
        z = "((tsxy - tsx * tsy / tn) / tn)"
        slope = f"sign({z}) * greatest(abs({z}) - alpha, 0) / ((tsxx - tsx * tsx / tn) / tn)"
    return f"""{path[:at].rstrip()},
scored AS (SELECT run, alpha_idx, alpha, {score} AS score FROM ev GROUP BY run, alpha_idx, alpha),
best AS (SELECT run, alpha FROM scored
         QUALIFY row_number() OVER (PARTITION BY run ORDER BY score, alpha DESC) = 1),
refit AS (SELECT run, alpha, {slope} AS slope, tsx / tn AS mx, tsy / tn AS my FROM best JOIN tot USING (run))
SELECT run, {r6('alpha', 'alpha')}, {r6('my - slope * mx', 'intercept')}, {r6('slope', 'slope')} FROM refit
"""


def _choice(spark, sf_dir, kind: str):
    fits = L.cv_fit(_fold_sums(spark, sf_dir), 1, ["run"], ALPHAS, kind, digits=6)
    return rounded(fits.select("run", "alpha", "intercept", F.col("coef")[0].alias("slope")))


@query("ridge_choice", _choice_sql("ridge"))
def ridge_choice(spark, sf_dir):
    """The ridge penalty of highest mean R2 over five folds of each run, and the fit
    with it on all training rows."""
    return _choice(spark, sf_dir, "ridge")


@query("lasso_choice", _choice_sql("lasso"))
def lasso_choice(spark, sf_dir):
    """The lasso penalty of lowest mean squared error over five folds of each run,
    and the fit with it on all training rows."""
    return _choice(spark, sf_dir, "lasso")


# ------------------------------------------------------------ extrapolation by range split

EXTRAPOLATION_SQL = f"""
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
scored AS (SELECT base.*, line.*, bb.sy / bb.n AS bucket_mean
           FROM base CROSS JOIN line LEFT JOIN bb USING (bucket)),
pred AS (
  SELECT role, label, 'Mean' AS model, mean_label AS prediction FROM scored
  UNION ALL SELECT role, label, 'Least Squares', intercept + slope * x FROM scored
  UNION ALL SELECT role, label, 'Bucket Mean', coalesce(bucket_mean, mean_label) FROM scored)
SELECT model, role, count(*) AS n,
       {r6('sqrt(avg((label - prediction) * (label - prediction)))', 'rmse')},
       {r6('avg(abs(label - prediction))', 'mae')},
       {r6('''CASE WHEN var_pop(label) * count(*) > 0
              THEN 1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*))
              ELSE 0.0 END''', 'r2')}
FROM pred GROUP BY model, role
"""


@query("range_split_extrapolation", EXTRAPOLATION_SQL)
def range_split_extrapolation(spark, sf_dir):
    """Train on price <= 50,000, score both sides; the
    bucket model stays flat past its training range, the line does not."""
    rows = PM.price_rows(table(spark, sf_dir, "lineitem")).drop(*PM.LINEITEM_KEY)
    rows = S.range_split(rows, F.col("x") <= 50000).withColumn("split", F.lit("price"))
    line, buckets = PM.fit_tables(rows.where(F.col("role") == "train"), ["split"])
    preds = PM.predictions(rows, line, buckets, ["split"])
    return rounded(M.regression_metrics(preds, ["model", "role"]).select(
        "model", "role", "n", "rmse", "mae", "r2"))


# ------------------------------------------------------------ linear contributions

_CONTRIB_CTES = f"""
{_TWO_FEATURE_CTES},
ph AS (
  SELECT run, fit.a + fit.b1 * fit.m1 + fit.b2 * fit.m2 + mu.gy AS base_value,
         x1 + g1 AS price, x2 + g2 AS discount,
         b1 * (x1 - m1) AS phi_price, b2 * (x2 - m2) AS phi_discount
  FROM r JOIN fit USING (run) CROSS JOIN mu WHERE role = 'test')
"""

CONTRIB_SQL = f"""
WITH {_CONTRIB_CTES},
lng AS (
  SELECT run, 'l_extendedprice' AS feature, phi_price AS phi, base_value FROM ph
  UNION ALL SELECT run, 'l_discount', phi_discount, base_value FROM ph),
agg AS (SELECT run, feature, count(*) AS n, avg(abs(phi)) AS mean_abs_phi, avg(phi) AS mean_phi,
               min(phi) AS min_phi, max(phi) AS max_phi, min(base_value) AS base_value
        FROM lng GROUP BY run, feature)
SELECT run, feature, n, {r6('mean_abs_phi', 'mean_abs_phi')}, {r6('mean_phi', 'mean_phi')},
       {r6('min_phi', 'min_phi')}, {r6('max_phi', 'max_phi')}, {r6('base_value', 'base_value')},
       row_number() OVER (PARTITION BY run ORDER BY mean_abs_phi DESC) AS importance_rank
FROM agg
"""


def _contributions(spark, sf_dir):
    """(run, feature, value, phi, base_value) of the test rows of all runs."""
    rows, shifts = _two_feature_rows(spark, sf_dir)
    train = rows.where(F.col("role") == "train")
    fits = _two_feature_fit(train)
    means = train.groupBy("run").agg(*[F.avg(f).alias(f) for f in TWO_FEATURES])
    phi = X.linear_contributions(rows.where(F.col("role") == "test"), fits, means, TWO_FEATURES, ["run"])
    return phi.withColumn("base_value", F.col("base_value") + shifts["label"]), shifts


@query("linear_contributions", CONTRIB_SQL)
def linear_contributions(spark, sf_dir):
    """Exact additive contributions of each run's two-feature line on its test
    rows, summarised by feature (mean |phi| order)."""
    phi, _ = _contributions(spark, sf_dir)
    summ = X.contribution_summary(phi, ["run"])
    # the window holds one run's features
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.col("mean_abs_phi").desc()))
    return rounded(summ.withColumn("importance_rank", rank.cast("bigint")))


SPREAD_SQL = f"""
WITH {_CONTRIB_CTES},
lng AS (
  SELECT 'l_extendedprice' AS feature, round(price, 2) AS value, phi_price AS phi FROM ph
  UNION ALL SELECT 'l_discount', round(discount, 2), phi_discount FROM ph),
cut AS (SELECT feature, quantile_cont(value, [0.2, 0.4, 0.6, 0.8]) AS q, min(phi) AS lo, max(phi) AS hi
        FROM lng GROUP BY feature)
SELECT feature, CAST(1 + (value > q[1])::INT + (value > q[2])::INT + (value > q[3])::INT + (value > q[4])::INT AS BIGINT) AS value_bin,
       CAST(least(floor((phi - lo) / ((hi - lo) / 5.0)) + 1, 5) AS BIGINT) AS phi_bin, count(*) AS n,
       {r6('min(value)', 'min_value')}, {r6('max(value)', 'max_value')},
       {r6('min(phi)', 'min_phi')}, {r6('max(phi)', 'max_phi')}, {r6('avg(phi)', 'mean_phi')}
FROM lng JOIN cut USING (feature) GROUP BY ALL
"""


@query("contribution_spread", SPREAD_SQL)
def contribution_spread(spark, sf_dir):
    """How contributions spread over the values of a feature, on the test rows of all
    runs: fifths of the values against five equal ranges of the contribution."""
    phi, shifts = _contributions(spark, sf_dir)
    back = F.when(F.col("feature") == TWO_FEATURES[0], shifts[TWO_FEATURES[0]]).otherwise(shifts[TWO_FEATURES[1]])
    return rounded(X.contribution_spread(phi.withColumn("value", F.round(F.col("value") + back, 2)), 5, 5))
