"""Registered queries: repeated holdout, roles, folds, exact cuts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions.random import hash32, key_string
from trellis.operators import metrics as M
from trellis.operators import splits as S
from trellis.operators import summary as U
from trellis.plans import price_models as PM
from trellis.plans.registry import query, rounded
from trellis.plans.sqlbits import (LINEITEM_KEY, RUNS, RUNS_CTE, TEST_CUT, h32, keyed, r6,
                                   seeded, v)
from trellis.session import cut_lineage, table

# ------------------------------------------------------------ holdout_compare

_PRICE_SQL_CTES = f"""
{RUNS_CTE},
base AS (
  SELECT {h32(LINEITEM_KEY)} AS kh, l_extendedprice AS x,
         l_extendedprice * (1 - l_discount) AS label,
         LEAST(CAST(floor(l_extendedprice / 10000.0) AS BIGINT), 10) AS bucket
  FROM lineitem),
r AS (
  SELECT run, x, label, bucket,
         CASE WHEN {seeded('kh')} < {TEST_CUT} THEN 'test' ELSE 'train' END AS role
  FROM base CROSS JOIN runs),
bb AS (
  SELECT run, bucket, CAST(count(*) AS DOUBLE) AS n, sum(label) AS sy, sum(x) AS sx,
         sum(x * x) AS sxx, sum(x * label) AS sxy
  FROM r WHERE role = 'train' GROUP BY run, bucket),
g AS (SELECT run, sum(n) AS n, sum(sy) AS sy, sum(sx) AS sx, sum(sxx) AS sxx, sum(sxy) AS sxy
      FROM bb GROUP BY run),
line AS (
  SELECT run, sy / n AS mean_label,
         (sxy - sx * sy / n) / (sxx - sx * sx / n) AS slope,
         sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n) * sx / n AS intercept
  FROM g),
scored AS (
  SELECT r.run, r.role, r.x, r.label, line.mean_label, line.slope, line.intercept,
         bb.sy / bb.n AS bucket_mean
  FROM r JOIN line USING (run) LEFT JOIN bb ON bb.run = r.run AND bb.bucket = r.bucket),
pred AS (
  SELECT run, role, label, 'Mean' AS model, 1 AS model_ord, mean_label AS prediction FROM scored
  UNION ALL
  SELECT run, role, label, 'Least Squares', 2, intercept + slope * x FROM scored
  UNION ALL
  SELECT run, role, label, 'Bucket Mean', 3, coalesce(bucket_mean, mean_label) FROM scored)
"""

_R2_SQL = """CASE WHEN var_pop(label) * count(*) > 0
              THEN 1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*))
              WHEN sum((label - prediction) * (label - prediction)) = 0 THEN 1.0 ELSE 0.0 END"""

_PER_RUN_SQL = f"""
per_run AS (
  SELECT run, model, model_ord,
         sqrt(avg((label - prediction) * (label - prediction))) AS rmse,
         avg(abs(label - prediction)) AS mae,
         {_R2_SQL} AS r2
  FROM pred WHERE role = 'test' GROUP BY run, model, model_ord)
"""

HOLDOUT_COMPARE_SQL = f"""
WITH {_PRICE_SQL_CTES}, {_PER_RUN_SQL}
SELECT model, min(model_ord) AS model_ord, count(*) AS n_runs,
       {r6('avg(rmse)', 'rmse_mean')}, {r6('stddev_samp(rmse)', 'rmse_std')},
       {r6('avg(mae)', 'mae_mean')}, {r6('stddev_samp(mae)', 'mae_std')},
       {r6('avg(r2)', 'r2_mean')}, {r6('stddev_samp(r2)', 'r2_std')}
FROM per_run GROUP BY model
"""


def holdout_per_run(spark, sf_dir, runs: int = RUNS):
    preds = PM.holdout_predictions(table(spark, sf_dir, "lineitem"), runs)
    return M.regression_metrics(preds, ["run", "model", "model_ord"])


@query("holdout_compare", HOLDOUT_COMPARE_SQL)
def holdout_compare(spark, sf_dir):
    """30-run holdout of three price models, by model."""
    per_run = holdout_per_run(spark, sf_dir)
    s = U.summarize(per_run, ["rmse", "mae", "r2"], ["model"], "model_ord")
    s = s.join(per_run.groupBy("model").agg(F.count(F.lit(1)).alias("n_runs")), "model")
    out = s.select("model", "model_ord", "n_runs", "rmse_mean", "rmse_std", "mae_mean",
                   "mae_std", "r2_mean", "r2_std").orderBy("rmse_mean", "model_ord")
    return rounded(out)


OVERFITTING_SQL = f"""
WITH {_PRICE_SQL_CTES},
per_role AS (
  SELECT run, model, role, sqrt(avg((label - prediction) * (label - prediction))) AS rmse,
         {_R2_SQL} AS r2
  FROM pred GROUP BY run, model, role),
wide AS (
  SELECT run, model,
         max(CASE WHEN role = 'train' THEN rmse END) AS rmse_train,
         max(CASE WHEN role = 'test' THEN rmse END) AS rmse_test,
         max(CASE WHEN role = 'train' THEN r2 END) AS r2_train,
         max(CASE WHEN role = 'test' THEN r2 END) AS r2_test
  FROM per_role GROUP BY run, model)
SELECT run, model, {r6('rmse_train', 'rmse_train')}, {r6('rmse_test', 'rmse_test')},
       {r6('r2_train', 'r2_train')}, {r6('r2_test', 'r2_test')},
       {r6("CASE WHEN rmse_train > 0 THEN rmse_test / rmse_train ELSE 'inf'::DOUBLE END",
           'overfitting')}
FROM wide
"""


@query("overfitting_factor", OVERFITTING_SQL)
def overfitting_factor(spark, sf_dir):
    """Train and test RMSE side by side and their ratio, per run and model."""
    preds = PM.holdout_predictions(table(spark, sf_dir, "lineitem"), RUNS,
                                   score_roles=("train", "test"))
    tt = M.train_test_metrics(preds, ["run", "model"])
    return rounded(tt)


METRIC_LONG_SQL = f"""
WITH {_PRICE_SQL_CTES}, {_PER_RUN_SQL}
SELECT run, model, metric, {r6('value', 'value')} FROM (
  SELECT run, model, 'rmse' AS metric, rmse AS value FROM per_run
  UNION ALL SELECT run, model, 'mae', mae FROM per_run
  UNION ALL SELECT run, model, 'r2', r2 FROM per_run)
"""


@query("metric_long", METRIC_LONG_SQL)
def metric_long(spark, sf_dir):
    """Per-run metrics in long form (the data behind the violin figures)."""
    per_run = holdout_per_run(spark, sf_dir)
    long = U.to_long(per_run.select("run", "model", "rmse", "mae", "r2"), ["run", "model"],
                     ["rmse", "mae", "r2"], "metric", "value")
    return rounded(long)


# ------------------------------------------------------------ roles and folds

NESTED_ROLES_SQL = f"""
WITH {RUNS_CTE},
base AS (SELECT o_orderkey, {h32(v('o_orderkey'))} AS kh,
                {h32(keyed(v('o_orderkey'), "'valid'"))} AS vh FROM orders),
r AS (
  SELECT run, o_orderkey,
         CASE WHEN {seeded('kh')} < {TEST_CUT} THEN 'test'
              WHEN {seeded('vh')} < {TEST_CUT} THEN 'valid'
              ELSE 'fit' END AS role
  FROM base CROSS JOIN runs)
SELECT run, role, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum,
       CAST(6 AS BIGINT) AS n_cols
FROM r GROUP BY run, role
"""


@query("nested_roles", NESTED_ROLES_SQL)
def nested_roles(spark, sf_dir):
    """Test / valid / fit roles for 30 runs, counted."""
    orders = table(spark, sf_dir, "orders")
    n_cols = len(orders.columns)
    o = S.add_key_hash(orders.select("o_orderkey"), "o_orderkey")
    o = S.add_key_hash(o, "o_orderkey", "valid_hash", salt="valid")
    r = S.nested_holdout(S.with_runs(o, RUNS), "key_hash", "valid_hash", 0.2, 0.2, "seed")
    return r.groupBy("run", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("key_sum"),
        F.lit(n_cols).cast("bigint").alias("n_cols"))


STRATIFIED_SQL = f"""
WITH {RUNS_CTE},
base AS (SELECT doc_id, quality, {h32(v('doc_id'))} AS kh FROM labels),
r AS (SELECT run, doc_id, quality, {seeded('kh')} AS h FROM base CROSS JOIN runs),
ranked AS (
  SELECT run, doc_id, quality,
         row_number() OVER (PARTITION BY run, quality ORDER BY h, {v('doc_id')}) - 1 AS pos,
         count(*) OVER (PARTITION BY run, quality) AS n
  FROM r)
SELECT run, quality, CASE WHEN pos < CAST(round(0.2 * n) AS BIGINT) THEN 'test' ELSE 'train' END
       AS role, count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS key_sum
FROM ranked GROUP BY ALL
"""


@query("stratified_roles", STRATIFIED_SQL)
def stratified_roles(spark, sf_dir):
    """Exact stratified 80/20 cut per run and class."""
    labels = S.add_key_hash(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    r = S.stratified_split(S.with_runs(labels, RUNS), "key_hash", "doc_id", "quality", 0.2,
                           "seed", extra_by=["run"])
    return r.groupBy("run", "quality", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").alias("key_sum"))


EXACT_SPLIT_SQL = f"""
WITH {RUNS_CTE},
base AS (SELECT c_custkey, {h32(v('c_custkey'))} AS kh FROM customer),
r AS (SELECT run, c_custkey, {seeded('kh')} AS h FROM base CROSS JOIN runs),
ranked AS (
  SELECT run, c_custkey,
         row_number() OVER (PARTITION BY run ORDER BY h, {v('c_custkey')}) - 1 AS pos,
         count(*) OVER (PARTITION BY run) AS n
  FROM r)
SELECT run, CASE WHEN pos < CAST(round(0.2 * n) AS BIGINT) THEN 'test' ELSE 'train' END AS role,
       count(*) AS n_rows, CAST(sum(c_custkey) AS BIGINT) AS key_sum
FROM ranked GROUP BY ALL
"""


@query("exact_split", EXACT_SPLIT_SQL)
def exact_split(spark, sf_dir):
    """Exactly round(0.2 n) test rows per run (not a coin toss)."""
    cust = S.add_key_hash(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    r = S.exact_split(S.with_runs(cust, RUNS), "key_hash", "c_custkey", 0.2, "seed", by=["run"])
    return r.groupBy("run", "role").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.sum("c_custkey").alias("key_sum"))


REPEATED_SPLIT_SQL = f"""
WITH {RUNS_CTE},
base AS (SELECT l_orderkey, l_returnflag, l_linenumber, {h32(v('l_orderkey'))} AS kh FROM lineitem),
r AS (SELECT run, l_orderkey, l_returnflag, {seeded('kh')} AS h FROM base CROSS JOIN runs),
ranked AS (
  SELECT run, l_returnflag, l_orderkey,
         row_number() OVER (PARTITION BY run, l_returnflag ORDER BY h, {v('l_orderkey')}) - 1 AS pos,
         count(*) OVER (PARTITION BY run, l_returnflag) AS n
  FROM r),
k AS (
  SELECT run, l_returnflag, l_orderkey, count(*) AS rows,
         count(*) FILTER (pos < CAST(round(0.2 * n) AS BIGINT)) AS test_rows
  FROM ranked GROUP BY ALL)
SELECT run, l_returnflag, CAST(sum(rows) AS BIGINT) AS n_rows, CAST(sum(test_rows) AS BIGINT) AS n_test,
       CAST(sum(l_orderkey * test_rows) AS BIGINT) AS test_key_sum,
       count(*) FILTER (test_rows BETWEEN 1 AND rows - 1) AS keys_on_both_sides
FROM k GROUP BY ALL
"""


@query("exact_split_repeated_keys", REPEATED_SPLIT_SQL)
def exact_split_repeated_keys(spark, sf_dir):
    """Exactly round(0.2 n) test lines per run and return flag, by order keys that
    several lines share; at most one key of a group lies on both sides of the cut."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    li = S.exact_mask(S.add_key_hash(li, "l_orderkey"), "key_hash", "l_orderkey", 0.2, RUNS, by=["l_returnflag"])
    # the lines of a key with the same roles in all runs are one row, before any is copied once a run
    alike = cut_lineage(li.groupBy("l_returnflag", "l_orderkey", "test_mask").agg(F.count(F.lit(1)).alias("rows")))
    run = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(RUNS).cast("bigint"))).alias("run")
    test_rows = F.when(S.in_mask("test_mask", F.col("run")), F.col("rows")).otherwise(F.lit(0).cast("bigint"))
    sums = alike.select("*", run).groupBy("run", "l_returnflag").agg(
        F.sum("rows").alias("n_rows"), F.sum(test_rows).alias("n_test"), F.sum(F.col("l_orderkey") * test_rows).alias("test_key_sum"))
    # a run's bit is set in some of a key's masks and not in others: the key lies on both sides
    sides = alike.groupBy("l_returnflag", "l_orderkey").agg(F.bit_or("test_mask").bitwiseXOR(F.bit_and("test_mask")).alias("both"))
    cut = sides.where("both <> 0").select("l_returnflag", S.runs_of("both", RUNS).alias("run")).groupBy(
        "run", "l_returnflag").agg(F.count(F.lit(1)).alias("n_both"))
    on = (F.col("s.run") == F.col("c.run")) & F.col("s.l_returnflag").eqNullSafe(F.col("c.l_returnflag"))
    return sums.alias("s").join(cut.alias("c"), on, "left").select(
        "s.run", "s.l_returnflag", "n_rows", "n_test", "test_key_sum", F.coalesce("n_both", F.lit(0).cast("bigint")).alias("keys_on_both_sides"))


FOLD_COUNTS_SQL = f"""
WITH {RUNS_CTE},
base AS (SELECT p_partkey, {h32(v('p_partkey'))} AS kh,
                {h32(keyed(v('p_partkey'), "'fold'"))} AS fh FROM part),
r AS (
  SELECT run, p_partkey, CAST({seeded('fh')} % 5 AS INTEGER) AS fold, {seeded('kh')} AS h
  FROM base CROSS JOIN runs)
SELECT run, fold, count(*) AS n_rows, CAST(sum(p_partkey) AS BIGINT) AS key_sum
FROM r WHERE h >= {TEST_CUT} GROUP BY run, fold
"""


@query("fold_counts", FOLD_COUNTS_SQL)
def fold_counts(spark, sf_dir):
    """Five hashed folds of the training rows of each run."""
    part = S.add_key_hash(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    part = S.add_key_hash(part, "p_partkey", "fold_hash", salt="fold")
    r = S.holdout(S.with_runs(part, RUNS), "key_hash", 0.2, "seed")
    r = S.kfold(r.where(F.col("role") == "train"), "fold_hash", 5, "seed")
    return r.groupBy("run", "fold").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.sum("p_partkey").alias("key_sum"))


SEEDED_SAMPLE_SQL = f"""
SELECT event_id, user_id, {r6('value', 'value')},
       row_number() OVER (ORDER BY {h32(keyed(v('event_id'), "'42'"))}, {v('event_id')})
         AS sample_rank
FROM events
ORDER BY {h32(keyed(v('event_id'), "'42'"))}, {v('event_id')}
LIMIT 1000
"""


@query("seeded_sample", SEEDED_SAMPLE_SQL)
def seeded_sample(spark, sf_dir):
    """Seeded sample of at most 1,000 events (the sample is the feature)."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return rounded(S.seeded_sample(ev, "event_id", 1000, seed=42))


SAMPLE_PER_USER_SQL = f"""
SELECT user_id, event_id, sample_rank FROM (
  SELECT user_id, event_id,
         row_number() OVER (PARTITION BY user_id
                            ORDER BY {h32(keyed(v('event_id'), "'42'"))}, {v('event_id')})
           AS sample_rank
  FROM events) WHERE sample_rank <= 5
"""


@query("sample_per_user", SAMPLE_PER_USER_SQL)
def sample_per_user(spark, sf_dir):
    """D7 per group: at most 5 seeded events per user (group limit before shuffle)."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id")
    return S.seeded_sample(ev, "event_id", 5, seed=42, by=["user_id"]).select(
        "user_id", "event_id", "sample_rank")
