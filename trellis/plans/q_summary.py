"""Registered queries: describe, first-seen order, top/bottom, log bins, labels
by language, and the paired signed-rank test."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import paired as P
from trellis.operators import summary as U
from trellis.plans import labels as LB
from trellis.plans.q_holdout import _PER_RUN_SQL, _PRICE_SQL_CTES, holdout_per_run
from trellis.plans.registry import query, rounded
from trellis.plans.sqlbits import r6
from trellis.session import table

DESCRIBE_SQL = f"""
SELECT l_returnflag, count(l_extendedprice) AS count,
       {r6('avg(l_extendedprice)', 'mean')}, {r6('stddev_samp(l_extendedprice)', 'std')},
       {r6('min(l_extendedprice)', 'min')}, {r6('quantile_cont(l_extendedprice, 0.25)', 'q25')},
       {r6('quantile_cont(l_extendedprice, 0.5)', 'q50')},
       {r6('quantile_cont(l_extendedprice, 0.75)', 'q75')}, {r6('max(l_extendedprice)', 'max')}
FROM lineitem GROUP BY l_returnflag
"""


@query("describe_by_group", DESCRIBE_SQL)
def describe_by_group(spark, sf_dir):
    """A2: count, mean, std, min, quartiles (exact, interpolated), max by group."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    d = U.describe(li, ["l_returnflag"], "l_extendedprice")
    return rounded(d.select("l_returnflag", "count", "mean", "std", "min", "q25", "q50", "q75",
                            "max"))


FIRST_SEEN_SQL = """
SELECT event_type, min(event_id) AS first_seen,
       row_number() OVER (ORDER BY min(event_id), event_type) AS first_ord
FROM events GROUP BY event_type
"""


@query("first_seen_order", FIRST_SEEN_SQL)
def first_seen_order(spark, sf_dir):
    """Distinct event types numbered by first appearance."""
    ev = table(spark, sf_dir, "events").select("event_type", "event_id")
    o = U.first_seen_order(ev, "event_type", "event_id")
    return o.select("event_type", "first_seen", F.col("first_ord").cast("bigint"))


TOP_BOTTOM_SQL = f"""
(SELECT p_partkey, {r6('p_retailprice', 'p_retailprice')}, 'top' AS side FROM part
 ORDER BY p_retailprice DESC, p_partkey LIMIT 10)
UNION ALL
(SELECT p_partkey, {r6('p_retailprice', 'p_retailprice')}, 'bottom' AS side FROM part
 ORDER BY p_retailprice ASC, p_partkey LIMIT 10)
"""


@query("top_bottom", TOP_BOTTOM_SQL)
def top_bottom(spark, sf_dir):
    """Ten largest and ten smallest retail prices, stacked."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return rounded(U.top_bottom(part, "p_retailprice", 10, ["p_partkey"]))


LOG_BINS_SQL = f"""
SELECT {r6('floor(log10(o_totalprice) * 10) / 10.0', 'log_bin')}, count(*) AS n
FROM orders WHERE o_totalprice >= 1000 GROUP BY 1
"""


@query("log_bins", LOG_BINS_SQL)
def log_bins(spark, sf_dir):
    """V4: tenth-of-a-decade bins on a log axis above a lower limit of 1,000."""
    o = table(spark, sf_dir, "orders").select("o_totalprice").where(F.col("o_totalprice") >= 1000)
    b = o.select((F.floor(F.log10("o_totalprice") * 10) / 10.0).alias("log_bin"))
    return rounded(b.groupBy("log_bin").agg(F.count(F.lit(1)).alias("n")))


TRANSLATED_SQL = f"""
WITH {_PRICE_SQL_CTES}, {_PER_RUN_SQL},
s AS (
  SELECT model, 'rmse' AS metric, avg(rmse) AS m, stddev_samp(rmse) AS sd FROM per_run GROUP BY model
  UNION ALL SELECT model, 'mae', avg(mae), stddev_samp(mae) FROM per_run GROUP BY model
  UNION ALL SELECT model, 'r2', avg(r2), stddev_samp(r2) FROM per_run GROUP BY model)
SELECT t.lang, s.model, s.metric, t.title, printf('%.4f±%.4f', s.m, s.sd) AS mean_std_text
FROM s JOIN {LB.sql_values()} ON s.metric = t.metric
"""


@query("translated_labels", TRANSLATED_SQL)
def translated_labels(spark, sf_dir):
    """Per-model `mean±std` texts with metric titles in each language."""
    per_run = holdout_per_run(spark, sf_dir)
    s = U.summarize(per_run, ["rmse", "mae", "r2"], ["model"], None)
    long = s.select("model", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("m"),
                 F.col(f"{m}_std").alias("sd")) for m in ["rmse", "mae", "r2"]])))
    titles = F.broadcast(LB.titles_table(spark))          # 32 rows at most
    j = long.join(titles, "metric")
    return j.select("lang", "model", "metric", "title",
                    U.format_mean_std("m", "sd", 4).alias("mean_std_text"))


def _signed_rank_sql(pairs: str, test: str) -> str:
    """Twin of the paired test over ``d(test, d)``: a CTE list that ends with it."""
    return f"""
WITH RECURSIVE {P.sql_exact_table()},
{pairs},
u AS (SELECT {test}, d, abs(d) AS ad FROM d WHERE d <> 0),
rk AS (SELECT {test}, d,
              rank() OVER (PARTITION BY {test} ORDER BY ad)
                + (count(*) OVER (PARTITION BY {test}, ad) - 1) / 2.0 AS ar,
              count(*) OVER (PARTITION BY {test}, ad) AS t FROM u),
st AS (SELECT {test}, count(*) AS n_used,
              sum(CASE WHEN d > 0 THEN ar ELSE 0 END) AS w_plus,
              sum(CASE WHEN d < 0 THEN ar ELSE 0 END) AS w_minus,
              CAST(sum(t * t - 1) AS DOUBLE) AS tie, max(t) AS max_tie FROM rk GROUP BY {test}),
np AS (SELECT {test}, count(d) AS n_pairs, count(*) AS n_keys FROM d GROUP BY {test}),
v AS (SELECT np.{test}, n_pairs, n_keys, coalesce(n_used, 0) AS n_used, w_plus, w_minus, max_tie,
             n_used * (n_used + 1) * (2 * n_used + 1) / 24.0 - tie / 48.0 AS var
      FROM np LEFT JOIN st USING ({test})),
z AS (SELECT *, CASE WHEN n_pairs = n_keys AND n_pairs > 1 AND var > 0
                     THEN (w_plus - n_used * (n_used + 1) / 4.0) / sqrt(var) END AS z FROM v),
p AS (SELECT z.*, CASE WHEN z IS NOT NULL THEN {P.sql_normal_sf('z')} END AS p_normal, share
      FROM z LEFT JOIN subset_share ON r = n_used AND n_used = n_pairs AND max_tie <= 1),
e AS (SELECT *, CASE WHEN z IS NULL THEN NULL WHEN share IS NULL THEN p_normal
                     ELSE {P.sql_exact_sf('share', 'w_plus')} END AS p_value FROM p)
SELECT {test}, n_pairs, n_used, {r6('w_plus', 'w_plus')}, {r6('w_minus', 'w_minus')},
       {r6('z', 'z')}, {r6('p_normal', 'p_normal')}, {r6('p_value', 'p_value')},
       CASE WHEN p_value IS NULL THEN 'not tested' WHEN p_value < 0.05 THEN 'significant'
            ELSE 'not significant' END AS verdict
FROM e
"""


SIGNED_RANK_SQL = _signed_rank_sql("""daily AS (
  SELECT CAST(ts AS DATE) AS day, event_type, avg(value) AS v FROM events GROUP BY 1, 2),
a AS (SELECT day, v AS va, comparison
      FROM daily, (SELECT DISTINCT event_type AS comparison FROM daily WHERE event_type <> 'click')
      WHERE event_type = 'click'),
b AS (SELECT day, event_type AS comparison, v AS vb FROM daily WHERE event_type <> 'click'),
d AS (SELECT comparison, va - vb AS d FROM a FULL JOIN b USING (day, comparison))""", "comparison")

SIGNED_RANK_BY_USER_SQL = _signed_rank_sql("""daily AS (
  SELECT user_id, CAST(ts AS DATE) AS day,
         avg(CASE WHEN event_type = 'click' THEN value END) AS va,
         avg(CASE WHEN event_type = 'view' THEN value END) AS vb
  FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
d AS (SELECT user_id, va - vb AS d FROM daily)""", "user_id")


@query("signed_rank", SIGNED_RANK_SQL)
def signed_rank(spark, sf_dir):
    """Daily mean value of clicks against each other event type,
    paired by day; one-sided signed-rank test (clicks greater)."""
    ev = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type",
                                               "value")
    daily = ev.groupBy("day", "event_type").agg(F.avg("value").alias("v"))
    others = daily.where(F.col("event_type") != "click").select(
        "day", F.col("event_type").alias("comparison"), F.col("v").alias("vb"))
    # one side per comparison: days x event types, a few hundred rows
    kinds = others.select(F.col("comparison")).distinct()
    clicks = (daily.where(F.col("event_type") == "click").select("day", F.col("v").alias("va"))
              .join(F.broadcast(kinds.agg(F.collect_set("comparison").alias("all"))))
              .select("day", "va", F.explode("all").alias("comparison")))
    d = (clicks.join(others, ["day", "comparison"], "full_outer")
         .withColumn("d", F.col("va") - F.col("vb")))
    return _tested(d, "comparison")


@query("signed_rank_by_user", SIGNED_RANK_BY_USER_SQL)
def signed_rank_by_user(spark, sf_dir):
    """The same test for each user, daily clicks against daily views.  Users with
    days that only one side has, or with a single day, are not tested."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    side = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    daily = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        side("click").alias("va"), side("view").alias("vb"))
    return _tested(daily.withColumn("d", F.col("va") - F.col("vb")), "user_id")


def _tested(d, test: str):
    t = P.signed_rank(d, [test], "d", "greater")
    return rounded(t.withColumn("verdict", U.verdict("p_value")).drop("_max_tie"))
