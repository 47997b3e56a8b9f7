"""Paired one-sided signed-rank test over runs (or any pairing key).

Pairs are joined on an explicit key (never by position), zero differences are
dropped, absolute differences get average ranks with ties, and

* ``w_plus`` = sum of ranks of positive differences (the statistic);
* normal approximation with tie correction, no continuity term:
  ``z = (w_plus - n(n+1)/4) / sqrt(n(n+1)(2n+1)/24 - sum(t^3 - t)/48)``;
* exact tail: the share of rank subsets with sum >= w, from a subset-sum table.

``p_value`` follows the common default: the exact tail for up to ``EXACT_PAIRS`` pairs
without ties or zero differences, the normal one else.  A test counts only if both
sides have the same keys and more than one: a difference that is null (a key that one
side lacks) or a single pair makes ``z`` and every p null.

Ranks need the pairs of one test in one window; a test has one pair per run
(or per day), which is bounded by the design of the experiment, not by data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Coefficients of the Chebyshev fit of erfc(x) (fractional error
# below 1.2e-7 everywhere), in order of the Horner scheme.
ERFC_COEFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
              0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


#: most pairs for which the exact tail is the default
EXACT_PAIRS = 50


def _erfc_pos(ax: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * ax)
    poly = F.lit(ERFC_COEFS[-1])
    for c in reversed(ERFC_COEFS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-ax * ax + poly)


def normal_sf(z: Column) -> Column:
    """Upper tail P(Z > z) of the standard normal, JVM-side."""
    x = z / F.lit(np.sqrt(2.0))
    e = _erfc_pos(F.abs(x))
    return F.when(x >= 0, F.lit(0.5) * e).otherwise(F.lit(1.0) - F.lit(0.5) * e)


def sql_normal_sf(z: str) -> str:
    """DuckDB twin of :func:`normal_sf` for an SQL expression ``z``."""
    ax = f"abs(({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.5 * {ax}))"
    poly = repr(ERFC_COEFS[-1])
    for c in reversed(ERFC_COEFS[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    e = f"({t} * exp(-{ax} * {ax} + {poly}))"
    return f"(CASE WHEN ({z}) >= 0 THEN 0.5 * {e} ELSE 1.0 - 0.5 * {e} END)"


def exact_upper_tail(n: int, w: float) -> float:
    """P(W+ >= w) under the null for n untied, non-zero pairs."""
    total = n * (n + 1) // 2
    share = np.zeros(total + 1)
    share[0] = 1.0
    for r in range(1, n + 1):                 # subsets of {1..r} by their sum
        share[r:] = share[r:] + share[:-r].copy()
        share /= 2.0
    k = int(np.ceil(w - 1e-9))
    return float(share[k:].sum())


def exact_sf(n: Column, w: Column) -> Column:
    """:func:`exact_upper_tail` as a column expression, for n up to ``EXACT_PAIRS``."""
    n = n.cast("int")
    total = (n * (n + 1) / 2).cast("int")
    sums = F.sequence(F.lit(0), total)
    start = F.transform(sums, lambda k: F.when(k == 0, 1.0).otherwise(0.0))

    def add(share, r):
        return F.transform(share, lambda x, k: (
            x + F.when(k >= r, F.get(share, k - r)).otherwise(0.0)) / 2.0)

    share = F.aggregate(F.sequence(F.lit(1), n), start, add)
    return F.aggregate(F.slice(share, F.ceil(w - 1e-9).cast("int") + 1, total + 1), F.lit(0.0),
                       lambda a, x: a + x)


def sql_exact_table(most: int = EXACT_PAIRS) -> str:
    """DuckDB twin: a recursive table ``subset_share(r, share)``, ``share[k + 1]`` being
    the share of subsets of 1..r with sum k."""
    cells = most * (most + 1) // 2 + 1
    return f"""subset_share(r, share) AS (
  SELECT 0, [CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR k IN range(0, {cells})]
  UNION ALL
  SELECT r + 1, [(share[k + 1] + CASE WHEN k > r THEN share[k - r] ELSE 0.0::DOUBLE END) / 2.0
                 FOR k IN range(0, {cells})]
  FROM subset_share WHERE r < {most})"""


def sql_exact_sf(share: str, w: str) -> str:
    return f"list_sum({share}[CAST(ceil({w} - 1e-9) AS INT) + 1:])"


def signed_rank(diffs: DataFrame, test_cols: list[str], diff_col: str = "d",
                alternative: str = "greater") -> DataFrame:
    """One row per test: ``n_pairs, n_used, w_plus, w_minus, z, p_normal, p_value``.

    ``alternative``: ``greater`` (a > b), ``less`` or ``two-sided``.  Rows whose
    difference is null are keys that one side lacks.
    """
    d = F.col(diff_col)
    base = diffs.where(d.isNotNull())
    used = base.where(d != 0).withColumn("_a", F.abs(d))
    w = Window.partitionBy(*test_cols).orderBy("_a")
    ties = Window.partitionBy(*test_cols, "_a")
    ranked = (used.withColumn("_r", F.rank().over(w).cast("double"))
              .withColumn("_t", F.count(F.lit(1)).over(ties).cast("double"))
              .withColumn("_ar", F.col("_r") + (F.col("_t") - 1) / 2.0))
    stats = ranked.groupBy(*test_cols).agg(
        F.count(F.lit(1)).alias("n_used"),
        F.sum(F.when(d > 0, F.col("_ar")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(d < 0, F.col("_ar")).otherwise(0.0)).alias("w_minus"),
        # each tie group of size t contributes t rows of (t^2 - 1): sum = sum(t^3 - t)
        F.sum(F.col("_t") * F.col("_t") - 1).alias("_tie"),
        F.max("_t").alias("_max_tie"))
    counts = diffs.groupBy(*test_cols).agg(F.count(d).alias("n_pairs"),
                                           F.count(F.lit(1)).alias("_keys"))
    n = F.col("n_used").cast("double")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tie") / 48.0
    z = (F.col("w_plus") - mean) / F.sqrt(var)
    other = n * (n + 1) / 2.0 - F.col("w_plus")
    if alternative == "greater":
        p, exact = normal_sf(z), exact_sf(n, F.col("w_plus"))
    elif alternative == "less":
        p, exact = normal_sf(-z), exact_sf(n, other)
    else:
        p = F.least(F.lit(1.0), F.lit(2.0) * normal_sf(F.abs(z)))
        exact = F.least(F.lit(1.0), 2.0 * exact_sf(n, F.greatest(F.col("w_plus"), other)))
    sound = (F.col("n_pairs") == F.col("_keys")) & (F.col("n_pairs") > 1) & (var > 0)
    plain = (F.col("n_used") == F.col("n_pairs")) & (F.col("_max_tie") <= 1) & (n <= EXACT_PAIRS)
    out = (counts.join(stats, test_cols, "left")
           .withColumn("z", F.when(sound, z))
           .withColumn("p_normal", F.when(sound, p))
           .withColumn("p_value", F.when(sound & plain, exact).otherwise(F.col("p_normal"))))
    return out.select(*test_cols, "n_pairs", F.coalesce("n_used", F.lit(0)).cast("bigint")
                      .alias("n_used"), "w_plus", "w_minus", "z", "p_normal", "p_value", "_max_tie")


def paired_differences(results: DataFrame, pair_key: list[str], model_col: str,
                       metric: str, model_a: str, model_b: str,
                       test_cols: list[str] | None = None) -> DataFrame:
    """``d = metric(a) - metric(b)`` by the pairing key (e.g. run); a key that one
    side lacks stays, with a null difference."""
    tc = list(test_cols or [])
    a = results.where(F.col(model_col) == model_a).select(*tc, *pair_key,
                                                         F.col(metric).alias("_a"))
    b = results.where(F.col(model_col) == model_b).select(*tc, *pair_key,
                                                         F.col(metric).alias("_b"))
    return a.join(b, [*tc, *pair_key], "full_outer").withColumn("d", F.col("_a") - F.col("_b"))
