"""Summaries of result tables: mean and deviation by model, describe, first-seen
order, long form, top and bottom rows, and the display texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.operators.ranking import quantiles_of, value_counts


def summarize(results: DataFrame, metrics: list[str], group_cols=("model",),
              order_col: str | None = "model_ord") -> DataFrame:
    """A1: ``<metric>_mean`` and ``<metric>_std`` (sample deviation, n-1) by group."""
    aggs: list[Column] = []
    for m in metrics:
        aggs += [F.avg(F.col(m)).alias(f"{m}_mean"), F.stddev_samp(F.col(m)).alias(f"{m}_std")]
    keys = list(group_cols)
    if order_col and order_col in results.columns and order_col not in keys:
        aggs.append(F.min(order_col).alias(order_col))
    return results.groupBy(*keys).agg(*aggs)


def describe(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """A2: count, mean, std, min, 25%, 50%, 75%, max of one column by group.

    The table is read once, into counts per value; everything else comes from these.
    Quantiles are exact (linear interpolation) and computed by ranks, not by collecting
    each group's values.  Null values are not counted.
    """
    rows, parts = value_counts(df, group_cols, value_col)
    v, c = F.col(value_col), F.col("_c")
    first = rows.groupBy(*group_cols).agg(F.sum("_c").alias("count"), (F.sum(v * c) / F.sum(c)).alias("mean"),
                                          F.min(v).alias("min"), F.max(v).alias("max"))
    on = [F.col(f"r.{g}").eqNullSafe(F.col(f"c.{g}")) for g in group_cols]
    # deviations from the mean, so that large values lose no digits
    spread_of = (rows.alias("r").join(first.select(*group_cols, "mean").alias("c"), on)
                 .groupBy(*[F.col(f"r.{g}") for g in group_cols])
                 .agg(F.sum((v - F.col("mean")) * (v - F.col("mean")) * c).alias("_ss")))
    q = quantiles_of(rows, parts, group_cols, value_col, [0.25, 0.5, 0.75])
    out = first.alias("r").join(spread_of.alias("c"), on).select("r.*", "_ss")
    out = out.alias("r").join(q.alias("c"), on).select("r.*", "q_0", "q_1", "q_2")
    return out.select(*group_cols, "count", "mean", F.when(F.col("count") > 1, F.sqrt(F.col("_ss") / (F.col("count") - 1))).alias("std"),
                      "min", "max", F.col("q_0").alias("q25"), F.col("q_1").alias("q50"), F.col("q_2").alias("q75"))


def first_seen_order(df: DataFrame, value_col: str, order_col: str,
                     out: str = "first_ord") -> DataFrame:
    """A3: distinct values numbered by first appearance (smallest ``order_col``).

    The window runs over the distinct values only (one row each), never over rows.
    """
    firsts = df.groupBy(value_col).agg(F.min(order_col).alias("first_seen"))
    return firsts.withColumn(out, F.row_number().over(Window.orderBy("first_seen", value_col)))


def to_long(df: DataFrame, ids: list[str], values: list[str], name_col: str = "metric",
            value_col: str = "value") -> DataFrame:
    """Wide metric columns to ``(ids..., metric, value)`` rows."""
    return df.unpivot(ids, values, name_col, value_col)


def top_bottom(df: DataFrame, value_col: str, k: int = 10, tie_cols: list[str] | None = None,
               side_col: str = "side") -> DataFrame:
    """O3 + U2: ``k`` largest and ``k`` smallest rows stacked (duplicates kept).

    Each side is a top-k (bounded merge of k rows per task).
    """
    ties = [F.col(c) for c in (tie_cols or [])]
    top = df.orderBy(F.col(value_col).desc(), *ties).limit(k).withColumn(side_col, F.lit("top"))
    bottom = df.orderBy(F.col(value_col).asc(), *ties).limit(k).withColumn(side_col, F.lit("bottom"))
    return top.unionByName(bottom)


def format_mean_std(mean_col: str, std_col: str, digits: int = 4) -> Column:
    """``mean±std`` text."""
    return F.format_string(f"%.{digits}f±%.{digits}f", F.col(mean_col), F.col(std_col))


def verdict(p_col: str = "p_value", alpha: float = 0.05) -> Column:
    """Verdict text from a p-value."""
    return (F.when(F.col(p_col).isNull(), F.lit("not tested"))
            .when(F.col(p_col) < alpha, F.lit("significant"))
            .otherwise(F.lit("not significant")))


def recode(col: str, mapping: dict) -> Column:
    """Map listed values, unlisted become null (a ``when`` chain, no ``otherwise``)."""
    items = list(mapping.items())
    expr = F.when(F.col(col) == F.lit(items[0][0]), F.lit(items[0][1]))
    for k, v in items[1:]:
        expr = expr.when(F.col(col) == F.lit(k), F.lit(v))
    return expr
