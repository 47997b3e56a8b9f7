"""The minimum slice: repeated holdout of three simple models of net price.

``net = l_extendedprice * (1 - l_discount)`` is predicted from ``l_extendedprice``
by a mean model, one-feature least squares, and a bucket-mean model (mean of
net per 10,000-wide price bucket; a piecewise-constant model that, like a tree,
is flat outside its training range).  All runs are fitted in one grouped
aggregate and scored in one more; the fitted tables are ``runs x 11`` rows,
which is the proven bound for broadcasting them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.random import key_string
from trellis.operators.splits import add_key_hash, holdout, with_runs

MODELS = ["Mean", "Least Squares", "Bucket Mean"]        # model_ord 1, 2, 3
N_BUCKETS = 11                                          # buckets 0..10; >= 100,000 in 10
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def price_rows(lineitem: DataFrame) -> DataFrame:
    """Key, feature, label and bucket of each lineitem row."""
    x = F.col("l_extendedprice")
    return lineitem.select(
        *LINEITEM_KEY,                  # the key text is built after rows are spread
        x.alias("x"),
        (x * (F.lit(1.0) - F.col("l_discount"))).alias("label"),
        F.least(F.floor(x / 10000.0), F.lit(N_BUCKETS - 1)).cast("bigint").alias("bucket"))


def fit_tables(train: DataFrame, group_cols: list[str], materialize: bool = True):
    """Per-group closed-form fits from one aggregate: bucket means, mean, OLS line.

    The per-(group, bucket) sums are at most groups x 11 rows; with
    ``materialize`` they are computed once and kept as a local table, so the
    scoring pass does not re-run the fitting pass for each fitted table.
    """
    by_bucket = train.groupBy(*group_cols, "bucket").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").alias("sy"),
        F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("x") * F.col("label")).alias("sxy"))
    if materialize:
        spark = train.sparkSession
        by_bucket = spark.createDataFrame(by_bucket.collect(), by_bucket.schema)
    by_group = by_bucket.groupBy(*group_cols).agg(
        *[F.sum(c).alias(c) for c in ["n", "sy", "sx", "sxx", "sxy"]])
    slope = ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"))
             / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")))
    line = by_group.select(
        *group_cols, (F.col("sy") / F.col("n")).alias("mean_label"), slope.alias("slope"),
        (F.col("sy") / F.col("n") - slope * F.col("sx") / F.col("n")).alias("intercept"))
    buckets = by_bucket.select(*group_cols, "bucket",
                               (F.col("sy") / F.col("n")).alias("bucket_mean"))
    return line, buckets


def predictions(rows: DataFrame, line: DataFrame, buckets: DataFrame,
                group_cols: list[str]) -> DataFrame:
    """Long prediction table: one row per (row, group, model)."""
    scored = (rows.join(F.broadcast(line), group_cols)
              .join(F.broadcast(buckets), [*group_cols, "bucket"], "left"))
    preds = F.array(
        F.struct(F.lit(MODELS[0]).alias("model"), F.lit(1).alias("model_ord"),
                 F.col("mean_label").alias("prediction")),
        F.struct(F.lit(MODELS[1]).alias("model"), F.lit(2).alias("model_ord"),
                 (F.col("intercept") + F.col("slope") * F.col("x")).alias("prediction")),
        F.struct(F.lit(MODELS[2]).alias("model"), F.lit(3).alias("model_ord"),
                 F.coalesce(F.col("bucket_mean"), F.col("mean_label")).alias("prediction")))
    keep = [c for c in rows.columns if c not in ("bucket",)]
    return (scored.select(*keep, F.inline(preds)))


def holdout_predictions(lineitem: DataFrame, runs: int = 30, test_frac: float = 0.2,
                        score_roles=("test",)) -> DataFrame:
    """(run, role, model, model_ord, label, prediction) for every run and row."""
    rows = add_key_hash(price_rows(lineitem), key_string(*LINEITEM_KEY)).drop(*LINEITEM_KEY)
    rows = with_runs(rows, runs)
    rows = holdout(rows, "key_hash", test_frac, "seed")
    line, buckets = fit_tables(rows.where(F.col("role") == "train"), ["run"])
    scored_rows = rows.where(F.col("role").isin(*score_roles)).drop("seed", "key_hash")
    return predictions(scored_rows, line, buckets, ["run"])
