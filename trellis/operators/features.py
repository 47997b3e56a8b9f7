"""Preprocessing: scaling, one-hot with unseen levels, equal-width bins, typed
column sets and encoded feature names.

Fitted parameters (means, deviations, min/max) are one-row aggregates used as
scalar subqueries: Spark computes them once (and merges the subqueries over the
same table), then inlines them as literals in the row expressions -- no join.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.operators.ranking import weighted_positions


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Names of numeric columns."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    """Names of text (categorical) columns."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def standardize(df: DataFrame, cols: list[str], fit_rows: DataFrame | None = None,
                prefix: str = "z_") -> DataFrame:
    """``(x - mean) / stddev_pop`` with parameters from ``fit_rows``.

    A zero deviation scales by 1, as the usual scaler does.  (Spark ML's
    ``StandardScaler`` divides by the sample deviation, hence this operator.)
    """
    fit_rows = fit_rows if fit_rows is not None else df
    out = df
    for c in cols:
        mean = fit_rows.select(F.avg(F.col(c).cast("double"))).scalar()
        std = fit_rows.select(F.stddev_pop(F.col(c).cast("double"))).scalar()
        scale = F.when(std > 0, std).otherwise(F.lit(1.0))
        out = out.withColumn(f"{prefix}{c}", (F.col(c).cast("double") - mean) / scale)
    return out


def equal_width_bins(df: DataFrame, col: str, k: int = 3, labels: list[str] | None = None,
                     bin_col: str = "bin", label_col: str = "bin_label") -> DataFrame:
    """``k`` equal-width bins over [min, max], right-closed, min in bin 1.

    ``labels`` name the bins in order (default 1..k as text).
    """
    lo = df.select(F.min(F.col(col).cast("double"))).scalar()
    hi = df.select(F.max(F.col(col).cast("double"))).scalar()
    width = (hi - lo) / F.lit(float(k))
    raw = F.ceil((F.col(col).cast("double") - lo) / width)
    b = F.least(F.greatest(raw, F.lit(1)), F.lit(k)).cast("bigint")
    out = df.withColumn(bin_col, F.when(width > 0, b).otherwise(F.lit(1).cast("bigint")))
    labels = labels or [str(i) for i in range(1, k + 1)]
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(bin_col).cast("int"))
    return out.withColumn(label_col, name)


def one_hot_pipeline(cat_cols: list[str], num_cols: list[str] | None = None,
                     out_col: str = "features") -> Pipeline:
    """F2 + F3: index (unseen kept apart) and one-hot every level; pass numerics.

    ``StringIndexer(handleInvalid='keep')`` puts unseen levels in the extra last
    index and ``OneHotEncoder(dropLast=True)`` drops exactly that slot, so every
    seen level has a column and unseen levels give all zeros.
    """
    idx = [f"{c}__idx" for c in cat_cols]
    ohe = [f"{c}__ohe" for c in cat_cols]
    stages = [StringIndexer(inputCols=cat_cols, outputCols=idx, handleInvalid="keep",
                            stringOrderType="frequencyDesc"),
              OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True,
                            handleInvalid="error")]
    stages.append(VectorAssembler(inputCols=[*(num_cols or []), *ohe], outputCol=out_col,
                                  handleInvalid="keep"))
    return Pipeline(stages=stages)


def level_slots(df: DataFrame, col: str, by_frequency: bool = True) -> DataFrame:
    """the dictionary of a categorical column as a table ``(level, n, slot)``, null
    levels left out.

    Slots are numbered from 0 by falling count, then level (or by level), over a range
    partitioning: any number of levels, none of them on the driver.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("n")).alias("n"), "level") if by_frequency else F.struct("level")
    placed = weighted_positions(counts.withColumn("_g", F.lit(0)).withColumn("_o", order).withColumn("_w", F.lit(1)),
                                ["_g"], "_o", "_w")
    return placed.select("level", "n", F.col("lo").alias("slot"))


def hot_slots(df: DataFrame, col: str, slots: DataFrame, slot_col: str = "slot") -> DataFrame:
    """``df`` with the slot of its level: the place of the 1 in a one-hot row, which is
    all there is to such a row; null where the level is null or was not seen in fitting."""
    known = slots.select(F.col("level").alias("_level"), F.col("slot").alias(slot_col))
    return df.join(known, F.col(col).cast("string") == F.col("_level"), "left").drop("_level")


def encoded_feature_names(fitted, cat_cols: list[str], num_cols: list[str]) -> list[str]:
    """Output names ``num..., <col>_<level>...`` in vector order."""
    indexer = fitted.stages[0]
    names = list(num_cols)
    for c, labels in zip(cat_cols, indexer.labelsArray):
        names += [f"{c}_{lv}" for lv in labels]
    return names


def equal_width_bins_many(df: DataFrame, cols: list[str], k: int = 3,
                          labels: list[str] | None = None, suffix: str = "_bin") -> DataFrame:
    """F5 for many columns at once: one min/max aggregate (scalar subqueries over
    the same plan are merged into one job), one projection of all bins."""
    labels = labels or [str(i) for i in range(1, k + 1)]
    names = F.array(*[F.lit(x) for x in labels])
    stats = df.select(*[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in
                        enumerate(cols)],
                      *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in
                        enumerate(cols)])
    out = []
    for i, c in enumerate(cols):
        lo = stats.select(f"lo_{i}").scalar()
        hi = stats.select(f"hi_{i}").scalar()
        width = (hi - lo) / F.lit(float(k))
        raw = F.least(F.greatest(F.ceil((F.col(c).cast("double") - lo) / width), F.lit(1)),
                      F.lit(k))
        b = F.when(width > 0, raw).otherwise(F.lit(1)).cast("int")
        out.append(F.element_at(names, b).alias(f"{c}{suffix}"))
    return df.select("*", *out)


def levels(df: DataFrame, col: str, most: int = 1000) -> list[str]:
    """Sorted distinct values of a low-cardinality column; more than ``most`` is an error,
    since the list (and one column per value) is held on the driver."""
    rows = df.where(F.col(col).isNotNull()).select(col).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{col} has more than {most} values")
    return sorted(r[0] for r in rows)
