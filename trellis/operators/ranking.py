"""Exact positions in a sort order without pulling a group into one task.

A window ``row_number() OVER (PARTITION BY g ORDER BY k)`` puts every row of a
group into one task; with a hot group (a third of all rows) that task is the job.
Here ranks are built in two levels from order-preserving *cells*:

1. sum the weights per (group, cell): a partial + final aggregate;
2. a running sum over cells gives, for each (group, cell), the rows of the
   group in earlier cells (the offset table: a row per group and cell);
3. inside a (group, cell) a window gives the local position;
4. position = offset + local position.

The window is partitioned by (group, cell), so the largest task holds one cell of one
group.  Cells of a hash order are its top bits.  Cells of a value order are the parts of a
range partitioning that is written before it is used: they grow in number with the data,
and a retried task sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.session import cut_lineage, spread

DEFAULT_HASH_BITS = 20          # 1M cells per group for a 32-bit hash order


def _offsets(cells: DataFrame, part_cols: list[str], bucket: str, n_col: str) -> DataFrame:
    before = Window.partitionBy(*part_cols).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1)
    return cells.select(*part_cols, bucket,
                        F.coalesce(F.sum(n_col).over(before), F.lit(0)).alias("_off"))


def _grouped(df: DataFrame, part_cols: list[str]):
    """A constant group column when none is given, so every join has a key."""
    if part_cols:
        return df, list(part_cols), None
    return df.withColumn("_g0", F.lit(0)), ["_g0"], "_g0"


def hash_positions(df: DataFrame, part_cols: list[str], hash_col: str, tie_col: str,
                   pos_col: str = "pos", bits: int = DEFAULT_HASH_BITS,
                   total_col: str | None = None) -> DataFrame:
    """0-based position by ``(hash_col, tie_col)`` inside each group.

    ``hash_col`` must be an unsigned 32-bit hash (uniform), so ``hash >> (32-bits)``
    is an order-preserving bucket with balanced cells.
    """
    df, part_cols, extra = _grouped(df, part_cols)
    out = _hash_positions(df, part_cols, hash_col, tie_col, pos_col, bits, total_col)
    return out.drop(extra) if extra else out


def _hash_positions(df, part_cols, hash_col, tie_col, pos_col, bits, total_col=None):
    tmp = df.withColumn("_b", F.shiftright(F.col(hash_col), 32 - bits))
    cells = tmp.groupBy(*part_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offs = _offsets(cells, part_cols, "_b", "_n")
    if total_col:       # group size from the same small cell table (no extra pass)
        offs = offs.join(cells.groupBy(*part_cols).agg(F.sum("_n").alias(total_col)),
                         part_cols)
    local = Window.partitionBy(*part_cols, "_b").orderBy(hash_col, tie_col)
    return (tmp.withColumn("_l", F.row_number().over(local) - 1)
            .join(offs, [*part_cols, "_b"])
            .withColumn(pos_col, (F.col("_l") + F.col("_off")).cast("bigint"))
            .drop("_b", "_l", "_off"))


def _ranged(df: DataFrame, part_cols: list[str], value_col: str, weight_col: str):
    """``df`` written in the order of (group, value) by a range partitioning, with its part
    and place (_part, _at), and the offset table of the parts of each group (_part, _off,
    _n, _total).  Parts are as many as the session's shuffles need, so they grow with the
    data, and a group lies in as many of them as its values fill; places are stored, so a
    retried task sees the same."""
    keys = [*part_cols, value_col]
    rows = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    whole = Window.partitionBy(*part_cols)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*part_cols, "_part").agg(F.sum(weight_col).alias("_n")).select(
        *part_cols, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), "_n",
        F.sum("_n").over(whole).alias("_total"))
    return rows, parts


def _on(cols: list[str], left: str = "r", right: str = "c"):
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols]


def weighted_positions(df: DataFrame, part_cols: list[str], value_col: str, weight_col: str,
                       ties: bool = False) -> DataFrame:
    """For rows keyed by (group, value) with a weight: ``lo`` = total weight of the group's
    rows with a smaller value (ties share one row upstream).  With ``ties`` several rows may
    have one value, and ``lo`` counts all rows up to and with the value."""
    rows, parts = _ranged(df, part_cols, value_col, weight_col)
    if ties:                             # equal values lie in one part
        local = Window.partitionBy(*part_cols, "_part").orderBy(value_col).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        local = Window.partitionBy(*part_cols, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.withColumn("_l", F.coalesce(F.sum(weight_col).over(local), F.lit(0)))
    return (cells.alias("r").join(parts.alias("c"), _on([*part_cols, "_part"]))
            .select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_l") + F.col("_off")).cast("bigint").alias("lo")))


def tie_ranks(df: DataFrame, part_cols: list[str], value_col: str) -> DataFrame:
    """Per (group, value): row count ``n`` and the average 1-based rank of its ties.

    Rows are combined per value before any ranking, so a value repeated by a
    third of all rows is one row here.
    """
    df, part_cols, extra = _grouped(spread(df.select(*part_cols, value_col))
                                    if part_cols else spread(df.select(value_col)), part_cols)
    counts = df.groupBy(*part_cols, value_col).agg(F.count(F.lit(1)).alias("n"))
    pos = weighted_positions(counts, part_cols, value_col, "n")
    return pos.select(*[c for c in part_cols if c != extra], value_col, "n",
                      (F.col("lo") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str,
                    probs: list[float]) -> DataFrame:
    """Linear-interpolation quantiles (the ``quantile_cont`` rule), exact.

    Output: group_cols + ``q_<i>`` columns.  ``df`` is read once, summed per value; only the
    parts that hold a target position are ranked.
    """
    df, group_cols, extra = _grouped(
        spread(df.select(*group_cols, F.col(value_col).cast("double").alias(value_col))),
        group_cols)
    counts = df.groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_c"))
    wide = quantiles_of(*_ranged(counts, group_cols, value_col, "_c"), group_cols, value_col, probs)
    return wide.drop(extra) if extra else wide


def quantiles_of(rows: DataFrame, parts: DataFrame, group_cols: list[str], value_col: str,
                 probs: list[float]) -> DataFrame:
    """Quantiles from the counts per value (``_c``) that :func:`_ranged` wrote."""
    targets = F.array(*[F.struct(F.lit(i).alias("q"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("h"))
                        for i, p in enumerate(probs)])
    wanted = (parts.select(*group_cols, "_part", "_off", "_n", F.explode(targets).alias("t"))
              .select(*group_cols, "_part", "_off", "_n", F.col("t.q").alias("_q"), F.col("t.h").alias("_h"),
                      F.floor("t.h").alias("_k0"), F.ceil("t.h").alias("_k1")))
    inside = lambda k: (F.col(k) >= F.col("_off")) & (F.col(k) < F.col("_off") + F.col("_n"))
    wanted = wanted.where(inside("_k0") | inside("_k1"))
    cells = wanted.select(*group_cols, "_part").distinct()
    held = rows.alias("r").join(cells.alias("c"), _on([*group_cols, "_part"]), "left_semi")
    upto = F.sum("_c").over(Window.partitionBy(*group_cols, "_part").orderBy("_at"))
    held = held.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("_c"))
    k0, k1 = F.col("_k0") - F.col("_off"), F.col("_k1") - F.col("_off")
    here = lambda k: (k >= F.col("_lo")) & (k < F.col("_hi"))
    picked = (held.alias("r").join(wanted.alias("c"), _on([*group_cols, "_part"]))
              .where(here(k0) | here(k1)).select(
                  *[F.col(f"r.{c}") for c in group_cols], "_q", "_h", "_k0", F.when(here(k0), F.col(value_col)).alias("_v0"),
                  F.when(here(k1), F.col(value_col)).alias("_v1")))
    per_q = picked.groupBy(*group_cols, "_q", "_h", "_k0").agg(F.max("_v0").alias("_v0"), F.max("_v1").alias("_v1"))
    per_q = per_q.withColumn("_val", F.col("_v0") + (F.col("_h") - F.col("_k0")) * (F.col("_v1") - F.col("_v0")))
    wide = per_q.groupBy(*group_cols).pivot("_q", list(range(len(probs)))).agg(F.first("_val"))
    return wide.select(*group_cols, *[F.col(str(i)).alias(f"q_{i}") for i in range(len(probs))])


def value_counts(df: DataFrame, group_cols: list[str], value_col: str):
    """Counts per (group, value) of a table read once, as :func:`_ranged` writes them."""
    counts = (spread(df.select(*group_cols, F.col(value_col).cast("double").alias(value_col))).where(F.col(value_col).isNotNull())
              .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_c")))
    return _ranged(counts, group_cols, value_col, "_c")
