"""Reproducible row roles: repeated holdout, nested validation, folds, exact and
stratified cuts, predicate splits and seeded samples.

All draws are md5 hashes of ``key:seed:salt`` (see :mod:`trellis.functions.random`),
so the role of a row never depends on partitioning, retries or cluster size, and
DuckDB can recompute every role for the oracle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions.random import TWO32, hash32, seeded_draws, seeded_hash
from trellis.session import cut_lineage, spread

FEW = 200_000           # rows of a group that one task ranks to find an exact cut
MAX_BROADCAST_GROUPS = 100_000
SEED_BASE = 41          # run r (1-based) uses seed 41 + r, so run 1 has seed 42


def with_runs(df: DataFrame, runs: int, run_col: str = "run",
              seed_col: str = "seed") -> DataFrame:
    """Repeat every row once per run (1..runs) with ``seed = 41 + run``.

    A generator, not a join: the copies are made inside the scan stage, and a
    grouped aggregate that follows absorbs the growth before any shuffle.
    """
    seq = F.sequence(F.lit(1).cast("bigint"), F.lit(int(runs)).cast("bigint"))
    return (spread(df).withColumn(run_col, F.explode(seq))
            .withColumn(seed_col, F.col(run_col) + F.lit(SEED_BASE).cast("bigint")))


def add_key_hash(df: DataFrame, key: Column | str, out: str = "key_hash",
                 salt: str | None = None) -> DataFrame:
    """One md5 per row: ``hash32(key[:salt])``.  Call before :func:`with_runs`,
    so the expensive hash is paid once per row, not once per run."""
    k = F.col(key) if isinstance(key, str) else key
    parts = [k] + ([F.lit(salt)] if salt else [])
    return spread(df).withColumn(out, hash32(*parts))


def holdout(df: DataFrame, key_hash: str = "key_hash", test_frac: float = 0.2,
            seed: Column | str | int = "seed", role_col: str = "role") -> DataFrame:
    """``test`` where the (row, seed) draw < test_frac * 2^32, else ``train``."""
    h = seeded_hash(key_hash, seed)
    return df.withColumn(role_col, F.when(h < F.lit(test_frac * TWO32), "test")
                         .otherwise("train"))


def nested_holdout(df: DataFrame, key_hash: str = "key_hash",
                   valid_hash: str = "valid_hash", test_frac: float = 0.2,
                   valid_frac: float = 0.2, seed: Column | str | int = "seed",
                   role_col: str = "role") -> DataFrame:
    """D1 + D2: roles ``test``, ``valid`` (an independent salted draw cut from
    train), ``fit``."""
    h_test = seeded_hash(key_hash, seed)
    h_valid = seeded_hash(valid_hash, seed)
    return df.withColumn(
        role_col,
        F.when(h_test < F.lit(test_frac * TWO32), "test")
        .when(h_valid < F.lit(valid_frac * TWO32), "valid")
        .otherwise("fit"))


def kfold(df: DataFrame, fold_hash: str = "fold_hash", k: int = 5,
          seed: Column | str | int = "seed", fold_col: str = "fold") -> DataFrame:
    """``fold = draw(row, seed) mod k`` from a fold-salted key hash."""
    return df.withColumn(fold_col, (seeded_hash(fold_hash, seed) % F.lit(int(k))).cast("int"))


def range_split(df: DataFrame, train_when: Column, role_col: str = "role") -> DataFrame:
    """P5: one role column from a predicate (train where it holds, else test)."""
    return df.withColumn(role_col, F.when(train_when, "train").otherwise("test"))


def exact_split(df: DataFrame, key_hash: str, tie: Column | str, test_frac: float = 0.2,
                seed: Column | str | int = "seed", by: list[str] | None = None,
                role_col: str = "role") -> DataFrame:
    """Exactly ``round(test_frac * n)`` test rows per group ``by``.

    Rows are ordered by ``(draw(row, seed), tie)``; the first ``round(f*n)`` in each group
    are test.  Rows with the same draw and tie (repeated keys) come in the order of a hash
    of all their columns, and of rows equal in every column as many are test as are needed.

    The cut is found by radix selection: rows are counted per group and digit of the draw,
    the digit that the cut falls into is narrowed by the next one until no group's has more
    than ``FEW`` rows, and only these are ranked.  Where a repeated key holds more, the
    digits of the hash of all columns go on narrowing, and equal rows are counted, not
    ranked; so the rows that one task ranks are bounded at any size.  All other rows compare
    their digits with the cut's.
    """
    by = list(by or [])
    t = F.col(tie) if isinstance(tie, str) else tie
    names = [c for c in df.columns if c != role_col]
    rows = (df.withColumn("_k", F.coalesce(t.cast("string"), F.lit("")))
            .withColumn("_h", F.coalesce(seeded_hash(key_hash, seed), F.lit(0)).cast("bigint"))
            .withColumn("_x", F.xxhash64(*[F.col(c) for c in names])))
    cut = _cut_of(rows, by, test_frac)
    on = [F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] or [F.lit(True)]
    marked = rows.alias("r").join(cut.alias("c"), on, "left").select(
        *[F.col(f"r.{c}") for c in [*names, "_h", "_k", "_x"]], "_last", "_copies", "_all")
    here = F.struct("_h", "_k", "_x")
    known = F.when(F.col("_last").isNull() | (here > F.col("_last")), "train").when(
        (here < F.col("_last")) | (F.col("_copies") == F.col("_all")), "test")
    marked = marked.withColumn(role_col, known)
    sure = marked.where(F.col(role_col).isNotNull()).select(*names, role_col)
    if cut.where("_copies < _all").isEmpty():
        return sure
    # rows equal to the last test row in every column: one row with a count, dealt anew
    equal = marked.where(F.col(role_col).isNull()).groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"), F.first("_copies").alias("_copies"))
    split = F.array(F.struct(F.lit("test").alias("role"), F.col("_copies").alias("n")),
                    F.struct(F.lit("train").alias("role"), (F.col("_n") - F.col("_copies")).alias("n")))
    parts = equal.select(*names, F.explode(split).alias("_p")).where("_p.n > 0")
    again = parts.select(*names, F.col("_p.role").alias(role_col),
                         F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_p.n")))).drop("col")
    return sure.unionByName(again)


def draw_mask(key_hash: str, runs: int, frac: float) -> Column:
    """Roles of all runs in one number: bit r - 1 is set where the row's draw for run r falls
    below ``frac``, as :func:`holdout` draws it.  Up to 62 runs."""
    return _mask(runs, lambda run: seeded_hash(key_hash, run + SEED_BASE) < F.lit(frac * TWO32))


def in_mask(mask: str, run: Column | int) -> Column:
    """Whether the bit of a run (1, 2, ...) is set."""
    run = F.lit(run) if isinstance(run, int) else run
    return F.call_function("shiftright", F.col(mask), (run - 1).cast("int")).bitwiseAND(F.lit(1)) == 1


def role_rows(rows: DataFrame, run: int, role: str, test_mask: str = "test_mask", valid_mask: str = "valid_mask") -> DataFrame:
    """The rows of a role (``test``, ``train``, ``valid``, ``fit``) in one run, by two masks."""
    test, valid = in_mask(test_mask, run), in_mask(valid_mask, run)
    return rows.where({"test": test, "train": ~test, "valid": ~test & valid, "fit": ~test & ~valid}[role])


def runs_of(mask: str, runs: int) -> Column:
    """One row per run whose bit is set: the runs that a row is a test row of."""
    return F.explode(F.filter(F.sequence(F.lit(1).cast("bigint"), F.lit(runs).cast("bigint")), lambda r: in_mask(mask, r)))


def _mask(runs: int, member) -> Column:
    if not 1 <= runs <= 62:
        raise ValueError("a mask holds 1 to 62 runs")
    # one expression a run, which Spark compiles; a lambda over the runs would be interpreted
    bits = [F.when(member(run), F.lit(1 << (run - 1)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for run in range(1, runs + 1)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def exact_mask(df: DataFrame, key_hash: str, tie: Column | str, frac: float, runs: int,
               by: list[str] | None = None, among: str | None = None, mask_col: str = "test_mask") -> DataFrame:
    """The test rows of :func:`exact_split` for all runs as one bit mask a row (bit r - 1: run
    r), so that no row is copied once a run: the cuts of all groups and runs are one small
    table, and a row compares its draws with them.

    ``among``: a mask; its set bits take the row out of that run (a second cut among the
    rows that a first one left).  Rows equal in every column are numbered first where a cut
    falls among them.
    """
    by = list(by or [])
    t = F.col(tie) if isinstance(tie, str) else tie
    names = df.columns
    rows = (df.withColumn("_k", F.coalesce(t.cast("string"), F.lit("")))
            .withColumn("_x", F.xxhash64(*[F.col(c) for c in names])))
    per_run = rows.select(*by, key_hash, "_k", "_x", *([among] if among else []), F.explode(
        F.sequence(F.lit(1).cast("bigint"), F.lit(int(runs)).cast("bigint"))).alias("_run"))
    if among:
        per_run = per_run.where(~in_mask(among, F.col("_run")))
    per_run = per_run.withColumn("_h", F.coalesce(seeded_hash(key_hash, F.col("_run") + F.lit(SEED_BASE)), F.lit(0)).cast("bigint"))
    cut = _cut_of(per_run, [*by, "_run"], frac)
    if not cut.where("_copies < _all").isEmpty():            # a cut among equal rows: tell them apart
        if "_copy" in names:
            raise ValueError("rows of equal hash in every column")
        numbered = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
        numbered = numbered.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).drop("_n")
        return exact_mask(numbered, key_hash, tie, frac, runs, by, among, mask_col).drop("_copy")
    cuts = cut.groupBy(*by).agg(F.array(*[
        F.max(F.when(F.col("_run") == run, F.col("_last"))) for run in range(1, runs + 1)]).alias("_cuts"))
    cuts = _small_side(cuts.withColumn("_draws", F.transform("_cuts", lambda c: c["_h"])))
    on = [F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] or [F.lit(True)]
    joined = rows.alias("r").join(cuts.alias("c"), on, "left").select(
        *[F.col(f"r.{c}") for c in [*names, "_k", "_x"]], "_cuts", "_draws")
    none = F.array(*[F.lit(-1).cast("bigint")] * runs)
    joined = joined.withColumn("_m", _against(runs)(F.col(key_hash).cast("bigint"), F.coalesce("_draws", none)))

    def member(run: int) -> Column:                          # rows of a cut's own draw, which are few
        last = F.col("_cuts")[run - 1]
        return in_mask("_at", run) & (F.struct("_k", "_x") <= F.struct(last["_k"].alias("_k"), last["_x"].alias("_x")))

    mask = F.when(F.col("_at") == 0, F.col("_below")).otherwise(F.col("_below").bitwiseOR(_mask(runs, member)))
    mask = mask.bitwiseAND(F.coalesce(F.bitwise_not(F.col(among)), F.lit(0).cast("bigint"))) if among else mask
    return joined.withColumns({"_below": F.col("_m.below"), "_at": F.col("_m.at")}).withColumn(mask_col, mask).select(*names, mask_col)


def _against(runs: int):
    """(row hash, a draw for each run) to two masks of the runs: in which the row's draw, as
    :func:`seeded_hash` gives it and 0 for null, is below that draw, and in which equal."""
    def masks(keys: pa.Array, cuts: pa.Array) -> pa.Array:
        known = np.asarray(keys.is_valid().to_numpy(zero_copy_only=False), bool)
        key = keys.fill_null(0).to_numpy(zero_copy_only=False)
        last = cuts.flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(-1, runs)
        below, at = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        for k in range(runs):
            draw = np.where(known, seeded_draws(key, k + 1 + SEED_BASE), 0)
            below |= (draw < last[:, k]).astype(np.int64) << k
            at |= (draw == last[:, k]).astype(np.int64) << k
        return pa.StructArray.from_arrays([pa.array(below), pa.array(at)], ["below", "at"])

    return F.arrow_udf(masks, "below bigint, at bigint")


def _digits() -> list[Column]:
    """Order-preserving digits of (_h, _x), most significant first: 8 bits at a time of the
    draw, so that the counts of many groups stay few in a task, then 16 bits at a time of the
    hash of all columns (signed order)."""
    h, x = F.col("_h"), F.col("_x").bitwiseXOR(F.lit(-2 ** 63))
    return [*[F.shiftright(h, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)],
            *[F.shiftrightunsigned(x, s).bitwiseAND(F.lit(65535)) for s in (48, 32, 16, 0)]]


def _cut_of(rows: DataFrame, by: list[str], test_frac: float) -> DataFrame:
    """One row per group: ``_last`` (the last test row's (_h, _k, _x), null without test
    rows), ``_copies`` of it that are test, and ``_all`` that there are."""
    on = [F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] or [F.lit(True)]
    group, digits = Window.partitionBy(*by), _digits()

    def narrowed(open_rows: DataFrame, digit: Column, need: Column) -> DataFrame:
        """The digit that holds the ``need``-th row of each group, what is needed of it,
        and its rows."""
        counts = open_rows.groupBy(*by, digit.alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.max("_need").alias("_need"))
        upto = F.sum("_n").over(group.orderBy("_d"))
        return (counts.withColumn("_total", F.sum("_n").over(group)).withColumn("_need", need)
                .withColumn("_before", upto - F.col("_n"))
                .where("_before < _need AND _need <= _before + _n")
                .select(*by, "_d", (F.col("_need") - F.col("_before")).alias("_need"), F.col("_n").alias("_size")))

    def inside(cut: DataFrame) -> DataFrame:
        small = cut.withColumnRenamed("_need", "_want")
        return (open_rows.drop("_need").alias("r").join(small.alias("c"), on)
                .where(digits[level].eqNullSafe(F.col("_d")))
                .select(*[F.col(f"r.{c}") for c in [*by, "_h", "_k", "_x"]], F.col("_want").alias("_need")))

    open_rows = rows.select(*by, "_h", "_k", "_x", F.lit(0).cast("bigint").alias("_need"))
    share = F.round(F.lit(float(test_frac)) * F.col("_total")).cast("bigint")
    for level in range(4):
        cut = _small_side(narrowed(open_rows, digits[level], share if level == 0 else F.col("_need")))
        open_rows = inside(cut)
        if (cut.agg(F.max("_size")).first()[0] or 0) <= FEW:
            return _ranked_cut(open_rows, by)
    # one draw, so one key but for collisions: the key, then the hash of all columns
    keys = open_rows.groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("_n"), F.max("_need").alias("_need"))
    before = F.sum("_n").over(group.orderBy("_k")) - F.col("_n")
    key = _small_side(keys.withColumn("_before", before).where("_before < _need AND _need <= _before + _n")
                      .select(*by, F.col("_k").alias("_key"), (F.col("_need") - F.col("_before")).alias("_want")))
    open_rows = open_rows.drop("_need").alias("r").join(key.alias("c"), on).where("_k = _key").select(
        *[F.col(f"r.{c}") for c in [*by, "_h", "_k", "_x"]], F.col("_want").alias("_need"))
    for level in range(4, len(digits)):
        cut = _small_side(narrowed(open_rows, digits[level], F.col("_need")))
        open_rows = inside(cut)
        if (cut.agg(F.max("_size")).first()[0] or 0) <= FEW:
            break
    return _ranked_cut(open_rows, by)


def _ranked_cut(open_rows: DataFrame, by: list[str]) -> DataFrame:
    """The cut among ``open_rows`` (..., _need): equal ones are counted before the ranking."""
    counts = open_rows.groupBy(*by, "_h", "_k", "_x").agg(F.count(F.lit(1)).alias("_all"), F.max("_need").alias("_need"))
    upto = F.sum("_all").over(Window.partitionBy(*by).orderBy("_h", "_k", "_x"))
    last = (counts.withColumn("_before", upto - F.col("_all"))
            .where("_before < _need AND _need <= _before + _all")
            .select(*by, F.struct("_h", "_k", "_x").alias("_last"),
                    (F.col("_need") - F.col("_before")).alias("_copies"), "_all"))
    return _small_side(last)


def _small_side(df: DataFrame) -> DataFrame:
    """One row per group, written once; broadcast if there are few groups."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_GROUPS else df


def stratified_split(df: DataFrame, key_hash: str, tie: Column | str, label_col: str,
                     test_frac: float = 0.2, seed: Column | str | int = "seed",
                     extra_by: list[str] | None = None, role_col: str = "role") -> DataFrame:
    """D3: exact cut inside each class (and run, when given in ``extra_by``)."""
    return exact_split(df, key_hash, tie, test_frac, seed,
                       by=[*(extra_by or []), label_col], role_col=role_col)


def seeded_sample(df: DataFrame, key: Column | str, k: int, seed: int = 42,
                  by: list[str] | None = None, rank_col: str = "sample_rank") -> DataFrame:
    """The ``k`` rows with the smallest md5(key:seed) (ties by key).

    Without ``by`` this is a top-k (per-task top-k, then one merge of k rows per
    task).  With ``by`` it is ``row_number() <= k`` per group, which Spark plans
    with a group limit before the shuffle, so each task ships at most k rows per
    group.
    """
    kk = F.col(key) if isinstance(key, str) else key
    tmp = df.withColumn("_k", kk.cast("string")).withColumn("_h", hash32(F.col("_k"), seed))
    if not by:
        top = tmp.orderBy("_h", "_k").limit(int(k))
        from pyspark.sql import Window
        # k rows only: numbering them in one task is bounded by k
        w = Window.orderBy("_h", "_k")
        return top.withColumn(rank_col, F.row_number().over(w).cast("bigint")).drop("_k", "_h")
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy("_h", "_k")
    return (tmp.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
            .where(F.col(rank_col) <= int(k)).drop("_k", "_h"))
