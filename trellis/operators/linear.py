"""Linear models from grouped sufficient statistics.

One aggregate over the data gives, per group (run, fold, ...), the sums
``n, sum x, sum y, sum x x', sum x y, sum y^2``.  Everything else works on those
few numbers per group:

* least squares (M1) of a few features: pseudo-inverse of the centred cross-product
  matrix; of many, or of more features than rows: :func:`ols_qr`, from triangular factors
  that tasks merge, which keeps the digits that squared sums lose;
* ridge (M2) and lasso (M3) paths over a penalty grid with k-fold choice: the
  statistics of "all folds but f" are the run total minus fold f, so 100
  penalties x 5 folds cost no extra pass over the data;
* scoring of a fold from its own sums (SSE is a quadratic form of the sums).

Per-group solves run in ``applyInPandas`` on groups of a handful of rows, so
nothing heavy crosses the driver.  :func:`sums` uses :func:`gram_sums_wide`, whatever the
number of features: per-task partial matrices in ``mapInPandas``, then a grouped sum of
matrix cells.

Penalty conventions (to match the usual library objectives):
ridge minimises ``||y - a - Xb||^2 + alpha ||b||^2``;
lasso minimises ``||y - a - Xb||^2 / (2n) + alpha ||b||_1``; the intercept is
never penalised.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.session import cut_lineage


def logspace_alphas(lo: float = -4.0, hi: float = 4.0, num: int = 100) -> list[float]:
    """Penalty grid ``10^lo .. 10^hi`` (num points), as used by the CV models."""
    return [float(10.0 ** (lo + (hi - lo) * i / (num - 1))) for i in range(num)]


# ---------------------------------------------------------------- sums

def sum_columns(features: list[str], label: str = "label") -> list[Column]:
    """Aggregate expressions for the sufficient statistics of ``label ~ features``."""
    p = len(features)
    x = [F.col(f).cast("double") for f in features]
    y = F.col(label).cast("double")
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy"),
            F.sum(y * y).alias("syy")]
    for i in range(p):
        aggs.append(F.sum(x[i]).alias(f"sx_{i}"))
        aggs.append(F.sum(x[i] * y).alias(f"sxy_{i}"))
        for j in range(i, p):
            aggs.append(F.sum(x[i] * x[j]).alias(f"sxx_{i}_{j}"))
    return aggs


def gram_sums(df: DataFrame, features: list[str], label: str = "label",
              group_cols: list[str] | None = None) -> DataFrame:
    """One hash aggregate (partial + final) of the sufficient statistics."""
    g = list(group_cols or [])
    return df.groupBy(*g).agg(*sum_columns(features, label))


def gram_sums_wide(df: DataFrame, features_col: str, p: int, label: str = "label",
                   group_cols: list[str] | None = None) -> DataFrame:
    """Sufficient statistics for an ``array<double>`` feature column of length p.

    Each task multiplies its Arrow batches into partial matrices (numpy), emits
    them as ``(group, cell, value)`` rows, and a grouped sum adds the partials.
    Output: group columns and ``cells``, an ordered array
    ``[n, sy, syy, sx..., sxy..., upper triangle of sum x x'...]`` (see :func:`unpack`).
    """
    g = list(group_cols or [])
    iu = np.triu_indices(p)
    cell_names = (["n", "sy", "syy"] + [f"sx_{i}" for i in range(p)]
                  + [f"sxy_{i}" for i in range(p)]
                  + [f"sxx_{i}_{j}" for i, j in zip(*iu)])
    schema = T.StructType([df.schema[c] for c in g] + [
        T.StructField("_cell", T.IntegerType()), T.StructField("_v", T.DoubleType())])

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pdf[g].astype(object).itertuples(index=False, name=None) if g else None
            X = np.vstack(pdf[features_col].to_numpy()).astype(float)
            y = pdf[label].to_numpy(dtype=float)
            if g:
                codes = pd.Series(list(keys)).astype("category")
                groups = [(k, np.flatnonzero(codes.cat.codes.to_numpy() == c))
                          for c, k in enumerate(codes.cat.categories)]
            else:
                groups = [((), np.arange(len(y)))]
            for k, idx in groups:
                Xi, yi = X[idx], y[idx]
                vec = np.concatenate([[len(yi), yi.sum(), yi @ yi], Xi.sum(axis=0),
                                      Xi.T @ yi, (Xi.T @ Xi)[iu]])
                acc[k] = acc.get(k, 0) + vec
        for k, vec in acc.items():
            out = pd.DataFrame({"_cell": np.arange(len(vec), dtype=np.int32), "_v": vec})
            for name, val in zip(g, k if g else ()):
                out[name] = val
            yield out[[*g, "_cell", "_v"]]

    cols = [*g, features_col, label]
    cells = df.select(*cols).mapInPandas(partial, schema).groupBy(*g, "_cell").agg(
        F.sum("_v").alias("_v"))
    # one ordered array of the p(p+1)/2 + 2p + 3 cells per group (bounded by p, not
    # by rows); a pivot to named columns would mean tens of thousands of columns
    ordered = F.sort_array(F.collect_list(F.struct("_cell", "_v")))
    return cells.groupBy(*g).agg(F.transform(ordered, lambda c: c["_v"]).alias("cells"))


def _unpack_cells(v, p: int):
    v = np.asarray(v, dtype=float)
    n, sy, syy = v[0], v[1], v[2]
    sx, sxy = v[3:3 + p], v[3 + p:3 + 2 * p]
    S = np.zeros((p, p))
    S[np.triu_indices(p)] = v[3 + 2 * p:]
    S = S + S.T - np.diag(np.diag(S))
    return float(n), sx, float(sy), S, sxy, float(syy)


def unpack(row, p: int):
    """(n, sx, sy, Sxx, sxy, syy) numpy view of one sums row (dict or Series);
    rows from the wide path carry one ``cells`` array instead of named columns."""
    if "cells" in row.keys():
        return _unpack_cells(row["cells"], p)
    n = float(row["n"])
    sx = np.array([row[f"sx_{i}"] for i in range(p)], dtype=float)
    sxy = np.array([row[f"sxy_{i}"] for i in range(p)], dtype=float)
    S = np.empty((p, p))
    for i in range(p):
        for j in range(i, p):
            S[i, j] = S[j, i] = row[f"sxx_{i}_{j}"]
    return n, sx, float(row["sy"]), S, sxy, float(row["syy"])


def _centred(n, sx, sy, S, sxy):
    xbar, ybar = sx / n, sy / n
    C = S - np.outer(sx, sx) / n
    c = sxy - sx * sy / n
    return xbar, ybar, C, c


def fit_ols(stats) -> tuple[float, np.ndarray]:
    """Least squares with intercept; minimum-norm when features outnumber rows.

    The centred matrix is scaled to unit diagonal before the pseudo-inverse, so
    features on very different scales (prices vs discounts) do not fall under
    the singular-value cut-off.
    """
    n, sx, sy, S, sxy, _ = stats
    xbar, ybar, C, c = _centred(n, sx, sy, S, sxy)
    d = np.sqrt(np.clip(np.diag(C), 0.0, None))
    d[d == 0] = 1.0
    beta = (np.linalg.pinv(C / np.outer(d, d), rcond=1e-13, hermitian=True) @ (c / d)) / d
    return float(ybar - xbar @ beta), beta


def fit_ridge(stats, alpha: float) -> tuple[float, np.ndarray]:
    n, sx, sy, S, sxy, _ = stats
    xbar, ybar, C, c = _centred(n, sx, sy, S, sxy)
    beta = np.linalg.solve(C + alpha * np.eye(len(c)), c)
    return float(ybar - xbar @ beta), beta


def fit_lasso(stats, alpha: float, beta0=None, max_iter: int = 10000,
              tol: float = 1e-9) -> tuple[float, np.ndarray]:
    """Coordinate descent on the centred quadratic (1/2n)||y - a - Xb||^2 + alpha|b|_1.

    Active-set sweeps (only non-zero coordinates) between full sweeps, with
    ``Q b`` kept up to date column by column, so wide problems stay cheap.
    """
    n, sx, sy, S, sxy, _ = stats
    xbar, ybar, C, c = _centred(n, sx, sy, S, sxy)
    Q, q = C / n, c / n
    p = len(q)
    diag = np.diag(Q).copy()
    b = np.zeros(p) if beta0 is None else np.array(beta0, dtype=float)
    Qb = Q @ b

    def sweep(idx) -> float:
        delta = 0.0
        for j in idx:
            if diag[j] <= 0:
                continue
            rho = q[j] - Qb[j] + diag[j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / diag[j]
            d = new - b[j]
            if d != 0.0:
                Qb[:] += Q[:, j] * d
                b[j] = new
                delta = max(delta, abs(d))
        return delta

    everything = range(p)
    for _ in range(max_iter):
        if sweep(everything) <= tol * max(1.0, float(np.max(np.abs(b)))):
            break
        active = np.flatnonzero(b)
        for _ in range(max_iter):
            if sweep(active) <= tol * max(1.0, float(np.max(np.abs(b)))):
                break
    return float(ybar - xbar @ b), b


def sse_from_stats(stats, intercept: float, beta: np.ndarray) -> float:
    """Sum of squared errors of ``a + x.b`` on the rows summarised by ``stats``."""
    n, sx, sy, S, sxy, syy = stats
    a = intercept
    return float(syy - 2 * a * sy - 2 * beta @ sxy + n * a * a
                 + 2 * a * beta @ sx + beta @ S @ beta)


def _sub(a, b):
    return tuple(x - y for x, y in zip(a, b))


def _add(a, b):
    return tuple(x + y for x, y in zip(a, b))


# ---------------------------------------------------------------- grouped fits

def _coef_schema(df: DataFrame, group_cols: list[str], extra: list[T.StructField]):
    return T.StructType([df.schema[c] for c in group_cols] + extra + [
        T.StructField("intercept", T.DoubleType()),
        T.StructField("coef", T.ArrayType(T.DoubleType()))])


def ols_from_sums(sums: DataFrame, p: int, group_cols: list[str]) -> DataFrame:
    """M1 per group: ``(group..., intercept, coef array)``."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        a, b = fit_ols(unpack(row, p))
        out = {c: [row[c]] for c in group_cols}
        out.update(intercept=[a], coef=[b.tolist()])
        return pd.DataFrame(out)
    return sums.groupBy(*group_cols).applyInPandas(fn, _coef_schema(sums, group_cols, []))


def _cv_path(fold_stats: list, alphas: list[float], kind: str):
    """Per penalty: mean CV R2 and mean CV MSE over folds; plus the fits."""
    total = fold_stats[0]
    for s in fold_stats[1:]:
        total = _add(total, s)
    rows = []
    warm = [None] * len(fold_stats)
    order = range(len(alphas)) if kind == "ridge" else sorted(
        range(len(alphas)), key=lambda i: -alphas[i])          # lasso: warm start downwards
    for ai in order:
        alpha = alphas[ai]
        r2s, mses = [], []
        for fi, fs in enumerate(fold_stats):
            train = _sub(total, fs)
            if kind == "ridge":
                a, b = fit_ridge(train, alpha)
            else:
                a, b = fit_lasso(train, alpha, warm[fi])
                warm[fi] = b
            sse = sse_from_stats(fs, a, b)
            n_f, _, sy_f, _, _, syy_f = fs
            sst = syy_f - sy_f * sy_f / n_f
            r2s.append(1.0 - sse / sst if sst > 0 else 0.0)
            mses.append(sse / n_f)
        rows.append((ai, alpha, float(np.mean(r2s)), float(np.mean(mses))))
    rows.sort()
    return total, rows


def cv_path(fold_sums: DataFrame, p: int, group_cols: list[str], alphas: list[float],
            kind: str = "ridge", fold_col: str = "fold") -> DataFrame:
    """M2 / M3 path: per group and penalty, mean CV R2 and mean CV MSE.

    ``fold_sums`` has one row of sums per (group..., fold).
    """
    schema = T.StructType([fold_sums.schema[c] for c in group_cols] + [
        T.StructField("alpha_idx", T.IntegerType()), T.StructField("alpha", T.DoubleType()),
        T.StructField("cv_r2", T.DoubleType()), T.StructField("cv_mse", T.DoubleType())])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(fold_col)
        stats = [unpack(r, p) for _, r in pdf.iterrows()]
        _, rows = _cv_path(stats, alphas, kind)
        out = pd.DataFrame(rows, columns=["alpha_idx", "alpha", "cv_r2", "cv_mse"])
        for c in group_cols:
            out[c] = pdf[c].iloc[0]
        out["alpha_idx"] = out["alpha_idx"].astype("int32")
        return out[[*group_cols, "alpha_idx", "alpha", "cv_r2", "cv_mse"]]

    return fold_sums.groupBy(*group_cols).applyInPandas(fn, schema)


def cv_fit(fold_sums: DataFrame, p: int, group_cols: list[str], alphas: list[float],
           kind: str = "ridge", fold_col: str = "fold", digits: int = 9) -> DataFrame:
    """Chosen penalty and refit on all folds: ridge by highest mean R2, lasso by
    lowest mean MSE.  Scores that agree in ``digits`` decimals are ties, and go to the
    larger penalty, the simpler model; so the choice does not hang on the last bits of a
    flat path."""
    schema = _coef_schema(fold_sums, group_cols, [T.StructField("alpha", T.DoubleType())])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(fold_col)
        stats = [unpack(r, p) for _, r in pdf.iterrows()]
        total, rows = _cv_path(stats, alphas, kind)
        if kind == "ridge":
            best = max(rows, key=lambda r: (round(r[2], digits), r[1]))
            a, b = fit_ridge(total, best[1])
        else:
            best = min(rows, key=lambda r: (round(r[3], digits), -r[1]))
            a, b = fit_lasso(total, best[1])
        out = {c: [pdf[c].iloc[0]] for c in group_cols}
        out.update(alpha=[best[1]], intercept=[a], coef=[b.tolist()])
        return pd.DataFrame(out)

    return fold_sums.groupBy(*group_cols).applyInPandas(fn, schema)


def linear_prediction(features: list[str], coef_col: str = "coef",
                      intercept_col: str = "intercept") -> Column:
    """``intercept + sum_j coef[j] * x_j`` as one JVM expression."""
    expr = F.col(intercept_col)
    for j, f in enumerate(features):
        expr = expr + F.col(coef_col)[j] * F.col(f).cast("double")
    return expr



def shifted(df: DataFrame, cols: list[str]):
    """Subtract each column's overall mean (one small aggregate job) before
    accumulating sums.  Raw sums of products cancel badly when means are large
    against spreads; shifted sums keep the digits (the fits are shift-invariant,
    only the intercept moves back by :func:`unshift_intercept`)."""
    # one small job now; the shifts are then plain literals in every later plan
    row = df.select(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    shifts = {c: F.lit(float(row[c] or 0.0)) for c in cols}
    return df.select(*[c for c in df.columns if c not in cols],
                     *[(F.col(c).cast("double") - shifts[c]).alias(c) for c in cols]), shifts


def unshift_intercept(fits: DataFrame, features: list[str], shifts: dict,
                      label: str) -> DataFrame:
    """Intercept in original units: ``a + m_y - sum_j coef_j * m_j``."""
    a = F.col("intercept") + shifts[label]
    for j, f in enumerate(features):
        a = a - F.col("coef")[j] * shifts[f]
    return fits.withColumn("intercept", a)


def sums(df: DataFrame, features: list[str], label: str = "label",
         group_cols: list[str] | None = None) -> DataFrame:
    """Sufficient statistics of any number of features, by per-task partial matrices."""
    return gram_sums_wide(_as_array(df, features, label, group_cols), "_feats", len(features), label, group_cols)


def _as_array(df: DataFrame, features: list[str], label: str, group_cols: list[str] | None) -> DataFrame:
    return df.select(*(group_cols or []), F.array(*[F.col(f).cast("double") for f in features]).alias("_feats"),
                     F.col(label).cast("double").alias(label))


# ---------------------------------------------------------------- least squares by QR

#: triangular factors that one task merges
MERGED = 16


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, no taller than it is wide."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def qr_factors(df: DataFrame, features: list[str], label: str, group_cols: list[str]) -> DataFrame:
    """``(group..., r)``: the R factor of ``[1, features, label]`` over each group's rows, row
    by row in one array of doubles.

    A task reduces its rows to one small triangle a group as it reads them; triangles are
    stacked and reduced again, ``MERGED`` at a time, until each group has one.  What is
    shuffled depends on tasks and features, not on rows.
    """
    q, g = len(features) + 2, list(group_cols)
    kinds = T.StructType([df.schema[c] for c in g] + [T.StructField("_task", T.LongType()), T.StructField("r", T.ArrayType(T.DoubleType()))])

    def reduce_rows(batches):
        held: dict = {}
        for pdf in batches:
            rows = np.c_[np.ones(len(pdf)), np.vstack(pdf["_feats"].to_numpy()).astype(float), pdf[label].to_numpy(float)] if len(pdf) else None
            if rows is None:
                continue
            found = pdf.groupby(g, sort=False, dropna=False).indices if g else {(): np.arange(len(pdf))}
            for k, at in found.items():
                k = k if isinstance(k, tuple) else (k,)
                for a in range(0, len(at), 4 * q):
                    held[k] = _triangle(np.vstack([held[k], rows[at[a:a + 4 * q]]]) if k in held else rows[at[a:a + 4 * q]])
        if held:
            from pyspark import TaskContext
            out = pd.DataFrame(list(held), columns=g) if g else pd.DataFrame(index=range(1))
            out["_task"] = TaskContext.get().partitionId()
            out["r"] = [r.ravel() for r in held.values()]
            yield out[[*g, "_task", "r"]]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["_task"] = out["_task"] // MERGED
        out["r"] = [_triangle(np.vstack([np.asarray(r).reshape(-1, q) for r in pdf.sort_values("_task")["r"]])).ravel()]
        return out[[*g, "_task", "r"]]

    factors = cut_lineage(_as_array(df, features, label, g).mapInPandas(reduce_rows, kinds))
    while factors.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        factors = cut_lineage(factors.groupBy(*g, F.floor(F.col("_task") / MERGED).alias("_part")).applyInPandas(
            merge, kinds))
    return factors.drop("_task")


def fit_triangle(r: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and coefficients from R of ``[1, X, y]``; minimum norm where features
    outnumber rows.  What lies right of and below the first entry is R of the centred rows."""
    inner = r[1:, 1:-1]
    if not len(inner):
        return float(r[0, -1] / r[0, 0]), np.zeros(r.shape[1] - 2)
    d = np.sqrt((inner ** 2).sum(axis=0))
    d[d == 0] = 1.0
    beta = np.linalg.lstsq(inner / d, r[1:, -1], rcond=1e-13)[0] / d
    return float((r[0, -1] - r[0, 1:-1] @ beta) / r[0, 0]), beta


def ols_qr(df: DataFrame, features: list[str], label: str, group_cols: list[str]) -> DataFrame:
    """M1 per group for any number of features: ``(group..., intercept, coef array)``."""
    q = len(features) + 2

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        # a group of fewer rows than columns has them as they are: make the first column [r, 0, 0, ...]
        r = np.linalg.qr(np.asarray(pdf["r"].iloc[0]).reshape(-1, q), mode="r")
        a, b = fit_triangle(r)
        out = {c: [pdf[c].iloc[0]] for c in group_cols}
        return pd.DataFrame({**out, "intercept": [a], "coef": [b.tolist()]})

    factors = qr_factors(df, features, label, group_cols)
    return factors.groupBy(*group_cols).applyInPandas(fn, _coef_schema(factors, group_cols, []))
