"""Logistic regression for many groups (runs) at once (M4, M5).

Objective per group, as the coordinate solver of the usual libraries defines
it: ``C * sum log(1 + exp(-y' w.x~)) + R(w)`` with ``x~ = [x, 1]`` (the bias is
a feature and is penalised), ``R = ||w||^2 / 2`` (L2) or ``||w||_1`` (L1).

Each Newton step is ONE aggregate over the data of all groups: with the current
weights joined in (groups x features numbers, broadcast), the aggregate returns
per group the gradient and Hessian of the log-loss -- ``q + q(q+1)/2`` numbers
for q = features + 1.  The small per-group solve happens on the driver:
a Newton step for L2, a proximal Newton step (coordinate descent on the
quadratic model) for L1.  Iterations stop when every group's step is tiny.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stats(df: DataFrame, features: list[str], label: str, group_cols: list[str],
           weights: dict) -> list:
    """Gradient and Hessian of the log-loss per group, in one pass.

    Each task turns its Arrow batches into numpy partial sums per group (the
    current weights travel in a broadcast of groups x q numbers); a grouped sum
    of the matrix cells adds the partials.  Returns rows
    ``(group..., cell, value)`` collected on the driver: groups x cells numbers.
    """
    from pyspark.sql import types as T
    q = len(features) + 1
    iu = np.triu_indices(q)
    bw = df.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([df.schema[c] for c in group_cols] + [
        T.StructField("_cell", T.IntegerType()), T.StructField("_v", T.DoubleType())])

    def partial(batches):
        wts = bw.value
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.c_[pdf[features].to_numpy(dtype=float), np.ones(len(pdf))]
            y = pdf[label].to_numpy(dtype=float)
            for k, idx in pdf.groupby(group_cols, sort=False).indices.items():
                k = k if isinstance(k, tuple) else (k,)
                k = tuple(v.item() if hasattr(v, "item") else v for v in k)
                Xi, yi = X[idx], y[idx]
                pr = 1.0 / (1.0 + np.exp(-(Xi @ wts[k])))
                s = pr * (1.0 - pr)
                vec = np.concatenate([Xi.T @ (pr - yi), ((Xi * s[:, None]).T @ Xi)[iu]])
                acc[k] = acc.get(k, 0) + vec
        for k, vec in acc.items():
            out = pd.DataFrame({"_cell": np.arange(len(vec), dtype=np.int32), "_v": vec})
            for name, val in zip(group_cols, k):
                out[name] = val
            yield out[[*group_cols, "_cell", "_v"]]

    cells = (df.select(*group_cols, *features, label).mapInPandas(partial, schema)
             .groupBy(*group_cols, "_cell").agg(F.sum("_v").alias("_v")))
    rows = cells.collect()                                  # groups x cells, bounded
    bw.unpersist()
    return rows


def _prox_newton_l1(w, g, H, iters: int = 200, tol: float = 1e-10):
    """argmin_v g'(v-w) + (v-w)'H(v-w)/2 + ||v||_1 by coordinate descent."""
    v = w.copy()
    for _ in range(iters):
        delta = 0.0
        for j in range(len(v)):
            if H[j, j] <= 0:
                continue
            # gradient of the quadratic part at v, without coordinate j's own term
            grad_j = g[j] + H[j] @ (v - w) - H[j, j] * (v[j] - w[j])
            z = H[j, j] * w[j] - grad_j
            new = np.sign(z) * max(abs(z) - 1.0, 0.0) / H[j, j]
            delta = max(delta, abs(new - v[j]))
            v[j] = new
        if delta < tol:
            break
    return v


def fit_logistic(df: DataFrame, features: list[str], label: str, group_cols: list[str],
                 penalty: str = "l2", C: float = 1.0, max_iter: int = 50,
                 tol: float = 1e-9) -> DataFrame:
    """Weights per group: ``(group..., coef array, intercept, iterations)``."""
    spark = df.sparkSession
    q = len(features) + 1
    groups = [tuple(r) for r in df.select(*group_cols).distinct().collect()]   # runs
    w = {g: np.zeros(q) for g in groups}
    # every Newton step re-reads the rows: keep the narrow projection cached
    # (recomputed from lineage if an executor is lost)
    data = df.select(*group_cols, *features, label).persist()
    it = 0
    for it in range(1, max_iter + 1):
        if not groups:
            break
        cells: dict = {}
        for r in _stats(data, features, label, group_cols, {g: w[g] for g in groups}):
            g = tuple(r[c] for c in group_cols)
            cells.setdefault(g, np.zeros(q + q * (q + 1) // 2))[r["_cell"]] = r["_v"]
        iu = np.triu_indices(q)
        biggest = 0.0
        for g, vec in cells.items():
            grad = vec[:q] * C
            H = np.zeros((q, q))
            H[iu] = vec[q:]
            H = (H + H.T - np.diag(np.diag(H))) * C
            if penalty == "l2":
                new = w[g] - np.linalg.solve(H + np.eye(q), grad + w[g])
            else:
                new = _prox_newton_l1(w[g], grad, H + 1e-12 * np.eye(q))
            biggest = max(biggest, float(np.max(np.abs(new - w[g]))))
            w[g] = new
        if biggest < tol * max(1.0, max(float(np.max(np.abs(v))) for v in w.values())):
            break
    data.unpersist()
    out = [(*g, [float(v) for v in w[g][:-1]], float(w[g][-1]), it) for g in groups]
    schema_fields = [df.schema[c] for c in group_cols]
    from pyspark.sql import types as T
    schema = T.StructType(schema_fields + [
        T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("iterations", T.IntegerType())])
    return spark.createDataFrame(out, schema)


def fit_logistic_runs(df: DataFrame, features: list[str], label: str, runs: int, test_mask: str,
                      penalty: str = "l2", C: float = 1.0, max_iter: int = 50, tol: float = 1e-9,
                      scale: list[str] | None = None) -> DataFrame:
    """As :func:`fit_logistic` with one group a run, from one copy of the rows: a row trains
    run r where bit r - 1 of ``test_mask`` is not set.  Returns ``(run, coef array,
    intercept, raw_coef array, raw_intercept, iterations, converged)``.

    A Newton step is one pass: each task multiplies its rows with the weights of all runs
    and returns one array of partial sums a run, so nothing is copied and what is shuffled
    does not depend on the rows.  ``scale`` names features that are taken less the mean of
    the run's training rows and over their population deviation, as is usual before a
    penalty; ``coef`` is of the scaled features, ``raw_coef`` gives the same predictions
    from the features as they are.
    """
    spark = df.sparkSession
    q = len(features) + 1
    iu = np.triu_indices(q)
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_f{j}") for j, c in enumerate(features)],
                     F.col(label).cast("double").alias("_y"), F.col(test_mask).alias("_m")).persist()

    def summed(partial, width: int) -> np.ndarray:
        """Sum over all rows of ``partial(x, y, trains)``, runs x width."""
        def run(batches):
            acc = None
            for batch in batches:
                cols = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(q + 1)]
                x, y = np.c_[tuple(cols[:q - 1] + [np.ones(batch.num_rows)])], cols[q - 1]
                trains = ((cols[q][:, None] >> np.arange(runs)) & 1) == 0
                part = partial(x, y, trains)
                acc = part if acc is None else acc + part
            if acc is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(runs), pa.int32()), pa.array(list(acc), pa.list_(pa.float64()))],
                                                 ["run", "v"])

        cells = data.mapInArrow(run, "run int, v array<double>").select("run", F.posexplode("v").alias("cell", "v"))
        out = np.zeros((runs, width))
        for r in cells.groupBy("run", "cell").agg(F.sum("v").alias("v")).collect():      # runs x cells numbers
            out[r["run"], r["cell"]] = r["v"]
        return out

    center, spread = np.zeros((runs, q)), np.ones((runs, q))
    if scale:
        first = summed(lambda x, y, t: t.T.astype(float) @ np.hstack([x, x * x]), 2 * q)
        n = np.maximum(first[:, q - 1:q], 1.0)
        center = first[:, :q] / n
        spread = np.sqrt(np.maximum(first[:, q:] / n - center ** 2, 0.0))
        spread[spread <= 1e-12 * np.maximum(1.0, np.abs(center))] = 1.0
        as_is = np.array([c not in scale for c in features] + [True])     # and the bias
        center[:, as_is], spread[:, as_is] = 0.0, 1.0
    w = np.zeros((runs, q))
    done, steps = np.zeros(runs, bool), np.zeros(runs, int)
    for it in range(1, max_iter + 1):
        def newton(x, y, trains, w=w.copy(), done=done.copy()):
            out = np.zeros((runs, q + len(iu[0])))
            for r in np.flatnonzero(~done):
                z = (x[trains[:, r]] - center[r]) / spread[r]
                p = 1.0 / (1.0 + np.exp(-(z @ w[r])))
                out[r] = np.concatenate([z.T @ (p - y[trains[:, r]]), ((z * (p * (1 - p))[:, None]).T @ z)[iu]])
            return out

        sums = summed(newton, q + len(iu[0]))
        for r in np.flatnonzero(~done):
            grad = sums[r, :q] * C
            H = np.zeros((q, q))
            H[iu] = sums[r, q:]
            H = (H + H.T - np.diag(np.diag(H))) * C
            new = (w[r] - np.linalg.solve(H + np.eye(q), grad + w[r]) if penalty == "l2"
                   else _prox_newton_l1(w[r], grad, H + 1e-12 * np.eye(q)))
            done[r] = np.max(np.abs(new - w[r])) < tol * max(1.0, float(np.max(np.abs(new))))
            w[r], steps[r] = new, it
        if done.all():
            break
    data.unpersist()
    raw = w / spread
    bias = w[:, -1] - (raw[:, :-1] * center[:, :-1]).sum(axis=1)
    return spark.createDataFrame(
        [(r + 1, w[r, :-1].tolist(), float(w[r, -1]), raw[r, :-1].tolist(), float(bias[r]), int(steps[r]), bool(done[r]))
         for r in range(runs)],
        "run bigint, coef array<double>, intercept double, raw_coef array<double>, raw_intercept double, iterations int, "
        "converged boolean")


def predict_logistic(df: DataFrame, fits: DataFrame, features: list[str],
                     group_cols: list[str]) -> DataFrame:
    """``probability`` of class 1 and ``prediction`` at 0.5."""
    if "raw_coef" in fits.columns:
        fits = fits.select(*group_cols, F.col("raw_coef").alias("coef"), F.col("raw_intercept").alias("intercept"))
    z = F.col("intercept")
    for j, f in enumerate(features):
        z = z + F.col("coef")[j] * F.col(f).cast("double")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return (df.join(F.broadcast(fits.select(*group_cols, "coef", "intercept")), group_cols)
            .withColumn("probability", p)
            .withColumn("prediction", F.when(F.col("probability") >= 0.5, 1).otherwise(0))
            .drop("coef", "intercept"))
