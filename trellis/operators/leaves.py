"""Tree ensembles as tables of leaves: scores and Shapley contributions.

A leaf is a set of conditions, one for each feature on its path: an interval (or a set of
categories), and the share of the training rows that its splits on that feature let
through.  The table is model-sized.  Rows are explained where they live, whole column
batches at a time, by array arithmetic over (rows, leaves, conditions); nothing walks a
tree, and no loop runs over rows.

For one leaf of value v with conditions 1..d let o_j be 1 where the row meets condition j.

* Path-dependent (X2): a condition outside the coalition holds with its share z_j.  The
  Shapley weights k! (d-1-k)! / d! of coalitions of k conditions are the integral of
  s^k (1-s)^(d-1-k), so the contribution of condition i is ::

      v (o_i - z_i) * integral over s in [0, 1] of prod_{j != i} (z_j (1 - s) + o_j s)

  a polynomial of degree d - 1 in s, which Gauss-Legendre points integrate exactly.

* Against a background table (X3): a condition outside the coalition holds if the
  background row meets it.  The whole background is reduced once, in Spark, to counts per
  leaf and pattern of met conditions; a row's contributions at a leaf depend on its own
  pattern only, and are worked out once per pattern.  So the cost is rows x leaves, however
  many background rows there are.  The counts are held in blocks of at most
  ``MAX_PATTERNS``; a larger model takes more passes over the rows, never a larger table.

For an ensemble the value is the weighted sum over trees (1/T for forests, ``treeWeights``
for boosting); for a forest classifier it is the class-1 share, i.e. the probability, for a
boosted classifier the margin.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import shared_path

#: rows of a background pattern table held at a time
MAX_PATTERNS = 2_000_000
#: cells (rows x leaves x conditions) of one step of array arithmetic
CELLS = 4_000_000


class Leaves:
    """Leaves with the same number of conditions: ``feature``, ``low``, ``high``, ``share``
    (leaves x conditions), ``allowed`` (leaves x conditions x categories, or None),
    ``value`` (already weighted) and ``number`` (of the leaf in the model)."""

    def __init__(self, rows: list[dict], categories: int):
        self.number = np.array([r["number"] for r in rows])
        self.value = np.array([r["value"] for r in rows])
        d = len(rows[0]["conditions"])
        cells = [[c for c in r["conditions"]] for r in rows]
        pick = lambda k, kind: np.array([[c[k] for c in row] for row in cells], kind).reshape(len(rows), d)
        self.feature, self.low, self.high, self.share = pick(0, int), pick(1, float), pick(2, float), pick(3, float)
        self.allowed = None
        if categories and any(c[4] is not None for row in cells for c in row):
            self.allowed = np.ones((len(rows), d, categories), bool)
            for a, row in enumerate(cells):
                for b, c in enumerate(row):
                    if c[4] is not None:
                        self.allowed[a, b] = [k in c[4] for k in range(categories)]

    @property
    def conditions(self) -> int:
        return self.feature.shape[1]

    def part(self, which) -> "Leaves":
        out = object.__new__(Leaves)
        out.number, out.value = self.number[which], self.value[which]
        out.feature, out.low, out.high, out.share = (x[which] for x in (self.feature, self.low, self.high, self.share))
        out.allowed = None if self.allowed is None else self.allowed[which]
        return out

    def pieces(self, rows: int) -> Iterator["Leaves"]:
        """The leaves, a few at a time, for so many rows."""
        step = max(1, CELLS // max(1, rows * max(1, self.conditions)))
        for a in range(0, len(self.number), step):
            yield self.part(slice(a, a + step))

    def met(self, x: np.ndarray) -> np.ndarray:
        """Rows x leaves x conditions: whether a row meets a condition."""
        v = x[:, self.feature]
        ok = (v > self.low) & (v <= self.high)
        if self.allowed is not None:
            code = np.clip(v, 0, self.allowed.shape[2] - 1).astype(int)
            ok &= np.take_along_axis(np.broadcast_to(self.allowed, (*v.shape, self.allowed.shape[2])), code[..., None], 3)[..., 0]
        return ok

    def spread(self, out: np.ndarray, parts: np.ndarray) -> None:
        """Add ``parts`` (rows x leaves x conditions) to ``out`` (rows x features)."""
        flat = self.feature.ravel()
        order = np.argsort(flat, kind="stable")
        head = np.flatnonzero(np.append(True, np.diff(flat[order]) > 0))
        out[:, flat[order][head]] += np.add.reduceat(parts.reshape(len(parts), -1)[:, order], head, axis=1)


class Model:
    """An ensemble as leaves, grouped by their number of conditions."""

    def __init__(self, leaves: list[dict], features: int):
        self.features, self.leaves = features, len(leaves)
        self.base = sum(r["value"] * float(np.prod([c[3] for c in r["conditions"]])) for r in leaves)
        cats = [max(c[4]) for r in leaves for c in r["conditions"] if c[4]]
        by: dict[int, list[dict]] = {}
        for number, r in enumerate(leaves):
            by.setdefault(len(r["conditions"]), []).append({**r, "number": number})
        self.groups = [Leaves(rows, int(max(cats)) + 1 if cats else 0) for _, rows in sorted(by.items())]

    def predictions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for group in self.groups:
            for some in group.pieces(len(x)):
                out += some.met(x).all(axis=2) @ some.value
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent contributions, rows x features."""
        out = np.zeros((len(x), self.features))
        for group in self.groups:
            if not group.conditions:
                continue
            points, weights = np.polynomial.legendre.leggauss((group.conditions + 1) // 2)
            for some in group.pieces(len(x)):
                met = some.met(x).astype(float)
                total = np.zeros(met.shape)
                for s, w in zip((points + 1) / 2, weights / 2):
                    factor = some.share * (1 - s) + met * s          # never 0: shares are positive
                    total += w * factor.prod(axis=2, keepdims=True) / factor
                some.spread(out, total * (met - some.share) * some.value[:, None])
        return out


def _node_leaves(nodes: list[dict], classifier: bool, weight: float) -> list[dict]:
    """Leaves of one tree from its rows of the saved node table."""
    by = {r["id"]: r for r in nodes}

    def cover(r):
        return float(sum(r["impurityStats"])) if classifier else float(r["impurityStats"][0])

    out, todo = [], [(by[0], {})]
    while todo:
        node, held = todo.pop()
        if node["leftChild"] < 0:
            value = node["impurityStats"][1] / cover(node) if classifier and cover(node) > 0 else (
                0.0 if classifier else node["prediction"])
            out.append({"value": weight * float(value), "conditions": [(f, *c) for f, c in sorted(held.items())]})
            continue
        f = node["feature"]
        low, high, share, cats = held.get(f, (-np.inf, np.inf, 1.0, None))
        for side in ("leftChild", "rightChild"):
            child = by[node[side]]
            a, b, c = low, high, cats
            if node["ncat"] and node["ncat"] > 0:
                left = {int(v) for v in node["thr"]}
                mine = left if side == "leftChild" else set(range(node["ncat"])) - left
                c = mine if c is None else c & mine
            elif side == "leftChild":
                b = min(b, node["thr"][0])
            else:
                a = max(a, node["thr"][0])
            todo.append((child, {**held, f: (a, b, share * cover(child) / cover(node), c)}))
    return out


def leaf_model(model, features: int, trees: int | None = None, spark: SparkSession | None = None) -> Model:
    """The leaves of a fitted Spark ML forest or boosted model, or of its first ``trees``."""
    spark = spark or SparkSession.getActiveSession()         # a thread of its own has no active one
    path = shared_path(spark, f"trellis-model-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    classifier = isinstance(model, RandomForestClassificationModel)
    averaging = classifier or isinstance(model, RandomForestRegressionModel)
    rows = (spark.read.parquet(f"{path}/data")
            .select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
                    "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"),
                    F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr"),
                    F.col("nodeData.split.numCategories").alias("ncat"))
            .toArrow().to_pylist())                          # bounded by the model
    by: dict[int, list[dict]] = {}
    for r in rows:
        by.setdefault(r["treeID"], []).append(r)
    kept = sorted(by)[:trees]
    weights = [1.0 / len(by)] * len(by) if averaging else list(model.treeWeights)
    return Model([leaf for t in kept for leaf in _node_leaves(by[t], classifier, weights[t])], features)


# ---------------------------------------------------------------- Spark jobs

def _matrix(column: pa.Array, features: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, features)


def _with_arrays(df: DataFrame, id_cols: list[str], features_col: str) -> DataFrame:
    return df.select(*id_cols, vector_to_array(F.col(features_col)).alias("_x"))


def explain_path_dependent(df: DataFrame, model, feature_names: list[str], id_cols: list[str],
                           features_col: str = "features") -> DataFrame:
    """Long table ``(id..., feature, value, phi, base_value, prediction)``; per row
    ``base_value + sum(phi) = prediction``."""
    leaves = leaf_model(model, len(feature_names), spark=df.sparkSession)
    return _explained(df, leaves, feature_names, id_cols, features_col, leaves.base, leaves.contributions)


def _explained(df, leaves: Model, names, id_cols, features_col, base: float, contributions) -> DataFrame:
    n, p = len(id_cols), len(names)
    held = df.sparkSession.sparkContext.broadcast((leaves, contributions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, parts = held.value
        for batch in batches:
            x = _matrix(batch.column(n), p)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(parts(x)), pa.list_(pa.float64())), pa.array(model.predictions(x))],
                [*id_cols, "_x", "_phi", "prediction"])

    rows = _with_arrays(df, id_cols, features_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    wide = rows.mapInArrow(run, f"{schema}, _phi array<double>, prediction double")
    return _long(wide, names, id_cols, F.lit(float(base)))


def _long(wide: DataFrame, names: list[str], id_cols: list[str], base) -> DataFrame:
    items = F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("_x").alias("value"), F.col("_phi").alias("phi"))
    return (wide.withColumn("base_value", base).select(*id_cols, "base_value", "prediction", F.explode(items).alias("_i"))
            .select(*id_cols, F.col("_i.feature").alias("feature"), F.col("_i.value").alias("value"),
                    F.col("_i.phi").alias("phi"), "base_value", "prediction"))


def background_patterns(background: DataFrame, leaves: Model, features_col: str = "features") -> DataFrame:
    """(leaf, pattern, n): how many background rows meet just the conditions of
    ``pattern`` (bit j: condition j) at each leaf."""
    held = background.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            x = _matrix(batch.column(0), model.features)
            for group in model.groups:
                for some in group.pieces(len(x)):
                    code, d = patterns(some.met(x)), group.conditions
                    both = (np.arange(len(some.number)) << d) + code
                    found, _, count = distinct(both.ravel(), len(some.number) << d)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some.number[found >> d]), pa.array(found & ((1 << d) - 1)), pa.array(count)],
                        ["leaf", "pattern", "n"])

    rows = _with_arrays(background, [], features_col).mapInArrow(run, "leaf bigint, pattern bigint, n bigint")
    return rows.groupBy("leaf", "pattern").agg(F.sum("n").alias("n"))


def patterns(met: np.ndarray) -> np.ndarray:
    """Rows x leaves: met conditions as bits."""
    return met @ (1 << np.arange(met.shape[2], dtype=np.int64))


def distinct(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ``keys`` (whole numbers under ``below``) in order, the place of each key
    among them, and how often each comes; counted, not sorted, if few keys are possible."""
    if below > CELLS:
        return np.unique(keys, return_inverse=True, return_counts=True)
    count = np.bincount(keys, minlength=below)
    found = np.flatnonzero(count)
    place = np.cumsum(count > 0) - 1
    return found, place[keys], count[found]


@lru_cache(maxsize=None)
def shapley_weight(x_only: int, b_only: int) -> float:
    """Weight of one coalition that holds the row's own conditions and none of the
    background's, with one of the row's own as the player."""
    return factorial(x_only - 1) * factorial(b_only) / factorial(x_only + b_only)


def pattern_contributions(row: int, seen: np.ndarray, share: np.ndarray, d: int) -> np.ndarray:
    """Contributions of a leaf of value 1 to its ``d`` conditions for a row's pattern,
    against background patterns ``seen`` and their shares."""
    full = (1 << d) - 1
    ok = (seen | row) == full                                # else no coalition reaches the leaf
    seen, share = seen[ok], share[ok]
    if not len(seen):
        return np.zeros(d)
    bit = np.arange(d)
    mine, theirs = (row >> bit) & 1, (seen[:, None] >> bit) & 1
    a, c = (mine & ~theirs & 1), (theirs & ~mine & 1)        # met by the row only, by the background only
    na, nc = a.sum(axis=1), c.sum(axis=1)
    plus = np.array([shapley_weight(int(i), int(j)) if i else 0.0 for i, j in zip(na, nc)])
    minus = np.array([shapley_weight(int(j), int(i)) if j else 0.0 for i, j in zip(na, nc)])
    return (share * plus) @ a - (share * minus) @ c


class Against:
    """Contributions against pattern counts of a background, for some leaves of a model."""

    def __init__(self, leaves: Model, counts: dict[int, tuple[np.ndarray, np.ndarray]], rows: int):
        self.leaves, self.counts, self.rows = leaves, counts, rows
        self.known: dict[tuple[int, int], np.ndarray] = {}   # a task's patterns come again in each batch

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.leaves.features))
        for group in self.leaves.groups:
            if not group.conditions:
                continue
            for some in group.part(np.array([n in self.counts for n in group.number], bool)).pieces(len(x)):
                code, d = patterns(some.met(x)), group.conditions
                if not code.size:
                    continue
                own, which, _ = distinct(((np.arange(len(some.number)) << d) + code).ravel(), len(some.number) << d)
                found = np.empty((len(own), d))
                for k, (number, r) in enumerate(zip(some.number[own >> d].tolist(), (own & ((1 << d) - 1)).tolist())):
                    if (number, r) not in self.known:
                        seen, n = self.counts[number]
                        self.known[number, r] = pattern_contributions(r, seen, n / self.rows, d)
                    found[k] = self.known[number, r]
                some.spread(out, found[which].reshape(*code.shape, d) * some.value[:, None])
        return out


def explain_interventional(df: DataFrame, model, feature_names: list[str], id_cols: list[str],
                           background: DataFrame, features_col: str = "features") -> DataFrame:
    """Shapley values against all rows of ``background``, as
    :func:`explain_path_dependent` gives them; the base is the mean background prediction."""
    leaves = leaf_model(model, len(feature_names), spark=df.sparkSession)
    spark = df.sparkSession
    path = shared_path(spark, f"trellis-patterns-{uuid.uuid4().hex}")
    background_patterns(background, leaves, features_col).write.parquet(path)
    counts = spark.read.parquet(path)
    sizes = counts.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("rows")).collect()   # model-sized
    rows = max((r["rows"] for r in sizes), default=0)
    blocks, held = [[]], 0
    for r in sorted(sizes, key=lambda r: r["leaf"]):
        if blocks[-1] and held + r["size"] > MAX_PATTERNS:
            blocks.append([])
            held = 0
        blocks[-1].append(r["leaf"])
        held += r["size"]
    full = {int(n): (1 << g.conditions) - 1 for g in leaves.groups for n in g.number}
    value = {int(n): float(v) for g in leaves.groups for n, v in zip(g.number, g.value)}
    base, out = 0.0, None
    for block in blocks:
        got: dict[int, list] = {}
        if block:
            for r in counts.where(F.col("leaf").between(block[0], block[-1])).toArrow().to_pylist():
                got.setdefault(r["leaf"], []).append((r["pattern"], r["n"]))
        tables = {leaf: tuple(np.array(c, np.int64) for c in zip(*pairs)) for leaf, pairs in got.items()}
        for leaf, (seen, n) in tables.items():
            base += value[leaf] * float(n[seen == full[leaf]].sum()) / rows
        part = _explained(df, leaves, feature_names, id_cols, features_col, 0.0, Against(leaves, tables, rows))
        out = part if out is None else out.unionByName(part)
    if len(blocks) > 1:                                      # contributions of all blocks of leaves add up
        out = out.groupBy(*id_cols, "feature").agg(F.first("value").alias("value"), F.sum("phi").alias("phi"),
                                                   F.first("prediction").alias("prediction"))
    return out.withColumn("base_value", F.lit(base)).select(*id_cols, "feature", "value", "phi", "base_value", "prediction")
