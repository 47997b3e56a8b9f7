"""Contributions of tree ensembles against enumeration of coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trellis.operators import leaves as LV
from trellis.operators import trees as TR

NAMES = ["a", "b", "c", "d"]


def _table(spark, n=300, classifier=False, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 4, n)
    y = ((x[:, 0] + (x[:, 3] == 2) > 0).astype(float) if classifier else x[:, 0] * 2 + x[:, 1] ** 2 + x[:, 0] * x[:, 3])
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "rid long, a double, b double, c double, d double, label double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).persist()


def _fitted(d, kind):
    if kind == "forest":
        return TR.forest_regressor(num_trees=4, max_depth=4).fit(d)
    if kind == "classifier":
        return TR.forest_classifier(num_trees=4, max_depth=4).fit(d)
    return TR.boosted("regression", max_iter=6, max_depth=3).fit(d)


def _own(model, d, kind):
    col = vector_to_array("probability")[1] if kind == "classifier" else F.col("prediction")
    return {r["rid"]: r["own"] for r in model.transform(d).select("rid", col.alias("own")).collect()}


def _shapley(value, p):
    """Contributions by the definition, from the value of every coalition."""
    phi = np.zeros(p)
    for i in range(p):
        rest = [j for j in range(p) if j != i]
        for k in range(p):
            for c in combinations(rest, k):
                phi[i] += factorial(k) * factorial(p - 1 - k) / factorial(p) * (value({*c, i}) - value(set(c)))
    return phi


def _rows(phi):
    out = {}
    for r in phi.collect():
        out.setdefault(r["rid"], {"base": r["base_value"], "prediction": r["prediction"], "phi": np.zeros(4), "x": np.zeros(4)})
        out[r["rid"]]["phi"][NAMES.index(r["feature"])] = r["phi"]
        out[r["rid"]]["x"][NAMES.index(r["feature"])] = r["value"]
    return out


@pytest.mark.parametrize("kind", ["forest", "classifier", "boosted"])
def test_path_dependent_equals_enumeration(spark, kind):
    d = _table(spark, classifier=kind == "classifier")
    model = _fitted(d, kind)
    rows, own = _rows(LV.explain_path_dependent(d.limit(12), model, NAMES, ["rid"])), _own(model, d, kind)
    groups = LV.leaf_model(model, 4).groups
    assert len(rows) == 12
    for rid, r in rows.items():
        def value(coalition):
            total = 0.0
            for g in groups:
                met = g.met(r["x"][None])[0]
                inside = np.isin(g.feature, list(coalition))
                total += float((np.where(inside, met, g.share).prod(axis=1) * g.value).sum())
            return total
        assert r["phi"] == pytest.approx(_shapley(value, 4), abs=1e-9)
        assert r["base"] + r["phi"].sum() == pytest.approx(r["prediction"], abs=1e-9)
        assert r["prediction"] == pytest.approx(own[rid], abs=1e-9)


@pytest.mark.parametrize("patterns", [10**6, 7])
@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_whole_background_equals_enumeration(spark, monkeypatch, kind, patterns):
    """Also where the pattern table comes in several blocks."""
    monkeypatch.setattr(LV, "MAX_PATTERNS", patterns)
    d = _table(spark, n=80)
    model = _fitted(d, kind)
    some = 3 if patterns > 7 else 1
    rows = _rows(LV.explain_interventional(d.limit(some), model, NAMES, ["rid"], d.repartition(3)))
    back = np.array(d.select(vector_to_array("features").alias("x")).toPandas()["x"].tolist())
    leaves, own = LV.leaf_model(model, 4), _own(model, d, kind)
    assert len(rows) == some
    for rid, r in rows.items():
        def value(coalition):
            x = back.copy()
            x[:, list(coalition)] = r["x"][list(coalition)]
            return float(leaves.predictions(x).mean())
        assert r["phi"] == pytest.approx(_shapley(value, 4), abs=1e-9)
        assert r["base"] == pytest.approx(np.mean(list(own.values())), abs=1e-9)
        assert r["base"] + r["phi"].sum() == pytest.approx(r["prediction"], abs=1e-9)


def test_first_rounds_equal_a_refit(spark):
    for kind in ("regression", "classification"):
        d = _table(spark, n=200, classifier=kind == "classification", seed=3)
        est = TR.boosted(kind, max_iter=7, max_depth=3, seed=5)
        part = TR.first_rounds(est.fit(d), 3)
        again = est.copy({est.maxIter: 3}).fit(d)
        assert part.getNumTrees == 3 and part.treeWeights == again.treeWeights
        a, b = (m.transform(d).select("rid", "prediction").collect() for m in (part, again))
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_categories_are_conditions_too(spark):
    from pyspark.ml.feature import VectorIndexer
    d = _table(spark)
    d = VectorIndexer(inputCol="features", outputCol="f2", maxCategories=5).fit(d).transform(d).drop("features").withColumnRenamed("f2", "features")
    model = _fitted(d, "forest")
    rows, own = _rows(LV.explain_path_dependent(d.limit(30), model, NAMES, ["rid"])), _own(model, d, "forest")
    for rid, r in rows.items():
        assert r["prediction"] == pytest.approx(own[rid], abs=1e-9)
        assert r["base"] + r["phi"].sum() == pytest.approx(own[rid], abs=1e-9)
