"""Law tests: properties every implementation must satisfy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trellis.operators import explain as X
from trellis.operators import linear as L
from trellis.operators import logistic as LG
from trellis.operators import metrics as M
from trellis.operators import paired as P
from trellis.operators import splits as S
from trellis.operators import trees as TR
from trellis.operators.ranking import exact_quantiles, hash_positions, tie_ranks
from trellis.sources import synthetic as SY


def _stats_np(X, y):
    n = len(y)
    return (float(n), X.sum(0), float(y.sum()), X.T @ X, X.T @ y, float(y @ y))


def test_ols_residuals_orthogonal():
    rng = np.random.default_rng(0)
    X_ = rng.normal(size=(200, 4)) * [1, 100, 0.01, 5]
    y = X_ @ [1, 2, 3, 4] + 7 + rng.normal(size=200)
    a, b = L.fit_ols(_stats_np(X_, y))
    r = y - a - X_ @ b
    assert abs(r.sum()) < 1e-6 and np.all(np.abs(X_.T @ r) < 1e-4 * np.abs(X_).sum(0))


def _wide(spark, n, p, seed, groups=1, parts=5):
    rng = np.random.default_rng(seed)
    X_, w = rng.normal(size=(n, p)) * rng.uniform(0.01, 100, p) + rng.normal(size=p) * 10, rng.normal(size=p)
    y = X_ @ w + 3.0 + (rng.normal(size=n) if p < n else 0)
    cols = [f"x{j}" for j in range(p)]
    df = spark.createDataFrame([(i % groups, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(X_, y))],
                               ", ".join(["run int"] + [f"{c} double" for c in cols] + ["label double"]))
    return X_, y, cols, df.repartition(parts)


@pytest.mark.parametrize("n,p,merged", [(60, 200, 16), (300, 50, 2), (40, 40, 2), (500, 3, 16)])
def test_ols_by_merged_triangles(spark, monkeypatch, n, p, merged):
    """More features than rows are fitted to the last digits; else as numpy fits them."""
    monkeypatch.setattr(L, "MERGED", merged)
    X_, y, cols, df = _wide(spark, n, p, 1, groups=2)
    for r in L.ols_qr(df, cols, "label", ["run"]).collect():
        at = np.arange(n) % 2 == r["run"]
        fitted = r["intercept"] + X_[at] @ np.array(r["coef"])
        if p >= n // 2:
            assert np.sqrt(np.mean((y[at] - fitted) ** 2)) < 1e-9 * np.abs(y).max()
        else:
            want = np.linalg.lstsq(np.c_[np.ones(at.sum()), X_[at]], y[at], rcond=None)[0]
            assert np.allclose(np.r_[r["intercept"], r["coef"]], want, rtol=1e-8, atol=1e-8)


def test_ridge_zero_is_ols_and_lasso_large_is_zero():
    rng = np.random.default_rng(2)
    X_ = rng.normal(size=(100, 3))
    y = X_ @ [1.0, -2.0, 0.5] + rng.normal(size=100)
    st = _stats_np(X_, y)
    a0, b0 = L.fit_ols(st)
    a1, b1 = L.fit_ridge(st, 0.0)
    assert np.allclose(b0, b1) and a0 == pytest.approx(a1)
    _, bl = L.fit_lasso(st, 1e6)
    assert np.all(bl == 0)


def test_sse_from_stats_matches_rows():
    rng = np.random.default_rng(3)
    X_ = rng.normal(size=(50, 2))
    y = rng.normal(size=50)
    b = np.array([0.3, -0.7])
    assert L.sse_from_stats(_stats_np(X_, y), 0.2, b) == pytest.approx(
        float(((y - 0.2 - X_ @ b) ** 2).sum()))


def test_roles_partition_and_exact_counts(spark):
    df = spark.range(2000).withColumn("k", F.col("id").cast("string"))
    d = S.with_runs(S.add_key_hash(df, "k"), 3)
    e = S.exact_split(d, "key_hash", "k", 0.2, "seed", by=["run"])
    counts = {(r["run"], r["role"]): r["count"] for r in e.groupBy("run", "role").count().collect()}
    assert all(counts[(r, "test")] == 400 and counts[(r, "train")] == 1600 for r in (1, 2, 3))


def test_hash_positions_are_a_permutation(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 3).withColumn("k", F.col("id").cast("string"))
    df = S.add_key_hash(df, "k")
    p = hash_positions(df, ["g"], "key_hash", "k", bits=6).toPandas()
    for _, grp in p.groupby("g"):
        assert sorted(grp["pos"]) == list(range(len(grp)))
        assert list(grp.sort_values("pos")["key_hash"]) == sorted(grp["key_hash"])


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(4)
    vals = np.round(rng.exponential(size=3000), 2)
    grp = rng.integers(0, 3, size=3000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g int, v double")
    q = exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9]).toPandas().set_index("g")
    for g in range(3):
        want = np.quantile(vals[grp == g], [0.1, 0.5, 0.9])
        assert np.allclose(q.loc[g, ["q_0", "q_1", "q_2"]].to_numpy(float), want)


def test_auc_invariant_to_monotone_map_and_matches_pairs(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, size=400)
    s = np.round(rng.normal(size=400) + y * 0.5, 1)       # ties on purpose
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    auc1 = M.roc_auc(df.withColumn("g", F.lit(1)), ["g"], "y", "s").collect()[0]["roc_auc"]
    auc2 = M.roc_auc(df.withColumn("g", F.lit(1)).withColumn("s", F.exp("s")), ["g"], "y",
                     "s").collect()[0]["roc_auc"]
    pos, neg = s[y == 1], s[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) \
        / (len(pos) * len(neg))
    assert auc1 == pytest.approx(brute) and auc2 == pytest.approx(brute)


def test_tie_ranks_average(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 3.0)], "g int, v double")
    r = {row["v"]: row["avg_rank"] for row in tie_ranks(df, ["g"], "v").collect()}
    assert r == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0}


def test_linear_contributions_add_up(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, -1.0)], "run int, a double, b double")
    fits = spark.createDataFrame([(1, 0.5, [2.0, -1.0])], "run int, intercept double, coef array<double>")
    means = spark.createDataFrame([(1, 2.0, 0.5)], "run int, a double, b double")
    phi = X.linear_contributions(df.withColumn("rid", F.monotonically_increasing_id()), fits,
                                 means, ["a", "b"], ["run"], ["rid", "a", "b"])
    tot = phi.groupBy("rid", "a", "b", "base_value").agg(F.sum("phi").alias("s")).collect()
    for r in tot:
        assert r["base_value"] + r["s"] == pytest.approx(0.5 + 2 * r["a"] - r["b"])


def test_patience_rule():
    assert TR.best_rounds([5, 4, 3, 3.5, 3.6] + [4] * 20, 10) == 3
    assert TR.best_rounds([3, 2, 1], 10) == 3


def test_logistic_l2_stationary(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(1.5 * x - 0.3)))).astype(int)
    df = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(x, y)], "run int, x double, y int")
    fit = LG.fit_logistic(df, ["x"], "y", ["run"], "l2").collect()[0]
    w = np.array([fit["coef"][0], fit["intercept"]])
    xt = np.c_[x, np.ones_like(x)]
    p = 1 / (1 + np.exp(-xt @ w))
    grad = xt.T @ (p - y) + w
    assert np.max(np.abs(grad)) < 1e-6


@pytest.mark.parametrize("penalty", ["l2", "l1"])
def test_logistic_of_all_runs_equals_one_by_one(spark, penalty):
    rng = np.random.default_rng(11)
    n, runs = 300, 3
    x = rng.normal(size=(n, 2)) * [3, 0.5] + [10, 0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 10 + x[:, 1])))).astype(int)
    mask = rng.integers(0, 1 << runs, n)
    rows = [(*map(float, r), int(t), int(m)) for r, t, m in zip(x, y, mask)]
    df = spark.createDataFrame(rows, "a double, b double, y int, m bigint").repartition(4)
    fits = {r["run"]: r for r in LG.fit_logistic_runs(df, ["a", "b"], "y", runs, "m", penalty, scale=["a"]).collect()}
    for run in range(1, runs + 1):
        train = (mask >> (run - 1)) & 1 == 0
        a = x[train, 0]
        z = np.c_[(a - a.mean()) / a.std(), x[train, 1]]
        one = spark.createDataFrame([(run, *map(float, r), int(t)) for r, t in zip(z, y[train])], "run int, a double, b double, y int")
        want = LG.fit_logistic(one, ["a", "b"], "y", ["run"], penalty).first()
        got = fits[run]
        assert got["converged"] and np.allclose(got["coef"], want["coef"], atol=1e-6)
        assert got["intercept"] == pytest.approx(want["intercept"], abs=1e-6)
        plain = x[train] @ np.array(got["raw_coef"]) + got["raw_intercept"]
        assert np.allclose(plain, z @ np.array(got["coef"]) + got["intercept"])


def test_masks_hold_the_roles_of_the_splits(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("label"))
    d = S.add_key_hash(df, "k")
    per_run = S.with_runs(d, 5)
    want = {(r["run"], r["k"]): r["role"] for r in S.stratified_split(per_run, "key_hash", "k", "label", 0.2, "seed", ["run"]).collect()}
    got = S.exact_mask(d, "key_hash", "k", 0.2, 5, by=["label"]).collect()
    assert {(run, r["k"]): "test" if (r["test_mask"] >> (run - 1)) & 1 else "train" for r in got for run in range(1, 6)} == want
    drawn = {(r["run"], r["k"]): r["role"] for r in S.holdout(per_run, "key_hash", 0.2, "seed").collect()}
    bits = d.withColumn("m", S.draw_mask("key_hash", 5, 0.2)).collect()
    assert {(run, r["k"]): "test" if (r["m"] >> (run - 1)) & 1 else "train" for r in bits for run in range(1, 6)} == drawn
    # a second cut among what the first left, and a cut that falls among equal rows
    two = S.exact_mask(S.exact_mask(d, "key_hash", "k", 0.2, 5, by=["label"]), "key_hash", "k", 0.25, 5, ["label"], "test_mask", "valid_mask").collect()
    for run in range(5):
        assert not any((r["test_mask"] >> run) & (r["valid_mask"] >> run) & 1 for r in two)
        for label in range(3):
            own = [r for r in two if r["label"] == label and not (r["test_mask"] >> run) & 1]
            assert sum((r["valid_mask"] >> run) & 1 for r in own) == int(len(own) * 0.25 + 0.5)
    same = S.exact_mask(S.add_key_hash(spark.range(50).select(F.lit(1).alias("k")), "k"), "key_hash", "k", 0.2, 4).collect()
    assert [sum((r["test_mask"] >> run) & 1 for r in same) for run in range(4)] == [10] * 4


def test_search_takes_up_finished_trials(spark, tmp_path):
    spaces = {"A": {"x": ("float", 0, 1)}, "B": {"x": ("log", 0.1, 1), "n": ("int", 1, 5)}}
    calls = []

    def losses(flavour, p):
        if len(calls) == 5:
            raise RuntimeError("the driver is lost")
        calls.append((flavour, p["trial"]))
        return {"loss": (p["x"] - 0.3) ** 2}

    folder = str(tmp_path / "trials")
    with pytest.raises(RuntimeError):
        TR.search(spark, spaces, 4, losses, threads=1, folder=folder)
    first = list(calls)
    calls.clear()
    again = TR.search(spark, spaces, 4, losses, threads=1, folder=folder)
    assert len(first) == 5 and not set(first) & set(calls) and len(calls) == 3
    calls.clear()
    whole = TR.search(spark, spaces, 4, lambda f, p: {"loss": (p["x"] - 0.3) ** 2}, threads=2)
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))


def test_signed_rank_normal_matches_known_value(spark):
    # 30 pairs all positive: W+ = 465, z = 4.78, p about 8.67e-07 (no continuity term)
    d = spark.createDataFrame([(1, float(i)) for i in range(1, 31)], "t int, d double")
    r = P.signed_rank(d, ["t"], "d").collect()[0]
    assert r["w_plus"] == 465 and r["p_normal"] == pytest.approx(8.67199e-07, rel=1e-4)


def test_normal_sf_sql_twin_agrees(spark):
    import duckdb
    for z in (-2.0, 0.0, 0.5, 3.3):
        s = spark.range(1).select(P.normal_sf(F.lit(z)).alias("p")).collect()[0]["p"]
        d = duckdb.sql(f"SELECT {P.sql_normal_sf(str(z))}").fetchall()[0][0]
        assert s == pytest.approx(d, rel=1e-12)


def test_grid_line_roles_and_trees_flat(spark):
    df = SY.grid_line(spark, n=200)
    assert df.where("region = 'train'").count() == df.where("abs(feature_0) <= 1").count()
    from pyspark.ml.feature import VectorAssembler
    d = VectorAssembler(inputCols=["feature_0"], outputCol="features").transform(df)
    m = TR.forest_regressor(num_trees=10, max_depth=5).fit(d.where("region = 'train'"))
    out = m.transform(d.where("feature_0 > 1.2")).select("prediction").distinct().count()
    assert out == 1                      # constant beyond the training range


def test_wide_sums_equal_column_sums(spark):
    rng = np.random.default_rng(9)
    X_ = rng.normal(size=(500, 5))
    rows = [(int(i % 3), *map(float, r), float(r.sum())) for i, r in enumerate(X_)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double, e double, label double")
    feats = ["a", "b", "c", "d", "e"]
    narrow = L.gram_sums(df, feats, "label", ["g"]).toPandas().set_index("g").sort_index()
    arr = df.select("g", F.array(*feats).alias("f"), "label")
    wide = L.gram_sums_wide(arr, "f", 5, "label", ["g"]).toPandas().set_index("g").sort_index()
    for g in narrow.index:
        a, b = L.unpack(narrow.loc[g], 5), L.unpack(wide.loc[g], 5)
        for x, y in zip(a, b):
            assert np.allclose(x, y)


def test_ols_many_features_from_sums(spark):
    rng = np.random.default_rng(10)
    X_ = rng.normal(size=(300, 50))
    w = rng.normal(size=50)
    y = X_ @ w + 3.0
    cols = [f"x{j}" for j in range(50)]
    df = spark.createDataFrame([(1, *map(float, r), float(t)) for r, t in zip(X_, y)],
                               ", ".join(["run int"] + [f"{c} double" for c in cols] + ["label double"]))
    s = L.sums(df, cols, "label", ["run"])
    fit = L.ols_from_sums(s, 50, ["run"]).collect()[0]
    assert np.allclose(fit["coef"], w, atol=1e-6) and abs(fit["intercept"] - 3.0) < 1e-6
