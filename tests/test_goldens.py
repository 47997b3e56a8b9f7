"""Published results: means, deviations, quartiles and signed-rank tests of paired runs."""

import pytest
from pyspark.sql import functions as F

from trellis.operators import paired as P
from trellis.operators import summary as U

# Published scores of 30 runs, in the order of the runs.
R2_LASSO = [
    0.00384483257913, 0.00435700230898, 0.00240086769257, 0.00404503577238, 0.00769694365759, 0.00132491361385,
    -0.000619649817416, 0.000585739321218, 0.00145267224416, 0.00572581726038, 0.00139718833791, 0.00221362941844,
    -0.0040019137385, 0.00397674999481, 7.51066570253e-05, 0.00205098148419, -0.00125420197221, -0.00141936523368,
    0.00013924070873, -0.00158797866583, -0.00262328670656, 0.00427050154439, -0.00267498185795, 0.000377704862206,
    0.000520401114718, -0.000287630208272, -0.0012962765795, 0.000893134111596, 0.00111015952072, -0.00514909434856]
R2_BOOSTED = [
    0.00430226670959, -0.000104822636653, -0.00354587464926, 0.000274946831368, -0.000299339644783, 0.000824590654771,
    -0.00162152601555, -0.00053488270548, 0.00114493818826, 0.000901972042068, 0.000268571167506, -0.00316848026847,
    -0.00778394025335, -0.00100939811567, -0.0015277789599, 0.00360491349653, -0.00431330401197, 0.000671321164912,
    -0.00469371231367, -0.00171910391304, -0.00338894965931, 0.00140482712527, -0.00236016990492, -0.000689963409148,
    -0.000169314815234, -0.00343253216191, -0.00178157634336, -0.000313421647324, 0.000192216225737, -0.0048916867898]
OVERFITTING_LASSO = [
    2.34691296899, 3.3913500888, 2.27749077328, 1.95408850524, 1.66532986849, 3.23990686024, 20.6993405768, 0.965157679784,
    2.03098544297, 1.69886127322, 1.52026524502, 2.54192015065, 2.47597915182, 2.68840250415, 2.38247114136, 7.22152697945,
    2.78191264356, 1.42106006212, 1.9495947671, 1.93965174497, 2.06520465155, 2.71815035639, 1.8266697494, 1.97844909124,
    3.60119912568, 1.78022185642, 1.78371359432, 1.76382734955, 1.74406628141, 4.17010485895]
OVERFITTING_BOOSTED = [
    1.83194153348, 1.46278215886, 1.18170868554, 1.5229641437, 1.51291064362, 1.41354252867, 1.43190182743, 0.995504500096,
    1.6358648641, 1.18990097847, 1.86374629983, 1.08273622375, 1.23199082946, 2.27917086717, 1.23595073542, 1.71545167062,
    1.26322677967, 1.80326834214, 2.05580261967, 1.16453510694, 1.40357109347, 1.79596926588, 1.12398111203, 1.14732075698,
    1.37266415189, 2.13903219359, 1.78410720716, 1.64357351066, 1.41724666795, 2.00039388447]
#: metric, scores of both models, alternative, W+, exact p, (mean, deviation) of both
CASES = [
    ("r2", R2_LASSO, R2_BOOSTED, "greater", 420, 1.52476e-05,
     (0.0009181414358846956, 0.002872227342629616), (-0.00112530715375934, 0.002550415822454294)),
    ("overfitting", OVERFITTING_LASSO, OVERFITTING_BOOSTED, "less", 435, 0.99999838,
     (3.0207938447652536, 3.528112059712527), (1.523425372756288, 0.3421616181106156))]


def _runs(spark, case):
    rows = [(run + 1, model, v) for model, scores in (("Lasso", case[1]), ("Boosted", case[2])) for run, v in enumerate(scores)]
    return spark.createDataFrame(rows, f"run long, model string, {case[0]} double")


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_summary_matches_published(spark, case):
    got = {r["model"]: r for r in U.summarize(_runs(spark, case), [case[0]], ["model"], None).collect()}
    for model, (mean, std) in (("Lasso", case[6]), ("Boosted", case[7])):
        assert got[model][f"{case[0]}_mean"] == pytest.approx(mean, rel=1e-9)
        assert got[model][f"{case[0]}_std"] == pytest.approx(std, rel=1e-9)


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_signed_rank_matches_published(spark, case):
    d = P.paired_differences(_runs(spark, case), ["run"], "model", case[0], "Lasso", "Boosted")
    r = P.signed_rank(d.withColumn("t", F.lit(1)), ["t"], "d", case[3]).first()
    assert r["w_plus"] == case[4]
    assert r["p_value"] == pytest.approx(case[5], rel=1e-4)


def test_describe_equals_sorted_scores(spark):
    import numpy as np
    d = {r["model"]: r for r in U.describe(_runs(spark, CASES[1]), ["model"], "overfitting").collect()}
    for model, scores in (("Lasso", OVERFITTING_LASSO), ("Boosted", OVERFITTING_BOOSTED)):
        want = np.percentile(scores, [25, 50, 75])
        assert [d[model][c] for c in ("q25", "q50", "q75")] == pytest.approx(list(want), rel=1e-12)
        assert d[model]["count"] == 30 and d[model]["std"] == pytest.approx(np.std(scores, ddof=1), rel=1e-12)
        assert (d[model]["min"], d[model]["max"]) == (min(scores), max(scores))
