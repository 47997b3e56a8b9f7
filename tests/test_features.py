"""Encoder, scaler and binning behaviour on small hand-made tables."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trellis.operators import features as FE


def test_one_hot_unseen_level_is_all_zeros_and_names(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "housing string, age double")
    score = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "housing string, age double")
    fitted = FE.one_hot_pipeline(["housing"], ["age"], "features").fit(train)
    names = FE.encoded_feature_names(fitted, ["housing"], ["age"])
    assert names == ["age", "housing_a", "housing_b"]          # every seen level kept
    rows = {r["housing"]: r["v"] for r in fitted.transform(score)
            .select("housing", vector_to_array("features").alias("v")).collect()}
    assert rows["a"] == [1.0, 1.0, 0.0] and rows["c"] == [2.0, 0.0, 0.0]


def test_population_scaler_and_zero_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    z = {r["x"]: (r["z_x"], r["z_k"]) for r in FE.standardize(df, ["x", "k"]).collect()}
    assert z[1.0] == (pytest.approx(-1.0), 0.0) and z[3.0] == (pytest.approx(1.0), 0.0)


def test_equal_width_bins_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,)], "x double")
    b = {r["x"]: r["bin_label"] for r in
         FE.equal_width_bins(df, "x", 3, ["low", "medium", "high"]).collect()}
    # right-closed bins, the minimum in the first bin
    assert b == {0.0: "low", 1.0: "low", 2.0: "medium", 3.0: "high"}
    many = FE.equal_width_bins_many(df.withColumn("y", -F.col("x")), ["x", "y"], 3)
    assert many.where("x_bin = '3' AND y_bin = '1'").count() == 1
