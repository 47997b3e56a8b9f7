"""Exact cuts under repeated keys and equal rows, at every depth of the narrowing."""

import pytest
from pyspark.sql import functions as F

from trellis.functions.random import hash32
from trellis.operators import splits as S


def _cut(df, by, few, monkeypatch, frac=0.2):
    monkeypatch.setattr(S, "FEW", few)
    d = S.add_key_hash(df, "k").withColumn("seed", F.lit(42).cast("bigint"))
    return S.exact_split(d, "key_hash", "k", frac, "seed", by=by)


@pytest.mark.parametrize("few", [1_000_000, 10, 0])
def test_repeated_keys_and_equal_rows(spark, monkeypatch, few):
    rows = [("a", 7, None)] * 90 + [("a", k, "x") for k in range(100, 110)]          # 90 equal rows
    rows += [("b", 7, str(k)) for k in range(50)]                                     # one key, all rows differ
    rows += [("c", k, "x") for k in range(40)] + [(None, None, None)] * 15 + [("d", 1, "x")]
    df = spark.createDataFrame(rows, "g string, k long, v string")
    out = _cut(df, ["g"], few, monkeypatch)
    assert out.columns == ["g", "k", "v", "key_hash", "seed", "role"]
    assert out.select("g", "k", "v").exceptAll(df).isEmpty() and out.count() == df.count()
    got = {(r["g"], r["role"]): r["count"] for r in out.groupBy("g", "role").count().collect()}
    assert got == {("a", "test"): 20, ("a", "train"): 80, ("b", "test"): 10, ("b", "train"): 40,
                   ("c", "test"): 8, ("c", "train"): 32, (None, "test"): 3, (None, "train"): 12, ("d", "train"): 1}


@pytest.mark.parametrize("few", [1_000_000, 3, 0])
def test_the_cut_follows_the_draw(spark, monkeypatch, few):
    df = spark.range(997).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    out = _cut(df, None, few, monkeypatch, 0.3)
    rows = out.withColumn("h", S.seeded_hash("key_hash", "seed")).collect()
    test = sorted((r["h"], str(r["k"])) for r in rows if r["role"] == "test")
    train = sorted((r["h"], str(r["k"])) for r in rows if r["role"] == "train")
    assert len(test) == 299 and test[-1] <= train[0]
    again = _cut(df.repartition(5), None, few, monkeypatch, 0.3)
    assert again.exceptAll(out).isEmpty()


def test_empty_table_and_no_test_rows(spark, monkeypatch):
    df = spark.range(2).select(F.col("id").alias("k"))
    assert _cut(df.limit(0), None, 10, monkeypatch).count() == 0
    assert {r["role"] for r in _cut(df, None, 0, monkeypatch, 0.0).collect()} == {"train"}
    assert {r["role"] for r in _cut(df, None, 0, monkeypatch, 1.0).collect()} == {"test"}
