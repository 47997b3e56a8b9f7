"""Short tests and id types of the tiling, repeated rows and ids, entropy limits by class."""

import math
import random
import string

import pytest
from pyspark.sql import functions as F

from trellis.llm import gam, mixing, recompression, secret_scan, tiling

DOCS = "doc_id long, text string"

# ---- string tiling


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_short_tests_and_id_types(spark, kind):
    docs = spark.createDataFrame([(1, "so One two, three FOUR then"), (2, "one two four three"), (3, "yes"), (4, None),
                                  (5, "a b c d e f g h"), (6, "no yes no")], DOCS)
    tests = spark.createDataFrame([(10, "one two three four"), (11, "Yes!"), (12, ""), (13, None), (14, "a b c d e f"), (None, "c d e")],
                                  "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
    rows = tiling.contamination(docs, tests).collect()
    ident = str if kind == "string" else int
    assert sorted(((r["doc_id"], r["item_id"], r["longest"]) for r in rows), key=str) == sorted(
        [(1, ident(10), 4), (3, ident(11), 1), (6, ident(11), 1), (5, ident(14), 6), (5, None, 3)], key=str)
    assert {r["coverage"] for r in rows} == {1.0}
    assert {r["doc_id"] for r in tiling.decontaminated(docs, tests).collect()} == {2, 4}


def test_blocks_of_tests_give_the_same(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.sample(words, 12))) for k in range(40)]
    texts = [(k, " ".join(rng.sample(words, 20)) + " " + (items[k][1] if k % 3 == 0 else "")) for k in range(40)]
    docs, tests = spark.createDataFrame(texts, DOCS), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, tiling.contamination(docs, tests).collect()))
    left = sorted(map(tuple, tiling.decontaminated(docs, tests).collect()))
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, tiling.contamination(docs, tests).collect())) == whole and len(whole) >= 14
    assert sorted(map(tuple, tiling.decontaminated(docs, tests).collect())) == left and len(left) == 40 - 14


# ---- mixing


def test_equal_and_null_ids_meet_the_targets(spark):
    rows = [(None if k % 3 else k, "x " * 10, "a" if k < 300 else "b", k) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other long").repartition(5)
    taken = {r["source"]: r["taken"] for r in mixing.source_mix(df).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    assert taken == {"a": 2000, "b": 4000}
    out = mixing.mixed(df)
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert got == {"a": 200, "b": 400} and out.columns == [*df.columns, "copies"]
    same = spark.createDataFrame([(7, "x " * 10, "a" if k < 200 else "b") for k in range(400)], "doc_id long, text string, source string")
    taken = {r["source"]: r["taken"] for r in mixing.source_mix(same).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    assert sum(taken.values()) == 4000 and abs(taken["a"] - 4000 / 3) <= 10
    assert mixing.source_mix(same).count() == 400


def brute_multiplier(sizes, target, cap):
    """The multiplier of one source by bisection over its documents."""
    mean = sum(sizes) / max(1, sum(s > 0 for s in sizes))
    words = lambda x: sum(s * min(cap, math.exp(min(x * s / mean, 50))) for s in sizes)
    low, high = -60.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < target else (low, mid)
    return high, mean


def test_rates_and_copies_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, "w " * rng.choice([0, 1, 3, 8, 40, 200]), rng.choice(["a", "b", "c", None])) for k in range(500)]
    out = mixing.source_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    wanted = mixing.targets([(s, sum(r["size"] for r in by[s])) for s in names])
    for s, target in zip(names, wanted):
        own = by[s]
        assert own[0]["target"] == pytest.approx(target)
        x, mean = brute_multiplier([r["size"] for r in own], target, 3.0)
        for r in own:
            if target < 3 * sum(o["size"] for o in own) * (1 - 1e-9):
                assert r["rate"] == pytest.approx(min(3.0, math.exp(x * r["size"] / mean)), rel=1e-4)
            assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        # copies are whole, and the rest of a size is carried on to the next smaller one
        assert abs(sum(r["taken"] for r in own) - target) <= 1
        for size in {r["size"] for r in own if r["size"]}:
            group = [r for r in own if r["size"] == size]
            due = sum(r["rate"] for r in group)
            assert abs(sum(r["copies"] for r in group) - due) <= 1 + 200 / size


# ---- substring dedup


def test_equal_rows_are_dealt_once(spark):
    text = " ".join(f"t{k}" for k in range(60))
    rows = [(5, text)] * 200 + [(9, "before " + text + " after")] + [(None, text)] * 50 + [(5, "other " + text)]
    out = recompression.without_repeats(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    got = sorted(((r["doc_id"], r["n_removed"], r["kept_text"]) for r in out), key=str)
    assert got == sorted([(5, 0, text)] * 200 + [(9, 60, "before after")] + [(None, 60, "")] * 50 + [(5, 0, "other " + text)], key=str)


# ---- quality model


def test_a_repeated_labelled_row_counts_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    hot = docs.join(labels.filter(~gam.held_out()), "doc_id").orderBy("doc_id").select("doc_id", "text").limit(1)
    many = docs.unionByName(hot.crossJoin(spark.range(60)).drop("id"))
    a = {r["doc_id"]: r["score"] for r in gam.quality_scores(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in gam.quality_scores(many, labels).distinct().collect()}
    assert a == b


# ---- entropy limits


def test_entropy_recall_by_class(spark):
    """Random strings of 32 characters are found in nine of ten cases or more, words and
    names are not."""
    rng = random.Random(2)
    classes = {"lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "mixed": string.ascii_letters,
               "digits": string.digits, "hex": "0123456789abcdef", "base64": string.ascii_letters + string.digits + "+/"}
    rows = [(name, "key " + "".join(rng.choice(chars) for _ in range(32)) + " end") for name, chars in classes.items() for _ in range(60)]
    clean = ["internationalization", "counterrevolutionaries", "Donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement",
             "uncharacteristically", "aaaaaaaaaaaaaaaaaaaaaaaa", "12121212121212121212", "--------------------------", "00000000000000000000"]
    rows += [("clean", w) for w in clean]
    df = spark.createDataFrame(rows, "name string, text string")
    out = secret_scan.secret_scan(df, id_col="name").groupBy("doc_id").agg(F.avg((F.col("n_entropy") > 0).cast("int")).alias("hit")).collect()
    got = {r["doc_id"]: r["hit"] for r in out}
    assert got.pop("clean") <= 1 / len(clean)
    assert min(got.values()) >= 0.88, got
