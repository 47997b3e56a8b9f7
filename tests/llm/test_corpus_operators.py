"""Near duplicates, string tiling, mixing and substring removal against brute force."""

import random
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from trellis.llm import mixing, probminhash, recompression, tiling
from trellis.llm.common import WordNames


# ---- near duplicates

def probability_jaccard(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def bag_of(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def likeness(a, b):
    x, y = bag_of(a), bag_of(b)
    if not x or not y:
        return 0.0
    return max(len(x.keys() & y.keys()) / len(x.keys() | y.keys()), probability_jaccard(x, y))


def test_similarity_is_probability_jaccard():
    rng, names = random.Random(1), WordNames()
    for _ in range(60):
        a, b = (" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        got = probminhash.similarity(probminhash.shingles(a.encode(), names), probminhash.shingles(b.encode(), names))
        assert got == pytest.approx(likeness(a, b)) or min(len(a.split()), len(b.split())) < 5


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    hits, want = 0, []
    for _ in range(30):
        w, v = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
        a, b = shared[:260], shared[40:]
        el, weight = np.concatenate([a, b]), np.concatenate([w[:260], v[40:]]).astype(float)
        both = probminhash.sketch(el, weight, np.repeat([0, 1], 260), 2)
        hits += (both[0] == both[1]).sum()
        want.append(probability_jaccard(dict(zip(a.tolist(), w[:260])), dict(zip(b.tolist(), v[40:]))))
        shared = rng.permutation(rng.integers(0, 2 ** 63, 300).astype(np.uint64))
    assert hits / (30 * probminhash.COMPONENTS) == pytest.approx(np.mean(want), abs=0.03)


def test_weights_are_scale_free():
    el = np.arange(1, 50, dtype=np.uint64)
    w = np.linspace(1, 5, 49)
    both = probminhash.sketch(np.concatenate([el, el]), np.concatenate([w, 3 * w]), np.repeat([0, 1], 49), 2)
    assert (both[0] == both[1]).all()


def components_of(ids, pairs):
    head = {i: i for i in ids}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i
    for a, b in pairs:
        head[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def near_copies(seed=7):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out, first = {}, [rng.choice(words) for _ in range(200)]
    for i in range(40):                               # one large group of near copies
        copy = list(first)
        for _ in range(rng.randrange(0, 3)):
            copy[rng.randrange(200)] = rng.choice(words)
        out[i] = " ".join(copy)
    for i in range(100, 110):                         # exact copies
        out[i] = " ".join(first[:60])
    passage = [rng.choice(words) for _ in range(120)]
    for i in range(200, 260):                         # a common passage, but other texts
        out[i] = " ".join(passage + [rng.choice(words) for _ in range(120)])
    for i in range(300, 330):
        out[i] = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
    return out


def test_classes_equal_brute_force(spark, texts):
    for given in (near_copies(), texts):
        df = spark.createDataFrame(list(given.items()), "doc_id long, text string")
        rows = probminhash.near_duplicates(df).collect()
        ids = sorted(given)
        bags = {i: bag_of(given[i]) for i in ids}
        holders = {}
        for i in ids:
            for g in bags[i]:
                holders.setdefault(g, []).append(i)
        pairs = {(a, b) for own in holders.values() for k, b in enumerate(own) for a in own[:k]}
        linked = [(a, b) for a, b in pairs if likeness(given[a], given[b]) >= 0.8]
        want = components_of(ids, linked)
        assert {r["doc_id"]: r["class_id"] for r in rows} == want
        assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)
        kept = probminhash.without_near_duplicates(df).collect()
        assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_texts_that_differ_in_repeats_only_are_linked(spark):
    given = {}
    for i in range(12):                               # equal sets of shingles, one of them 500 times in one text
        words = " ".join(f"p{i}w{k}" for k in range(200))
        given[2 * i], given[2 * i + 1] = words + " spam" * 5, words + " spam" * 504
        assert likeness(given[2 * i], given[2 * i + 1]) == 1 and probability_jaccard(*map(bag_of, (given[2 * i], given[2 * i + 1]))) < 0.4
    given[100] = f"{given[0]} x"
    given[101] = f"{given[1]} y"
    df = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(df).collect()}
    assert got == {**{i: i - i % 2 for i in range(24)}, 100: 0, 101: 0}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)], "center long, node long")
    got = {r["node"]: r["label"] for r in probminhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def test_near_duplicates_odd_tables(odd, nothing):
    rows = probminhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    assert {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"]} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    kept = probminhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "8", "None"]
    assert probminhash.near_duplicates(nothing).count() == 0
    assert probminhash.without_near_duplicates(nothing).count() == 0


# ---- string tiling

def brute_tiling(test, text, width):
    """Greedy string tiling by its definition: the longest unmarked match again and again."""
    marked_a, marked_b, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(test)):
            for j in range(len(text)):
                n = 0
                while (i + n < len(test) and j + n < len(text) and test[i + n] == text[j + n]
                       and i + n not in marked_a and j + n not in marked_b):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < width:
            return out
        marked_a.update(range(i, i + n))
        marked_b.update(range(j, j + n))
        out += n


def test_tiles_equal_greedy_definition():
    rng = random.Random(4)
    for _ in range(150):
        test = [rng.choice("abc") for _ in range(rng.randrange(3, 18))]
        text = [rng.choice("abc") for _ in range(rng.randrange(3, 25))]
        i, j = np.array([(a, b) for a in range(len(test) - 2) for b in range(len(text) - 2)
                         if test[a:a + 3] == text[b:b + 3]] or np.empty((0, 2), int)).T
        found = tiling.tiles(i, j, 3) if len(i) else []
        for a, b, n in found:
            assert test[a:a + n] == text[b:b + n]
        assert sum(n for _, _, n in found) == brute_tiling(test, text, 3)


def test_reordered_and_changed_passages_are_caught_clean_ones_not(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(6))
    parts = [[word() for _ in range(12)] for _ in range(4)]
    item = " ".join(sum(parts, []))
    noise = lambda n: " ".join(word() for _ in range(n))
    given = {1: f"{noise(40)} {item} {noise(30)}", 2: " ".join(" ".join(p) + " " + noise(9) for p in parts[::-1]),
             3: noise(200), 4: f"{noise(10)} {' '.join(parts[0])} {noise(60)}", 5: item.upper() + "!", 6: "", 7: None}
    df = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    tests = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (13, noise(30))], "item_id long, text string")
    rows = tiling.contamination(df, tests).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(1, 10), (2, 10), (5, 10)]
    assert {r["doc_id"]: r["n_tiles"] for r in rows} == {1: 1, 2: 4, 5: 1}
    kept = tiling.decontaminated(df, tests)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7]


def test_blocks_of_tests_change_nothing(spark, docs, monkeypatch):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = tiling.contamination(docs, bench).collect()
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 300)
    assert sorted(map(tuple, tiling.contamination(docs, bench).collect())) == sorted(map(tuple, whole))
    assert whole


def test_tiling_odd_tables(spark, odd, nothing):
    tests = spark.createDataFrame([(1, ROWS[4][1])], "item_id long, text string")
    rows = tiling.contamination(odd, tests).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["5", "5", "6", "None"]
    assert tiling.contamination(nothing, tests).count() == 0
    assert tiling.contamination(odd, tests.limit(0)).count() == 0
    assert tiling.decontaminated(odd, tests).columns == odd.columns


# ---- mixing

def test_targets_by_hand():
    got = mixing.targets([("a", 10), ("b", 10), ("c", 1000), (None, 0)])
    # weights 1 2 3 1 of 1020: b stops at 30, a at 30, null at 0; c takes the rest, below 3000
    assert got == pytest.approx([30, 30, 960, 0])
    assert mixing.targets([]) == []


def test_mix_meets_targets_with_tilted_rates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = mixing.source_mix(docs)
    rows = first.collect()
    size, taken, target, due = Counter(), Counter(), {}, Counter()
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        due[r["source"]] += r["size"] * r["rate"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert due[s] == pytest.approx(target[s], rel=1e-6)
        assert taken[s] == pytest.approx(target[s], rel=0.01)
        # the logarithm of an uncapped rate is a line through 0 in the size
        lines = [log(r["rate"]) / r["size"] for r in rows if r["source"] == s and r["size"] and 1e-6 < r["rate"] < 2.999]
        assert max(lines) - min(lines) <= 1e-9 * max(1.0, max(map(abs, lines)))
    assert first.exceptAll(mixing.source_mix(docs.repartition(7))).isEmpty()


def test_cuts_in_cells_take_the_smallest_keys(spark):
    """A group of many documents of one size: exactly the odd copies, in key order."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"),
                                  F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    rows = mixing.source_mix(df).collect()
    for source in "xy":
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3
    keys = {r["id"]: r["h"] for r in spark.range(3000).select("id", F.xxhash64("id").alias("h")).collect()}
    own = sorted((keys[r["doc_id"]], r["copies"]) for r in rows if r["source"] == "x")
    assert [c for _, c in own] == sorted((c for _, c in own), reverse=True)


def test_mixing_odd_tables(odd, nothing):
    rows = mixing.source_mix(odd).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    out = mixing.mixed(odd)
    assert out.columns == [*odd.columns, "copies_"]
    assert mixing.source_mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0


# ---- substring removal

def brute_kept(given):
    first = {}
    for i in sorted(given, key=lambda i: (i is None, i)):
        words = (given[i] or "").split()
        for p in range(len(words) - 12):
            first.setdefault(tuple(words[p:p + 13]), i)
    out = {}
    for i, text in given.items():
        words = (text or "").split()
        gone = [False] * len(words)
        for p in range(len(words) - 12):
            if first[tuple(words[p:p + 13])] != i:
                gone[p:p + 13] = [True] * 13
        out[i] = [w for w, g in zip(words, gone) if not g]
    return out


def repeating_texts(seed):
    """Few words, runs, shared stretches of every length, shifted and nested."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(rng.choice([1, 2, 3, 8, 60]))]
    passages = [[rng.choice(words) for _ in range(rng.randrange(5, 80))] for _ in range(6)]
    out = {}
    for i in range(60):
        text = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p[a:a + rng.randrange(1, 60)] if rng.random() < .7 else [rng.choice(words)] * rng.randrange(1, 40)
        out[i * 3 % 61] = " ".join(text)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_repeats_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(recompression, "CHUNK_CHARS", 1500)          # many chunks
    given = repeating_texts(seed)
    df = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    want = brute_kept(given)
    rows = recompression.without_repeats(df).collect()
    assert {r["doc_id"]: r["kept_text"] for r in rows} == {i: " ".join(w) for i, w in want.items()}
    assert all(r["n_words"] - r["n_removed"] == len(r["kept_text"].split()) for r in rows)


def test_repeats_in_the_given_documents(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {i: b" ".join(x.encode() for x in w).decode() for i, w in brute_kept(
        {i: t for i, t in texts.items()}).items()}
    assert {r["doc_id"]: r["kept_text"] for r in recompression.without_repeats(df).collect()} == want


def test_equal_windows_hold_equal_features():
    """What a window is filed under depends on its words alone."""
    rng = random.Random(9)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz"):
        window = " ".join(rng.choice(letters) for _ in range(13))
        seen = set()
        for _ in range(200):
            around = [" ".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(2)]
            text = f"{around[0]} {window} {around[1]}".encode()
            chunk = recompression.Chunk([1], [text], WordNames())
            seen.add(int(chunk.feature[len(around[0].split())]))
        assert len(seen) == 1


def test_substring_odd_tables(odd, nothing):
    rows = recompression.without_repeats(odd).collect()
    assert len(rows) == len(ROWS)
    removed = sorted((str(r["doc_id"]), r["n_removed"]) for r in rows)
    assert removed == [("1", 0), ("2", 0), ("3", 0), ("4", 0), ("5", 0), ("5", 0), ("6", 15), ("7", 0), ("8", 0), ("None", 15)]
    assert recompression.without_repeats(nothing).count() == 0
