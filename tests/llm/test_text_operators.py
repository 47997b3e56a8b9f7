"""Token counts, fertility rules, secret scans and the quality model."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, ROWS
from trellis.llm import fertility, gam, secret_scan, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

STRINGS = [
    "", None, "a", "  two  spaces \n\n and\tlines ", "don't we'll I'M 'tis ''s", "x<|endoftext|>y", "<|endoftext|>",
    "naïve café 東京都 русский", "emoji 👩‍👩‍👧 ok", "१२३ ٣٤", "new ࢏꟱ points \U00010940", "͸ unassigned",
    "nul\0inside", " nbsp　wide", "a" * 5000, "1234567890" * 300, "a1b2 c3!? ,,,;;; ###$$$", "\r\n\x0b\x0c x",
    "mixed    separators \x85", " leading", "trailing ", "\n", "the the the " * 500, LONG]


# ---- token counts

def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BPE)
    df = spark.createDataFrame(list(enumerate(STRINGS)), "doc_id long, text string").union(docs.select("doc_id", "text"))
    got = token_counts.token_counts(df, BPE, public_tokenizers.PATTERN).collect()
    want = sorted((r["doc_id"], len((r["text"] or "").encode()), n, n > 1024) for r in df.collect()
                  for n in [len(tok.encode(r["text"] or "", add_special_tokens=False).ids)])
    assert sorted(tuple(r) for r in got) == want


def test_token_counts_do_not_depend_on_the_table(spark, docs):
    for size in (1, 50):
        a = token_counts.token_counts(docs, BPE, public_tokenizers.PATTERN, frequent=size)
        b = token_counts.token_counts(docs, BPE, public_tokenizers.PATTERN)
        assert a.exceptAll(b).isEmpty()


def test_token_counts_odd_tables(odd, nothing):
    run = lambda df: token_counts.token_counts(df, BPE, public_tokenizers.PATTERN)
    rows = run(odd).collect()
    assert len(rows) == len(ROWS) and {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 0
    assert run(nothing).count() == 0 and run(nothing).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


# ---- fertility rules

def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n)


def test_fertility_base_counts(spark, docs):
    more = [(1000 + i, s, "xx") for i, s in enumerate(STRINGS)]
    df = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = fertility.fertility_rules(df, PIECES).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == brute_base(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_fertility_measures_by_hand():
    ids = np.array([5, 5, 7, 9])
    assert fertility.entropy_share(ids) == pytest.approx((0.5 * 1 + 0.5 * 2) / 2)
    assert fertility.entropy_share(ids[:1]) == 1.0
    assert fertility.script_of("привет мир ok") == "script:cyrillic"
    assert fertility.script_of("12 34") == "script:none"


def test_fertility_rejects_what_leaves_the_band(spark):
    rng = random.Random(3)
    words = ["river", "stone", "light", "garden", "window", "market", "silver", "morning", "teacher", "winter", "letter",
             "travel", "summer", "bridge", "forest", "island", "doctor", "memory", "person", "number"]
    clean = [(i, " ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(100)), "en") for i in range(200)]
    junk = [(900, " ".join("".join(rng.choice("qxzjkvw$#%&") for _ in range(7)) for _ in range(100)), "en"),
            (901, " ".join("".join(chr(rng.randrange(0x12000, 0x12300)) for _ in range(4)) for _ in range(100)), "en")]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in fertility.fertility_rules(df, PIECES).collect()}
    assert not kept[900] and not kept[901]
    assert sum(kept[i] for i, _, _ in clean) >= 198


def test_fertility_bands_of_few_documents(spark):
    rng = random.Random(5)
    words = ["river", "stone", "light", "garden", "window", "market", "silver", "morning", "teacher", "winter", "letter"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(n))
    junk = lambda n: " ".join("".join(chr(rng.randrange(0x12000, 0x12300)) for _ in range(4)) for _ in range(n))
    cyrillic = lambda n: " ".join("".join(rng.choice("абвгдеикл") for _ in range(6)) for _ in range(n))
    rows = [(i, text(100), "en") for i in range(120)] + [(200 + i, cyrillic(100), "ru") for i in range(60)]
    rows += [(300, junk(9000), "en"), (301, text(70), "en"),     # alone in their octaves, judged by the nearest ones
             (302, cyrillic(70), "ru"),                          # by its own language, not by the English ones
             (303, junk(100), "xx")]                             # of a language of one document: all languages
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in fertility.fertility_rules(df, PIECES).collect()}
    assert not kept[300] and not kept[303]
    assert kept[301] and kept[302]
    assert sum(kept[i] for i, _, _ in rows[:180]) >= 176
    cells = spark.createDataFrame([("a", 3, 60), ("a", 4, 20), ("a", 6, 35), ("a", 9, 1), ("b", 3, 10), ("b", 12, 2)],
                                  "band string, octave int, n long")
    found = {(r["band"], r["octave"]): (r["reach"], r["pooled"]) for r in fertility.sources(cells).collect()}
    assert found == {("a", 3): (0, False), ("a", 4): (1, False), ("a", 6): (2, False), ("a", 9): (5, False),
                     ("b", 3): (0, True), ("b", 12): (8, True)}


def test_fertility_odd_tables(odd, nothing):
    rows = fertility.fertility_rules(odd, PIECES).collect()
    assert len(rows) == len(ROWS)
    assert {r["doc_id"]: (r["kept"], r["n_words"]) for r in rows if r["doc_id"] in (1, 2, 3)} == dict.fromkeys((1, 2, 3), (False, 0))
    assert fertility.fertility_rules(nothing, PIECES).count() == 0


# ---- secrets

def brute_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A)
        if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def brute_entropy(text):
    """Windows of each candidate, their entropy worked out afresh."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        s, before = m[0], text[max(0, m.start() - 24):m.start()]
        if any(re.fullmatch(p, s) for p in secret_scan.ALLOWED) or re.search(secret_scan.ALLOWED_BEFORE, before):
            continue
        least = next(v for p, v in secret_scan.CLASSES if re.fullmatch(p, s))
        if least is None:
            continue
        hot = [j for j in range(len(s) - 19)
               if -sum(c / 20 * math.log2(c / 20) for c in Counter(s[j:j + 20]).values()) >= least - 1e-9]
        for j in hot:
            if out and out[-1][1] == 3 and out[-1][3] == m.start() and m.start() + j <= out[-1][2]:
                out[-1] = (*out[-1][:2], m.start() + j + 20, m.start())
            else:
                out.append((m.start() + j, 3, m.start() + j + 20, m.start()))
    return sorted(o[:3] for o in out)


def secret_texts():
    rng = random.Random(5)
    text = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = ['é password = "hunter22" x', "token=token:abcdefgh", "TOKEN : 'abc' SeCrEt:zzzzzz", "api_key=short apikey==x123456",
           "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 12 + " AKIAZ", "deadbeef" * 4 + "g" + "0" * 23, "ſecret=abcdefgh ToKen=abcdefg",
           "sha256:" + text("0123456789abcdef", 64), "my example " + "EXAMPLE" + text(b64, 30), "x" * 500, "ab" * 40,
           "123e4567-e89b-12d3-a456-426614174000", "4111111111111111111111111", "Donaudampfschifffahrtsgesellschaft", "日本 " + text(b64, 43)]
    for n in (20, 21, 83, 84, 85, 300, 5000):
        out += [f"né {text(b64, n)} é", text("0123456789abcdef", n), text("0123456789ABCDEF", n) + text("aB", n)]
    out.append(" ".join(f"token={text(b64[:62], 8)}" for _ in range(700)))
    return out


def test_secret_spans_equal_brute_force(spark, texts):
    given = [*secret_texts(), "", *texts.values()]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    for r in secret_scan.secret_scan(df).collect():
        text = given[r["doc_id"]]
        listed = lambda spans: ",".join(f"{secret_scan.KINDS[k]}:{a}:{z}" for a, k, z in spans)
        base = brute_spans(text)
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(b[1] == k for b in base) for k in range(3)]
        assert r["spans"] == listed(sorted(base + brute_entropy(text))), text[:80]


def test_entropy_finds_what_no_pattern_does_and_leaves_words(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYzq83hV0d"
    df = spark.createDataFrame([(1, f"use {key} now"), (2, "incomprehensibilities-and-internationalization"),
                                (3, f"sha256:{key}")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_entropy"] for r in secret_scan.secret_scan(df).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_redaction_masks_the_union_of_spans(spark):
    given = [*secret_texts(), None, ""]
    df = spark.createDataFrame([(i, t, 3, 9) for i, t in enumerate(given)], "doc_id long, text string, n_chars long, spans int")
    out = secret_scan.redacted(df, length_col="n_chars", mask="[s]")
    assert out.columns == df.columns
    for r in out.collect():
        text = given[r["doc_id"]]
        spans = [] if text is None else sorted(brute_spans(text) + brute_entropy(text))
        want, at = "", 0
        for a, _, z in spans:
            if a > at or not want and at == 0:
                want += text[at:a] + "[s]"
            elif a == at:                            # touching spans are one stretch
                pass
            at = max(at, z)
        if spans:
            assert r["text"] == want + text[at:] and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == text and r["n_chars"] == 3


def test_secret_odd_tables(odd, nothing):
    rows = secret_scan.secret_scan(odd).collect()
    assert len(rows) == len(ROWS) and rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secret_scan.secret_scan(nothing).count() == 0
    assert secret_scan.redacted(odd).columns == odd.columns and secret_scan.redacted(odd).count() == len(ROWS)


# ---- quality model

def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scores = gam.quality_scores(docs, labels)
    rows = scores.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_never_learns_from_held_out_rows(docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", F.when(gam.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = gam.quality_scores(docs, labels), gam.quality_scores(docs, flipped)
    assert a.exceptAll(b).isEmpty()


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert (0, 1) in [tuple(sorted(p)) for p in model.pairs]
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((300, 4))
    model = gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    for row, score in zip(x[:20], model.score(x[:20])):
        total = model.intercept + sum(t[sum(v >= c for c in cut)] for v, cut, t in zip(row, model.cuts, model.tables))
        for (i, j), t in zip(model.pairs, model.pair_tables):
            total += t[sum(row[i] >= c for c in model.pair_cuts[i]), sum(row[j] >= c for c in model.pair_cuts[j])]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_odd_tables(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (6, None), (8, 0)], "doc_id long, quality int")
    rows = gam.quality_scores(odd, labels).collect()
    assert len(rows) == len(ROWS) and all(r["score"] is not None for r in rows)
    assert gam.quality_scores(nothing, labels).count() == 0
    assert {r["score"] for r in gam.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert gam.good_documents(odd, labels).columns == odd.columns


def near_copies(rng, n, words=60, families=3):
    """Texts about the threshold: edits of a few words of a base, some of them repeated."""
    vocabulary = [f"w{k}" for k in range(40)]
    bases = [[f"b{f}x{k}" for k in range(words)] for f in range(families)]
    texts = []
    for k in range(n):
        own = list(bases[k % families])
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(words)] = rng.choice(vocabulary)
        if k % 7 == 0:
            own = own[:20] + own[10:20] * 2 + own[20:]
        texts.append(" ".join(own))
    return sorted(set(texts))


def true_links(texts):
    from trellis.llm import probminhash as P
    from trellis.llm.common import WordNames
    bags = [P.shingles(t.encode(), WordNames()) for t in texts]
    return {(i, j) for j in range(len(bags)) for i in range(j) if P.similarity(bags[i], bags[j]) >= 0.8}


def classes_of(n, edges):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        label[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def test_prefix_join_holds_all_links_between_classes(spark):
    import random

    from trellis.llm.common import stored
    from trellis.llm.probminhash import prefix_pairs, with_shingles
    texts = near_copies(random.Random(5), 150)
    shingled = stored(with_shingles(spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")))
    for label in (lambda k: k, lambda k: k % 4):
        labelled = spark.createDataFrame([(k, label(k)) for k in range(len(texts))], "node bigint, label bigint")
        got = {tuple(r) for r in prefix_pairs(labelled, shingled, 0.8).collect()}
        want = {(i, j) for i, j in true_links(texts) if label(i) != label(j)}
        assert want <= got and all(label(i) != label(j) and i < j for i, j in got)
        assert len(got) < len(texts) ** 2 / 4
    one = spark.createDataFrame([(k, 7) for k in range(len(texts))], "node bigint, label bigint")
    assert prefix_pairs(one, shingled, 0.8).isEmpty()


def test_prefix_join_leaves_out_copies_that_are_not_near_enough(spark):
    """Copies whose own parts are frequent words: they share rare shingles, but not enough."""
    import random

    from trellis.llm.common import stored
    from trellis.llm.probminhash import prefix_pairs, verified, with_shingles
    draw, base = random.Random(8), [f"w{k}" for k in range(100)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in draw.sample(range(100), 3):
            words[at] = f"v{draw.randrange(2)}"
        texts.append(" ".join(words))
    shingled = stored(with_shingles(spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")))
    labelled = spark.createDataFrame([(k, k) for k in range(len(texts))], "node bigint, label bigint")
    pairs = prefix_pairs(labelled, shingled, 0.8)
    want = {(i, j) for i, j in true_links(texts)}
    assert want <= {tuple(r) for r in pairs.collect()} and pairs.count() <= len(want) + 120
    assert {tuple(r) for r in verified(pairs, shingled, 0.8).collect()} == want


def test_prefix_join_finds_what_no_star_does(spark):
    """A text that is similar to a member of a class but not to the class's center."""
    from trellis.llm.common import stored
    from trellis.llm.probminhash import prefix_pairs, verified, with_shingles
    words = [f"w{k}" for k in range(120)]
    texts = {1: ["x"] * 8 + words[8:], 2: words, 3: words[:-8] + ["y"] * 8, 4: [f"z{k}" for k in range(90)]}
    shingled = stored(with_shingles(spark.createDataFrame(
        [(n, " ".join(t)) for n, t in texts.items()], "node bigint, text string")))
    labelled = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "node bigint, label bigint")
    out = verified(prefix_pairs(labelled, shingled, 0.8), shingled, 0.8)
    assert sorted(map(tuple, out.collect())) == [(2, 3)]


def test_classes_of_a_large_near_copy_group(spark):
    """Every pair that brute force links is in one class, and no others are."""
    import random

    from trellis.llm.probminhash import near_duplicates
    texts = near_copies(random.Random(6), 500, words=80, families=2)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    want = classes_of(len(texts), true_links(texts))
    assert [got[k] for k in range(len(texts))] == want
    assert 1 < len(set(want)) < len(texts)


def test_no_candidate_is_left_open(spark):
    """A bucket of more unlike texts than any number of rounds, and two that are alike."""
    from trellis.llm import probminhash as P
    marks = bytes(2 * P.COMPONENTS)
    rows = [(k, bytes([k]), k, [5], marks) for k in range(1, 31)]
    texts = [(k, bytes([k]), " ".join(f"a{k}-{j}" for j in range(40))) for k in range(1, 29)]
    like = [f"b{j}" for j in range(60)]
    texts += [(29, bytes([29]), " ".join(like)), (30, bytes([30]), " ".join([*like, "c"]))]
    base = spark.createDataFrame(rows, "doc_id bigint, hash binary, node bigint, keys array<bigint>, marks binary")
    out = P.links(base, spark.createDataFrame(texts, "doc_id bigint, hash binary, text string"))
    assert set(map(tuple, out.collect())) == {(29, 30)}
