"""Collocations, the prefix trie and byte dedup against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.conftest import LONG, ROWS
from trellis.llm import collocations as C
from trellis.llm import prefix_trie as P
from trellis.llm import suffix_order as S

# ---- collocations


def brute_collocations(rows, least, top, longest=5):
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang, text = ("und" if lang is None else lang), text or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    c = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    out = []
    for (lang, w), a in c.items():
        if any(g == lang and len(v) > len(w) and 100 * b >= 100 * a
               and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (g, v), b in c.items()):
            continue
        score, _, x, y = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                             for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, x, y, n[lang], score))
    result = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        result += [(lang, k + 1, *r[1:]) for k, r in enumerate(own[:top])]
    return sorted(result)


def random_texts(seed, rows=60, words=12, size=60):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" for k in range(words)] + ["é", "the", "a,b"]
    return [(rng.choice(["en", "de", None, "und"]),
             "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b"]) for _ in range(rng.randrange(size))))
            for _ in range(rows)] + [("en", None), ("en", ""), (None, " .. ")]


@pytest.mark.parametrize("seed,least,top", [(1, 3, 10**6), (2, 8, 5), (3, 2, 7)])
def test_collocations_equal_brute_force(spark, seed, least, top):
    rows = random_texts(seed)
    df = spark.createDataFrame(rows, "lang string, text string")
    out = C.collocations(df.repartition(5), least=least, top=top)
    assert sorted(map(tuple, out.collect())) == brute_collocations(rows, least, top)


def test_collocations_in_small_slices(spark, monkeypatch):
    """Counts do not depend on what a task holds at a time."""
    rows = random_texts(4, rows=30)
    for name, value in (("SLICE", 50), ("HELD", 90), ("VOCABULARY", 6)):
        monkeypatch.setattr(C, name, value)
    counts = []
    for lang, text in rows:
        counter = C.Counts("x", range(1, 6), None, None)
        for words in C.slices([(text or "").encode()]):
            counter.add(words)
        for batch in counter.taken():
            counts += [(lang, p, n) for p, n in zip(batch["phrase"].to_pylist(), batch["n"].to_pylist())]
    whole = Counter()
    for lang, p, n in counts:
        whole[lang, p] += n
    want = Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    want[lang, " ".join(w[i:i + k])] += 1
    assert whole == want


def test_bitmap_lets_all_its_phrases_through(spark):
    words = [f"w{k}" for k in range(500)]
    df = spark.createDataFrame([("en", w) for w in words], "lang string, phrase string")
    bits = np.frombuffer(C.bitmap(df, 1).value, np.uint8)
    own = C.Vocabulary("en")
    own.numbers([w.encode() for w in words])
    assert C.set_in(bits, own.named()[1:]).all()
    other = C.Vocabulary("de")
    other.numbers([w.encode() for w in words])
    assert C.set_in(bits, other.named()[1:]).sum() < 5


def test_collocation_scores_are_exact(spark):
    """Products beyond 64 bits."""
    df = spark.createDataFrame([("en", "a b " * 3)], "lang string, text string")
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big), ("en", "a b", big - 1)], "lang string, phrase string, n long")
    totals = spark.createDataFrame([("en", 40 * big)], "lang string, total long")
    import unittest.mock as mock
    with mock.patch.object(C, "phrase_counts", return_value=(counts, totals)):
        row, = C.collocations(df).collect()
    assert row["score"] == 1000 * (big - 1) * 40 * big // ((big + 7) * big)


def test_collocations_odd_tables(odd, nothing):
    rows = [(r[2], r[1]) for r in ROWS]
    out = C.collocations(odd, least=2, top=10**6)
    assert sorted(map(tuple, out.collect())) == brute_collocations(rows, 2, 10**6)
    assert C.collocations(nothing).count() == 0


# ---- prefix trie


def brute_trie(sequences):
    """Rows of the trie of {conv_id: [(role, text), ...]}."""
    nodes = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        ends = sorted(c for c in members if len(sequences[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                    sum(len(p) == len(path) + 1 for p in below),
                    sum(not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in nodes) for p in below),
                    sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None),
                                      key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def random_conversations(seed, n=70, longest=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(["", "a b", "c", None, "x\ty  z"])))
    rng.shuffle(rows)
    return rows


CONVERSATION = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,longest", [(1, 4), (2, 7), (3, 30)])
def test_trie_equals_brute_force(spark, seed, longest):
    rows = random_conversations(seed, longest=longest)
    df = spark.createDataFrame(rows, CONVERSATION).repartition(7)
    out = P.prefix_trie(*P.rebuilt(*P.ordered_turns(df)))
    assert sorted(map(tuple, out.collect()), key=str) == brute_trie(brute_rebuilt(rows))


def test_trie_of_long_conversations_and_many_copies(spark, monkeypatch):
    """Blocks far from the start, segments of one block, packs of two ids."""
    monkeypatch.setattr(P, "SEGMENT", 1)
    monkeypatch.setattr(P, "PACK", 2)
    turns = {c: [("user", f"t{k} w")for k in range(45)] for c in range(9)}
    turns[20] = turns[0][:16]
    turns[21] = turns[0][:17] + [("user", "else")]
    turns[22] = turns[0][:24]
    rows = [(c, k, *t) for c, own in turns.items() for k, t in enumerate(own)]
    at, convs = P.ordered_turns(spark.createDataFrame(rows, CONVERSATION).repartition(3))
    out = P.prefix_trie(at.select("conv_id", "pos", "a", "b", "words"), convs.select("conv_id"))
    assert sorted(map(tuple, out.collect()), key=str) == brute_trie(turns)


def test_positions_of_one_hot_conversation(spark):
    """A conversation that lies in many parts, with repeated rows and equal turn numbers."""
    rows = [(1, k // 2, "user", f"t{k // 4}") for k in range(400)] + [(c, 0, "user", "x") for c in range(2, 9)]
    df = spark.createDataFrame(rows, CONVERSATION).repartition(6)
    at, convs = P.ordered_turns(df)
    got = at.filter("conv_id = 1").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(400))
    assert {r["conv_id"]: r["size"] for r in convs.collect()} == {1: 400, **dict.fromkeys(range(2, 9), 1)}


def test_trie_odd_tables(spark):
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", LONG), (2, None, "", ""), (2, 0, "user", LONG),
            (3, 0, "user", ""), (3, 1, "user", ""), (40, 0, "a", "b")]
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(3) for c in ("pos", "a", "part", "block", "start", "words")})
    out = P.prefix_trie(*P.rebuilt(*P.ordered_turns(df)))
    assert sorted(map(tuple, out.collect()), key=str) == brute_trie(brute_rebuilt(rows))
    assert P.prefix_trie(*P.rebuilt(*P.ordered_turns(df.limit(0)))).count() == 0


# ---- byte dedup


def brute_bytes(rows, width=100):
    """(doc_id, n_bytes, n_spans, kept) of rows (doc_id, text); ids distinct but for equal
    rows, which are not earlier than each other."""
    first = {}
    rank = lambda i: (i is None, i or 0)
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            k = b[p:p + width]
            first[k] = min(first.get(k, (rank(i), p)), (rank(i), p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] < (rank(i), p):
                gone[p:p + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def random_documents(seed):
    rng = random.Random(seed)
    alphabet = "abcdeé "
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.choice([60, 99, 100, 101, 150, 400]))) for _ in range(8)]
    rows = []
    for k in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(200)))
                 for _ in range(rng.randrange(6))]
        rows.append((k, "".join(parts)))
    return rows + [(60, "a" * 700), (61, "ab" * 300), (62, "a" * 99), (63, rows[5][1]), (64, rows[5][1]), (65, None), (66, ""),
                   (67, "x" + "ab" * 90 + "y" + "ba" * 90)]


@pytest.mark.parametrize("seed,chunk,slab", [(1, 4_000_000, 1 << 18), (2, 700, 1 << 18), (3, 700, 128), (4, 4_000_000, 64)])
def test_bytes_equal_brute_force(spark, monkeypatch, seed, chunk, slab):
    """Also across many chunks, and with runs cut where a slab ends."""
    rows = random_documents(seed)
    want = brute_bytes(rows)
    monkeypatch.setattr(S, "CHUNK_CHARS", chunk)
    if slab == S.SLAB:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        out = S.without_repeated_bytes(df).select("doc_id", "n_bytes", "n_spans", F.col("kept"))
        assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in out.collect()), key=str) == want
        return
    monkeypatch.setattr(S, "SLAB", slab)                     # workers do not see it: the classes themselves
    chunks = [S.Chunk([i for i, _ in part], [(t or "").encode() for _, t in part]) for part in (rows[0::3], rows[1::3], rows[2::3])]

    def one(kind, asked):                                    # a single bucket
        got = S.answer(S.pa.concat_tables([S.questions(k, kind, *a, 1) for k, a in enumerate(asked)])).to_pylist()
        return [S.answered(S.pa.Table.from_pylist([r for r in got if r["chunk"] == k], S.ANSWER), kind, *a, 1)
                for k, a in enumerate(asked)]

    level = [c.runs for c in chunks]
    for kind in (S.RUN, S.PART, S.WINDOW):
        bits = one(kind, [c.asked(runs) for c, runs in zip(chunks, level)])
        level = [c.undecided(runs, *b) for c, runs, b in zip(chunks, level, bits)]
        if kind != S.WINDOW:
            level = [(c.parts if kind == S.RUN else c.windows)(runs) for c, runs in zip(chunks, level)]
    out = []
    for part, c in zip((rows[0::3], rows[1::3], rows[2::3]), chunks):
        kept, spans = c.kept()
        out += [(i, len((t or "").encode()), int(n), k) for (i, t), n, k in zip(part, spans, kept)]
    assert sorted(out, key=str) == want


def test_bytes_of_documents(spark, docs):
    """Against brute force on the small table."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = S.without_repeated_bytes(docs)
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in out.collect()), key=str) == brute_bytes(rows)


def test_bytes_odd_tables(odd, nothing):
    rows = [(r[0], r[1]) for r in ROWS]
    out = S.without_repeated_bytes(odd)
    assert out.columns == ["doc_id", "n_bytes", "n_spans", "kept"]
    assert sorted(((r[0], r[1], r[2], bytes(r[3])) for r in out.collect()), key=str) == brute_bytes(rows)
    assert S.without_repeated_bytes(nothing).count() == 0


def test_names_of_strings_depend_on_bytes_only():
    rng = np.random.default_rng(0)
    part = rng.integers(97, 100, 3000).astype(np.uint8)
    for digit in (0, 1):
        at = np.arange(2900)
        names = S.Strings(part, digit).names(at, at + 5)
        want = [part[k:k + 5].tobytes() for k in at]
        assert len(set(zip(names, want))) == len(set(names)) == len(set(want))
        shifted = S.Strings(part[7:], digit).names(at[:-7], at[:-7] + 5)
        assert (shifted == names[7:]).all()
