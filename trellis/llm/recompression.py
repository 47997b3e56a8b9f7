"""Removal of repeated word windows by recompression.

A text's words are recompressed in rounds: a round names runs of one symbol, then pairs
of adjacent symbols of which the first is on the left and the second on the right side
of a split of the alphabet.  Names are 64-bit fingerprints of what they stand for, so all
tasks give the same names without exchanging a dictionary.  Whether a symbol of the first
round stands where it does depends on a few words around it only; so equal windows of
words hold the same interior symbols.

Three exchanges answer which windows also start in a document with a smaller id:

1. ``FEATURE``: each window stands for its smallest-named run of three first-round symbols
   that the window alone determines.  Windows whose feature occurs in one document only
   are unique.
2. ``LONG``: neighbouring symbols of the last round, 13 words or more.  Where a smaller
   document holds the same two, all windows inside are repeats.
3. ``WINDOW``: the windows left, verified by the name of all their words.

Documents are dealt into chunks of about ``CHUNK_CHARS`` characters.  A chunk sends each
name once, with its smallest document (so a passage of many documents is summed before
the shuffle), packed by bucket, as many as the session has shuffle partitions; what comes
back is one bit for each name.  The texts are shuffled once, into their chunks; the later
passes reuse that exchange.  Names decide: repeats are not compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import WordNames, columns, mix, window_names

WIDTH, ROUNDS, CHUNK_CHARS = 13, 9, 4_000_000
FEATURE, LONG, WINDOW = 0, 1, 2
STEP = np.uint64(0x9E3779B97F4A7C15)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LAST = np.iinfo(np.int64).max


class Symbols:
    """Symbols of all documents of a chunk, one after the other.

    ``start``: first word of each; ``low``, ``high``: the words that determine it, end
    exclusive (followed through the first round only).
    """

    def __init__(self, names: np.ndarray, doc: np.ndarray):
        n = len(names)
        self.name, self.doc, self.start, self.words = names, doc, np.arange(n), n
        self.low, self.high = self.start, self.start + 1

    def runs(self) -> None:
        """Name each run of one symbol by the symbol and its length."""
        same = (self.name[1:] == self.name[:-1]) & (self.doc[1:] == self.doc[:-1])
        head = np.flatnonzero(np.append(True, ~same))
        length = np.diff(np.append(head, len(self.name)))
        self.name = np.where(length > 1, mix(self.name[head] * STEP + length.astype(np.uint64)), self.name[head])
        self.doc, self.start = self.doc[head], self.start[head]
        # that a run ends where it does, shows in the word before and the word after it
        self.low, self.high = self.start - 1, np.append(self.start[1:], self.words) + 1

    def pairs(self, turn: int) -> None:
        """Name each pair of a left symbol and a right symbol next to it."""
        right = (mix(self.name + np.uint64(turn * int(STEP) & int(NONE))) & np.uint64(1)).astype(bool)
        joined = np.zeros(len(right), bool)                  # with the next symbol
        joined[:-1] = ~right[:-1] & right[1:] & (self.doc[:-1] == self.doc[1:])
        low_before = np.append(-1, self.low[:-1])
        high_after = np.append(self.high[1:], self.words + 1)
        # a right symbol depends on the one before it, a left symbol on the one after it
        low = np.where(right, np.minimum(self.low, low_before), self.low)
        high = np.where(right, self.high, np.maximum(self.high, high_after))
        name = self.name.copy()
        at = np.flatnonzero(joined)
        name[at] = mix(mix(self.name[at] * STEP) + self.name[at + 1])
        high[at] = self.high[at + 1]
        stay = np.ones(len(right), bool)
        stay[at + 1] = False
        self.name, self.doc, self.start = name[stay], self.doc[stay], self.start[stay]
        self.low, self.high = low[stay], high[stay]


class Chunk:
    """All documents of a chunk: their words, windows and names."""

    def __init__(self, ids: list, texts: list, names: WordNames):
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        self.name = np.concatenate([names.array(w) for w in self.words]) if len(sizes) else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        n = len(self.name)
        self.whole = np.zeros(n, bool)                       # whether a window starts at a word
        self.whole[np.arange(n) + WIDTH <= self.end[self.doc]] = True
        symbols = Symbols(self.name, self.doc)
        if n:
            symbols.runs()
            symbols.pairs(1)
            self.features(symbols)
            for turn in range(2, ROUNDS + 1):
                symbols.runs()
                symbols.pairs(turn)
            self.long_pairs(symbols)
        else:
            self.feature = self.long = np.empty(0, np.uint64)
            self.long_doc = self.long_start = self.long_end = np.empty(0, np.int64)

    def features(self, s: Symbols) -> None:
        """The feature of the window at each word; ``NONE`` if no symbols are fixed in it."""
        self.feature = np.full(len(self.name), NONE)
        if len(s.name) < 3:
            return
        name = mix(mix(s.name[:-2] * STEP + s.name[1:-1]) * STEP + s.name[2:])
        own = s.doc[:-2]
        first = np.maximum(s.high[2:] - WIDTH, self.begin[own])
        last = np.minimum(s.low[:-2], self.end[own] - WIDTH)
        one = own == s.doc[2:]
        for back in range(WIDTH):
            at = last - back
            ok = one & (at >= first)
            if not ok.any():
                break
            np.minimum.at(self.feature, at[ok], name[ok])

    def long_pairs(self, s: Symbols) -> None:
        """Pairs of neighbours of the last round that hold a window, or single symbols
        that have no neighbour."""
        end = np.append(s.start[1:], len(self.name))
        a = np.arange(len(s.name) - 1)
        b = a + 1
        one = s.doc[:-1] == s.doc[1:]
        alone = np.ones(len(s.name), bool)
        alone[:-1] &= ~one
        alone[1:] &= ~one
        single = np.flatnonzero(alone)
        a, b = np.concatenate([a[one], single]), np.concatenate([b[one], single])
        fits = end[b] - s.start[a] >= WIDTH
        a, b = a[fits], b[fits]
        self.long = mix(mix(s.name[a] * STEP + np.uint64(77)) + s.name[b])
        self.long_doc, self.long_start, self.long_end = s.doc[a], s.start[a], end[b]

    def asked(self, kind: int, answers: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(names, documents' ids) that this chunk asks about."""
        if kind == FEATURE:
            at = np.flatnonzero(self.whole & (self.feature != NONE))
            return self.feature[at], self.ids[self.doc[at]]
        if kind == LONG:
            return self.long, self.ids[self.long_doc]
        at = self.open_windows(answers)
        return self.window_name[at], self.ids[self.doc[at]]

    def covered(self, answers: dict) -> np.ndarray:
        """Windows inside two long symbols that a smaller document holds as well."""
        names, ids = self.asked(LONG)
        repeat = smaller(names, ids, answers[LONG])
        step = np.zeros(len(self.name) + 1, np.int64)
        np.add.at(step, self.long_start[repeat], 1)
        np.add.at(step, self.long_end[repeat] - WIDTH + 1, -1)
        return np.cumsum(step[:-1]) > 0

    def open_windows(self, answers: dict) -> np.ndarray:
        """Starts of the windows that need the third exchange."""
        names, ids = self.asked(FEATURE)
        shared = self.whole & (self.feature == NONE)
        shared[np.flatnonzero(self.whole & (self.feature != NONE))] = several(names, ids, answers[FEATURE])
        self.cover = self.covered(answers)
        found = window_names(self.name, WIDTH)
        self.window_name = np.concatenate([found, np.zeros(len(self.name) - len(found), np.uint64)])
        return np.flatnonzero(shared & ~self.cover)

    def kept(self, answers: dict) -> list[list[bytes]]:
        """The words of each document that no repeated window covers."""
        if not len(self.name):
            return self.words
        at = self.open_windows(answers)
        repeat = self.cover & self.whole
        repeat[at] = smaller(self.window_name[at], self.ids[self.doc[at]], answers[WINDOW])
        repeat[~self.whole] = False
        step = np.zeros(len(self.name) + WIDTH + 1, np.int64)
        starts = np.flatnonzero(repeat)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + WIDTH, -1)
        stay = np.cumsum(step)[:len(self.name)] == 0
        return [w if stay[a:z].all() else [x for x, ok in zip(w, stay[a:z]) if ok]
                for w, a, z in zip(self.words, self.begin, self.end)]


def summed(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, the smallest and the largest id of each, and each entry's number."""
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.empty(0, bool)
    head = np.flatnonzero(new)
    number = np.empty(len(names), np.int64)
    number[order] = np.cumsum(new) - 1
    if not len(head):
        return names, ids, ids, number
    return ranked[head], np.minimum.reduceat(ids[order], head), np.maximum.reduceat(ids[order], head), number


def several(names, ids, elsewhere: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Whether each name has another document, here or in another chunk."""
    own, least, most, number = summed(names, ids)
    return ((least < most) | elsewhere(own))[number]


def smaller(names, ids, elsewhere: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Whether each name has a document with a smaller id, here or in another chunk."""
    own, least, _, number = summed(names, ids)
    return elsewhere(own)[number] | (least[number] < ids)


def dealt(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct sorted names by bucket, and the buckets in that order."""
    bucket = ((names >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


QUESTION = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("names", pa.binary()),
                      ("ids", pa.binary()), ("n", pa.int32())])
ANSWER = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("bits", pa.binary())])
QUESTION_SQL = "kind int, bucket int, chunk int, names binary, ids binary, n int"
ANSWER_SQL = "kind int, bucket int, chunk int, bits binary"


def questions(chunk_id: int, kind: int, names, ids, buckets: int) -> list[dict]:
    own, least, _, _ = summed(names, ids)
    order, bucket = dealt(own, buckets)
    own, least = own[order], least[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    return [{"kind": kind, "bucket": int(bucket[a]), "chunk": chunk_id, "names": own[a:z].tobytes(),
             "ids": b"" if kind == FEATURE else _packed(least[a:z]), "n": int(z - a)}
            for a, z in zip(cut, [*cut[1:], len(own)])]


def answer(table: pa.Table) -> pa.Table:
    """For one bucket of one kind: a bit for each name of each chunk.  ``FEATURE``: another
    chunk has it; else: another chunk has it with a smaller id."""
    rows = table.to_pylist()
    sizes = [r["n"] for r in rows]
    names = np.concatenate([np.frombuffer(r["names"], np.uint64) for r in rows])
    if rows[0]["kind"] == FEATURE:
        _, _, _, number = summed(names, np.zeros(len(names), np.int64))
        bits = np.bincount(number)[number] > 1
    else:
        ids = np.concatenate([np.frombuffer(pa.decompress(r["ids"], 8 * r["n"], codec="zstd", asbytes=True), np.int64)
                              for r in rows])
        _, least, _, number = summed(names, ids)
        bits = least[number] < ids
    ends = np.cumsum(sizes)
    return pa.Table.from_pylist(
        [{"kind": r["kind"], "bucket": r["bucket"], "chunk": r["chunk"], "bits": np.packbits(bits[z - n:z]).tobytes()}
         for r, n, z in zip(rows, sizes, ends)], ANSWER)


def lookups(table: pa.Table, buckets: int) -> dict[int, Callable[[np.ndarray], np.ndarray]]:
    """From the answers of a chunk, for each kind: distinct sorted names to their bits."""
    by: dict[tuple[int, int], bytes] = {(r["kind"], r["bucket"]): r["bits"] for r in table.to_pylist()}

    def of(kind: int):
        def look(names: np.ndarray) -> np.ndarray:
            order, bucket = dealt(names, buckets)
            bits = np.zeros(len(names), bool)
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
            for a, z in zip(cut, [*cut[1:], len(names)]):
                got = np.frombuffer(by[kind, int(bucket[a])], np.uint8)
                bits[order[a:z]] = np.unpackbits(got, count=int(z - a)).astype(bool)
            return bits
        return look

    return {kind: of(kind) for kind in (FEATURE, LONG, WINDOW)}


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (the words kept,
    joined by one space).

    A word goes if a window of 13 consecutive words covers it whose words also start in a
    document with a smaller id; windows are judged on the input.  Null, empty and shorter
    texts lose nothing; rows with equal ids are not smaller than each other; null ids are
    larger than all others and not smaller than each other; an empty table gives an empty
    table; other columns are not read.  Ids are integers.
    """
    docs = columns(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    again = not docs.groupBy("doc_id", F.xxhash64("text")).count().filter("count > 1").isEmpty()
    if again:                                                # a row that is there many times is dealt once
        docs = docs.groupBy("doc_id", "text").count()
    else:
        docs = docs.withColumn("count", F.lit(1).cast("long"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks, buckets = int(chars // CHUNK_CHARS) + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = docs.select("doc_id", "text", "count", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))

    def chunk_of(table: pa.Table) -> Chunk:
        return Chunk(table["doc_id"].to_pylist(), [t.as_py() or b"" for t in table["text"].cast(pa.binary())], WordNames())

    def ask_first(table: pa.Table) -> pa.Table:
        chunk, number = chunk_of(table), table["chunk"][0].as_py()
        return pa.Table.from_pylist([q for k in (FEATURE, LONG) for q in questions(number, k, *chunk.asked(k), buckets)], QUESTION)

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return QUESTION.empty_table()
        chunk, number = chunk_of(table), table["chunk"][0].as_py()
        if not len(chunk.name):
            return QUESTION.empty_table()
        asked = chunk.asked(WINDOW, lookups(answers, buckets))
        return pa.Table.from_pylist(questions(number, WINDOW, *asked, buckets), QUESTION)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = chunk_of(table) if len(table) else None
        kept = chunk.kept(lookups(answers, buckets)) if chunk else []
        n = [len(w) for w in chunk.words] if chunk else []
        return pa.table({
            "doc_id": table["doc_id"], "n_words": pa.array(n, pa.int64()),
            "n_removed": pa.array([a - len(w) for a, w in zip(n, kept)], pa.int64()),
            "kept_text": pa.array([b" ".join(w) for w in kept], pa.binary()).cast(pa.string()), "count": table["count"]})

    def answered(asked: DataFrame) -> DataFrame:
        return asked.groupBy("kind", "bucket").applyInArrow(answer, ANSWER_SQL)

    by_chunk = chunked.groupBy("chunk")
    first = answered(by_chunk.applyInArrow(ask_first, QUESTION_SQL))
    windows = answered(by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(ask_windows, QUESTION_SQL))
    both = first.unionByName(windows)
    rows = by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(
        cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string, count bigint")
    if again:
        rows = rows.withColumn("count", F.explode(F.sequence(F.lit(1).cast("long"), "count")))
    return rows.drop("count")
