"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every place of a text where ``WIDTH`` bytes start is a suffix, ordered through these bytes
only.  The sort takes most significant digits first; a digit is a 64-bit name of bytes, the
same for equal bytes everywhere, and a group that cannot hold an undecided repeat leaves
before the next digit:

1. The smallest-named gram of ``GRAM`` bytes among the suffix's first ``WIDTH``.  Suffixes
   in a row that share it (a run, 36 on average) are in one group and move as one record,
   with the bytes of the whole run as the next digit.  A run equal to one that starts
   earlier is repeated in full, and one whose gram comes in no other run is decided.
2. Runs that share the gram with different ones are split by the largest-named gram too,
   and the parts decided in the same way.
3. What is left, where a repeated passage begins or ends, goes by the suffix's own ``WIDTH``
   bytes, in two digits.

Groups that are equal in all digits are the repeated strings.  Names decide by 128 bits.

Documents are dealt into chunks of about ``CHUNK_CHARS`` characters, shuffled once; later
passes reuse that exchange.  A chunk sends each distinct pair of digits once with its
smallest document, so a passage of many documents is summed before the shuffle, packed
into one row for each bucket of the first digit (as many as the session has shuffle
partitions); what comes back is two bits for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import columns, mix

WIDTH, GRAM, CHUNK_CHARS = 100, 32, 4_000_000
SPAN = WIDTH - GRAM + 1
#: suffixes that are named at a time; their places need ``PLACE`` bits
SLAB, PLACE = 1 << 18, 19
RUN, PART, WINDOW = 0, 1, 2
LAST = np.iinfo(np.int64).max
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
STEP = np.uint64(BASES[0])
#: names of bytes, one table for each digit
BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in BASES]
POWER = [np.cumprod(np.full(SLAB + WIDTH, b, np.uint64)) for b in BASES]
INVERSE = [np.cumprod(np.full(SLAB + WIDTH, pow(b, -1, 1 << 64), np.uint64)) for b in BASES]


class Strings:
    """Names of any strings of some bytes, for one digit."""

    def __init__(self, part: np.ndarray, digit: int):
        self.byte, self.digit = BYTES[digit][part], digit
        self.sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(self.byte * POWER[digit][:len(part)], out=self.sums[1:])

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * INVERSE[self.digit][start] + (end - start).astype(np.uint64))


def grams(byte: np.ndarray) -> np.ndarray:
    """The names of all grams, from the bytes' names."""
    gram, width = byte, 1
    while width < GRAM:
        gram = gram[:-width] * np.uint64(BASES[1] + 2 * width) + gram[width:]
        width *= 2
    return mix(gram)


def anchors(gram: np.ndarray) -> np.ndarray:
    """For each suffix the place of its smallest-named gram, the first of equal ones."""
    low = np.uint64((1 << PLACE) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPAN - width
    return (np.minimum(least[:len(least) - rest], least[rest:]) & low).astype(np.int64)


class Runs:
    """Suffixes in a row that move as one: the first suffix, how many, their digits and row."""

    def __init__(self, start: np.ndarray, count: np.ndarray, high: np.ndarray, low: np.ndarray, row: np.ndarray):
        self.start, self.count, self.high, self.low, self.row = start, count, high, low, row

    def only(self, which: np.ndarray) -> "Runs":
        return Runs(*(x[which] for x in (self.start, self.count, self.high, self.low, self.row)))

    @staticmethod
    def joined(parts: list["Runs"]) -> "Runs":
        kinds = (np.int64, np.int64, np.uint64, np.uint64, np.int64)
        return Runs(*(np.concatenate([getattr(p, c) for p in parts]) if parts else np.empty(0, t)
                      for c, t in zip(("start", "count", "high", "low", "row"), kinds)))

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Every suffix, and the number of its run."""
        number = np.repeat(np.arange(len(self.start)), self.count)
        return self.start[number] + np.arange(len(number)) - np.append(0, np.cumsum(self.count)[:-1])[number], number


class Chunk:
    """All documents of a chunk, their runs and what is known to be repeated."""

    def __init__(self, ids: list, texts: list[bytes]):
        # a later pass may get the rows in another order
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k], texts[k]))
        self.ids = np.array([LAST if ids[k] is None else ids[k] for k in self.order], np.int64)
        self.whole = np.frombuffer(b"".join(texts[k] for k in self.order), np.uint8)
        sizes = np.array([len(texts[k]) for k in self.order], np.int64)
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        self.step = np.zeros(len(self.whole) + 1, np.int32)      # where repeated bytes begin, less where they end
        some = sizes >= WIDTH
        edge = np.zeros(len(self.whole) + 1, np.int8)
        edge[self.begin[some]] = 1
        edge[self.end[some] - WIDTH + 1] -= 1
        self.starts = np.cumsum(edge[:-1]).astype(bool)          # whether WIDTH bytes of a document start here
        self.runs = Runs.joined([self.named(at) for at in range(0, max(len(self.whole) - WIDTH + 1, 0), SLAB)])

    def part(self, at: int) -> np.ndarray:
        """The bytes of all suffixes of the slab that begins at a place."""
        return self.whole[at:at + SLAB + WIDTH - 1]

    def named(self, at: int) -> Runs:
        """Runs that start in one slab.  One that repeats an earlier run of its row and slab
        is marked at once."""
        strings = Strings(self.part(at), 0)
        gram = grams(strings.byte)
        place = anchors(gram)
        ok = self.starts[at:at + len(place)]
        change = np.append(True, place[1:] != place[:-1])
        change[1:] |= ok[1:] != ok[:-1]
        head = np.flatnonzero(change)
        count = np.diff(np.append(head, len(place)))
        head, count = head[ok[head]], count[ok[head]]
        runs = Runs(head + at, count, gram[place[head]], strings.names(head, head + count + WIDTH - 1),
                    np.searchsorted(self.end, head + at, side="right"))
        first = first_of(runs.high, runs.low, runs.row)
        self.mark(runs.only(~first))
        return runs.only(first)

    def mark(self, runs: Runs) -> None:
        np.add.at(self.step, runs.start, 1)
        np.add.at(self.step, runs.start + runs.count + WIDTH - 1, -1)

    def asked(self, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The digits of runs and their documents' ids."""
        return runs.high, runs.low, self.ids[runs.row]

    def undecided(self, runs: Runs, smaller: np.ndarray, several: np.ndarray) -> Runs:
        """The runs that the answers on each leave open; repeated ones are marked."""
        repeated = smaller | ~first_of(runs.high, runs.low, runs.row)
        self.mark(runs.only(repeated))
        return runs.only(several & ~repeated)

    def by_slab(self, at: np.ndarray):
        """(place of the slab, first and last entry + 1) of ascending places."""
        slab = at // SLAB
        for s in np.unique(slab):
            yield int(s) * SLAB, *np.searchsorted(slab, [s, s + 1])

    def parts(self, runs: Runs) -> Runs:
        """``runs`` split by their suffixes' largest-named gram."""
        found = []
        for at, a, z in self.by_slab(runs.start):
            some = runs.only(slice(a, z))
            strings = Strings(self.part(at), 0)
            gram = ~grams(strings.byte)
            place = anchors(gram)
            suffix, number = some.suffixes()
            head = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (np.diff(place[suffix - at]) != 0)))
            count = np.diff(np.append(head, len(suffix)))
            first, of = suffix[head], number[head]
            found.append(Runs(first, count, mix(some.high[of] * STEP + gram[place[first - at]]),
                              strings.names(first - at, first - at + count + WIDTH - 1), some.row[of]))
        return Runs.joined(found)

    def windows(self, runs: Runs) -> Runs:
        """The suffixes of ``runs`` one by one, named by their own bytes."""
        suffix, number = runs.suffixes()
        names = [np.empty(len(suffix), np.uint64) for _ in BASES]
        for at, a, z in self.by_slab(suffix):
            here = suffix[a:z] - at
            for digit, name in enumerate(names):
                name[a:z] = Strings(self.part(at), digit).names(here, here + WIDTH)
        return Runs(suffix, np.ones(len(suffix), np.int64), *names, runs.row[number])

    def kept(self) -> tuple[list[bytes], np.ndarray]:
        """The bytes that are not marked and the number of stretches removed of each
        document."""
        gone = np.cumsum(self.step[:-1]) > 0
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        at = self.begin[self.begin < self.end]
        rise[at] = gone[at]
        total = np.append(0, np.cumsum(rise))
        cut = np.append(0, np.cumsum(gone))
        out = [b""] * len(self.order)
        spans = np.zeros(len(self.order), np.int64)
        for k, a, z in zip(self.order, self.begin, self.end):
            part = self.whole[a:z]
            out[k] = (part if cut[a] == cut[z] else part[~gone[a:z]]).tobytes()
            spans[k] = total[z] - total[a]
        return out, spans


def ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs of digits, and where in that order a new pair begins."""
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    return order, np.flatnonzero(new)


def first_of(high: np.ndarray, low: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each entry, in the order of their places, is its row's first of its digits."""
    order = np.lexsort((row, low, high))
    out = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    out[a] = (high[a] != high[b]) | (low[a] != low[b]) | (row[a] != row[b])
    return out


def distinct(high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs in order, the smallest id of each, and each entry's pair."""
    order, head = ranked(high, low)
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
    least = np.minimum.reduceat(ids[order], head) if len(head) else ids
    return high[order[head]], low[order[head]], least, number


def dealt(high: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, entries) of distinct pairs by the first digit."""
    bucket = (high >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)) if len(order) else []
    for a, z in zip(cut, [*cut[1:], len(order)]):
        yield int(bucket[order[a]]), order[a:z]


QUESTION = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()),
                      ("high", pa.binary()), ("low", pa.binary()), ("ids", pa.binary())])
ANSWER = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("smaller", pa.binary()),
                    ("several", pa.binary())])
QUESTION_SQL = "kind int, bucket int, chunk int, n int, high binary, low binary, ids binary"
ANSWER_SQL = "kind int, bucket int, chunk int, smaller binary, several binary"


def questions(chunk: int, kind: int, high: np.ndarray, low: np.ndarray, ids: np.ndarray, buckets: int) -> pa.Table:
    high, low, least, _ = distinct(high, low, ids)
    return pa.Table.from_pylist(
        [{"kind": kind, "bucket": bucket, "chunk": chunk, "n": len(at), "high": high[at].tobytes(), "low": low[at].tobytes(),
          "ids": pa.compress(least[at].tobytes(), codec="zstd", asbytes=True)} for bucket, at in dealt(high, buckets)], QUESTION)


def answer(table: pa.Table) -> pa.Table:
    """For one bucket of one kind, two bits for each pair of each chunk: whether some chunk
    has it with a smaller id, and whether its first digit has another second digit."""
    rows = table.to_pylist()
    sizes = [r["n"] for r in rows]
    high, low = (np.frombuffer(b"".join(r[c] for r in rows), np.uint64) for c in ("high", "low"))
    ids = np.concatenate([np.frombuffer(pa.decompress(r["ids"], 8 * r["n"], codec="zstd", asbytes=True), np.int64) for r in rows])
    firsts, _, least, number = distinct(high, low, ids)
    smaller = least[number] < ids
    _, group, members = np.unique(firsts, return_inverse=True, return_counts=True)
    several = (members > 1)[group][number]
    return pa.Table.from_pylist(
        [{"kind": r["kind"], "bucket": r["bucket"], "chunk": r["chunk"], "smaller": np.packbits(smaller[z - n:z]).tobytes(),
          "several": np.packbits(several[z - n:z]).tobytes()} for r, n, z in zip(rows, sizes, np.cumsum(sizes))], ANSWER)


def answered(table: pa.Table, kind: int, high: np.ndarray, low: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether a smaller document has its digits, and whether its first
    digit has several second ones."""
    by = {r["bucket"]: r for r in table.to_pylist() if r["kind"] == kind}
    firsts, _, least, number = distinct(high, low, ids)
    bits = np.zeros((2, len(firsts)), bool)
    for bucket, at in dealt(firsts, buckets):
        for k, c in enumerate(("smaller", "several")):
            bits[k, at] = np.unpackbits(np.frombuffer(by[bucket][c], np.uint8), count=len(at)).astype(bool)
    return bits[0][number] | (least[number] < ids), bits[1][number]


def without_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (of its text in UTF-8), n_spans (the
    stretches removed) and kept (the bytes left, which may begin or end inside a
    character).

    A byte goes if ``WIDTH`` bytes that cover it also start earlier: in a document with a
    smaller id, or further up in the same document.  Strings are judged on the input.  Null
    and empty texts keep nothing and lose nothing, shorter ones are kept; rows with equal
    ids are not earlier than each other; null ids are larger than all others and not
    earlier than each other; equal rows get equal results, however many they are; a very
    long text is one chunk's, named in slabs; an empty table gives an empty table; other
    columns are not read.  Ids are integers.
    """
    spark = docs.sparkSession
    docs = columns(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    again = not docs.groupBy("doc_id", F.xxhash64("text")).count().filter("count > 1").isEmpty()
    if again:                                                # a row that is there many times is dealt once
        docs = docs.groupBy("doc_id", "text").count()
    else:
        docs = docs.withColumn("count", F.lit(1).cast("long"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks, buckets = int(chars // CHUNK_CHARS) + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_chunk = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).groupBy("chunk")

    def chunk_of(table: pa.Table) -> tuple[int, Chunk]:
        texts = [t.as_py() or b"" for t in table["text"].cast(pa.binary())]
        return table["chunk"][0].as_py(), Chunk(table["doc_id"].to_pylist(), texts)

    def asked_of(chunk: Chunk, answers: pa.Table, upto: int) -> Runs:
        """What a chunk asks in the pass ``upto``, from the answers of those before it."""
        runs = chunk.runs
        for kind, split in ((RUN, chunk.parts), (PART, chunk.windows))[:upto]:
            runs = split(chunk.undecided(runs, *answered(answers, kind, *chunk.asked(runs), buckets)))
        return runs

    def ask_runs(table: pa.Table) -> pa.Table:
        number, chunk = chunk_of(table)
        return questions(number, RUN, *chunk.asked(chunk.runs), buckets)

    def ask(kind: int):
        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not len(table):
                return QUESTION.empty_table()
            number, chunk = chunk_of(table)
            return questions(number, kind, *chunk.asked(asked_of(chunk, answers, kind)), buckets)
        return run

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.schema([("doc_id", table.schema.field("doc_id").type), ("n_bytes", pa.int64()), ("n_spans", pa.int64()),
                              ("kept", pa.binary()), ("count", pa.int64())]).empty_table()
        _, chunk = chunk_of(table)
        runs = asked_of(chunk, answers, WINDOW)
        chunk.undecided(runs, *answered(answers, WINDOW, *chunk.asked(runs), buckets))
        kept, spans = chunk.kept()
        sizes = np.empty(len(kept), np.int64)
        sizes[chunk.order] = chunk.end - chunk.begin
        return pa.table({"doc_id": table["doc_id"], "n_bytes": sizes, "n_spans": spans,
                         "kept": pa.array(kept, pa.binary()), "count": table["count"]})

    def answers_to(asked: DataFrame) -> DataFrame:
        return asked.groupBy("kind", "bucket").applyInArrow(answer, ANSWER_SQL)

    answers = answers_to(by_chunk.applyInArrow(ask_runs, QUESTION_SQL))
    for later in (PART, WINDOW):
        more = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(ask(later), QUESTION_SQL)
        answers = answers.unionByName(answers_to(more))
    rows = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(
        cut, f"doc_id {kind}, n_bytes bigint, n_spans bigint, kept binary, count bigint")
    if again:
        rows = rows.withColumn("count", F.explode(F.sequence(F.lit(1).cast("long"), "count")))
    return rows.drop("count")
