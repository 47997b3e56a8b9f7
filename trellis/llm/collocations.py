"""Collocations from sorted streams of phrase counts.

A text is lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into
words.  Phrases of one to ``LONGEST`` words are counted for each language in three scans:
words, pairs of words, and the longer phrases.  A phrase can be frequent only if all its
words and pairs are, so a scan skips what the scans before it ruled out.  It asks a bitmap
of ``BITS`` bits, whatever the size of the corpus: a bit set by chance costs a counted row
that is dropped later, never a phrase.  Tasks sum what they count before the shuffle.

The frequent phrases are one count stream.  Each cut of a phrase of n words gives its first
k words and the rest, and merge joins of sorted streams bring their counts: in prefix order
(by the first words) the left ones, in suffix order (by the rest) the right ones, and by
the phrase without its last or its first word the counts of its extensions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import columns, mix, stored

LONGEST, LEAST, TOP, UNKNOWN = 5, 100, 2000, "und"
#: bits of each bitmap (8 MB) that a scan asks
BITS = 1 << 26
#: bytes of text, words counted and different words that a task holds at a time
SLICE, HELD, VOCABULARY = 2_000_000, 2_000_000, 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)
#: lower case, punctuation and line ends to one mark, tabs to spaces
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The words of ``texts``, a mark ``.`` between pieces and between texts; a few MB of
    text at a time, cut between pieces."""
    def cut(part: list[bytes]) -> Iterator[list[bytes]]:
        whole = b"\n".join(part).translate(PLAIN)
        at = 0
        while at < len(whole):
            end = whole.find(b".", at + SLICE) if len(whole) - at > SLICE else -1
            end = len(whole) if end < 0 else end
            yield whole[at:end].replace(b".", b" . ").split()
            at = end

    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= SLICE:
            yield from cut(part)
            part, size = [], 0
    if part:
        yield from cut(part)


class Vocabulary(defaultdict):
    """Numbers of one language's words, 0 for the mark between pieces, and their 64-bit
    names."""

    def __init__(self, lang: str):
        super().__init__()
        self.default_factory = self.__len__
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())
        self[b"."]                                           # noqa: B018 - takes number 0
        self.names = np.zeros(1, np.uint64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def named(self) -> np.ndarray:
        new = list(self)[len(self.names):]
        more = np.fromiter((xxhash.xxh3_64_intdigest(w, self.seed) for w in new), np.uint64, len(new))
        self.names = np.concatenate([self.names, more])
        return self.names


def pair_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * STEP + b)


def places(names: np.ndarray) -> np.ndarray:
    """The bit of each name."""
    return (mix(names) % np.uint64(BITS)).astype(np.int64)


def set_in(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = places(names)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


class Counts:
    """Phrases of ``sizes`` words of one language, summed until they are taken.

    ``words``, ``pairs``: bitmaps that all words, all pairs of a phrase must be in.
    """

    def __init__(self, lang: str, sizes: range, words: np.ndarray | None, pairs: np.ndarray | None):
        self.lang, self.sizes, self.words, self.pairs = lang, sizes, words, pairs
        self.clear()

    def clear(self) -> None:
        self.vocabulary, self.kept, self.held = Vocabulary(self.lang), [], 0

    def add(self, words: list[bytes]) -> None:
        ids = self.vocabulary.numbers(words)
        self.kept.append(ids)
        self.held += len(ids)

    def taken(self) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n) of all that was added, and forgets it."""
        ids = np.concatenate([*self.kept, np.zeros(1, np.int64)])  # a mark ends the last piece
        spelled = pa.array(list(self.vocabulary), pa.binary())
        ok = ids > 0
        if self.words is not None:
            names = self.vocabulary.named()
            ok &= set_in(self.words, names)[ids]
        if self.pairs is not None:
            chain = ok[:-1] & ok[1:]
            at = np.flatnonzero(chain)
            chain[at] = set_in(self.pairs, pair_names(names[ids[at]], names[ids[at + 1]]))
        else:
            chain = ok[:-1] & ok[1:]
        # rank: the number of the phrase that starts at each of the places ``at``
        at = np.flatnonzero(ok)
        rank = ids[at]
        for size in range(1, self.sizes.stop):
            if size > 1:
                longer = (at + size - 1 < len(ids)) & chain[np.minimum(at + size - 2, len(chain) - 1)]
                at, rank = at[longer], rank[longer]
                rank = rank << 32 | ids[at + size - 1]
            if not len(at):
                break
            _, first, rank, n = np.unique(rank, return_index=True, return_inverse=True, return_counts=True)
            if size in self.sizes:
                where = at[first]
                for a in range(0, len(where), 200_000):
                    some = where[a:a + 200_000]
                    parts = [spelled.take(pa.array(ids[some + k])) for k in range(size)]
                    phrase = pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([self.lang] * len(some)), phrase.cast(pa.string()), pa.array(n[a:a + 200_000], pa.int64())],
                        ["lang", "phrase", "n"])
        self.clear()


def counted(docs: DataFrame, sizes: range, words: Broadcast | None = None, pairs: Broadcast | None = None) -> DataFrame:
    """(lang, phrase, n): how often each phrase of ``sizes`` words occurs, of those that the
    bitmaps let through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, Counts] = {}
        bits = [np.frombuffer(b.value, np.uint8) if b else None for b in (words, pairs)]
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for lang in langs.unique().to_pylist():
                counts = of.setdefault(lang, Counts(lang, sizes, *bits))
                for some in slices(texts.filter(pc.equal(langs, lang)).to_pylist()):
                    counts.add(some)
                    if sum(c.held for c in of.values()) >= HELD or sum(len(c.vocabulary) for c in of.values()) >= VOCABULARY:
                        for c in of.values():
                            yield from c.taken()
        for c in of.values():
            yield from c.taken()

    rows = docs.mapInArrow(run, "lang string, phrase string, n bigint")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bitmap(phrases: DataFrame, size: int) -> Broadcast:
    """Bitmap of the names of ``phrases`` (lang, phrase) of one or two words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = [xxhash.xxh3_64_intdigest(x.encode()) for x in batch.column(0).to_pylist()]
            words = [x.split(b" ") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            parts = [np.array([xxhash.xxh3_64_intdigest(w[k], s) for w, s in zip(words, seeds)], np.uint64)
                     for k in range(size)]
            at = places(parts[0] if size == 1 else pair_names(*parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["at", "bits"])

    rows = (phrases.select("lang", "phrase").mapInArrow(run, "at bigint, bits bigint")
            .groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow())     # at most BITS / 64 rows
    whole = np.zeros(BITS >> 6, np.int64)
    whole[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(whole.tobytes())


def phrase_counts(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """From (lang, text): (lang, phrase, n) of all phrases that occur ``least`` times, and
    (lang, total) words."""
    words = stored(counted(docs, range(1, 2)))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.filter(F.col("n") >= least)
    known = bitmap(frequent, 1)
    pairs = stored(counted(docs, range(2, 3), known).filter(F.col("n") >= least))
    if longest < 3:
        return frequent.unionByName(pairs), totals
    joined = bitmap(pairs, 2)
    more = stored(counted(docs, range(3, longest + 1), known, joined).filter(F.col("n") >= least))
    return frequent.unionByName(pairs).unionByName(more), totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP,
                 longest: int = LONGEST, share: int = 100) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank (from 1), phrase, a (how often it
    occurs), l and r (how often the parts of its lowest-scoring cut do), n (words of the
    language) and score.

    Candidates are phrases of 2 to ``longest`` words that occur ``least`` times.  One goes
    if a longer candidate that holds it occurs at least ``share`` hundredths as often (for
    100 it is enough to look at candidates longer by one word: counts only fall with
    length; for less too).  A null language is ``und``; null, empty and one-word texts give
    no phrase; very long texts are read in slices between pieces; a repeated row counts
    again; ties go by phrase; an empty table gives an empty table; other columns are not
    read.
    """
    docs = columns(docs, lang=lang_col, text=text_col).select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts, totals = phrase_counts(docs, least, longest)
    stream = counts.withColumn("words", F.split("phrase", " ", -1)).withColumn("size", F.size("words"))
    cuts = (stream.filter("size >= 2")
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("lang", "phrase", F.col("n").alias("a"), "size", "k",
                    F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
                    F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ").alias("right")))

    def of(part: str, count: str) -> DataFrame:              # the count stream in the order of a part
        return counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(count)).hint("merge")

    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    totals = totals.select("lang", F.col("total").alias("n"))
    wide = "decimal(19,0)"
    scored = scored.join(totals, "lang").withColumn("score", F.expr(
        f"(cast(a as {wide}) * cast(n as {wide}) * 1000BD) div (cast(l as {wide}) * cast(r as {wide}))"))
    best = (scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    longer = cuts.filter("size >= 3")
    held = (longer.filter("k = size - 1").select("lang", F.col("left").alias("phrase"), "a")
            .unionByName(longer.filter("k = 1").select("lang", F.col("right").alias("phrase"), "a"))
            .groupBy("lang", "phrase").agg(F.max("a").alias("extended")))
    kept = (best.join(held.hint("merge"), ["lang", "phrase"], "left")
            .filter(F.col("extended").isNull() | (100 * F.col("extended") < share * F.col("a"))))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
