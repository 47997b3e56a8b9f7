"""Benchmark decontamination by greedy string tiling.

Tests and documents are words (lower case, outer punctuation off).  Every run of
``SEED`` words of a test is a seed, named by a running Karp-Rabin style hash; documents
join the seeds on that name inside the scan, so nothing is shuffled.  A document and a
test that share seeds are tiled: repeatedly the longest match of unmarked words is
marked on both sides, until none of ``SEED`` words is left.  The share of the test's
words under tiles does not depend on the order of the passages, so reordered copies are
caught too.

A test of fewer words than a seed is found where all its words stand in a row.

The tests are broadcast in blocks of at most ``BLOCK_WORDS`` words; a larger benchmark
takes more passes over the documents, never a larger broadcast: each pass is written and
its block released before the next.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trellis.llm.common import WORD, WordNames, columns, stored, window_names

SEED, COVERAGE, BLOCK_WORDS = 5, 0.5, 500_000
PUNCTUATION = ".,;:!?\"'()[]{}"


class PlainNames(WordNames):
    """Names of words without case and outer punctuation."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        text = word.decode("utf-8", "replace").lower()
        plain = (text.strip(PUNCTUATION) or text).encode()
        name = self[word] = xxhash.xxh3_64_intdigest(plain)
        return name


class Tests:
    """A block of tests: their names and a sorted seed index over all of them."""

    def __init__(self, rows: list[tuple]):
        names = PlainNames()
        self.ids, self.names = [], []
        seeds, items, places = [], [], []
        self.short: dict[int, dict[int, list]] = {}  # words: name of all words: tests
        for item_id, text in rows:
            own = names.array((text or "").encode().split())
            found = window_names(own, SEED)
            if not len(found):
                if len(own):
                    name = int(window_names(own, len(own))[0])
                    self.short.setdefault(len(own), {}).setdefault(name, []).append(item_id)
                continue
            seeds.append(found)
            items.append(np.full(len(found), len(self.ids), np.int64))
            places.append(np.arange(len(found)))
            self.ids.append(item_id)
            self.names.append(own)
        empty = [np.empty(0, np.int64)]
        seeds = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.items = np.concatenate(items or empty)[order]
        self.places = np.concatenate(places or empty)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, names: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(test, places in the test, places in the text) of all shared seeds."""
        found = window_names(names, SEED)
        at = np.flatnonzero(self.maybe[(found >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return
        low = np.searchsorted(self.seeds, found[at], "left")
        many = np.searchsorted(self.seeds, found[at], "right") - low
        at, low, many = at[many > 0], low[many > 0], many[many > 0]
        if not len(at):
            return
        j = np.repeat(at, many)
        index = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        item, i = self.items[index], self.places[index]
        order = np.argsort(item, kind="stable")
        item, i, j = item[order], i[order], j[order]
        cuts = np.flatnonzero(np.diff(item)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(item)]):
            yield int(item[a]), i[a:b], j[a:b]


def tiles(i: np.ndarray, j: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from all seed matches (i, j) of ``width`` words.

    Returns (place in the test, place in the text, length), longest first, ties by
    place.  Runs of seeds on a diagonal are the maximal matches; one that marks have
    eaten into goes back as its unmarked pieces.
    """
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(j - i) != 0) | (np.diff(i) != 1)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(i))) + width - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(lengths, i[starts], j[starts])]
    heapq.heapify(heap)
    test, text, out = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [k for k in range(n) if a + k not in test and b + k not in text]
        if len(free) == n:
            out.append((a, b, n))
            test.update(range(a, a + n))
            text.update(range(b, b + n))
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= width:
                    heapq.heappush(heap, (start - k, a + free[start], b + free[start]))
                start = k
    return out


def leaks(names: np.ndarray, tests: Tests, coverage: float) -> list[dict]:
    """The tests of which this text holds at least ``coverage``; of the short ones all."""
    out = []
    for words, known in tests.short.items():
        own = np.unique(window_names(names, words))
        for name in own[np.isin(own, np.fromiter(known, np.uint64, len(known)))]:
            out += [{"item_id": item, "coverage": 1.0, "n_tiles": 1, "longest": words} for item in known[int(name)]]
    for item, i, j in tests.matches(names):
        total = len(tests.names[item])
        reach = np.zeros(total + 1, np.int64)             # words under any seed: an upper bound
        np.add.at(reach, i, 1)
        np.add.at(reach, i + SEED, -1)
        if np.count_nonzero(np.cumsum(reach[:total])) < coverage * total:
            continue
        found = tiles(i, j, SEED)
        covered = sum(n for _, _, n in found)
        if covered >= coverage * total:
            out.append({"item_id": tests.ids[item], "coverage": covered / total,
                        "n_tiles": len(found), "longest": max(n for _, _, n in found)})
    return out


def each_block(tests: DataFrame, id_col: str, text_col: str, one_pass: Callable) -> list[DataFrame]:
    """``one_pass`` of a broadcast of each block of at most about ``BLOCK_WORDS`` words and the
    result of the block before (None at first); of several blocks, each result is written
    and its block released before the next."""
    tests = columns(tests, item_id=id_col, text=text_col)
    total = tests.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    blocks, out = int(total // BLOCK_WORDS) + 1, []
    for b in range(blocks):
        rows = tests if blocks == 1 else tests.filter(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = tests.sparkSession.sparkContext.broadcast(
            Tests([(r["item_id"], r["text"]) for r in rows.toLocalIterator()]))
        found = one_pass(block, out[-1] if out else None)
        if blocks == 1:
            return [found]
        out.append(stored(found))
        block.destroy()
    return out


def contamination(docs: DataFrame, tests: DataFrame, coverage: float = COVERAGE,
                  id_col: str = "doc_id", text_col: str = "text",
                  test_id_col: str = "item_id", test_text_col: str = "text") -> DataFrame:
    """One row per document row and test that it leaks: doc_id, item_id, coverage (share
    of the test's words under tiles), n_tiles, longest (words of the longest tile).

    Null and empty texts leak nothing, null and empty tests are never leaked; a test of under
    ``SEED`` words is leaked where all its words stand in a row; of equally long matches the
    first in the test, then in the text, is marked first; repeated documents or tests give
    repeated rows; null ids stay null and ids may be of any type; an empty side gives an
    empty table; other columns are not read.  Very long texts are tiled whole, by one task.
    """
    docs = columns(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    test_kind = tests.schema[test_id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {test_kind}, coverage double, n_tiles int, longest int"
    item_type = to_arrow_type(tests.schema[test_id_col].dataType)

    def one_pass(block, _):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = PlainNames()
            for batch in batches:
                at, rows = [], []
                for k, text in enumerate(batch.column(1).cast(pa.binary())):
                    for row in leaks(names.array((text.as_py() or b"").split()), block.value, coverage):
                        at.append(k)
                        rows.append(row)
                if rows:
                    ids = batch.column(0).take(pa.array(at, pa.int64()))
                    cols = {c: [r[c] for r in rows] for c in rows[0]}
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(cols["item_id"], item_type), pa.array(cols["coverage"], pa.float64()),
                         pa.array(cols["n_tiles"], pa.int32()), pa.array(cols["longest"], pa.int32())],
                        ["doc_id", "item_id", "coverage", "n_tiles", "longest"])
        return docs.mapInArrow(find, schema)

    return reduce(DataFrame.unionByName, each_block(tests, test_id_col, test_text_col, one_pass))


def decontaminated(docs: DataFrame, tests: DataFrame, coverage: float = COVERAGE,
                   text_col: str = "text", test_id_col: str = "item_id",
                   test_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that leak no test.

    Null and empty texts stay; repeated rows are judged one by one; very long texts are
    tiled whole; without tests all rows stay; an empty table gives an empty table; clashing
    column names are kept.
    """
    at = docs.columns.index(text_col)

    def one_pass(block, before):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = PlainNames()
            for batch in batches:
                texts = batch.column(at).cast(pa.binary())
                yield batch.filter(pa.array(
                    [not leaks(names.array((t.as_py() or b"").split()), block.value, coverage)
                     for t in texts], pa.bool_()))
        return (docs if before is None else before).mapInArrow(keep, docs.schema)

    return each_block(tests, test_id_col, test_text_col, one_pass)[-1]
