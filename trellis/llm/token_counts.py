"""Token counts by a map-side two-tier lookup.

Tier 1 is a compact table of the corpus' frequent pre-tokens and their lengths in
tokens, broadcast to every task.  Tier 2 is a bounded cache in each worker, filled by
encoding the pre-tokens that tier 1 misses.  No pre-token is ever shuffled: the table
comes from one fixed-size heavy-hitter summary per task over *all* texts, and the
summaries (never the pre-tokens of a text) are merged in two levels.  The counts are
exact whatever the table holds; the table only decides what is looked up and what is
encoded.

A text goes whole to the tokenizer library when looking up pre-tokens could differ from
it: if it holds an added token's string, or a code point that this Python's Unicode
tables do not assign (the pattern engine and the library may class it differently).
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import columns

#: entries of tier 1, of a task's summary, and of a worker's cache; length limit of a cached key
FREQUENT, SUMMARY, CACHE, KEY_CHARS = 65_536, 32_768, 500_000, 64
MERGERS = 16


def _heavy(counts: Counter, keep: int) -> Counter:
    """Misra-Gries reduction: subtract the (keep+1)-th largest count, drop the rest."""
    if len(counts) <= keep:
        return counts
    cut = sorted(counts.values(), reverse=True)[keep]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def _pattern(text: str):
    import regex
    return regex.compile(text)


def _pack(counts: Counter) -> dict:
    keys = sorted(counts)
    return {"keys": keys, "counts": [counts[k] for k in keys]}


SUMMARY_SCHEMA = "part int, keys array<string>, counts array<bigint>"


def frequent_pretokens(docs: DataFrame, pattern: str, size: int = FREQUENT) -> list[str]:
    """The frequent pre-tokens of all texts: at most ``size`` reach the driver."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        find, counts = _pattern(pattern).findall, Counter()
        for batch in batches:
            for text in batch.column(0):
                value = text.as_py()
                if value:
                    counts.update(find(value))
                    if len(counts) > 8 * SUMMARY:
                        counts = _heavy(counts, SUMMARY)
        counts = _heavy(Counter({k: v for k, v in counts.items() if len(k) <= KEY_CHARS}), SUMMARY)
        packed = _pack(counts)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId() % MERGERS], pa.int32()),
            "keys": pa.array([packed["keys"]], pa.list_(pa.string())),
            "counts": pa.array([packed["counts"]], pa.list_(pa.int64()))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, Counter] = {}
        for batch in batches:
            for row in batch.to_pylist():
                total = parts.setdefault(row["part"], Counter())
                total.update(dict(zip(row["keys"], row["counts"])))
                if len(total) > 4 * size:
                    parts[row["part"]] = _heavy(total, size)
        for part, total in parts.items():
            packed = _pack(_heavy(total, size))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()),
                "keys": pa.array([packed["keys"]], pa.list_(pa.string())),
                "counts": pa.array([packed["counts"]], pa.list_(pa.int64()))})

    summaries = docs.select("text").mapInArrow(summarise, SUMMARY_SCHEMA)
    merged = summaries.repartition(MERGERS, "part").mapInArrow(merge, SUMMARY_SCHEMA)
    total: Counter = Counter()
    for row in merged.toLocalIterator():                # at most MERGERS rows of bounded size
        total.update(dict(zip(row["keys"], row["counts"])))
    top = sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))[:size]
    return [k for k, v in top if v > 1]


def load_tokenizer(path: str):
    """A plain tokenizer: no truncation, no padding, added tokens as its default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _lengths(tok, keys: list[str]) -> list[int]:
    return [len(e.ids) for e in tok.encode_batch_fast(keys, add_special_tokens=False)]


def compact_table(tok, keys: list[str]) -> tuple[str, bytes]:
    """Keys joined by NUL and one byte of length each; no key with a NUL or an unsure code
    point is taken, so that such pieces are always missed."""
    unsure = _unsure().search
    keys = [k for k in keys if "\0" not in k and not unsure(k)]
    pairs = [(k, n) for k, n in zip(keys, _lengths(tok, keys)) if n < 256]
    return "\0".join(k for k, _ in pairs), bytes(n for _, n in pairs)


def _unsure() -> re.Pattern:
    """Any code point without a category in this Python's Unicode tables."""
    spans, start = [], None
    for c in range(0x80, sys.maxunicode + 2):
        odd = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if odd and start is None:
            start = c
        elif not odd and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile("[" + "".join(spans) + "]")


class Counters:
    """Both tiers in one worker."""

    def __init__(self, path: str, pattern: str, table: tuple[str, bytes]):
        self.tok = load_tokenizer(path)
        self.find = _pattern(pattern).findall
        self.tier1 = dict(zip(table[0].split("\0"), table[1])) if table[1] else {}
        self.tier2: dict[str, int] = {}
        self.unsure = _unsure().search
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)").search

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int] = [0] * len(texts)
        missed: set[str] = set()
        waiting: list[tuple] = []
        first = self.tier1.get
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.special(text):
                out[i] = self.whole(text)
                continue
            pieces = self.find(text)
            lengths = list(map(first, pieces))
            if None not in lengths:
                out[i] = sum(lengths)
                continue
            rest = [p for p, n in zip(pieces, lengths) if n is None]
            out[i] = sum(filter(None, lengths))
            lengths = list(map(self.tier2.get, rest))
            if None not in lengths:
                out[i] += sum(lengths)
                continue
            missed.update(p for p, n in zip(rest, lengths) if n is None)
            waiting.append((i, text, out[i], rest))
            if len(missed) >= 50_000:
                self._fill(missed, waiting, out)
        self._fill(missed, waiting, out)
        return out

    def whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def _fill(self, missed: set[str], waiting: list[tuple], out: list[int]) -> None:
        """Encode what both tiers miss; a text with an unsure piece goes whole."""
        unsure = {p for p in missed if not p.isascii() and self.unsure(p)}
        keys = list(missed - unsure)
        known = self.tier2 | dict(zip(keys, _lengths(self.tok, keys)))
        for i, text, so_far, rest in waiting:
            lengths = list(map(known.get, rest))
            out[i] = self.whole(text) if None in lengths else so_far + sum(lengths)
        self.tier2 = known if len(known) <= CACHE else {k: known[k] for k in keys}
        for key in [k for k in keys if len(k) > KEY_CHARS]:
            del self.tier2[key]
        missed.clear()
        waiting.clear()


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text",
                 frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null; repeated rows
    are counted one by one; an empty table gives an empty table; other columns are not
    read.  Texts are encoded whole, however long.  ``pattern`` is the tokenizer's own
    pre-token pattern.
    """
    docs = columns(docs, doc_id=id_col, text=text_col)
    keys = frequent_pretokens(docs, pattern, frequent)
    table = docs.sparkSession.sparkContext.broadcast(
        compact_table(load_tokenizer(tokenizer_path), keys))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = None
        for batch in batches:
            counters = counters or Counters(tokenizer_path, pattern, table.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counters.count(batch.column(1).to_pylist()), pa.int64()),
                 pc.binary_length(batch.column(1)).cast(pa.int64()).fill_null(0)],
                ["doc_id", "n_tokens", "n_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.mapInArrow(count, f"doc_id {kind}, n_tokens bigint, n_bytes bigint")
            .select("doc_id", "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit")))
