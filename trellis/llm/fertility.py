"""Quality rules by tokeniser fertility.

A public subword vocabulary with byte fallback measures every text: characters per
token, the share of byte-fallback tokens, and the entropy of its tokens.  Each language
(where none is given, each script) has a band for each measure, taken from the quartiles
of all its documents of about the same length (the same power of two of words, as short
texts scatter more); texts outside a band are rejected.  Where these are too few, the
language's next lengths on both sides join them, up to all its lengths; only a language
with too few documents in all takes those of all languages, found in the same way.

Plain counting rules come first (``base_failed``); a text that fails them is not kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import WordNames, columns, settle, window_names

SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
WINDOW = 5
#: band: quartiles -/+ REACH times their distance; groups of fewer than ENOUGH documents
#: take in the next octaves of words, and a language of fewer in all the other languages; a
#: table of fewer documents in all has one band from them all
REACH, ENOUGH = 3.0, 50
#: rows of bands that are broadcast at most; more are joined by shuffle
SMALL = 10_000
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: least spread a band is built on, so that a measure that hardly varies rejects nothing
LEAST = {"chars_per_token": 0.02, "byte_share": 0.02, "token_entropy": 0.02}

#: one letter of a script decides when no language is given; first of these with most letters
SCRIPTS = (("latin", "A-Za-zÀ-ɏ"), ("greek", "Ͱ-Ͽ"), ("cyrillic", "Ѐ-ӿ"),
           ("hebrew", "֐-׿"), ("arabic", "؀-ۿ"), ("devanagari", "ऀ-ॿ"),
           ("thai", "฀-๿"), ("kana", "぀-ヿ"), ("han", "一-鿿"),
           ("hangul", "가-힯"))


class Pieces(dict):
    """Token ids of a word as int32 bytes; encoded once, forgotten when too many."""

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece
        super().__init__()
        self.model, self.limit = sentencepiece.SentencePieceProcessor(model_file=path), limit
        size = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(i) for i in range(size)), bool, size)

    def __missing__(self, word: bytes) -> bytes:
        ids = np.array(self.model.encode(word.decode("utf-8", "replace"), num_threads=1), np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids


def repeated_words(names: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    found = window_names(names, width)
    if not len(found):
        return 0
    order = np.argsort(found, kind="stable")
    same = found[order][1:] == found[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(names) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def base_counts(text: bytes, words: list[bytes], names: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return chars, symbols, len(lines) - len(set(lines)), repeated_words(names)


def entropy_share(ids: np.ndarray) -> float:
    """Entropy of the tokens over the most that so many tokens can have (1 if under 2)."""
    n = len(ids)
    if n < 2:
        return 1.0
    ids = np.sort(ids)
    edges = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    p = np.diff(np.append(edges, n)) / n
    return float(-(p * np.log2(p)).sum() / np.log2(n))


def script_of(text: str) -> str:
    counts = [(len(_SCRIPTS[name].findall(text)), name) for name, _ in SCRIPTS]
    most = max(n for n, _ in counts)
    return "script:" + (next(name for n, name in counts if n == most) if most else "none")


_SCRIPTS = {name: re.compile(f"[{span}]") for name, span in SCRIPTS}

MEASURED = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
            "n_repeat_words bigint, chars_per_token double, byte_share double, token_entropy double, "
            "band string")


def measures(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and all counts of (doc_id, text, lang), one row per row."""
    names = [c.split()[0] for c in MEASURED.split(", ")]
    kinds = dict(zip(names, [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.string()]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = hashes = None
        for batch in batches:
            if pieces is None:
                pieces, hashes = Pieces(model_path), WordNames()
            rows = []
            for text, lang in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                text, lang = text.as_py() or b"", lang.as_py()
                words = text.split()
                counts = base_counts(text, words, hashes.array(words))
                ids = np.frombuffer(b"".join(map(pieces.__getitem__, words)), np.int32)
                n = len(ids)
                rows.append((len(words), *counts, counts[0] / n if n else 0.0,
                             float(pieces.is_byte[ids].mean()) if n else 0.0, entropy_share(ids),
                             lang if lang is not None else script_of(text.decode("utf-8", "replace"))))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, kinds[k]) for c, k in zip(cols, names))],
                ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(measure, f"doc_id {kind}, {MEASURED}")


def sources(cells: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(octave, reach) of each language or script and octave of ``cells`` (band, octave, n),
    and whether it is ``pooled``: its band is built from the documents at most ``reach``
    octaves away, the fewest octaves that hold ``enough``, of the same language, or of all
    languages where its own has fewer in all."""
    own = cells.withColumn("total", F.sum("n").over(Window.partitionBy("band")))
    octaves = cells.groupBy("octave").agg(F.sum("n").alias("n"))

    def reach(wanted: DataFrame, given: DataFrame, by: list[str]) -> DataFrame:
        near = (wanted.join(given.withColumnRenamed("octave", "other"), by) if by
                else wanted.crossJoin(given.withColumnRenamed("octave", "other")))
        rings = near.groupBy(*by, "octave", F.abs(F.col("octave") - F.col("other")).alias("reach")).agg(
            F.sum("n").alias("n"))
        upto = Window.partitionBy(*by, "octave").orderBy("reach")
        held = rings.withColumn("held", F.sum("n").over(upto))
        return held.groupBy(*by, "octave").agg(
            F.coalesce(F.min(F.when(F.col("held") >= enough, F.col("reach"))), F.max("reach")).alias("reach"))

    alone = own.filter(F.col("total") >= enough)
    few = own.filter(F.col("total") < enough)
    return (reach(alone.select("band", "octave"), alone.select("band", "octave", "n"), ["band"])
            .withColumn("pooled", F.lit(False))
            .unionByName(few.select("band", "octave").join(reach(few.select("octave").distinct(), octaves, []), "octave")
                         .withColumn("pooled", F.lit(True))))


def bands(measured: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Quartiles of each measure for each language or script and octave of words that holds
    a document which passes the base rules; only such documents count."""
    good = measured.filter(~F.col("base_failed"))
    cells = settle(good.groupBy("band", "octave").agg(F.count(F.lit(1)).alias("n")))
    found = settle(sources(cells, enough))
    # which bands a document of each cell belongs to; pooled ones have no language
    own = cells.join(found.filter(~F.col("pooled")).withColumnRenamed("octave", "to"), "band").select(
        "band", "octave", "to", "reach", F.col("band").alias("for"))
    pooled = cells.crossJoin(found.filter("pooled").select(F.col("octave").alias("to"), "reach").distinct()).select(
        "band", "octave", "to", "reach", F.lit(None).cast("string").alias("for"))
    targets = settle(own.unionByName(pooled).filter(F.abs(F.col("octave") - F.col("to")) <= F.col("reach"))
                     .groupBy("band", "octave").agg(F.collect_list(F.struct("for", "to")).alias("targets")))
    if targets.count() <= SMALL:                     # languages times octaves: a small table
        targets = F.broadcast(targets)
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 2000).alias(m) for m in MEASURES]
    built = settle(good.join(targets, ["band", "octave"]).select(*MEASURES, F.explode("targets").alias("t"))
                   .groupBy("t.for", "t.to").agg(*quartiles))
    return (found.join(built, F.when(~F.col("pooled"), F.col("band")).eqNullSafe(F.col("for"))
                       & (F.col("octave") == F.col("to")))
            .select("band", "octave", *MEASURES))


def inside(measure: str, quartiles: Column) -> Column:
    q1, q3 = quartiles.getItem(0), quartiles.getItem(1)
    reach = F.greatest(q3 - q1, F.lit(LEAST[measure])) * REACH
    value = F.col(measure)
    if measure == "byte_share":                      # only too many byte tokens are bad
        return value <= q3 + reach
    if measure == "token_entropy":                   # only too few different tokens are bad
        return value >= q1 - reach
    return value.between(q1 - reach, q3 + reach)


def fertility_rules(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed, the three measures and
    ``kept`` (false if base_failed, else whether all measures lie in their bands).

    Null and empty texts have no words and fail the base rules; a null language is
    replaced by the text's main script; ties and repeated rows are measured one by one;
    an empty table gives an empty table; other columns are not read.  Every document that
    passes the base rules is judged by a band, however few there are.
    """
    picked = columns(docs, doc_id=id_col, text=text_col)
    if lang_col is not None and lang_col in docs.columns:
        picked = columns(docs, doc_id=id_col, text=text_col, lang=lang_col)
    else:
        picked = picked.withColumn("lang", F.lit(None).cast("string"))
    measured = settle(measures(picked, model_path).withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "octave": F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int")}))
    found = settle(bands(measured)).select("band", "octave", *[F.col(m).alias(f"band_{m}") for m in MEASURES])
    if found.count() <= SMALL:                       # languages times octaves: a small table
        found = F.broadcast(found)
    joined = measured.join(found, ["band", "octave"], "left")
    ok = None
    for m in MEASURES:
        one = inside(m, F.col(f"band_{m}"))
        ok = one if ok is None else ok & one
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & F.coalesce(ok, F.lit(False))).alias("kept"),
                         *MEASURES, "band")

