"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins.  Training goes round the features in cycles; each step
fits a shallow tree to the current gradients of one feature's bins and adds it, shrunk,
to that feature's lookup table.  Then the pairs that explain most of what is left get
tables of their own, boosted in the same way over two cuts.  A score is the logistic
function of a sum of table entries, looked up for a whole batch at once.

Features come from the text alone.  The model is fitted on the driver on at most
``MAX_ROWS`` labelled rows (those with the smallest hash of their id); every document is
scored inside the scan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import WordNames, columns
from trellis.llm.fertility import SPACE, SYMBOLS, repeated_words

MAX_ROWS, THRESHOLD = 20_000, 0.7
BINS, PAIR_BINS, CYCLES, PAIR_CYCLES, PAIRS = 32, 8, 120, 60, 6
RATE, LEAF_ROWS, RIDGE = 0.1, 10, 1.0

FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share",
            "stop_share", "comma_share", "bang_share", "pipe_share", "high_byte_share",
            "distinct_share", "top_word_share", "repeat_share", "dup_line_share",
            "words_per_line", "longest_word")
UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
HIGH = bytes(range(128, 256))


def features(text: bytes, names: WordNames) -> list[float]:
    """The features of one text; all defined for empty texts."""
    words = text.split()
    n, size = len(words), max(1, len(text))

    def share(which: bytes) -> float:
        return (len(text) - len(text.translate(None, which))) / size

    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    chars = sum(map(len, words))
    some = max(1, n)
    return [np.log1p(n), chars / some, share(SYMBOLS), share(UPPER), share(DIGIT), share(b"."),
            share(b","), share(b"!"), share(b"|"), share(HIGH), len(counts) / some,
            max(counts.values(), default=0) / some, repeated_words(names.array(words)) / some,
            (len(lines) - len(set(lines))) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
            np.log1p(max(map(len, counts), default=0))]


@dataclass
class Model:
    """Intercept, cut points and lookup tables; scored by adding table entries."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_cuts[k], x[:, k], "right")
                  for k in {f for pair in self.pairs for f in pair}}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 cuts between distinct values, at quantiles of the distinct ones
    as well as of the rows, so that a rare large value gets a bin too."""
    values = np.unique(x)
    if len(values) < 2:
        return np.empty(0)
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) < bins:
        return middle
    by_row = np.quantile(x, np.linspace(0, 1, bins // 2 + 1)[1:-1])
    by_value = middle[np.linspace(0, len(middle) - 1, bins - len(by_row) - 1).astype(int)]
    return np.unique(np.concatenate([by_row, by_value]))


def _leaf(g, h):
    return g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def step(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of at most four leaves over ordered bins: the best cut, then the best cut
    on either side, each leaf with ``LEAF_ROWS`` rows.  Returns a value for each bin."""
    out = np.zeros(len(g))

    def cut(a: int, b: int) -> int | None:
        left = np.cumsum(n[a:b])[:-1]
        fits = (left >= LEAF_ROWS) & (n[a:b].sum() - left >= LEAF_ROWS)
        if not fits.any():
            return None
        gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        gt, ht = g[a:b].sum(), h[a:b].sum()
        gain = np.where(fits, _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht), -1.0)
        best = int(np.argmax(gain))
        return a + best + 1 if gain[best] > 1e-12 else None

    spans, done = [(0, len(g))], []
    for _ in range(2):
        deeper = []
        for a, b in spans:
            at = cut(a, b)
            if at is None:
                done.append((a, b))
            else:
                deeper += [(a, at), (at, b)]
        spans = deeper
    for a, b in spans + done:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def pair_step(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best pair of cuts, one on each axis, as four leaves; and its gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = len(g) - 1, len(g[0]) - 1
    if a < 1 or b < 1:
        return np.zeros_like(g), 0.0

    def quarters(C):
        ll = C[:-1, :-1]
        lr, rl = C[:-1, -1:] - ll, C[-1:, :-1] - ll
        return ll, lr, rl, C[-1, -1] - ll - lr - rl

    parts = list(zip(quarters(G), quarters(H)))
    gain = sum(_gain(p, q) for p, q in parts) - _gain(G[-1, -1], H[-1, -1])
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    (ll, lr, rl, rr) = [_leaf(p[i, j], q[i, j]) for p, q in parts]
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = ll, lr, rl, rr
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of logistic loss.  Without rows every score is 0.5; with one
    class only, every score is that class's smoothed share."""
    n, width = x.shape
    rate = (y.sum() + 1) / (n + 2)
    start = float(np.log(rate / (1 - rate)))
    cuts = [cut_points(x[:, k], BINS) for k in range(width)]
    model = Model(start, cuts, [np.zeros(len(c) + 1) for c in cuts])
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    total = np.full(n, start)

    def gradients():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for k, (b, table) in enumerate(zip(bins, model.tables)):
            g, h = gradients()
            delta = RATE * step(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), sizes[k])
            table += delta
            total += delta[b]
    model.pair_cuts = [cut_points(x[:, k], PAIR_BINS) for k in range(width)]
    coarse = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(model.pair_cuts)]
    shape = [len(c) + 1 for c in model.pair_cuts]

    def grid(i, j, v):
        return np.bincount(coarse[i] * shape[j] + coarse[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = gradients()
    gains = sorted(((pair_step(grid(i, j, g), grid(i, j, h))[1], i, j)
                    for i in range(width) for j in range(i)), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(PAIR_CYCLES):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = gradients()
            delta = RATE * pair_step(grid(i, j, g), grid(i, j, h))[0]
            table += delta
            total += delta[coarse[i], coarse[j]]
    return model


def _features_of(column: pa.Array, names: WordNames) -> np.ndarray:
    rows = [features(t.as_py() or b"", names) for t in column.cast(pa.binary())]
    return np.array(rows, float).reshape(-1, len(FEATURES))


def held_out(id_col: str = "doc_id"):
    """Rows that never train: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled documents (doc_id, text) and (doc_id, label).

    Held-out ids, null ids and null labels are left out; several labels of one id count
    as their rounded mean.  At most ``max_rows`` ids, those with the smallest hash, are
    broadcast to pick their texts, and of these at most ``max_rows`` different rows, each
    once however often it is repeated; features, not texts, reach the driver.
    """
    picked = (labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = (docs.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text", F.xxhash64("text").alias("own"))
            .dropDuplicates(["doc_id", "own"]))
    ids = rows.select("doc_id", "own").orderBy(F.xxhash64("doc_id", "own"), "doc_id", "own").limit(max_rows)
    rows = rows.join(F.broadcast(ids), ["doc_id", "own"]).select("doc_id", "label", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            x = _features_of(batch.column(2), names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))],
                ["doc_id", "label", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(describe, f"doc_id {kind}, label int, x array<double>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"], r["x"]))
    x = np.array([r["x"] for r in found], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in found], float))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_id_col: str = "doc_id", label_col: str = "quality",
                   threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 at ``threshold``
    or more).

    Null texts score as empty ones; a null id is scored and counts as not held out;
    repeated rows are scored one by one; an empty table gives an empty table; without
    labels every score is 0.5; other columns are not read.
    """
    docs = columns(docs, doc_id=id_col, text=text_col)
    labels = columns(labels, doc_id=label_id_col, label=label_col)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            scores = model.value.score(_features_of(batch.column(1), names))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())],
                                             ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_id_col: str = "doc_id", label_col: str = "quality",
                   threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score ``threshold`` or more.

    Null texts score as empty ones, null ids as any other; repeated rows are judged one by
    one; very long texts are scored whole; without labels every score is 0.5; an empty
    table gives an empty table; clashing column names are kept.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(
        columns(docs, doc_id=id_col, text=text_col),
        columns(labels, doc_id=label_id_col, label=label_col), max_rows))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            good = model.value.score(_features_of(batch.column(at), names)) >= threshold
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
