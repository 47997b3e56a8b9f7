"""Near duplicates by ProbMinHash over weighted shingles.

A text is the bag of its runs of ``SHINGLE`` words, weighted by how often they occur.
Each shingle is a Poisson process whose rate is its weight: its arrivals fall on random
components of the sketch, and a component keeps the shingle that arrives first.  A
shingle stops as soon as its next arrival is later than every component's first one.
Two sketches agree in a component with probability equal to the probability Jaccard of
the weighted bags.

Bands of the sketch give candidate pairs, and for a text whose shingles repeat also the
bands of a second sketch, without weights; a text without repeats has one sketch for both,
so all bands share their keys.  Candidates are taken as stars: one text of a band's bucket
against the others: first the smallest, which gathers most of each class, then in buckets
that hold several classes the one that lies in most of them, which of many near copies is
the nearest to what they are copies of.  Candidates are screened by their
whole sketches, of which a row keeps a byte for each component, and those left verified on
all their shingles: a link is a probability Jaccard or a plain Jaccard of ``SIMILAR`` or
more.

What is left are texts in buckets of several classes.  Their links are found by an exact
join: with each text's shingles ordered from rare to frequent, two texts can be as similar
only if they share one of their first shingles (as many as leave less than ``SIMILAR`` of
the text), at places that leave enough in common after them.  It finds all links between
their classes, whatever the sketches say, and never pairs texts of one class, so groups of
many texts that are nearly similar enough cost about as many rows as they have links.
Classes are the connected components of the links, named by their smallest doc_id.

With 24 bands of 4 components a pair at similarity 0.8 shares no band in about 3 of a
million cases, and agrees in fewer than 56 components about as rarely; a link is missed
only where that happens and no other link joins the two classes.  Texts are told apart by a
128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import WordNames, columns, discard, fresh, mix, stored, window_names

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
COMPONENTS = BANDS * ROWS
#: share of the components that a candidate pair must agree in, as a part of the similarity
SCREEN = 56 / COMPONENTS / SIMILAR
#: shingles sketched at a time
CHUNK = 300_000
#: numbers of 64 bits in the picture of a text's shingles, one bit for each by its name
PICTURE = 16


def shingles(text: bytes, names: WordNames) -> np.ndarray:
    """Sorted names of all shingles, repeats included; a text of fewer words is one
    shingle, a text without words none."""
    words = names.array(text.split())
    found = window_names(words, min(SHINGLE, len(words))) if len(words) else np.empty(0, np.uint64)
    return np.sort(found)


def sketch(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """ProbMinHash of several bags at once: ``owners`` rows of component winners.

    ``elements`` of one owner are distinct.  Every owner has at least one.
    """
    first = np.full(owners * COMPONENTS, np.inf)
    winner = np.zeros(owners * COMPONENTS, np.uint64)
    latest = np.full(owners, np.inf)
    time = np.zeros(len(elements))
    left = np.arange(len(elements))
    turn = 0
    while len(left):
        turn += 1
        draw = mix(elements[left] + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        uniform = (draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        time[left] -= np.log1p(-uniform) / weights[left]
        place = (mix(draw ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(COMPONENTS)).astype(np.int64)
        slot = owner[left] * COMPONENTS + place
        np.minimum.at(first, slot, time[left])
        won = time[left] == first[slot]
        winner[slot[won]] = elements[left][won]
        touched = np.unique(owner[left])
        latest[touched] = first.reshape(owners, COMPONENTS)[touched].max(axis=1)
        left = left[time[left] < latest[owner[left]]]
    return winner.reshape(owners, COMPONENTS)


def band_keys(winners: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name for each band of each row."""
    keys = np.zeros((len(winners), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + winners[:, r::ROWS])
    return mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64))


def bags(texts: list[bytes], names: WordNames) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of the texts with words, their sketches, their sketches without weights),
    some texts at a time."""
    at, parts, counts, size = [], [], [], 0

    def flush():
        owner = np.repeat(np.arange(len(at)), [len(p) for p in parts])
        weighted = sketch(np.concatenate(parts), np.concatenate(counts).astype(float), owner, len(at))
        again = [k for k, c in enumerate(counts) if (c > 1).any()]
        plain = weighted
        if again:
            some = [parts[k] for k in again]
            owner = np.repeat(np.arange(len(again)), [len(p) for p in some])
            plain = weighted.copy()
            plain[again] = sketch(np.concatenate(some), np.ones(len(owner)), owner, len(again))
        return at, weighted, plain

    for k, text in enumerate(texts):
        found, times = np.unique(shingles(text, names), return_counts=True)
        if not len(found):
            continue
        at.append(k)
        parts.append(found)
        counts.append(times)
        size += len(found)
        if size >= CHUNK:
            yield flush()
            at, parts, counts, size = [], [], [], 0
    if at:
        yield flush()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of probability Jaccard and plain Jaccard of two sorted bags."""
    a, x = np.unique(a, return_counts=True)
    b, y = np.unique(b, return_counts=True)
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(a) + len(b) - len(both))
    if (x == 1).all() and (y == 1).all():
        return plain
    # sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i): by ratio x / y,
    # j at or above i's ratio count with x, those below with y
    xs, ys = x[ia].astype(float), y[ib].astype(float)
    order = np.argsort(xs / ys, kind="stable")
    xs, ys = xs[order], ys[order]
    above = np.cumsum(xs[::-1])[::-1] + (x.sum() - xs.sum())
    below = np.cumsum(ys) - ys + (y.sum() - ys.sum())
    return max(plain, float((1 / (above / xs + below / ys)).sum()))


def sketches(texts: DataFrame) -> DataFrame:
    """(doc_id, hash, text) to (doc_id, hash, keys, marks): band keys of both sketches, none
    without words, and a byte of each component of both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            values = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
            keys: list = [[] for _ in values]
            marks = [b""] * len(values)
            for at, weighted, plain in bags(values, names):
                found, low = band_keys(weighted).view(np.int64), np.hstack([weighted, plain]).astype(np.uint8)
                more = found if plain is weighted else band_keys(plain).view(np.int64)
                for j, k in enumerate(at):
                    same = np.array_equal(found[j], more[j])
                    keys[k], marks[k] = found[j] if same else np.union1d(found[j], more[j]), low[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["doc_id", "hash", "keys", "marks"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, hash binary, keys array<bigint>, marks binary")


def screened(pairs: DataFrame, marked: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs`` (center, node, ...) that may be similar by ``marked`` (node,
    marks) of both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 2, COMPONENTS)
                    for c in ("marks_a", "marks_b"))
            near = (a == b).sum(axis=2).max(axis=1) >= round(SCREEN * least * COMPONENTS)
            yield batch.select(names).filter(pa.array(near, pa.bool_()))

    names = pairs.columns
    ends = pairs
    for end, mark in (("node", "marks_b"), ("center", "marks_a")):
        ends = ends.join(marked.select(F.col("node").alias(end), F.col("marks").alias(mark)), end)
    return ends.select(*names, "marks_a", "marks_b").mapInArrow(run, pairs.schema)


def with_shingles(texts: DataFrame) -> DataFrame:
    """(node, text) to (node, bag): all shingles as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for batch in batches:
            found = [shingles(t.as_py() or b"", names).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "bag"])

    return texts.mapInArrow(run, "node bigint, bag binary")


def verified(pairs: DataFrame, shingled: DataFrame, least: float) -> DataFrame:
    """The pairs (center, node) whose similarity is at least ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similarity(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) >= least
                  for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return (pairs.join(shingled.withColumnRenamed("bag", "bag_b"), "node")
            .join(shingled.select(F.col("node").alias("center"), F.col("bag").alias("bag_a")), "center")
            .select("center", "node", "bag_a", "bag_b")
            .mapInArrow(run, "center bigint, node bigint"))


def stars(members: DataFrame) -> DataFrame:
    """(key, center): the smallest node of each bucket that holds two or more."""
    return (members.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("far"))
            .filter(F.col("center") < F.col("far")).drop("far"))


def links(base: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame | None:
    """Verified pairs (center, node) of different texts, enough to connect each class.

    ``base`` has (doc_id, hash, node, keys, marks), ``texts`` (doc_id, hash, text).
    """
    # copies go before the join on the bucket, which a frequent bucket would leave to one task
    members = base.select("node", F.explode("keys").alias("key")).distinct()
    members = stored(members.join(stars(members), "key").select("key", "center", "node"))
    needed = stored(members.select("node").distinct())
    if needed.isEmpty():
        return None
    marked = stored(base.select("node", "marks").join(needed, "node", "left_semi").dropDuplicates(["node"]))
    owners = (base.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("hash").alias("hash"))
              .join(needed, "node", "left_semi"))
    picked = texts.join(owners, (texts["hash"] == owners["hash"]) & texts["doc_id"].eqNullSafe(owners["doc_id"]))
    shingled = with_shingles(picked.select("node", "text"))
    shingled = stored(shingled.dropDuplicates(["node"]) if _repeats(base) else shingled)
    met = stored(screened(members.filter("node != center").select("center", "node").distinct(), marked, least))
    found = stored(verified(met, shingled, least))
    labels = components(found)
    open_ = _open(members.select("key", "node").join(labels, "node", "left")
                  .select("key", "node", F.coalesce("label", "node").alias("label")))
    discard(members, needed)
    if not open_.isEmpty():
        pairs = stored(screened(hub_stars(open_), marked, least).join(met, ["center", "node"], "left_anti"))
        more = stored(verified(pairs.select("center", "node"), shingled, least))
        met, found = met.unionByName(pairs.select("center", "node")), found.unionByName(more)
        open_ = _joined(open_, pairs.join(more, ["center", "node"]).select("a", "b"))
    if not open_.isEmpty():
        pairs = stored(prefix_pairs(open_.select("node", "label").distinct(), shingled, least)
                       .join(met, ["center", "node"], "left_anti"))
        found = found.unionByName(stored(verified(pairs, shingled, least)))
        discard(pairs)
    found = stored(found)
    discard(marked, shingled, open_)
    return found


def _open(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (key, node, label) in buckets of several labels."""
    classes = members.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b")
    return stored(members.join(classes.select("key"), "key", "left_semi"))


def _joined(open_: DataFrame, same: DataFrame) -> DataFrame:
    """``open_`` after the labels of ``same`` (a, b) became one, without buckets of one
    label."""
    if same.isEmpty():
        return open_
    now = components(same.select(F.col("a").alias("center"), F.col("b").alias("node")))
    after = _open(open_.join(now.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left")
                  .select("key", "node", F.coalesce("now", "label").alias("label")))
    discard(open_, now)
    return after


def hub_stars(open_: DataFrame) -> DataFrame:
    """Pairs (center, node, a, b: their labels) of the text of each bucket of ``open_`` (key,
    node, label) that lies in most of its buckets with those of other labels."""
    often = F.count(F.lit(1)).over(Window.partitionBy("node"))             # of its band keys
    centers = (open_.withColumn("often", often).groupBy("key")
               .agg(F.max_by(F.struct("node", "label"), F.struct("often", "node")).alias("c"))
               .select("key", F.col("c.node").alias("center"), F.col("c.label").alias("center_label")))
    forward = F.col("center") < F.col("node")
    return (open_.join(centers, "key").filter("label != center_label")
            .select(F.least("center", "node").alias("center"), F.greatest("center", "node").alias("node"),
                    F.when(forward, F.col("center_label")).otherwise(F.col("label")).alias("a"),
                    F.when(forward, F.col("label")).otherwise(F.col("center_label")).alias("b"))
            .distinct())


def picture(names: np.ndarray) -> np.ndarray:
    """``PICTURE`` numbers whose bits are set where a name's last digits point."""
    bits = np.zeros(PICTURE * 64, np.uint8)
    bits[(mix(names) % np.uint64(PICTURE * 64)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def prefix_pairs(labelled: DataFrame, shingled: DataFrame, least: float) -> DataFrame:
    """Pairs (center, node) of ``labelled`` (node, label) with different labels that can be
    similar, by the order of their shingles: a superset of the links between them.

    For plain Jaccard shingles count one each, for the probability Jaccard by their share
    of the text, since that similarity is at most the sum of the smaller shares.  A shingle
    belongs to a text's prefix if it and those after it are ``least`` of the text; two
    similar texts share a prefix shingle.  What comes before the first such is in one text
    only: with the shares r and s from it on, either similarity is at most
    1 / (1 / r + 1 / s - 1).  The same holds for the shares r and s that are left without
    what only one of the two can hold: a bit of its picture (``PICTURE``) that the other's
    has not stands for one shingle or more of its own.  In the list of a shingle only texts
    that are not of its largest class look for partners.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, label, bag in zip(*(batch.column(c).to_pylist() for c in range(3))):
                found, times = np.unique(np.frombuffer(bag, np.uint64), return_counts=True)
                bits = picture(found)
                alone = lambda value: [value] + [None] * (len(found) - 1)  # noqa: E731  on one row of a text
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), node)), pa.array(np.full(len(found), label)),
                     pa.array(found.view(np.int64)), pa.array(times, pa.int64()), pa.array(alone(bits), pa.list_(pa.int64())),
                     pa.array(alone(int(np.bitwise_count(bits.view(np.uint64)).sum())), pa.int64())],
                    ["node", "label", "shingle", "times", "bits", "ones"])

    rows = labelled.join(shingled, "node").select("node", "label", "bag").mapInArrow(
        spread, "node bigint, label bigint, shingle bigint, times bigint, bits array<bigint>, ones bigint")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    whole = Window.partitionBy("node")
    # from the most frequent shingle back, so that what comes after one is a running sum
    back = whole.orderBy(F.desc("often"), F.desc("shingle"))
    after = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, total = F.count(F.lit(1)).over(whole), F.sum("times").over(whole)
    placed = rows.join(often, "shingle").select(
        "node", "label", "shingle", "often", n.alias("n"), total.alias("total"), F.max("bits").over(whole).alias("bits"),
        F.max("ones").over(whole).alias("ones"), F.row_number().over(back).alias("left"), (F.sum("times").over(after) / total).alias("rest"))
    near = least - 1e-9
    placed = (placed.withColumn("plain", F.col("left") >= near * F.col("n")).withColumn("massed", F.col("rest") >= near)
              .filter("often > 1 AND (plain OR massed)").drop("often"))
    placed = stored(placed)
    lists = placed.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("size"))
    lists = (lists.groupBy("shingle").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
             .filter("labels > 1").select("shingle", "main"))
    own = placed.join(lists, "shingle").filter("label != main").alias("x")
    need = near / (1 + near)

    both = reduce(add, [F.bit_count(F.col("x.bits")[k].bitwiseAND(F.col("y.bits")[k])) for k in range(PICTURE)])
    nx, ny, ox, oy = (F.col(c) for c in ("x.n", "y.n", "x.ones", "y.ones"))
    # least bits of both, so that what either may hold in common is enough: for the shares the
    # root of (x - ox + b) and (y - oy + b) put into the bound
    bits_plain = need * (nx + ny) + F.greatest(ox - nx, oy - ny)
    tx, ty, most = F.col("x.total"), F.col("y.total"), F.lit(1 + 1 / near)
    a, b = tx - ox, ty - oy
    half, rest = most * (a + b) - tx - ty, most * a * b - tx * b - ty * a
    bits_massed = (F.sqrt(F.greatest(half * half - 4 * most * rest, F.lit(0.0))) - half) / (2 * most)
    plain = F.col("x.plain") & F.col("y.plain") & (F.least("x.left", "y.left") >= need * (nx + ny))
    massed = F.col("x.massed") & F.col("y.massed") & (1 / F.col("x.rest") + 1 / F.col("y.rest") <= most)
    partners = ((F.col("x.label") != F.col("y.label"))
                & ((F.col("y.label") == F.col("x.main")) | (F.col("x.node") < F.col("y.node")))
                & (plain | massed)
                & (both + 1e-6 >= F.least(F.when(plain, bits_plain), F.when(massed, bits_massed))))
    out = stored(own.join(placed.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & partners)
                 .select(F.least("x.node", "y.node").alias("center"), F.greatest("x.node", "y.node").alias("node")).distinct())
    discard(placed)
    return out


def _repeats(base: DataFrame) -> bool:
    """Whether some row, id and text, occurs twice."""
    return not base.groupBy("doc_id", "node").count().filter("count > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (center, node) edges: the smallest node that it is
    connected with, by rounds of taking the neighbours' smallest label and then the
    label's own label, until nothing changes."""
    both = stored(edges.select(F.col("center").alias("a"), F.col("node").alias("b"))
                  .union(edges.select(F.col("node").alias("a"), F.col("center").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
                    .select(F.col("a").alias("node"), "label"))
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
                .select(F.col("a").alias("node"), "near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(lower.join(jump, "label", "left").select(
            "node", F.least("label", F.coalesce("next", "label")).alias("label"), "old"))
        discard(labels)
        labels = after
        if after.filter("label < old").isEmpty():
            discard(both)
            return after.select("node", "label")


def text_hash(text: str):
    """16 bytes that stand for a text; null texts are empty ones."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """Stored (doc_id, hash, has_words, class_id, class_hash) for each row of ``docs``."""
    texts = docs.select("doc_id", text_hash("text").alias("hash"), "text")
    rows = stored(sketches(texts))
    nodes = stored(rows.groupBy("hash").agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()))
    base = rows.join(nodes.select("hash", "node"), "hash")
    edges = links(base, texts, least)
    if edges is None:
        labelled = nodes.withColumn("label", F.col("node"))
    else:
        labelled = nodes.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stored(labelled)
    heads = labelled.groupBy("label").agg(
        F.min("first").alias("class_id"),
        F.coalesce(F.min_by("hash", F.when(F.col("first").isNotNull(), F.struct("first", "hash"))),
                   F.min("hash")).alias("class_hash"))       # all ids null: the smallest hash
    by_hash = labelled.join(heads, "label").select("hash", "class_id", "class_hash")
    out = stored(rows.select("doc_id", "hash", (F.size("keys") > 0).alias("has_words")).join(by_hash, "hash"))
    discard(rows, nodes, labelled)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    least: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest doc_id of its class) and
    kept (whether it is that document).

    Texts without words, null ones too, are linked with nothing: each is its own class.
    Equal texts are one class however many; a null id takes part but names no class with
    other ids in it; a very long text is sketched and verified whole, by one task; an empty
    table gives an empty table; other columns are not read.
    """
    rows = _classes(columns(docs, doc_id=id_col, text=text_col), least)
    class_id = F.when(F.col("has_words"), F.col("class_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", class_id.alias("class_id"),
                       (class_id.eqNullSafe(F.col("doc_id"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            least: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id (of equal ids the
    smallest text hash, of equal rows any), all columns as they are.

    Rows without words all stay, null texts too; null ids are kept only where their class
    has no other; an empty table gives an empty table; clashing column names are kept.
    """
    hash_, head_id, head_hash = fresh(docs, "hash", "head_id", "head_hash")
    rows = _classes(columns(docs, doc_id=id_col, text=text_col), least)
    heads = rows.filter(F.col("has_words") & F.col("doc_id").eqNullSafe(F.col("class_id"))
                        & (F.col("hash") == F.col("class_hash"))).select("doc_id", "hash")
    marked = docs.withColumn(hash_, text_hash(f"`{text_col}`"))
    wordless = ~F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keys = heads.distinct().select(F.col("doc_id").alias(head_id), F.col("hash").alias(head_hash))
    kept = marked.filter(~wordless).join(
        keys, (F.col(f"`{hash_}`") == F.col(f"`{head_hash}`"))
        & F.col(f"`{id_col}`").eqNullSafe(F.col(f"`{head_id}`")), "left_semi")
    if not heads.groupBy("doc_id", "hash").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([hash_])          # the same row more than once
    return kept.drop(hash_).unionByName(docs.filter(wordless))
