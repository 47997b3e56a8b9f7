"""The trie of conversation prefixes by ROLLUP over positional columns of turn ids.

Each conversation is a row of ``WIDTH`` turn-id columns, and one ``GROUP BY ... ROLLUP``
over them aggregates all its prefixes at once; ``grouping_id`` tells a prefix's length.  A
longer conversation goes on in further rows of columns (blocks), each keyed by the name of
the node that the block before ended in, so all blocks take part in the same ROLLUP.  A
turn's id is 128 bits of its role and text, and its words; a node's name is the exclusive
or of its turns' ids mixed with their positions, so that names of all prefixes come from
running sums instead of one step a turn.

The first ROLLUP gives each node its owner, the smallest conversation below it.  The nodes
that one conversation owns are the lower end of its path, so all there is to know about a
conversation is where that end starts, how many words lie above it and whether it ends in a
leaf.  The second ROLLUP sums these over the members of each node: children, leaves and
saved words of the whole subtree need no walk over the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import WORD, columns, stored

#: turns of a block; blocks of a segment of running sums
WIDTH, SEGMENT = 8, 1024
#: conversations whose ids are joined into one row
PACK = 50_000


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, pos, a, b, words) for each turn, its 128-bit id and its position from
    0, and (conv_id, part, size) for each conversation.

    Turns are ordered by turn, null first, ties by the id.  Positions come from a sorted
    range partitioning, and offsets of the parts that a conversation lies in, so that a
    long conversation is not one task's.
    """
    turns = columns(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).filter("conv_id IS NOT NULL")
    turns = turns.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64("role", "text").alias("a"),
                       F.xxhash64("text", "role").alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    keys = ["conv_id", "turn", "a", "b", "row"]
    ranged = ids.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = stored(ranged.drop("turn", "row").withColumn("at", F.monotonically_increasing_id()))
    at = at.withColumn("part", F.shiftright("at", 33))
    whole = Window.partitionBy("conv_id")
    parts = (at.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
             .withColumn("size", F.sum("n").over(whole))
             .withColumn("offset", F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    rows = at.join(parts, ["conv_id", "part"])
    return (rows.select("conv_id", (F.col("at") - F.col("start") + F.col("offset")).alias("pos"), "a", "b", "words", "size"),
            parts.filter("offset = 0").select("conv_id", "size"))


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings, from those of :func:`ordered_turns`: the first h
    turns of conversation c - c % 20 (all if fewer, none if absent), then c's own turns
    after its first h, if any, for h = crc32(c) % 4.  ``convs`` keep all ids, turnless ones
    too."""
    h = F.crc32(F.col("conv_id").cast("string")) % 4
    base = F.col("conv_id") - F.col("conv_id") % 20
    heads = turns.filter("conv_id % 20 = 0 AND pos < 3").select(F.col("conv_id").alias("base"), "pos", "a", "b", "words")
    wanted = convs.select("conv_id", base.alias("base"), h.alias("h"))
    first = heads.join(wanted, "base").filter("pos < h").select("conv_id", "pos", "a", "b", "words")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    taken = (wanted.join(sizes, "base", "left")
             .select("conv_id", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken")))
    own = (turns.join(taken, "conv_id").filter("pos >= h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "words"))
    return first.unionByName(own), convs.select("conv_id")


def _names(pos: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """What a turn at a position adds to the name of a node."""
    return F.xxhash64(pos.cast("long"), a, b), F.xxhash64(b, pos.cast("long"), a)


def _blocks(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per conversation and block: (conv_id, block, ka, kb, before, t0, t1, ...,
    length), the name of and the words in what comes before the block, its turns, the turns
    of the conversation; and (conv_id, length, words, na, nb) per conversation."""
    na, nb = _names(F.col("pos"), F.col("a"), F.col("b"))
    cells = turns.select("conv_id", "a", "b", "words", na.alias("na"), nb.alias("nb"),
                         F.expr(f"pos div {WIDTH}").alias("block"), (F.col("pos") % WIDTH).alias("j"))
    here = [F.max(F.when(F.col("j") == j, F.col(c))).alias(f"{c}{j}") for j in range(WIDTH) for c in ("a", "b", "words")]
    sums = [F.bit_xor("na").alias("na"), F.bit_xor("nb").alias("nb"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("n")]
    rows = cells.groupBy("conv_id", "block").agg(*here, *sums).withColumn("seg", F.expr(f"block div {SEGMENT}"))

    def running(window):
        return {"ka": F.bit_xor("na").over(window), "kb": F.bit_xor("nb").over(window), "before": F.sum("words").over(window)}

    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    total = {"length": F.sum("n").over(whole), "all_words": F.sum("words").over(whole),
             "all_na": F.bit_xor("na").over(whole), "all_nb": F.bit_xor("nb").over(whole)}
    segs = (rows.groupBy("conv_id", "seg").agg(F.bit_xor("na").alias("na"), F.bit_xor("nb").alias("nb"),
                                               F.sum("words").alias("words"), F.sum("n").alias("n"))
            .withColumns(running(earlier)).withColumns(total))
    inner = Window.partitionBy("conv_id", "seg").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(running(inner)).join(
        segs.select("conv_id", "seg", "length", *[F.col(c).alias(f"{c}0_") for c in ("ka", "kb", "before")]), ["conv_id", "seg"])
    zero = F.lit(0).cast("long")
    turn = [F.when(F.col(f"a{j}").isNotNull(), F.struct(F.col(f"a{j}").alias("a"), F.col(f"b{j}").alias("b"),
                                                       F.col(f"words{j}").alias("w"))).alias(f"t{j}") for j in range(WIDTH)]
    blocks = rows.select(
        "conv_id", "block", *[F.coalesce(c, zero).bitwiseXOR(F.coalesce(f"{c}0_", zero)).alias(c) for c in ("ka", "kb")],
        (F.coalesce("before", zero) + F.coalesce("before0_", zero)).alias("before"), *turn, "length")
    ends = segs.filter("seg = 0").select("conv_id", "length", F.col("all_words").alias("words"),
                                         F.col("all_na").alias("na"), F.col("all_nb").alias("nb"))
    none = convs.distinct().join(ends, "conv_id", "left_anti")
    blocks = blocks.unionByName(none.select(
        "conv_id", *[zero.alias(c) for c in ("block", "ka", "kb", "before")],
        *[F.lit(None).cast(blocks.schema["t0"].dataType).alias(f"t{j}") for j in range(WIDTH)], zero.alias("length")))
    ends = ends.unionByName(none.select("conv_id", *[zero.alias(c) for c in ("length", "words", "na", "nb")]))
    return blocks, ends


def _rollup(blocks: DataFrame, aggregates: str) -> DataFrame:
    """``aggregates`` of every prefix of every conversation; in them ``{depth}`` is the
    node's depth and ``{above}`` the words before its last turn."""
    turns = ", ".join(f"t{j}" for j in range(WIDTH))
    level = f"cast({WIDTH} - bit_count(grouping_id()) AS long)"
    depth = f"({WIDTH} * block + {level})"
    above = "(before + " + " + ".join(f"if({level} > {j + 1}, coalesce(t{j}.w, 0), 0)" for j in range(WIDTH - 1)) + ")"
    # a prefix longer than the block's turns is no node; the empty prefix of a later block is
    # the last one of the block before
    node = f"if({level} = 0, block = 0, element_at(array({', '.join(f't{j} IS NOT NULL' for j in range(WIDTH))}), greatest(int({level}), 1)))"
    return blocks.sparkSession.sql(f"""
        SELECT block, ka, kb, before, {turns}, {level} AS level, {depth} AS depth, {aggregates.format(depth=depth, above=above)}
        FROM {{blocks}} GROUP BY block, ka, kb, before, ROLLUP({turns}) HAVING {node}""", blocks=blocks)


def _named(nodes: DataFrame) -> DataFrame:
    """``nodes`` of a ROLLUP with their names (na, nb), those of their parents (pa, pb) and
    the words above their last turn."""
    def name(side: int, upto: Column) -> Column:
        parts = [F.when(upto > j, F.coalesce(_names(F.col("block") * WIDTH + j, F.col(f"t{j}.a"), F.col(f"t{j}.b"))[side],
                                             F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")) for j in range(WIDTH)]
        return reduce(lambda x, y: x.bitwiseXOR(y), parts, F.col(("ka", "kb")[side]))

    level = F.col("level")
    above = reduce(lambda x, y: x + y, [F.when(level > j + 1, F.coalesce(f"t{j}.w", F.lit(0))).otherwise(F.lit(0))
                                        for j in range(WIDTH - 1)], F.col("before"))
    return nodes.withColumns({"na": name(0, level), "nb": name(1, level), "pa": name(0, level - 1), "pb": name(1, level - 1),
                              "above": above})


def _digests(ends: DataFrame) -> DataFrame:
    """(first, sha256) of the ids of conversations that are equal, for two or more of them;
    ``first`` is the smallest.

    Ids are sorted over all tasks and joined into rows of up to ``PACK``; one pass over
    these rows updates the digest, so no task holds the ids of one group.
    """
    same = ["length", "na", "nb"]
    groups = (ends.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
              .filter("n > 1").drop("n"))
    members = ends.join(groups, same).select("first", "conv_id").repartitionByRange("first", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, out = None, [], []

        def row():
            return {"first": at, "least": ids[0], "ids": ",".join(map(str, ids))}

        for batch in batches:
            for first, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (first != at or len(ids) >= PACK):
                    out.append(row())
                    ids = []
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, PACKED)
                        out = []
                at = first
                ids.append(conv)
        if ids:
            out.append(row())
        yield pa.RecordBatch.from_pylist(out, PACKED)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for first, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if first == at:
                    state.update(b",")
                else:
                    if state:
                        out.append({"first": at, "sha256": state.hexdigest()})
                    at, state = first, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist(out, DIGESTED)
        if state:
            yield pa.RecordBatch.from_pylist([{"first": at, "sha256": state.hexdigest()}], DIGESTED)

    packed = members.sortWithinPartitions("first", "conv_id").mapInArrow(pack, "first bigint, least bigint, ids string")
    return (packed.repartition("first").sortWithinPartitions("first", "least")
            .mapInArrow(digest, "first bigint, sha256 string"))


PACKED = pa.schema([("first", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])
DIGESTED = pa.schema([("first", pa.int64()), ("sha256", pa.string())])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of all conversations.

    ``turns``: (conv_id, pos, a, b, words), positions from 0 without gaps, as by
    :func:`ordered_turns`; ``convs``: (conv_id), turnless ones too.  Columns: conv_id (the
    smallest conversation below the node), depth, parent_conv_id (its parent's conv_id,
    null at the root), n_convs, n_children, n_leaves, saved_tokens (over its subtree, the
    words of each node's turn times the conversations below it but one) and ends_sha256 (of
    the ids of the conversations that end in it).  (conv_id, depth) is unique.

    Rows without conv_id are left out; null roles and texts are empty ones; turns without a
    number come first, equal numbers in the order of a hash of role and text; a repeated
    row is one more turn; long texts and conversations need no memory of their own; an
    empty table gives an empty table; other columns are not read.
    """
    blocks, ends = _blocks(turns, convs)
    blocks, ends = stored(blocks), stored(ends)
    nodes = stored(_named(_rollup(blocks, "min(conv_id) AS conv_id, max(length) = {depth} AS leaf"))
                   .select("depth", "na", "nb", "pa", "pb", "above", "conv_id", "leaf"))
    owned = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("start"), F.min_by("above", "depth").alias("above"), F.min_by("pa", "depth").alias("pa"),
        F.min_by("pb", "depth").alias("pb"), F.max(F.col("leaf").cast("int")).alias("leaf"))
    above = nodes.select((F.col("depth") + 1).alias("start"), F.col("na").alias("pa"), F.col("nb").alias("pb"),
                         F.col("conv_id").alias("parent"))
    owned = owned.join(above, ["start", "pa", "pb"], "left").select("conv_id", "start", "above", "leaf", "parent")
    facts = ends.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("start", F.col("length") + 1).alias("start"), F.coalesce("above", "words").alias("shared"),
        F.coalesce("leaf", F.lit(0)).alias("leaf"), "parent")
    rows = _rollup(blocks.join(facts, "conv_id"), """
        min(conv_id) AS conv_id, count(*) AS n_convs,
        max(CASE WHEN start < {depth} THEN conv_id WHEN start = {depth} THEN parent END) AS parent_conv_id,
        count_if(start <= {depth} + 1 AND length > {depth}) AS n_children, sum(cast(leaf AS long)) AS n_leaves,
        coalesce(sum(CASE WHEN start > {depth} THEN shared - {above} END), 0) AS saved_tokens,
        count_if(length = {depth}) AS n_ends, min(CASE WHEN length = {depth} THEN conv_id END) AS first_end""")
    rows = rows.withColumn("first", F.coalesce("first_end", "conv_id"))
    one = F.sha2(F.when(F.col("n_ends") == 0, F.lit("")).otherwise(F.col("first_end").cast("string")).cast("binary"), 256)
    return (rows.join(_digests(ends), "first", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.when(F.col("n_ends") > 1, F.col("sha256")).otherwise(one).alias("ends_sha256")))
