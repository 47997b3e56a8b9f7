"""Mixing sources to target weights by entropy balancing.

Document rates r minimise their entropy distance from 1 under one constraint per source:
the words taken, sum of size * r, meet the source's target.  By the convex dual a rate is
exponentially tilted, r = min(cap, exp(lambda * size / mean size)), with one multiplier
for each source.  Newton steps find them: a step is one aggregate over the table of
(source, size, number of documents), whatever the number of documents, and a bracket
guards it.

Rates become whole copies without drifting off the target: going down the sizes of a
source, each size takes the copies nearest to what is due, with the rest carried on to
the next smaller size.  Within a size the documents with the smallest hashes take the
odd copies; documents with equal ids are told apart by a hash of the row, and equal rows by
a count of them, so targets hold whatever the ids, and reruns agree.

One row per source reaches the driver; more than ``MAX_SOURCES`` is an error.
"""

from __future__ import annotations

from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.common import WORD, columns, fresh, settle

WEIGHTS, CAP = (1.0, 2.0, 3.0), 3.0
MAX_SOURCES, MAX_STEPS, CLOSE = 100_000, 200, 1e-9
#: documents of a ranking cell, cells of a group at most, groups broadcast at most
CELL, CELLS, SMALL = 64, 4096, 200_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, cap: float = CAP) -> list[float]:
    """Targets of (source, size) pairs in code point order, null last.

    Weights repeat along the sources and share all words; a target stops at ``cap`` times
    its source's size and the excess is reshared by weight until none is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(n for _, n in sizes))
    while open_:
        share = left / sum(weight[i] for i in open_)
        over = {i for i in open_ if share * weight[i] > cap * sizes[i][1]}
        if not over:
            for i in open_:
                out[i] = share * weight[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i][1])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def _source_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcast table of one row per source (at most ``MAX_SOURCES``)."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def rate(cap: float) -> Column:
    return F.when(F.col("lambda") == inf, F.lit(cap)).otherwise(
        F.least(F.lit(cap), F.exp(F.least(F.col("lambda") * F.col("size") / F.col("mean"), F.lit(50.0)))))


def multipliers(hist: DataFrame, sources: list[dict], cap: float) -> list[float]:
    """lambda per source by guarded Newton steps on the dual, all sources in one job each."""
    spark = hist.sparkSession
    state = {}
    for src in sources:
        if src["size"] == 0 or src["target"] >= cap * src["size"] * (1 - 1e-12):
            state[src["s"]] = {"x": inf if src["size"] else 0.0, "done": True}
        elif src["target"] <= 0:
            state[src["s"]] = {"x": -inf, "done": True}
        else:
            state[src["s"]] = {"x": 0.0, "low": -inf, "high": inf, "done": False}
    by = {src["s"]: src for src in sources}
    for _ in range(MAX_STEPS):
        todo = [(s, float(v["x"]), float(by[s]["mean"])) for s, v in state.items() if not v["done"]]
        if not todo:
            break
        r = rate(cap)
        words = F.col("size") * F.col("n") * r
        found = (hist.join(_source_table(spark, todo, "s int, lambda double, mean double"), "s")
                 .groupBy("s", "lambda", "mean")
                 .agg(F.sum(words).alias("words"),
                      F.sum(F.when(r < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
                 .collect())
        for row in found:
            v, target = state[row["s"]], by[row["s"]]["target"]
            off = row["words"] - target
            if abs(off) <= CLOSE * target:
                v["done"] = True
                continue
            v["high" if off > 0 else "low"] = v["x"]
            step = v["x"] - off / row["slope"] if row["slope"] > 0 else inf
            if not v["low"] < step < v["high"]:
                if v["low"] == -inf:
                    step = v["x"] - max(1.0, 2 * abs(v["x"]))
                elif v["high"] == inf:
                    step = v["x"] + max(1.0, 2 * abs(v["x"]))
                else:
                    step = (v["low"] + v["high"]) / 2
            if v["high"] - v["low"] <= 1e-13 * max(1.0, abs(v["x"])):
                v["done"] = True
            v["x"] = step
    else:
        raise ArithmeticError("entropy balancing did not converge")
    # twelve digits, so that the order of summation cannot show in the copies
    return [float(f"{state[src['s']]['x']:.12g}") for src in sources]


def copies(cap: float):
    """Copies of each size of one source, largest first, the rest carried on."""
    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        carry, whole, extra = 0.0, [], []
        for size, n, r in zip(pdf["size"], pdf["n"], pdf["rate"]):
            due = n * size * r + carry
            number = min(int(cap) * n, max(0, round(due / size))) if size else n
            carry = due - number * size
            whole.append(number // n)
            extra.append(number % n)
        return pd.DataFrame({"s": pdf["s"], "size": pdf["size"], "n": pdf["n"], "rate": pdf["rate"],
                             "whole": whole, "extra": extra})
    return share


def order_key() -> Column:
    return F.struct(F.xxhash64("doc_id", "own_row", "copy").alias("hash"), F.col("doc_id").alias("id"),
                    F.col("own_row").alias("own_row"), F.col("copy").alias("copy"))


def numbered(docs: DataFrame, id_col: str, row_col: str, copy_col: str) -> DataFrame:
    """``docs`` with a hash of the row and, for rows that are there several times, a number
    from 1; equal rows are counted before they are numbered, so a hot one is no task's."""
    marked = docs.withColumn(row_col, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    again = marked.groupBy(F.col(f"`{id_col}`"), F.col(f"`{row_col}`")).count().filter("count > 1")
    if again.isEmpty():
        return marked.withColumn(copy_col, F.lit(1).cast("bigint"))
    counted = marked.groupBy(*[F.col(f"`{c}`") for c in marked.columns]).agg(F.count(F.lit(1)).alias(copy_col))
    return counted.withColumn(copy_col, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"`{copy_col}`"))))


def cuts(base: DataFrame, groups: DataFrame) -> DataFrame:
    """(s, size, whole, rate, cut): in each group the documents whose key is at most
    ``cut`` take one copy more.  Groups are ranked in cells of about ``CELL`` documents:
    cell counts place a cell in its group, so no group is sorted by one task."""
    odd = groups.filter(F.col("extra") > 0)
    keyed = (base.join(odd, ["s", "size"])
             .withColumn("cells", F.greatest(F.lit(1), F.least(F.lit(CELLS), (F.col("n") / CELL).cast("int"))))
             .withColumn("key", order_key()))
    # cells follow the order of the hash: its high bits
    keyed = keyed.withColumn("cell", F.floor(
        (F.shiftrightunsigned("key.hash", 33).bitwiseXOR(F.lit(1 << 30))) * F.col("cells") / F.lit(float(1 << 31))))
    counts = keyed.groupBy("s", "size", "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    before = counts.withColumn("before", F.sum("in_cell").over(
        Window.partitionBy("s", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("s", "size", "cell").orderBy("key"))
    cut = (keyed.withColumn("rank", rank).join(before, ["s", "size", "cell"])
           .filter(F.col("rank") + F.coalesce("before", F.lit(0)) == F.col("extra"))
           .select("s", "size", F.col("key").alias("cut")))
    return groups.join(cut, ["s", "size"], "left").drop("n", "extra")


def mix_plan(sized: DataFrame, weights=WEIGHTS, cap: float = CAP):
    """From (doc_id, source, size, own_row, copy): the table of sources (s, source, source_size, target)
    and the table of groups (s, size, whole, rate, cut)."""
    spark = sized.sparkSession
    hist = settle(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    rows = (hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"),
                                       F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n"))
            .limit(MAX_SOURCES + 1).collect())
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([(r["source"], r["size"]) for r in rows], weights, cap)
    sources = [{"s": i, "source": r["source"], "size": r["size"], "target": t,
                "mean": r["size"] / r["n"] if r["n"] else 1.0} for i, (r, t) in enumerate(zip(rows, wanted))]
    kind = sized.schema["source"].dataType.simpleString()
    known = _source_table(spark, [(v["s"], v["source"], v["size"], v["target"]) for v in sources],
                          f"s int, source {kind}, source_size bigint, target double")
    named = hist.withColumnRenamed("source", "own").join(
        known, F.col("own").eqNullSafe(F.col("source"))).select("s", "size", "n")
    found = multipliers(named, sources, cap)
    tilt = _source_table(spark, [(v["s"], x, v["mean"]) for v, x in zip(sources, found)],
                         "s int, lambda double, mean double")
    groups = settle(named.join(tilt, "s").select("s", "size", "n", rate(cap).alias("rate"))
                    .groupBy("s").applyInPandas(
                        copies(cap), "s int, size bigint, n bigint, rate double, whole bigint, extra bigint"))
    base = sized.withColumnRenamed("source", "own").join(
        known, F.col("own").eqNullSafe(F.col("source"))).select("s", "size", "doc_id", "own_row", "copy")
    planned = settle(cuts(base, groups))
    return known, F.broadcast(planned) if planned.count() <= SMALL else planned


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def taken_copies() -> Column:
    return (F.col("whole") + F.when(F.col("cut").isNotNull() & (order_key() <= F.col("cut")), 1)
            .otherwise(0)).cast("bigint")


def source_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source, rate,
    copies.

    Null and empty texts have size 0 and take nothing; a null source is a source of its
    own, the last; a null id is ranked as any other; documents with equal ids, and equal
    rows, take copies one by one; very long texts are counted whole; an empty table gives an
    empty table; other columns are not read.
    """
    docs = numbered(columns(docs, doc_id=id_col, text=text_col, source=source_col), "doc_id", "own_row", "copy")
    sized = settle(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), "own_row", "copy"))
    known, groups = mix_plan(sized, weights, cap)
    return (sized.withColumnRenamed("source", "own")
            .join(known, F.col("own").eqNullSafe(F.col("source"))).join(groups, ["s", "size"])
            .select("doc_id", "size", "source_size", "target", (F.col("size") * taken_copies()).alias("taken"),
                    "source", "rate", taken_copies().alias("copies")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns as they are, and ``copies``:
    how often each is taken (named ``copies_`` if that name is in use).

    Null, empty and very long texts, null and equal ids, equal rows and sources are as in
    :func:`source_mix`; rows that take nothing go; an empty table gives an empty table;
    clashing column names are kept.
    """
    name, own_row, copy = fresh(docs, "copies", "own_row", "copy")
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = numbered(docs, id_col, own_row, copy)
    packed = marked.select(whole_row.alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                           F.col(f"`{source_col}`").alias("own"), size_of(F.col(f"`{text_col}`")).alias("size"),
                           F.col(f"`{own_row}`").alias("own_row"), F.col(f"`{copy}`").alias("copy"))
    sized = settle(packed.select("doc_id", F.col("own").alias("source"), "size", "own_row", "copy"))
    known, groups = mix_plan(sized, weights, cap)
    return (packed.join(known, F.col("own").eqNullSafe(F.col("source"))).join(groups, ["s", "size"])
            .select("row.*", taken_copies().alias(name)).filter(F.col(name) > 0))
