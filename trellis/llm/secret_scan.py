"""Secret scans with DataFrame functions only.

Base kinds are patterns.  The method adds ``entropy`` spans: candidate strings are runs
of at least ``WINDOW`` characters of the base64 alphabet; a window of that width slides
over each, and its Shannon entropy is kept by incremental counts: a step only looks at
how often the leaving and the entering character stand in the window.  Windows at or
above the limit of the candidate's character class are joined into spans.  Candidates
on the allow-list, or behind a context on it, are suppressed.

Everything happens inside the row, so nothing is shuffled.  Running sums over a row's
matches go in blocks, so that a text with very many of them stays cheap.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import columns, fresh

#: fixed patterns of the base kinds, in the order of the kinds
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_CHARS = 6

WINDOW, BLOCK = 20, 64
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: (characters of the whole candidate, least entropy in bits); the first that fits counts.
#: Limits follow what random strings of a class reach in their best window: those of 20
#: characters lie above them in about 0.8 of cases, those of 32 in 0.95 or more
CLASSES = ((r"[0-9]+", 2.8), (r"[0-9a-f]+|[0-9A-F]+", 3.0), (r"[A-Z]?[a-z]+|[A-Z]+", 3.55),
           (r"[A-Za-z]+", 3.8), (r"[A-Za-z0-9]+", 3.6), (r".+", 3.7))
#: never secrets: placeholders, UUIDs, alphabets, one character or pair again and again, rules
ALLOWED = (r"(?i).*(example|placeholder|changeme|your[_-]?(key|token|secret)).*",
           r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}",
           r"(?i).*(abcdefghijklm|nopqrstuvwxyz|0123456789abcdef|1234567890123456).*",
           r"(.{1,2})\1{9,}.?", r"[=_/+-]+")
#: what stands right before a candidate that is a digest or embedded data, no secret
ALLOWED_BEFORE = r"(?i)(sha(1|224|256|384|512)[:=-]|md5[:=]|base64,|integrity=[\"']?)$"

SPAN = "struct<start:bigint,ord:int,end:bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def blocks_of(n: Column) -> Column:
    """0, 1, ... one number for each started block of ``BLOCK`` of ``n`` entries."""
    return F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int"))) \
        .otherwise(F.array().cast("array<int>"))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running ``op`` (sum, maximum) of an array of bigint, block by block."""
    zero = F.lit(0).cast("bigint")

    def scan(a: Column) -> Column:
        totals = F.transform(blocks_of(F.size(a)),
                             lambda b: F.aggregate(F.slice(a, b * BLOCK + 1, F.lit(BLOCK)), zero, op))
        return let(totals, lambda t: F.flatten(F.transform(t, lambda _, b: let(
            F.aggregate(F.slice(t, F.lit(1), b), zero, op), lambda before: let(
                F.slice(a, b * BLOCK + 1, F.lit(BLOCK)), lambda own: F.transform(
                    own, lambda _, j: F.aggregate(F.slice(own, F.lit(1), j + 1), before, op)))))))

    return let(values, scan)


def total(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as (start, match, before): where each starts
    in code points, its text, and the text between it and the match before it."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                    F.split(text, pattern, -1).alias("g"))

    def place(s: Column) -> Column:
        steps = F.transform(s["m"], lambda _, i: (
            F.length(F.get(s["g"], i))
            + F.when(i > 0, F.length(F.get(s["m"], i - 1))).otherwise(0)).cast("bigint"))
        return let(running(steps, total), lambda starts: F.transform(s["m"], lambda m, i: F.struct(
            F.get(starts, i).alias("start"), m.alias("match"), F.get(s["g"], i).alias("before"))))

    return let(both, place)


def span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.lit(kind).alias("ord"),
                    end.cast("bigint").alias("end")).cast(SPAN)


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def base_spans(text: Column, kind: int, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    hits = found(text, pattern)
    if keep is not None:
        hits = F.filter(hits, keep)
    spans = F.transform(hits, lambda h: span(h["start"], kind, h["start"] + F.length(h["match"])))
    return F.when(text.rlike(pattern), spans).otherwise(no_spans())


def hot_windows(chars: Column, most: Column) -> Column:
    """Starts of the windows whose sum of c * log2(c) over their characters' counts c is
    at most ``most``: high entropy is a low sum.  Counted afresh at each block's start,
    then kept by what leaves and what enters."""
    cost = F.array(*[F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 2)])

    def count(window: Column, char: Column) -> Column:
        return F.size(F.filter(window, lambda x: x == char))

    def afresh(window: Column) -> Column:
        return F.aggregate(F.array_distinct(window), F.lit(0.0),
                           lambda s, x: s + F.get(cost, count(window, x)))

    def change(window: Column, out: Column, into: Column) -> Column:
        return F.when(out == into, F.lit(0.0)).otherwise(let(
            F.struct(count(window, out).alias("o"), count(window, into).alias("i")), lambda c: (
                F.get(cost, c["o"] - 1) - F.get(cost, c["o"])
                + F.get(cost, c["i"] + 1) - F.get(cost, c["i"]))))

    def window_at(j: Column) -> Column:
        return F.slice(chars, j + 1, F.lit(WINDOW))

    windows = F.size(chars) - (WINDOW - 1)

    def block(b: Column) -> Column:
        first = b * BLOCK
        start = F.struct(afresh(window_at(first)).alias("sum"), F.array().cast("array<int>").alias("hot"))
        steps = F.sequence(first, F.least(first + (BLOCK - 1), windows - 1))
        return F.aggregate(steps, start, lambda s, j: F.struct(
            F.when(j + 1 < windows, s["sum"] + change(window_at(j), F.get(chars, j), F.get(chars, j + WINDOW)))
            .otherwise(s["sum"]).alias("sum"),
            F.when(s["sum"] <= most + 1e-9, F.concat(s["hot"], F.array(j))).otherwise(s["hot"]).alias("hot")),
            lambda s: s["hot"])

    return F.flatten(F.transform(blocks_of(windows), block))


def entropy_spans(text: Column) -> Column:
    def allowed(h: Column) -> Column:
        hits = [h["match"].rlike(f"^(?:{p})$") for p in ALLOWED]
        return reduce(Column.__or__, hits) | F.right(h["before"], F.lit(24)).rlike(ALLOWED_BEFORE)

    def most(h: Column) -> Column:
        """Upper limit of the sum for the candidate's class; null if it has no limit."""
        out = F.lit(None).cast("double")
        for chars, least in reversed(CLASSES):
            limit = F.lit(None if least is None else WINDOW * (log2(WINDOW) - least)).cast("double")
            out = F.when(h["match"].rlike(f"^(?:{chars})$"), limit).otherwise(out)
        return out

    def joined(h: Column) -> Column:
        """Overlapping or touching hot windows as one span."""
        def ends(w: Column) -> Column:
            last = F.size(w) - 1
            starts = F.filter(w, lambda x, i: (i == 0) | (x - F.get(w, i - 1) > WINDOW))
            stops = F.filter(w, lambda x, i: (i == last) | (F.get(w, i + 1) - x > WINDOW))
            return F.zip_with(starts, stops, lambda a, b: span(
                h["start"] + a, KINDS.index("entropy"), h["start"] + b + WINDOW))
        return let(hot_windows(h["chars"], h["most"]), ends)

    hits = F.transform(F.filter(found(text, CANDIDATE), lambda h: ~allowed(h)), lambda h: F.struct(
        h["start"].alias("start"), most(h).alias("most"), F.split(h["match"], "").alias("chars")))
    spans = F.flatten(F.transform(F.filter(hits, lambda h: h["most"].isNotNull()), joined))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(no_spans())


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(text: Column) -> dict[str, Column]:
    """One array of spans per kind."""
    return {
        "assign": base_spans(text, 0, ASSIGN, lambda h: F.length(
            F.regexp_extract(h["match"], ASSIGN, 2)) >= ASSIGN_CHARS),
        "access": base_spans(text, 1, ACCESS),
        "hex": base_spans(text, 2, HEX),
        "entropy": entropy_spans(text)}


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_entropy.  Spans are in code points, ends exclusive; entropy spans may overlap base
    ones.

    Null and empty texts have no spans; a null id stays null; repeated rows are scanned
    one by one; an empty table gives an empty table; other columns are not read.  Texts
    are scanned whole.
    """
    docs = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.select("doc_id", *[c.alias(k) for k, c in all_spans(F.col("text")).items()])
    base = F.concat("assign", "access", "hex")
    return docs.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat(base, F.col("entropy"))).alias("spans"),
        F.size("entropy").cast("bigint").alias("n_entropy"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with each stretch that spans cover replaced by ``mask``."""
    def cut(s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), larger)

        def stretches(r: Column) -> Column:
            first = F.filter(F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"))),
                             lambda x: (x["i"] == 0) | (x["start"] > F.get(r, x["i"] - 1)))
            return let(first, lambda f: F.transform(f, lambda x, k: F.struct(
                x["start"].alias("start"),
                F.get(r, F.coalesce(F.get(f, k + 1)["i"], F.size(s)) - 1).alias("end"))))
        return let(reach, stretches)

    def glue(b: Column) -> Column:
        chars, parts = b["chars"], b["parts"]
        piece = lambda a, z: F.array_join(F.slice(chars, (a + 1).cast("int"), F.greatest(
            (z - a).cast("int"), F.lit(0))), "")
        zero = F.lit(0).cast("bigint")
        return F.concat(
            F.array_join(F.transform(parts, lambda p, k: F.concat(
                piece(F.coalesce(F.get(parts, k - 1)["end"], zero), p["start"]), F.lit(mask))), ""),
            piece(F.element_at(parts, -1)["end"], F.size(chars).cast("bigint")))

    changed = let(F.struct(F.split(text, "").alias("chars"), let(F.array_sort(spans), cut).alias("parts")), glue)
    return F.when(F.size(spans) > 0, changed).otherwise(text)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None,
             mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret, base or entropy, replaced by ``mask``; all
    rows and columns stay, and ``length_col`` follows the new text where it changed.

    Null texts stay null and empty ones empty; touching spans become one mask; repeated
    rows and null ids are rows like any other; very long texts are scanned whole; an empty
    table gives an empty table; clashing column names are kept.
    """
    (spans,) = fresh(docs, "spans")
    text = F.col(f"`{text_col}`")
    marked = docs.withColumn(spans, F.concat(*all_spans(F.coalesce(text, F.lit(""))).values()))
    hit = F.size(F.col(f"`{spans}`")) > 0
    out = [F.when(hit, masked(text, F.col(f"`{spans}`"), mask)).otherwise(text).alias(c) if c == text_col
           else F.col(f"`{c}`") for c in docs.columns]
    done = marked.select(*out, F.col(f"`{spans}`"))
    if length_col is not None and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        done = done.withColumn(length_col, F.when(hit, F.length(text).cast(kind)).otherwise(F.col(f"`{length_col}`")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])
