"""URL filters: rules first, then propagation over the graph of hosts.

Rules are (host, path) prefixes; the longest that fits decides.  Where none fits, the
host's standing decides: trust is a personalised PageRank from hosts with allowed pages
along links; distrust is one from hosts with blocked pages along reversed links, as a
host that links to blocked ones is suspect.  A host whose distrust is above ``ratio``
times its trust is blocked.  Ranks are compared relative to their own size, however small.

Edges join the host of a page with the hosts that its absolute links name, and ``www.a.org``
with ``a.org``, both ways, as they are one site.  Other parent domains are no edges: the
sites under a public suffix have nothing to do with each other.  Edges are summed per pair
of hosts before anything else, so a host with a third of all pages is no larger than its
distinct links.  DataFrame functions only.

A step of the propagation is one join of ranks and edges and one sum.  The tables that go
from step to step are written in as many parts as their rows need (``PART_ROWS``), and the
ones before them removed, so a small graph takes few small files at any size of cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import columns, discard, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
DAMPING, CUT_EVERY, RATIO = 0.85, 8, 2.0
#: rules that become one expression; more are joined
MANY_RULES = 200
#: ranks are settled when none changes by more than this part of itself in ``CUT_EVERY``
#: steps; a host that rank reaches first in them changes by all of it.  After ``STEPS``
#: steps less than 1e-14 of any seed's rank is still on its way, and they end
TOLERANCE, STEPS = 1e-6, 200
#: rows of a part of the tables that go from step to step
PART_ROWS = 250_000
#: ranks are given to so many significant digits, and ratios nearer than that are ties
DIGITS = 10


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


FIT = "struct<size:int,rule:string,verdict:string>"


def ruling(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(size, rule, verdict) of the longest of a few rules that fits, null if none does."""
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            .cast(FIT) for h, p, v in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast(FIT)


def judged_by(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``pages`` (host, path, ...) with ``fit``, the longest of ``rules`` (host, path,
    verdict) that fits, null if none does.

    Many rules are joined, not tried: each distinct host and path gives its host's
    suffixes, and the beginnings of its path of the lengths that rules have.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        if len(rules) <= MANY_RULES:
            return pages.withColumn("fit", ruling(F.col("host"), F.col("path"), rules))
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    lengths = F.array_sort(F.array(*[F.lit(r[0]) for r in rules.select(F.length("rule_path")).distinct().collect()]))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = pages.filter("host != ''").select("host", "path").distinct()
    keys = urls.select("host", "path", F.explode(suffixes).alias("rule_host")).select(
        "host", "path", "rule_host", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("n"))
    keys = keys.select("host", "path", "rule_host", F.substr("path", F.lit(1), F.col("n")).alias("rule_path"))
    found = keys.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.concat("rule_host", "rule_path").alias("rule"), "verdict")).cast(FIT).alias("fit"))
    return pages.join(found, ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) from (host, html), without loops: links and ``www`` pairs."""
    own = pages.filter("host != ''")
    linked = F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1)),
        lambda h: F.translate(h, UPPER, LOWER)))
    links = (own.select("host", F.explode(linked).alias("dst")).filter("host != dst")
             .groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    hosts = own.select("host").distinct().union(links.select("dst")).distinct()
    bare = F.substr("host", F.lit(5))
    pairs = hosts.filter(F.startswith("host", F.lit("www.")) & bare.contains(".")).select("host", bare.alias("bare"))
    ends = F.array(F.struct(F.col("host").alias("src"), F.col("bare").alias("dst")),
                   F.struct(F.col("bare").alias("src"), F.col("host").alias("dst")))
    both = pairs.select(F.inline(ends)).withColumn("weight", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def in_parts(df: DataFrame, rows: int) -> DataFrame:
    """``df`` written in as many parts as about ``rows`` rows need."""
    return stored(df.coalesce(max(1, rows // PART_ROWS)))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(kind, host, rank): personalised PageRank for each ``kind`` of (kind, src, dst,
    weight) from (kind, host, seed), until no rank changes by more than ``TOLERANCE`` of
    itself, or after ``steps`` steps.  Rank that reaches a host without edges is not passed
    on."""
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    rows = edges.count()
    share = in_parts(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out")).alias("share")), rows)
    start = in_parts(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank")), seeds.count())
    ranks, before = seeds.select("kind", "host", F.col("seed").alias("rank")), None
    if not rows:
        return stored(start)
    for step in range(1, steps + 1):
        passed = (ranks.withColumnRenamed("host", "src").join(share, ["kind", "src"])
                  .select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank")))
        ranks = passed.unionByName(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % CUT_EVERY == 0 or step == steps:
            ranks = in_parts(ranks, rows)
            settled = before is not None and not _moved(before, ranks)
            if before is not None:
                discard(before)
            if settled:
                break
            before = ranks
    discard(share, start)
    return ranks


def _moved(before: DataFrame, after: DataFrame) -> bool:
    """Whether a rank changed by more than ``TOLERANCE`` of itself, or came in or went."""
    both = (before.withColumn("late", F.lit(0)).unionByName(after.withColumn("late", F.lit(1)))
            .groupBy("kind", "host").agg(*[F.sum(F.when(F.col("late") == k, F.col("rank")).otherwise(0.0)).alias(n)
                                           for k, n in enumerate(("a", "b"))]))
    return not both.filter(F.abs(F.col("b") - F.col("a")) > F.greatest("a", "b") * TOLERANCE).isEmpty()


def host_standing(pages: DataFrame, damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """(host, trust, distrust, blocked) of hosts that rank reaches, from (host, html,
    ruled) where ``ruled`` is the rule's verdict or null."""
    seeds = stored(pages.filter("host != '' and ruled is not null")
                   .groupBy(F.col("ruled").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n")))
    total = seeds.agg(F.sum("n")).first()[0] or 1          # of both kinds, so that ranks compare
    share = seeds.select("kind", "host", (F.col("n") / total).alias("seed"))
    edges = stored(host_edges(pages))
    forth = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight")
    back = edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    ranks = propagate(forth.unionByName(back), share, damping)
    # significant digits, not decimals: a share of a large table is small, and its ratio counts
    digits = lambda x: F.format_string(f"%.{DIGITS - 1}e", x).cast("double")
    rank = lambda kind: digits(F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)))
    out = stored(ranks.groupBy("host").agg(rank("allow").alias("trust"), rank("block").alias("distrust"))
                 .withColumn("blocked", F.col("distrust") > F.col("trust") * (ratio * (1 + 10.0 ** (1 - DIGITS)))))
    discard(seeds, edges, ranks)
    return out


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html", damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    ``rules``: (host, path, verdict), any number.  A null url or one without ``://`` has an
    empty host and path, fits no rule and is allowed; a null html has no links, a very long
    one is searched whole; a host that no rank reaches is allowed; a null id stays null;
    repeated rows are judged one by one and count as pages of their host; an empty table
    gives an empty table; other columns are not read.
    """
    pages = columns(pages, page_id=id_col, url=url_col, html=html_col)
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = judged_by(parsed, rules)
    standing = host_standing(judged.select("host", "html", F.col("fit.verdict").alias("ruled")), damping, ratio)
    own = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return judged.drop("html").join(standing, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"),
        "trust", "distrust")
