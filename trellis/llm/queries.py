"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trellis.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def load_all() -> tuple[dict, dict]:
    return dict(QUERIES), dict(ORACLES)


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level BPE vocabulary."""
    import public_tokenizers
    from trellis.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@_register
def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more, with the item."""
    from trellis.llm.tiling import contamination
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register
def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting rules and fertility bands over every document."""
    import public_tokenizers
    from trellis.llm.fertility import fertility_rules
    return fertility_rules(table(spark, sf_dir, "documents"),
                           public_tokenizers.path("piece_bpe_32k.model"))


@_register
def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the additive model with interactions."""
    from trellis.llm.gam import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base spans and high-entropy windows."""
    from trellis.llm.secret_scan import secret_scan
    return secret_scan(table(spark, sf_dir, "documents"))


@_register
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each document gives to the mix of sources."""
    from trellis.llm.mixing import source_mix
    return source_mix(table(spark, sf_dir, "documents"))


@_register
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    from trellis.llm.probminhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@_register
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the word windows that smaller documents hold."""
    from pyspark.sql import functions as F
    from trellis.llm.recompression import without_repeats
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: fixed rules of the page filter: host, path, verdict
PAGE_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
              ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@_register
def op2_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by rules and the standing of its host."""
    from trellis.llm.link_graph import url_verdicts
    return url_verdicts(table(spark, sf_dir, "pages"), PAGE_RULES)


@_register
def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns as linked calls, their results and other turns in canonical
    JSON; -1 and empty for what is null in the operator's result."""
    from trellis.llm.tool_calls import REPLY, calls_of, linked_calls
    calls, results, others = calls_of(table(spark, sf_dir, "conversations"))
    return (linked_calls(calls, results, REPLY, others).fillna(-1, ["turn", "step", "result_turn"])
            .fillna(False, ["valid"]).fillna("", ["call_id", "errors", "record"]))


@_register
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of each language."""
    from trellis.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"))


@_register
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations with shared openings."""
    from trellis.llm.prefix_trie import ordered_turns, prefix_trie, rebuilt
    return prefix_trie(*rebuilt(*ordered_turns(table(spark, sf_dir, "conversations"))))


@_register
def op13_suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 100 bytes that start earlier."""
    from pyspark.sql import functions as F
    from trellis.llm.suffix_order import without_repeated_bytes
    rows = without_repeated_bytes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), "n_spans",
                       F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op1_tool_calls"] = """
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::INT AS words
  FROM conversations),
u AS (SELECT *, conv_id || ':' || turn AS call_id, CASE WHEN turn >= 2 THEN conv_id || ':' || (turn - 2) END AS need
      FROM m WHERE role = 'user'),
a AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS call_id, text AS content FROM m WHERE role = 'assistant'),
g AS (SELECT conv_id, call_id, min(turn) AS result_turn, arg_min(content, turn) AS content, count(*) AS n_results
      FROM a GROUP BY ALL),
c AS (
  SELECT u.conv_id, u.call_id, u.turn, u.words, u.text, u.need, g.result_turn, g.content, coalesce(g.n_results, 0) AS n_results,
         concat_ws(',', CASE WHEN u.words > 500 THEN 'maximum:words' END, CASE WHEN u.words < 3 THEN 'minimum:words' END) AS errors,
         u.need IS NOT NULL AND n.call_id IS NULL AS unmet
  FROM u LEFT JOIN g USING (conv_id, call_id) LEFT JOIN u AS n ON n.conv_id = u.conv_id AND n.call_id = u.need)
SELECT conv_id, call_id, turn, 0 AS step,
       CASE WHEN unmet THEN 'missing_need' WHEN errors <> '' THEN 'invalid' WHEN n_results = 0 THEN 'no_result' ELSE 'ok' END AS status,
       coalesce(result_turn, -1) AS result_turn, n_results::BIGINT AS n_results, errors, errors = '' AS valid,
       '{"arguments":{"prompt":' || to_json(text)::VARCHAR || ',"words":' || words || '},"id":"' || call_id
         || '","name":"reply","needs":[' || coalesce('"' || need || '"', '') || '],"result":'
         || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS record
FROM c
UNION ALL
SELECT a.conv_id, a.call_id, turn, -1,
       CASE WHEN NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = a.conv_id AND u.call_id = a.call_id) THEN 'orphan_result'
            WHEN a.turn = g.result_turn AND a.content = g.content THEN 'result' ELSE 'extra_result' END,
       turn, 1, '', false, '{"content":' || to_json(a.content)::VARCHAR || ',"id":"' || a.call_id || '"}'
FROM a JOIN g ON g.conv_id = a.conv_id AND g.call_id = a.call_id
UNION ALL
SELECT conv_id, '', turn, -1, 'other_role', -1, 0, '', false,
       '{"content":' || to_json(text)::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
FROM m WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""

ORACLES["op8_substring_dedup"] = """
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS first_id FROM p GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM p JOIN f USING (k), (SELECT unnest(range(0, 13)) AS o) WHERE first_id < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES["op11_collocations"] = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, any_value(ws[i:i + k - 1]) AS ws, count(*) AS a
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
            FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k) GROUP BY ALL),
t AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= 100),
s AS (SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, n,
             (1000::HUGEINT * c.a::HUGEINT * n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c
      JOIN f AS x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(c.ws[1:j], ' ')
      JOIN f AS y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(c.ws[j + 1:], ' ')
      JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS d ON d.lang = c.lang AND d.k > c.k
         AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * d.a >= 100 * c.a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM b ANTI JOIN gone USING (lang, phrase))
WHERE rank <= 2000
"""

ORACLES["op12_prefix_trie"] = """
WITH o AS (SELECT conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(t ORDER BY pos) AS ts,
             xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
               lambda x: list_transform(range(0, 8), lambda k: ((ascii(x) >> k) & 1)::BIGINT)))),
               lambda r, b: xor(r >> 1, CASE WHEN xor(r, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 4 AS h
      FROM o GROUP BY conv_id),
s AS (SELECT c.conv_id, list_concat(coalesce(b.ts, [])[1:c.h], c.ts[c.h + 1:]) AS ts
      FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, unnest(range(0, len(ts) + 1)) AS d, ts, len(ts) AS size FROM s),
q AS (SELECT conv_id, d, size, ts[1:d] AS k,
             CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(ts[d].text, '[^\\x20\\x09-\\x0D]+')) END AS w FROM p),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, bool_and(size = d) AS leaf,
             string_agg(conv_id, ',' ORDER BY conv_id) FILTER (size = d) AS ends FROM q GROUP BY d, k),
path AS (SELECT q.conv_id, q.d, n.conv_id AS own FROM q JOIN n USING (d, k)),
up AS (SELECT n.conv_id, n.d, p.own AS parent FROM n LEFT JOIN path AS p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
sub AS (SELECT p.own AS conv_id, p.d, sum(leaf::INT) AS n_leaves, sum((n_convs - 1) * w) AS saved
        FROM n JOIN path AS p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY ALL)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n JOIN up USING (conv_id, d) JOIN sub USING (conv_id, d) LEFT JOIN kids USING (conv_id, d)
"""

ORACLES["op13_suffix_order"] = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5_number(x[2 * i + 1:2 * i + 200]) AS k
      FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM t WHERE len(x) >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span
      FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY ALL),
u AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
e AS (SELECT doc_id, a, z FROM s UNION ALL SELECT doc_id, len(x) // 2, 0 FROM t),
b AS (SELECT doc_id, coalesce(max(z) OVER (PARTITION BY doc_id ORDER BY a, z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z, a FROM e),
k AS (SELECT doc_id, string_agg(x[2 * b.z + 1:2 * a], '' ORDER BY a) AS kept FROM b JOIN t USING (doc_id) WHERE a > b.z GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN u USING (doc_id) LEFT JOIN k USING (doc_id)
"""
