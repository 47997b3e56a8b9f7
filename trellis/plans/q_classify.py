"""Registered queries: preprocessing operators and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.operators import features as FE
from trellis.operators import metrics as M
from trellis.operators import splits as S
from trellis.operators import summary as U
from trellis.plans.registry import query, rounded
from trellis.plans.sqlbits import TEST_CUT, h32, r6, seeded, v
from trellis.session import table

# ------------------------------------------------------------ F1 standardize

STANDARDIZE_SQL = f"""
WITH r AS (
  SELECT p_partkey, p_retailprice, p_size,
         CASE WHEN {seeded(h32(v('p_partkey')), '42')} < {TEST_CUT} THEN 'test' ELSE 'train' END
           AS role
  FROM part),
s AS (SELECT avg(p_retailprice) AS m1, stddev_pop(p_retailprice) AS s1,
             avg(CAST(p_size AS DOUBLE)) AS m2, stddev_pop(CAST(p_size AS DOUBLE)) AS s2
      FROM r WHERE role = 'train')
SELECT p_partkey, role,
       {r6('(p_retailprice - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1.0 END', 'z_p_retailprice')},
       {r6('(p_size - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1.0 END', 'z_p_size')}
FROM r CROSS JOIN s
"""


@query("standardize", STANDARDIZE_SQL)
def standardize(spark, sf_dir):
    """population-deviation scaling fitted on train rows, applied to all."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    r = S.holdout(S.add_key_hash(part, "p_partkey"), "key_hash", 0.2, 42)
    z = FE.standardize(r, ["p_retailprice", "p_size"], r.where(F.col("role") == "train"))
    return rounded(z.select("p_partkey", "role", "z_p_retailprice", "z_p_size"))


# ------------------------------------------------------------ F2 one-hot, unseen levels

TRAIN_END = "2024-01-03"

ONE_HOT_SQL = f"""
WITH tr AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS level FROM events
            WHERE ts < TIMESTAMP '{TRAIN_END}'),
a AS (SELECT CAST(user_id AS VARCHAR) AS level, count(*) AS n_rows FROM events GROUP BY 1)
SELECT a.level, CASE WHEN tr.level IS NOT NULL THEN 1 ELSE 0 END AS seen, n_rows,
       CASE WHEN tr.level IS NOT NULL THEN n_rows ELSE 0 END AS n_hot
FROM a LEFT JOIN tr ON a.level = tr.level
"""


@query("one_hot_unseen", ONE_HOT_SQL)
def one_hot_unseen(spark, sf_dir):
    """one-hot fitted on early events as a table of levels and slots; levels first
    seen later have no slot.  Per level: seen in training, rows, rows with its slot set."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("level"), "ts")
    train = ev.where(F.col("ts") < F.lit(TRAIN_END).cast("timestamp_ntz"))
    # rows are summed per level before they meet the dictionary, so a frequent level is one row
    per = ev.groupBy("level").agg(F.count(F.lit(1)).alias("n_rows"))
    hot = FE.hot_slots(per, "level", FE.level_slots(train, "level"))
    seen = F.col("slot").isNotNull()
    return hot.select("level", seen.cast("int").alias("seen"), "n_rows",
                      F.when(seen, F.col("n_rows")).otherwise(0).alias("n_hot"))


# ------------------------------------------------------------ F5 equal-width bins

BINS_SQL = f"""
WITH mm AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier),
b AS (SELECT s_suppkey, s_acctbal,
             CASE WHEN (hi - lo) / 3.0 > 0
                  THEN LEAST(GREATEST(CAST(ceil((s_acctbal - lo) / ((hi - lo) / 3.0)) AS BIGINT), 1), 3)
                  ELSE 1 END AS bin
      FROM supplier CROSS JOIN mm)
SELECT s_suppkey, {r6('s_acctbal', 's_acctbal')}, bin,
       CASE bin WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS bin_label
FROM b
"""


@query("equal_width_bins", BINS_SQL)
def equal_width_bins(spark, sf_dir):
    """three equal-width bins of supplier balance labelled low/medium/high."""
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    out = FE.equal_width_bins(sup, "s_acctbal", 3, ["low", "medium", "high"])
    return rounded(out.select("s_suppkey", "s_acctbal", "bin", "bin_label"))


# ------------------------------------------------------------ P4 recode

RECODE_SQL = """
SELECT o_orderstatus,
       CAST(CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 END AS DOUBLE)
       AS code, count(*) AS n_rows
FROM orders GROUP BY 1, 2
"""


@query("label_recode", RECODE_SQL)
def label_recode(spark, sf_dir):
    """Map status F -> 0, O -> 1; unlisted values become null."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus")
    # double, so a null code reads the same (NaN / None) in every client
    return o.withColumn("code", U.recode("o_orderstatus", {"F": 0, "O": 1}).cast("double")).groupBy(
        "o_orderstatus", "code").agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------------ E4-E8 classification

_DOC_SQL = """
j AS (SELECT d.lang, CAST(d.n_chars AS DOUBLE) AS n_chars, l.quality AS label
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
m AS (
  SELECT lang, label, 'length_logit' AS model,
         1.0 / (1.0 + exp(-(ln(n_chars + 1.0) - 7.5))) AS probability FROM j
  UNION ALL
  SELECT lang, label, 'all_negative', 0.0 FROM j),
p AS (SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction,
             LEAST(GREATEST(probability, 1e-15), 1.0 - 1e-15) AS pc FROM m)
"""

CLASS_SQL = f"""
WITH {_DOC_SQL}
SELECT lang, model, count(*) AS n,
       {r6('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)', 'accuracy')},
       {r6('''CASE WHEN 2 * sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)
                  + sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END)
                  + sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) > 0
             THEN 2.0 * sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)
                  / (2 * sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)
                     + sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END)
                     + sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END))
             ELSE 0.0 END''', 'f1')},
       {r6('avg((probability - label) * (probability - label))', 'brier')},
       {r6('-avg(label * ln(pc) + (1 - label) * ln(1 - pc))', 'logloss')}
FROM p GROUP BY lang, model
"""


def doc_predictions(spark, sf_dir):
    """(lang, label, model, probability, prediction) of two fixed scoring rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    j = docs.join(labels, "doc_id").select("lang", "label",
                                           F.col("n_chars").cast("double").alias("n_chars"))
    logit = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.log(F.col("n_chars") + 1.0) - 7.5)))
    m = j.select("lang", "label", F.inline(F.array(
        F.struct(F.lit("length_logit").alias("model"), logit.alias("probability")),
        F.struct(F.lit("all_negative").alias("model"), F.lit(0.0).alias("probability")))))
    return m.withColumn("prediction", F.when(F.col("probability") >= 0.5, 1).otherwise(0))


@query("classification_metrics", CLASS_SQL)
def classification_metrics(spark, sf_dir):
    """Accuracy, F1 (0 when undefined), Brier and log loss by
    language for a length-based score and an all-negative rule."""
    p = doc_predictions(spark, sf_dir)
    return rounded(M.classification_metrics(p, ["lang", "model"]).select(
        "lang", "model", "n", "accuracy", "f1", "brier", "logloss"))


AUC_SQL = """
WITH j AS (SELECT d.lang, CAST(d.n_chars AS DOUBLE) AS s, l.quality AS y
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
rk AS (SELECT lang, s, y, rank() OVER (PARTITION BY lang ORDER BY s) AS r,
              count(*) OVER (PARTITION BY lang, s) AS t FROM j),
ar AS (SELECT lang, y, r + (t - 1) / 2.0 AS avg_rank FROM rk)
SELECT lang, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos,
       (round(CAST((sum(CASE WHEN y = 1 THEN avg_rank ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
        / (sum(y) * (count(*) - sum(y))) AS DOUBLE), 6) + 0.0) AS roc_auc
FROM ar GROUP BY lang
"""


@query("roc_auc", AUC_SQL)
def roc_auc(spark, sf_dir):
    """Exact tie-averaged ROC AUC of document length for quality, by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = docs.join(labels, "doc_id")
    auc = M.roc_auc(j, ["lang"], label="quality", score="n_chars")
    cnt = j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"),
                                F.sum("quality").cast("bigint").alias("n_pos"))
    return rounded(cnt.join(auc, "lang"))


# ------------------------------------------------------------ F2, F6 dictionary of levels

LEVELS_SQL = f"""
WITH n AS (SELECT CAST(user_id AS VARCHAR) AS level, count(*) AS n FROM events
           WHERE ts < TIMESTAMP '{TRAIN_END}' AND user_id IS NOT NULL GROUP BY 1)
SELECT level, n, row_number() OVER (ORDER BY n DESC, level) - 1 AS slot,
       'user_id_' || level AS feature FROM n
"""


@query("level_slots", LEVELS_SQL)
def level_slots(spark, sf_dir):
    """The dictionary of a one-hot encoder: level, count, slot by falling count,
    and the encoded feature's name."""
    train = table(spark, sf_dir, "events").where(F.col("ts") < F.lit(TRAIN_END).cast("timestamp_ntz"))
    return FE.level_slots(train, "user_id").select("level", "n", "slot", F.concat(F.lit("user_id_"), "level").alias("feature"))
