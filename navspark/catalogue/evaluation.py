"""Detector-evaluation queries: ``labels`` joined to ``documents``, and ``embeddings``.

A document stands for a recording: its language is the scenario, its quality flag the
label, and simple text measures are features and scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navspark.catalogue import Query, read, rounded
from navspark.operators.audit import subset_auc
from navspark.operators.intervals import PREVALENCES, base_rate_analysis, mcnemar_table
from navspark.operators.metrics import (
    confusion_metrics,
    contingency,
    precision_at_prevalence,
    roc_auc,
)
from navspark.operators.thresholds import DEFAULT_THRESHOLD, evaluate_thresholds, fpr_target_thresholds, max_f1_threshold

MEASURES = {
    "chars": "CAST(n_chars AS DOUBLE)",
    "words": "CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE)",
    "lines": "CASE WHEN n_chars < 200 THEN NULL ELSE CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) END",
    "digits": "CAST(length(text) - length(translate(text, '0123456789', '')) AS DOUBLE)",
    "fixed": "CAST(0 AS DOUBLE)",
}
SCORE = "n_chars / 20000e0"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: ``doc_id, lang, y, toxic, score`` and the measures."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.expr(SCORE).alias("score"), *[F.expr(sql).alias(c) for c, sql in MEASURES.items()]
    )
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), "toxic")
    return docs.join(labels, "doc_id")


DOCS_SQL = (
    f"docs AS (SELECT doc_id, lang, quality AS y, toxic, {SCORE} AS score, "
    + ", ".join(f"{sql} AS {c}" for c, sql in MEASURES.items())
    + " FROM documents JOIN labels USING (doc_id))"
)


def feature_auc_screen(spark, sf_dir):
    out = subset_auc(
        documents(spark, sf_dir), F.col("y"), F.array(F.lit("overall"), F.col("lang")), list(MEASURES)
    )
    return rounded(out, ["auc"], 9)


_AUC_TAIL = """
counts AS (SELECT feature, subset, value, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM subs GROUP BY ALL),
ranked AS (SELECT *, sum(neg) OVER (PARTITION BY feature, subset ORDER BY value) AS upto FROM counts),
auc AS (
  SELECT feature, subset, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 AND count(*) > 1
         THEN CAST(sum(pos * (upto - neg / 2)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS a
  FROM ranked GROUP BY feature, subset
)
SELECT feature, subset, round(CASE WHEN a IS NULL THEN NULL ELSE greatest(a, 1 - a) END, 9) AS auc FROM auc"""

AUC_SCREEN_SQL = f"""
WITH {DOCS_SQL},
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, lang, y, {c} AS v FROM docs" for c in MEASURES)}),
med AS (SELECT feature, coalesce(median(v), 0) AS m FROM long GROUP BY feature),
filled AS (SELECT feature, lang, y, coalesce(v, m) AS value FROM long JOIN med USING (feature)),
subs AS (SELECT feature, 'overall' AS subset, y, value FROM filled UNION ALL SELECT feature, lang, y, value FROM filled),
{_AUC_TAIL}"""


def embedding_auc_screen(spark, sf_dir):
    """AUC of each of the 64 dimensions for class 0 against the rest."""
    rows = read(spark, sf_dir, "embeddings")
    dims = [f"d{i:02d}" for i in range(64)]
    wide = rows.select(
        (F.col("label") == 0).cast("int").alias("y"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(d) for i, d in enumerate(dims)],
    )
    out = subset_auc(wide, F.col("y"), F.array(F.lit("overall")), dims)
    return rounded(out, ["auc"], 9)


EMBEDDING_AUC_SQL = f"""
WITH long AS (
  SELECT CAST(label = 0 AS INT) AS y, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings
),
subs AS (SELECT 'd' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, 'overall' AS subset, y, CAST(v AS DOUBLE) AS value FROM long),
{_AUC_TAIL}"""


def roc_auc_query(spark, sf_dir):
    return rounded(roc_auc(documents(spark, sf_dir), ["lang"]), ["auc"], 9)


ROC_AUC_SQL = f"""
WITH {DOCS_SQL},
counts AS (SELECT lang, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM docs GROUP BY ALL),
ranked AS (SELECT *, sum(neg) OVER (PARTITION BY lang ORDER BY score) AS upto FROM counts)
SELECT lang, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(pos * (upto - neg / 2)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) END, 9) AS auc
FROM ranked GROUP BY lang"""

_RATES = ["accuracy", "precision", "recall", "f1", "fpr"]
_RATES_SQL = """round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  round(fp / greatest(fp + tn, 1), 6) AS fpr"""
_COUNTS_SQL = """count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp"""


def confusion_metrics_query(spark, sf_dir):
    scored = documents(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.1).cast("int"))
    return rounded(confusion_metrics(scored, ["lang"]), _RATES)


CONFUSION_SQL = f"""
WITH {DOCS_SQL}, c AS (SELECT lang, {_COUNTS_SQL} FROM (SELECT *, CAST(score >= 0.1 AS INT) AS p FROM docs) GROUP BY lang)
SELECT lang, tn, fp, fn, tp, {_RATES_SQL} FROM c"""

TARGETS = [0.01, 0.05]


def threshold_fpr_target(spark, sf_dir):
    """Quantiles of the negatives' scores per scenario."""
    return rounded(fpr_target_thresholds(documents(spark, sf_dir), ["lang"], TARGETS).withColumnsRenamed(
        {"fpr_target_0.01": "t01", "fpr_target_0.05": "t05"}
    ), ["t01", "t05"], 9)


FPR_SQL = f"""
WITH {DOCS_SQL}
SELECT lang, round(quantile_cont(score, 0.99), 9) AS t01, round(quantile_cont(score, 0.95), 9) AS t05
FROM docs WHERE y = 0 GROUP BY lang"""


def threshold_max_f1(spark, sf_dir):
    return rounded(max_f1_threshold(documents(spark, sf_dir), ["lang"]), ["threshold"], 9)


_F1_SQL = """
c AS (SELECT lang, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM docs GROUP BY ALL),
r AS (SELECT lang, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY lang) AS p
      FROM c WINDOW w AS (PARTITION BY lang ORDER BY score DESC)),
f AS (SELECT lang, score, 2 * (tp / (tp + fp)) * (tp / p) / greatest(tp / (tp + fp) + tp / p, 1e-12) AS f1 FROM r WHERE p > 0),
best AS (SELECT lang, score FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, score) = 1)"""
MAX_F1_SQL = f"WITH {DOCS_SQL}, {_F1_SQL} SELECT lang, round(score, 9) AS threshold FROM best"


def policy_evaluation(spark, sf_dir):
    """Each policy's threshold from validation rows (toxic = 0), scored on the others (toxic = 1)."""
    docs = documents(spark, sf_dir)
    validation = docs.where("toxic = 0").select("score", "y")
    best, cuts = max_f1_threshold(validation, []).first(), fpr_target_thresholds(validation, [], TARGETS).first()
    chosen = {"default_0.5": DEFAULT_THRESHOLD, "val_max_f1": best["threshold"], **cuts.asDict()}
    return rounded(evaluate_thresholds(docs.where("toxic = 1"), chosen), ["threshold", *_RATES])


POLICY_SQL = f"""
WITH {DOCS_SQL}, val AS (SELECT * FROM docs WHERE toxic = 0),
c AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM val GROUP BY score),
r AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM c WINDOW w AS (ORDER BY score DESC)),
f AS (SELECT score, 2 * (tp / (tp + fp)) * (tp / p) / greatest(tp / (tp + fp) + tp / p, 1e-12) AS f1 FROM r),
pol AS (
  SELECT 'default_0.5' AS policy, 0.5 AS threshold
  UNION ALL SELECT 'val_max_f1', (SELECT score FROM f ORDER BY f1 DESC, score LIMIT 1)
  UNION ALL SELECT 'fpr_target_0.01', (SELECT quantile_cont(score, 0.99) FROM val WHERE y = 0)
  UNION ALL SELECT 'fpr_target_0.05', (SELECT quantile_cont(score, 0.95) FROM val WHERE y = 0)
),
k AS (SELECT policy, threshold, {_COUNTS_SQL} FROM (SELECT *, CAST(score >= threshold AS INT) AS p FROM docs CROSS JOIN pol WHERE toxic = 1) GROUP BY policy, threshold)
SELECT policy, round(threshold, 6) AS threshold, tn, fp, fn, tp, {_RATES_SQL} FROM k"""


def prevalence_table(spark, sf_dir):
    """Precision at assumed prevalences, point estimate per scenario."""
    scored = documents(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.1).cast("int"))
    m = confusion_metrics(scored, ["lang"])
    levels = m.withColumn("prevalence", F.explode(F.array(*[F.lit(p) for p in PREVALENCES])))
    tpr = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    fpr = F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn")))
    out = levels.select("lang", "prevalence", precision_at_prevalence(tpr, fpr, F.col("prevalence")).alias("precision"))
    return rounded(out, ["precision"], 9)


PREVALENCE_SQL = f"""
WITH {DOCS_SQL}, c AS (SELECT lang, {_COUNTS_SQL} FROM (SELECT *, CAST(score >= 0.1 AS INT) AS p FROM docs) GROUP BY lang),
r AS (SELECT lang, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS tpr, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END AS fpr FROM c),
l AS (SELECT CAST(unnest([0.5, 0.1, 0.01, 0.001, 0.0001]) AS DOUBLE) AS prevalence)
SELECT lang, prevalence, round(CASE WHEN tpr * prevalence + fpr * (1 - prevalence) > 0
       THEN tpr * prevalence / (tpr * prevalence + fpr * (1 - prevalence)) END, 9) AS precision
FROM r CROSS JOIN l"""


def clopper_pearson_query(spark, sf_dir):
    """Base-rate table with exact intervals per scenario."""
    scored = documents(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.1).cast("int"))
    table = base_rate_analysis(confusion_metrics(scored, ["lang"]), ["lang"])
    return rounded(table, [c for c in table.columns if c not in ("lang", "prevalence")], 9)


def _precision_sql(tpr: str, fpr: str) -> str:
    hits, alarms = f"{tpr} * prevalence", f"{fpr} * (1 - prevalence)"
    return f"round(CASE WHEN {hits} + {alarms} > 0 THEN {hits} / ({hits} + {alarms}) END, 9)"


# Ends of the intervals by halving: the binomial tail, summed term by term, is to be 0.025.
CLOPPER_PEARSON_SQL = f"""
WITH RECURSIVE {DOCS_SQL}, c AS (SELECT lang, {_COUNTS_SQL} FROM (SELECT *, CAST(score >= 0.1 AS INT) AS p FROM docs) GROUP BY lang),
pairs AS (SELECT lang, 'tpr' AS name, tp AS k, tp + fn AS n FROM c UNION ALL SELECT lang, 'fpr', fp, fp + tn FROM c),
search AS (
  SELECT lang, name, k, n, side, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, 0 AS step
  FROM pairs, (VALUES ('lo'), ('hi')) s(side) WHERE n > 0 AND CASE side WHEN 'lo' THEN k > 0 ELSE k < n END
  UNION ALL
  SELECT lang, name, k, n, side, CASE WHEN (side = 'lo') = (tail < 0.025) THEN mid ELSE low END, CASE WHEN (side = 'lo') = (tail < 0.025) THEN high ELSE mid END, step + 1
  FROM (
    SELECT *, list_sum(list_transform(CASE side WHEN 'lo' THEN range(k, n + 1) ELSE range(0, k + 1) END,
        lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(mid) + (n - i) * ln(1 - mid)))) AS tail
    FROM (SELECT *, (low + high) / 2 AS mid FROM search WHERE step < 60)
  )
),
ends AS (
  SELECT lang, name, CASE WHEN n > 0 THEN k / n END AS rate,
    CASE WHEN n > 0 THEN coalesce((SELECT (low + high) / 2 FROM search s WHERE step = 60 AND side = 'lo' AND s.lang = p.lang AND s.name = p.name), 0) END AS low,
    CASE WHEN n > 0 THEN coalesce((SELECT (low + high) / 2 FROM search s WHERE step = 60 AND side = 'hi' AND s.lang = p.lang AND s.name = p.name), 1) END AS high
  FROM pairs p
),
r AS (
  SELECT t.lang, t.rate AS tpr, f.rate AS fpr, t.low AS tl, t.high AS th, f.low AS fl, f.high AS fh
  FROM ends t JOIN ends f ON t.lang = f.lang AND t.name = 'tpr' AND f.name = 'fpr'
),
l AS (SELECT CAST(unnest([0.5, 0.1, 0.01, 0.001, 0.0001]) AS DOUBLE) AS prevalence)
SELECT lang, prevalence, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr, round(tl, 9) AS tpr_ci_lo, round(th, 9) AS tpr_ci_hi,
  round(fl, 9) AS fpr_ci_lo, round(fh, 9) AS fpr_ci_hi, {_precision_sql('tpr', 'fpr')} AS precision_at_prevalence,
  {_precision_sql('tl', 'fh')} AS precision_lo, {_precision_sql('th', 'fl')} AS precision_hi
FROM r CROSS JOIN l"""


def baseline_left_join(spark, sf_dir):
    """Every document with the external detector's verdict where there is a valid one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    verdicts = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("baseline_pred"))
    merged = docs.join(verdicts, "doc_id", "left")
    valid = F.coalesce(F.col("baseline_pred").isin(0, 1), F.lit(False))
    return merged.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_excluded"),
        F.count_if(F.col("baseline_pred") == 1).alias("n_flagged"),
    )


BASELINE_SQL = """
SELECT lang, count(*) AS n, count(*) FILTER (WHERE toxic IN (0, 1)) AS n_valid,
       count(*) FILTER (WHERE toxic IS NULL OR toxic NOT IN (0, 1)) AS n_excluded, count(*) FILTER (WHERE toxic = 1) AS n_flagged
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"""


def _contingency(spark, sf_dir):
    docs = documents(spark, sf_dir)
    first = (F.col("score") >= 0.1).cast("int") == F.col("y")
    second = (F.lit(1) - F.col("toxic")) == F.col("y")
    return contingency(docs, ["lang"], first, second)


CONTINGENCY_SQL = f"""
WITH {DOCS_SQL}, r AS (SELECT lang, CAST(score >= 0.1 AS INT) = y AS a, 1 - toxic = y AS b FROM docs)
SELECT lang, count(*) FILTER (WHERE a AND b) AS both_right, count(*) FILTER (WHERE a AND NOT b) AS only_first,
       count(*) FILTER (WHERE NOT a AND b) AS only_second, count(*) FILTER (WHERE NOT a AND NOT b) AS both_wrong
FROM r GROUP BY lang"""


def mcnemar(spark, sf_dir):
    return rounded(mcnemar_table(_contingency(spark, sf_dir)), ["p_value"], 9)


MCNEMAR_SQL = f"""
WITH t AS ({CONTINGENCY_SQL}),
d AS (SELECT *, least(only_first, only_second) AS fewer, only_first + only_second AS pairs FROM t),
z AS (SELECT *, abs(pairs - 2 * fewer - 1) / sqrt(2 * pairs) AS z FROM d)
SELECT lang, both_right, only_first, only_second, both_wrong, round(CASE
    WHEN pairs < 25 THEN least(1, 2 * list_sum(list_transform(range(0, fewer + 1), lambda i: exp(lgamma(pairs + 1) - lgamma(i + 1) - lgamma(pairs - i + 1)))) / pow(2, pairs))
    WHEN z < 2 THEN 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 60),
        lambda k: z * pow(2 * z * z, k) / exp(lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))
    ELSE exp(-z * z) / sqrt(pi()) / list_reduce(list_transform(range(150, 0, -1), lambda k: CAST(k AS DOUBLE)), lambda f, k: z + k / (2 * f), z)
  END, 9) AS p_value
FROM z"""


def vote_recall(spark, sf_dir):
    """Votes of three rules per document, then the share of positives outvoted per scenario."""
    docs = documents(spark, sf_dir).where("y = 1")
    votes = docs.withColumn(
        "vote", F.explode(F.array(*[(F.col("score") >= t).cast("int") for t in (0.05, 0.1, 0.3)]))
    )
    share = votes.groupBy("lang", "doc_id").agg(F.avg("vote").alias("share"))
    out = share.groupBy("lang").agg(F.avg((F.col("share") >= 0.5).cast("int")).alias("recall"))
    return rounded(out, ["recall"], 9)


VOTE_SQL = f"""
WITH {DOCS_SQL},
s AS (SELECT lang, doc_id, (CAST(score >= 0.05 AS INT) + CAST(score >= 0.1 AS INT) + CAST(score >= 0.3 AS INT)) / 3 AS share FROM docs WHERE y = 1)
SELECT lang, round(avg(CAST(share >= 0.5 AS INT)), 9) AS recall FROM s GROUP BY lang"""

QUERIES = {
    "feature_auc_screen": Query(feature_auc_screen, AUC_SCREEN_SQL),
    "embedding_auc_screen": Query(embedding_auc_screen, EMBEDDING_AUC_SQL),
    "roc_auc": Query(roc_auc_query, ROC_AUC_SQL),
    "confusion_metrics": Query(confusion_metrics_query, CONFUSION_SQL),
    "threshold_fpr_target": Query(threshold_fpr_target, FPR_SQL),
    "threshold_max_f1": Query(threshold_max_f1, MAX_F1_SQL),
    "policy_evaluation": Query(policy_evaluation, POLICY_SQL),
    "prevalence_table": Query(prevalence_table, PREVALENCE_SQL),
    "clopper_pearson": Query(clopper_pearson_query, CLOPPER_PEARSON_SQL),
    "baseline_left_join": Query(baseline_left_join, BASELINE_SQL),
    "contingency": Query(_contingency, CONTINGENCY_SQL),
    "mcnemar": Query(mcnemar, MCNEMAR_SQL),
    "vote_recall": Query(vote_recall, VOTE_SQL),
}
