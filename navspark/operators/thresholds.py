"""Decision thresholds chosen without test labels, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from navspark.operators.metrics import confusion_counts, with_rates
from navspark.operators.ordered import exact_quantiles, running_totals

# Fixed value.
DEFAULT_THRESHOLD = 0.5


def max_f1_threshold(df: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Score whose ``score >= threshold`` rule has the highest F1; the lowest one on ties."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    # Counting downwards needs no group total: sort by the negated score.
    falling = counts.withColumn("_down", -F.col(score))
    upto = running_totals(falling, keys, "_down", ["pos", "neg"])
    tp, flagged = F.col("pos_upto").cast("double"), (F.col("pos_upto") + F.col("neg_upto")).cast("double")
    precision, recall = tp / flagged, tp / F.col("pos_total")
    f1 = precision * recall * 2.0 / F.greatest(precision + recall, F.lit(1e-12))
    scored = upto.where(F.col("pos_total") > 0).select(*keys, F.col(score).alias("_s"), f1.alias("_f1"))
    best = (scored.groupBy(*keys) if keys else scored.groupBy()).agg(
        F.max(F.struct("_f1", (-F.col("_s")).alias("_neg"))).alias("_best")
    )
    return best.select(*keys, (-F.col("_best._neg")).alias("threshold"))


def fpr_target_thresholds(
    df: DataFrame, keys: list[str], targets: list[float], score: str = "score", y: str = "y"
) -> DataFrame:
    """``(1 - target)`` quantile of the negatives' scores, one column ``fpr_target_<t>`` each."""
    negatives = df.where(F.col(y) == 0)
    probs = {policy_name(t): 1.0 - t for t in targets}
    return exact_quantiles(negatives, keys, score, probs)


def policy_name(target: float) -> str:
    return f"fpr_target_{target:g}"


def pick_threshold(df: DataFrame, policy: str = "fpr_target", target_fpr: float = 0.01,
                   score: str = "score", y: str = "y") -> float:
    """One threshold as a number, from validation rows ``score, y``."""
    if policy == "default":
        return DEFAULT_THRESHOLD
    if policy == "val_max_f1":
        row = max_f1_threshold(df, [], score, y).first()
        return float(row["threshold"])
    if policy == "fpr_target":
        row = fpr_target_thresholds(df, [], [target_fpr], score, y).first()
        value = row[policy_name(target_fpr)] if row else None
        return DEFAULT_THRESHOLD if value is None else float(value)
    raise ValueError(f"unknown policy {policy!r}")


def evaluate_thresholds(df: DataFrame, thresholds: dict[str, float], score: str = "score", y: str = "y") -> DataFrame:
    """Metrics per policy: one pass over the rows, one set of counters per policy."""
    label = F.col(y)
    counters = [
        F.struct(
            F.lit(policy).alias("policy"),
            F.lit(float(t)).alias("threshold"),
            *confusion_counts(label, (F.col(score) >= float(t)).cast("int")),
        )
        for policy, t in thresholds.items()
    ]
    table = df.agg(F.array(*counters).alias("_rows")).select(F.inline("_rows"))
    return with_rates(table)
