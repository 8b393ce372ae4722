"""Detection metrics from labelled, scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from navspark.operators.ordered import running_totals


def confusion_counts(y: Column, pred: Column) -> list[Column]:
    return [
        F.count_if((y == 0) & (pred == 0)).alias("tn"),
        F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 1) & (pred == 0)).alias("fn"),
        F.count_if((y == 1) & (pred == 1)).alias("tp"),
    ]


def ratio(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(empty).cast("double"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and FPR from ``tn, fp, fn, tp``; empty denominators give 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    negatives = F.greatest(fp + tn, F.lit(1.0))
    return (
        counts.withColumn("accuracy", ratio(tn + tp, tn + fp + fn + tp))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(tp * 2.0, tp * 2.0 + fp + fn))
        .withColumn("fpr", fp / negatives)
    )


def confusion_metrics(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return with_rates(grouped.agg(*confusion_counts(F.col(y), F.col(pred))))


def roc_auc(df: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """Rank AUC per group with ties counted half; NULL where only one class is present."""
    usable = df.where(F.col(score).isNotNull())
    counts = usable.groupBy(*keys, score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    ranked = running_totals(counts, keys, score, ["neg"])
    below = F.col("neg_upto") - F.col("neg") * 0.5
    grouped = ranked.groupBy(*keys) if keys else ranked.groupBy()
    sums = grouped.agg(
        F.sum(F.col("pos") * below).alias("_wins"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    pairs = F.col("_p").cast("double") * F.col("_n")
    return sums.select(*keys, F.when(pairs > 0, F.col("_wins") / pairs).alias("auc"))


def contingency(df: DataFrame, keys: list[str], first_right: Column, second_right: Column) -> DataFrame:
    """2x2 table of two classifiers being right on the same rows."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(
        F.count_if(first_right & second_right).alias("both_right"),
        F.count_if(first_right & ~second_right).alias("only_first"),
        F.count_if(~first_right & second_right).alias("only_second"),
        F.count_if(~first_right & ~second_right).alias("both_wrong"),
    )


def precision_at_prevalence(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    hits = tpr * prevalence
    total = hits + fpr * (F.lit(1.0) - prevalence)
    return F.when(total > 0, hits / total)
