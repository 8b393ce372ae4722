"""Single-feature screens: AUC per feature and subset, and two-sample KS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from navspark.operators.ordered import column_quantiles, melt, running_totals
from navspark.schema import META_COLUMNS, family_of

# Fixed values.
ORACLE_AUC = 0.99
ZERO_INTENSITY_AUC = 0.75
KS_MIN_ROWS = 20


def feature_columns(df: DataFrame, extra: tuple[str, ...] = ("_error",)) -> list[str]:
    return [c for c in df.columns if c not in META_COLUMNS and c not in extra]


def subset_names() -> Column:
    """Names of the subsets a row belongs to: overall, its scenario, zero-intensity ones."""
    name = F.col("scenario")
    still = (name == "A3") & (F.col("param_2_name") == "shift_speed") & (F.col("param_2_value") == 0)
    zero = (name == "A1") & (F.col("param_1_value") == 0) & (F.col("param_2_value") == 0)
    return F.array_compact(
        F.array(F.lit("overall"), name, F.when(still, F.lit("A3_speed0")), F.when(zero, F.lit("A1_zero")))
    )


def subset_auc(df: DataFrame, y: Column, subsets: Column, features: list[str]) -> DataFrame:
    """``feature, subset, auc`` for every feature as a classifier of its own.

    A missing value takes the feature's overall median (0 where it has none). AUC is
    folded to ``max(a, 1 - a)`` and NULL with a single class or no spread. Only four
    columns are carried through the unpivot, and rows collapse to distinct values
    before any sorting.
    """
    medians = column_quantiles(df, [], features, {"median": 0.5}).first()
    filled = df.select(
        y.alias("_y"),
        subsets.alias("_subsets"),
        *[
            F.coalesce(F.col(c).cast("double"), F.lit(float(medians[f"{c}_median"] or 0.0))).alias(c)
            for c in features
        ],
    )
    long = melt(filled, ["_y", "_subsets"], features)
    counted = long.groupBy("feature", "value", "_subsets").agg(
        F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")
    )
    # Subsets overlap, so rows are collapsed first and copied into their subsets after.
    counts = (
        counted.withColumn("subset", F.explode("_subsets"))
        .groupBy("feature", "subset", "value")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    ranked = running_totals(counts, ["feature", "subset"], "value", ["neg"])
    sums = ranked.groupBy("feature", "subset").agg(
        F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") * 0.5)).alias("_wins"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.count(F.lit(1)).alias("_distinct"),
    )
    pairs = F.col("_p").cast("double") * F.col("_n")
    raw = F.when((pairs > 0) & (F.col("_distinct") > 1), F.col("_wins") / pairs)
    return sums.select("feature", "subset", F.greatest(raw, F.lit(1.0) - raw).alias("_auc"), raw.alias("_raw")).select(
        "feature", "subset", F.when(F.col("_raw").isNotNull(), F.col("_auc")).alias("auc")
    )


def audit(
    df: DataFrame,
    oracle_auc: float = ORACLE_AUC,
    zero_auc: float = ZERO_INTENSITY_AUC,
) -> DataFrame:
    """AUC table of a labelled feature table: one row per feature, one column per subset."""
    features = feature_columns(df)
    long = subset_auc(df, (F.col("label") == "spoofed").cast("int"), subset_names(), features)
    scenarios = [r["scenario"] for r in df.select("scenario").where("scenario IS NOT NULL").distinct().orderBy("scenario").collect()]
    special = [
        name
        for name in ("A3_speed0", "A1_zero")
        if not df.where(F.array_contains(subset_names(), name)).limit(1).isEmpty()
    ]
    wide = long.groupBy("feature").pivot("subset", ["overall", *scenarios, *special]).agg(F.first("auc"))
    family = F.lit(None)
    for c in features:
        if family_of(c):
            family = F.when(F.col("feature") == c, F.lit(family_of(c))).otherwise(family)
    named = wide.withColumn("family", F.coalesce(family.cast("string"), F.lit("other")))
    reaches = F.lit(False)
    for s in scenarios:
        reaches = reaches | F.coalesce(F.col(f"`{s}`") >= oracle_auc, F.lit(False))
    out = named.withColumn("oracle_any_scenario", reaches)
    if "A3_speed0" in special:
        out = out.withColumn(
            "zero_intensity_separator", F.coalesce(F.col("A3_speed0") >= zero_auc, F.lit(False))
        )
    head = ["feature", "family", "overall", *scenarios, *special]
    return out.select(*head, *[c for c in out.columns if c not in head])


def family_summary(audited: DataFrame) -> DataFrame:
    """Highest AUC per family and subset."""
    subsets = [
        c for c in audited.columns
        if c not in ("feature", "family", "oracle_any_scenario", "zero_intensity_separator")
    ]
    return audited.groupBy("family").agg(*[F.max(f"`{c}`").alias(c) for c in subsets])


def zero_intensity_separators(audited: DataFrame) -> DataFrame:
    return audited.where("zero_intensity_separator").orderBy(F.col("A3_speed0").desc())


def ks_two_sample(
    long: DataFrame,
    keys: list[str] = ["feature"],
    value: str = "value",
    first: str = "is_first",
    min_rows: int = KS_MIN_ROWS,
) -> DataFrame:
    """Largest gap between two empirical distributions, with both sizes and medians.

    ``long`` has one row per observation and a boolean telling the sample. Groups with
    fewer than ``min_rows`` values on a side are left out.
    """
    present = long.where(F.col(value).isNotNull())
    counts = present.groupBy(*keys, value).agg(
        F.count_if(F.col(first)).alias("_a"), F.count_if(~F.col(first)).alias("_b")
    )
    ranked = running_totals(counts, keys, value, ["_a", "_b"])
    sized = ranked.withColumnsRenamed({"_a_total": "n_first", "_b_total": "n_second"}).where(
        (F.col("n_first") >= min_rows) & (F.col("n_second") >= min_rows)
    )

    def order_statistic(upto: str, position: Column) -> Column:
        return F.min(F.when(F.col(upto) > position, F.col(value)))

    def middle(upto: str, n: str) -> Column:
        # Mean of the two central values; they coincide for an odd count.
        spot = (F.col(n) - 1) / 2.0
        return (order_statistic(upto, F.floor(spot)) + order_statistic(upto, F.ceil(spot))) / 2.0

    gap = F.abs(F.col("_a_upto") / F.col("n_first") - F.col("_b_upto") / F.col("n_second"))
    return sized.groupBy(*keys).agg(
        F.max(gap).alias("ks_stat"),
        middle("_a_upto", "n_first").alias("first_median"),
        middle("_b_upto", "n_second").alias("second_median"),
        F.max("n_first").alias("n_first"),
        F.max("n_second").alias("n_second"),
    )
