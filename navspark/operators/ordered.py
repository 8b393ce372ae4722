"""Running totals over sorted values, and what follows from them exactly.

Quantiles, rank AUC, two-sample KS and precision-recall curves all need, for each
distinct value, how many rows lie at or below it. Rows are first collapsed to
``(group, value, counts)``, which is a partial aggregate. These are cut into ranges by
group and value, as many as the session's shuffle partitions, accumulated within each
range and shifted by the totals of the group's ranges before it. A group of any size
lies over as many ranges as it needs; small groups share one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from navspark.session import stage


def running_totals(counts: DataFrame, keys: list[str], value: str, totals: list[str]) -> DataFrame:
    """Add ``<c>_upto``, the inclusive running total of each count by rising value, and
    ``<c>_total``, its group total.

    ``counts`` has one row per ``keys + value``. It is written once in ranges, because several
    passes follow and each must see the same ranges.
    """
    ranged = stage(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "ranged")
    place = [*keys, "_range"]
    group = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*place)
        .agg(*[F.sum(c).alias(f"_t_{c}") for c in totals])
        .select(
            *[F.col(k).alias(f"_at_{k}") for k in place],
            *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in totals],
            *[F.sum(f"_t_{c}").over(group).alias(f"{c}_total") for c in totals],
        )
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in place])
    upto = Window.partitionBy(*place).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(offsets, same).select(
        *counts.columns,
        *[(F.sum(c).over(upto) + F.col(f"_o_{c}")).alias(f"{c}_upto") for c in totals],
        *[f"{c}_total" for c in totals],
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs``.

    The two order statistics around each position are looked up in the running totals. A group
    without any value keeps its row, with NULLs.
    """
    # A NULL counts nothing, but holds its group.
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_c"))
    upto = running_totals(counts, keys, value, ["_c"])
    regrouped = upto.groupBy(*keys) if keys else upto.groupBy()

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_c_upto") > position, F.col(value)))

    parts, picks = [], []
    for i, (name, p) in enumerate(probs.items()):
        spot = (F.col("_c_total") - 1) * F.lit(float(p))
        parts += [
            at(F.floor(spot)).alias(f"_lo_{i}"),
            at(F.ceil(spot)).alias(f"_hi_{i}"),
            F.max(spot - F.floor(spot)).alias(f"_f_{i}"),
        ]
        lo, hi, frac = (F.col(f"_{part}_{i}") for part in ("lo", "hi", "f"))
        picks.append((lo * (1.0 - frac) + hi * frac).alias(name))
    return regrouped.agg(*parts).select(*keys, *picks)


def column_quantiles(df: DataFrame, keys: list[str], columns: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of many columns at once, as columns ``<column>_<prob name>``.

    The columns are unpivoted so that the work spreads over ``(group, column, value)``.
    """
    found = exact_quantiles(melt(df, keys, columns), [*keys, "feature"], "value", probs)
    grouped = found.groupBy(*keys) if keys else found.groupBy()
    return grouped.agg(
        *[
            F.max(F.when(F.col("feature") == c, F.col(name))).alias(f"{c}_{name}")
            for c in columns
            for name in probs
        ]
    )


def melt(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Long form ``keys, feature, value``."""
    typed = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return typed.unpivot(keys, columns, "feature", "value")
