"""Two-sided nearest-match as-of join with a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from navspark.operators.neighbours import Lookup, lookup_neighbours


def pick_nearest(at: Column, lo: str, hi: str, on: str, tol: float, tie: str = "later") -> Column:
    """Nearer of two candidate structs, NULL beyond ``tol`` (inclusive)."""
    if tie not in ("later", "earlier"):
        raise ValueError("tie must be 'later' or 'earlier'")
    lo_gap, hi_gap = F.abs(F.col(f"{lo}.{on}") - at), F.abs(F.col(f"{hi}.{on}") - at)
    take_hi = hi_gap <= lo_gap if tie == "later" else hi_gap < lo_gap
    best = F.when(F.col(lo).isNull() | take_hi, F.col(hi)).otherwise(F.col(lo))
    gap = F.when(F.col(lo).isNull() | take_hi, hi_gap).otherwise(lo_gap)
    return F.when(gap <= tol, best)


def nearest_asof(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    fields: list[str],
    tol: float,
    tie: str = "later",
    segment_s: float = 3600.0,
    name: str = "match",
) -> DataFrame:
    """Left rows plus ``name``: a struct of ``on`` and ``fields`` of the nearest right row.

    Every left row is kept; a right row may be matched more than once. Both sides
    go through one union and one shuffle on ``(by, time segment)``.
    """
    rows = (
        left.withColumn("_is_left", F.lit(True))
        .unionByName(
            right.select(*by, F.col(on), *[F.col(f).alias(f"_r_{f}") for f in fields]).withColumn(
                "_is_left", F.lit(False)
            ),
            allowMissingColumns=True,
        )
        .withColumn("_segment", F.floor(F.col(on) / segment_s))
    )
    from_right = ~F.col("_is_left")
    right_fields = tuple(f"_r_{f}" for f in fields)
    found = lookup_neighbours(
        rows,
        by,
        ["_segment"],
        on,
        [Lookup("_lo", from_right, right_fields, "back"), Lookup("_hi", from_right, right_fields, "ahead")],
        keep=F.col("_is_left"),
    )
    best = pick_nearest(F.col(on), "_lo", "_hi", on, tol, tie)
    chosen = found.withColumn("_best", best)
    match = F.when(
        F.col("_best").isNotNull(),
        F.struct(F.col(f"_best.{on}").alias(on), *[F.col(f"_best._r_{f}").alias(f) for f in fields]),
    )
    return chosen.select(*left.columns, match.alias(name))
