"""Look-ups of the nearest earlier or later matching row, cut into segments.

``lag``, "carry the last value forward" and as-of matching all need a row's
neighbours in time order. A plain window over ``PARTITION BY device`` puts a
whole device in one task, which fails when one device holds a third of the data.
Here every ordered group is cut into segments (an hour of time, a block of a
file). The window runs per ``(group, segment)``, and what a segment needs to know
about the segments around it comes from one summary row per segment: the last
(or first) matching row in it. Summaries are a partial aggregate, a few numbers
per segment, so stitching them costs next to nothing, and the detail rows are
shuffled exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Lookup:
    """``name`` becomes a struct column of ``key`` plus ``fields`` of the row found.

    ``back`` finds the latest row at or before the current one, ``back_strict``
    the latest one before it in row order, ``ahead`` the earliest at or after it.
    """

    name: str
    matches: Column
    fields: tuple[str, ...]
    direction: str = "back"


def lookup_neighbours(
    df: DataFrame,
    by: list[str],
    segment: list[str],
    key: str,
    lookups: list[Lookup],
    keep: Column | None = None,
    span: Column | None = None,
) -> DataFrame:
    """Add one struct column per look-up.

    ``by + segment`` must order consistently with ``key``: all rows of an earlier
    segment precede those of a later one. ``keep`` filters the rows returned, after
    they have served as neighbours. With ``span``, ``_t0`` and ``_t1`` are the first and
    last ``key`` of the group's rows that satisfy it; they come out of the same
    summaries, so no row is joined on the group alone, which may be hot.
    """
    for look in lookups:
        if look.direction not in ("back", "back_strict", "ahead"):
            raise ValueError(f"unknown direction {look.direction!r}")
    place = [*by, *segment]

    aggregates = [agg for look in lookups for agg in _summarise(look, key)]
    bounds = []
    if span is not None:
        inside = F.when(span, F.col(key))
        aggregates += [F.min(inside).alias("_min"), F.max(inside).alias("_max")]
        group = Window.partitionBy(*by)
        bounds = [F.min("_min").over(group).alias("_t0"), F.max("_max").over(group).alias("_t1")]
    summary = df.groupBy(*place).agg(*aggregates)
    seeds = summary.select(*place, *[_seed(look, by, segment, key) for look in lookups], *bounds)

    within = Window.partitionBy(*place)
    rising = within.orderBy(F.col(key))
    frames = {
        "back": rising.rangeBetween(Window.unboundedPreceding, Window.currentRow),
        "back_strict": rising.rowsBetween(Window.unboundedPreceding, -1),
        # Scanning backwards keeps the frame a running one; a frame that ends at
        # UNBOUNDED FOLLOWING is recomputed for every row.
        "ahead": within.orderBy(F.col(key).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow),
    }
    joined = df.join(seeds, place, "left")
    found = {
        look.name: F.coalesce(
            F.last(_row(look, key), ignorenulls=True).over(frames[look.direction]),
            F.col(f"_seed_{look.name}"),
        )
        for look in lookups
    }
    spans = ["_t0", "_t1"] if span is not None else []
    out = joined.select(*df.columns, *[col.alias(name) for name, col in found.items()], *spans)
    return out.where(keep) if keep is not None else out


def with_span(df: DataFrame, by: list[str], key: str, rows: Column, segment_s: float = 3600.0) -> DataFrame:
    """Add ``_t0``/``_t1``: first and last ``key`` of each group's ``rows``."""
    cut = df.withColumn("_segment", F.floor(F.col(key) / segment_s))
    return lookup_neighbours(cut, by, ["_segment"], key, [], span=rows).drop("_segment")


def _row(look: Lookup, key: str) -> Column:
    return F.when(look.matches, F.struct(F.col(key), *[F.col(f) for f in look.fields]))


def _summarise(look: Lookup, key: str) -> list[Column]:
    # Aggregated one by one: a struct buffer would force a sort-based aggregate.
    position = F.when(look.matches, F.col(key))
    extreme, pick = (F.min, F.min_by) if look.direction == "ahead" else (F.max, F.max_by)
    return [
        extreme(position).alias(f"_{look.name}_{key}"),
        *[pick(F.col(f), position).alias(f"_{look.name}_{f}") for f in look.fields if f != key],
    ]


def _seed(look: Lookup, by: list[str], segment: list[str], key: str) -> Column:
    order = [F.col(c).desc() if look.direction == "ahead" else F.col(c).asc() for c in segment]
    outside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    row = F.when(
        F.col(f"_{look.name}_{key}").isNotNull(),
        F.struct(
            F.col(f"_{look.name}_{key}").alias(key),
            *[F.col(f"_{look.name}_{f}").alias(f) for f in look.fields],
        ),
    )
    return F.last(row, ignorenulls=True).over(outside).alias(f"_seed_{look.name}")
