"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navspark.llm.common import WORD, ranked
from navspark.session import stage

WEIGHTS = (5, 2, 1)
VOLUME = 1.5
CEILING = 2.0
_ROUNDS = 80
#: Sums are taken over whole multiples of this part of a word, so their order cannot change them.
_GRAIN = 1 / 1024


def source_targets(
    totals: dict[str | None, int], weights: tuple = WEIGHTS, volume: float = VOLUME, ceiling: float = CEILING
) -> dict[str | None, float]:
    """Words wanted of each source.

    Sources in code point order, null last, take the weights in turn and share ``volume``
    times all words. Whoever would pass ``ceiling`` times its own size stops there and
    the excess is shared again by weight. A source without words gets none.
    """
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    targets: dict[str | None, float] = {}
    left, free = volume * sum(totals.values()), list(names)
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * share > ceiling * totals[s]]
        if not full:
            return targets | {s: weight[s] * share for s in free}
        for s in full:
            targets[s] = ceiling * totals[s]
            left -= targets[s]
        free = [s for s in free if s not in targets]
    return targets


def _by_source(values: dict[str | None, float]) -> Column:
    """A literal per source; the list of sources is the one thing here that is held whole."""
    pairs = [F.lit(x) for s, v in values.items() if s is not None for x in (s, float(v))]
    known = F.element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(None).cast("double")
    return F.when(F.col("source").isNull(), F.lit(values.get(None))).otherwise(known)


def _rate(slopes: dict, means: dict, ceiling: float) -> Column:
    exponent = _by_source(slopes) * F.col("size") / _by_source(means)
    return F.least(F.lit(ceiling), F.exp(F.least(F.lit(50.0), exponent)))


def tilt(groups: DataFrame, totals: dict, targets: dict, ceiling: float) -> tuple[dict, dict]:
    """Dual solution: each document of a source is wanted exp(slope * size / mean) times.

    Among all rates up to ``ceiling`` these are the closest in entropy to taking every document
    once that meet the token target. ``groups`` has (source, size, n). Each Newton step is
    one distributed sum for all sources; steps that leave the bracket are halved.
    """
    sizes = groups.groupBy("source").agg(F.sum("n").alias("n")).collect()
    means = {r["source"]: max(1.0, totals[r["source"]] / r["n"]) for r in sizes}
    slopes = {s: 0.0 for s in totals}
    low, high = {s: -60.0 for s in totals}, {s: 60.0 for s in totals}
    open_ = {s for s in totals if 0 < targets[s] < ceiling * totals[s]}
    for s in totals:
        if s not in open_ and totals[s]:
            slopes[s] = 1e6 if targets[s] else -1e6
    for _ in range(_ROUNDS):
        if not open_:
            break
        rate = _rate(slopes, means, ceiling)
        words = F.col("n") * F.col("size") * rate
        lever = F.when(rate < ceiling, words * F.col("size") / _by_source(means)).otherwise(0.0)
        whole = lambda x: F.sum(F.round(x / _GRAIN).cast("decimal(38,0)"))
        sums = groups.groupBy("source").agg(whole(words).alias("f"), whole(lever).alias("d")).collect()
        for r in sums:
            s = r["source"]
            if s not in open_:
                continue
            gap, slope = float(r["f"]) * _GRAIN - targets[s], float(r["d"]) * _GRAIN
            if abs(gap) <= max(1e-7 * targets[s], 0.01):
                open_.discard(s)
                continue
            (high if gap > 0 else low)[s] = slopes[s]
            step = slopes[s] - gap / slope if slope > 0 else math.inf
            slopes[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-12:
                open_.discard(s)
    return slopes, means


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, volume: float = VOLUME, ceiling: float = CEILING,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` (0 to ``ceiling``) is how often the mix repeats the row, ``taken`` the words
    that makes. Rates are rounded along the sizes of a source, carrying the remainder on,
    then the source's last difference is worked off with single copies until none helps: at most half the smallest
    size of the source that has a copy left to add or drop, as ``single_copies`` shows. A null source is a
    source; null and empty texts have size 0 and come once; an empty table gives no rows.
    Equal rows may get different copies, but every run gives the same ones.
    """
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    groups = stage(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "groups")
    totals = {r["source"]: r["s"] for r in groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("s")).collect()}
    targets = source_targets(totals, weights, volume, ceiling)
    slopes, means = tilt(groups, totals, targets, ceiling)
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.when(F.col("size") == 0, F.col("n")).otherwise(F.col("n") * _rate(slopes, means, ceiling))
    so_far = F.floor(F.round(F.sum(wanted).over(along), 6) + 0.5)
    whole = groups.withColumn("so_far", so_far).withColumn(
        "copies", (F.col("so_far") - F.coalesce(F.lag("so_far").over(Window.partitionBy("source").orderBy("size")), F.lit(0)))
    )
    whole = stage(whole.select("source", "size", "n", F.col("copies").cast("long").alias("copies")), "copies")
    off = _worked_off(whole, targets, ceiling).select(F.col("source").alias("_source"), F.col("size").alias("_size"), "change")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    whole = whole.join(off, same, "left").select("source", "size", "n", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))
    shares = whole.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "copies")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    joined = rows.join(shares, same).select("doc_id", "source", "size", "n", "copies")
    spread = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / 1000))
    order = [F.xxhash64(F.col("doc_id"), F.lit("copies")), F.col("doc_id")]
    placed = ranked(joined, ["source", "size"], order, spread, "_place")
    copies = (F.expr("copies div n") + (F.col("_place") < F.expr("copies % n")).cast("long")).cast("int")
    return placed.select(
        "doc_id", "source", "size", _by_source(totals).cast("long").alias("source_size"),
        _by_source(targets).alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def single_copies(gap: float, sizes: np.ndarray, spare: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Copies to add (or take away) per size, so that no further single copy brings the gap nearer to 0.

    ``spare`` copies of each size may still be added, ``taken`` be dropped. Each step closes the gap by as
    many copies of the largest size within it as there are, or else by one copy that oversteps it by less; the gap
    shrinks at every step. What is left is at most half the smallest size with a copy to add
    (gap above 0) or to drop (below 0), because a smaller one would have been used.
    """
    order = np.argsort(sizes)[::-1]
    sizes, spare, taken, change = sizes[order], spare[order].astype(np.int64), taken[order].astype(np.int64), np.zeros(len(sizes), np.int64)
    while True:
        free = spare - change if gap > 0 else taken + change
        size = abs(gap)
        useful = np.flatnonzero((free > 0) & (sizes > 0) & (np.abs(size - sizes) < size))
        if not len(useful):
            break
        within = useful[sizes[useful] <= size]
        # Largest size within the gap, many at once; else the one that oversteps least.
        at = within[0] if len(within) else useful[-1]
        step = min(int(free[at]), max(1, int(size // sizes[at])))
        change[at] += step if gap > 0 else -step
        gap += -step * float(sizes[at]) if gap > 0 else step * float(sizes[at])
    out = np.zeros(len(sizes), np.int64)
    out[order] = change
    return out


def _worked_off(groups: DataFrame, targets: dict, ceiling: float) -> DataFrame:
    """(source, size, change): single copies that bring each source as near to its target as they can.

    A source's task sees the sizes up to twice its gap, at most that many rows; larger ones cannot help.
    """
    taken = {r["source"]: r["t"] for r in groups.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()}
    rows = groups.withColumn("gap", _by_source({s: float(targets[s]) - float(t) for s, t in taken.items()}))
    rows = rows.where((F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        spare = np.floor(ceiling * rows["n"].to_numpy()).astype(np.int64) - rows["copies"].to_numpy()
        change = single_copies(float(rows["gap"].iloc[0]), rows["size"].to_numpy(), spare, rows["copies"].to_numpy())
        return pd.DataFrame({"source": rows["source"], "size": rows["size"], "change": change})[change != 0]

    return rows.groupBy("source").applyInPandas(work, "source string, size long, change long")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each repeated as often as ``mix`` says, columns unchanged.

    Rows that share id, source and size are told apart by a hash of all their columns, so reruns repeat the same ones.
    """
    names = {k: options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    size = F.coalesce(F.regexp_count(F.col(names["text_col"]), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.struct(F.col(names["id_col"]).alias("id"), F.col(names["source_col"]).cast("string").alias("source"), size.alias("size"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row"))).alias("turn")
    # The rows travel in one column, so that no name of theirs can clash.
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key")).select("row", "key", turn)
    counts = mix(docs, **options).select(F.struct(F.col("doc_id").alias("id"), "source", "size").alias("own"), "copies")
    place = F.row_number().over(Window.partitionBy("own").orderBy("copies")).alias("place")
    right = counts.select("own", "copies", place)
    same = F.col("turn") == F.col("place")
    for part in ("id", "source", "size"):
        same = same & F.col(f"key.{part}").eqNullSafe(F.col(f"own.{part}"))
    repeated = left.join(right, same).where("copies > 0")
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
