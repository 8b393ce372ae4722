"""Time stamps that logging software puts in front of a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from navspark.functions.once import computed_once

DAY_S = 86400.0

# Fixed patterns of the two prefix styles.
SCS_LINE = r"^\d{2}/\d{2}/\d{4},\d{2}:\d{2}:\d{2}(\.\d+)?,[$!]"
ISO_LINE = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)[,\s]+([$!].*)$"


def _seconds(date: Column, time: Column, fraction: Column) -> Column:
    """UTC seconds of ``YYYY-MM-DD`` and ``HH:MM:SS``; NULL where that is no calendar time.

    Plain arithmetic, so the session time zone plays no part.
    """
    h, m, s = (F.substring(time, at, 2).try_cast("int") for at in (1, 4, 7))
    day = F.unix_date(date.try_cast("date")).cast("double")
    whole = F.when((h < 24) & (m < 60) & (s < 60), day * DAY_S + h * 3600 + m * 60 + s)
    return whole + F.coalesce(F.concat(F.lit("0."), fraction).try_cast("double"), F.lit(0.0))


def _fraction(time_text: Column) -> Column:
    digits = F.substring_index(time_text, ".", -1)
    return F.when(time_text.contains(".") & (digits != ""), digits)


def split_log_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``ext_clock`` (seconds, NULL for a bare sentence) and ``payload``.

    Lines that hold no sentence, or whose time stamp is no calendar time, are
    dropped.
    """
    t = F.col("_text")
    kind = (
        F.when(t.rlike(SCS_LINE), F.lit("scs"))
        .when(t.rlike(ISO_LINE), F.lit("iso"))
        .when(F.substring(t, 1, 1).isin("$", "!"), F.lit("bare"))
    )
    staged = df.withColumn("_text", F.regexp_replace(F.col(line), r"^\s+|\s+$", "")).withColumn("_kind", kind)
    kind = F.col("_kind")
    stamp = F.when(kind == "scs", F.substring_index(t, ",", 2)).when(kind == "iso", F.regexp_extract(t, ISO_LINE, 1))
    staged = staged.withColumn("_stamp", stamp)
    s = F.col("_stamp")
    month, day, year = (F.substring(s, at, n) for at, n in ((1, 2), (4, 2), (7, 4)))
    ext = F.when(
        kind == "scs", _seconds(F.concat_ws("-", year, month, day), F.substring(s, 12, 8), _fraction(s))
    ).when(
        kind == "iso",
        _seconds(F.substring(s, 1, 10), F.substring(s, 12, 8), _fraction(F.rtrim(s, F.lit("Z")))),
    )
    payload = (
        F.when(kind == "scs", t.substr(F.length(s) + 2, F.length(t)))
        .when(kind == "iso", F.regexp_extract(t, ISO_LINE, 2))
        .otherwise(t)
    )
    out = computed_once(
        staged.withColumn("ext_clock", ext).withColumn("payload", payload), ["_kind", "ext_clock", "payload"]
    )
    return out.where((kind == "bare") | F.col("ext_clock").isNotNull()).drop("_text", "_kind", "_stamp")


def absolute_utc(of_day: Column, ext_clock: Column) -> Column:
    """Seconds since midnight placed on the day nearest to the external clock.

    The earliest of equally near candidates wins. Without an external clock the
    seconds since midnight stay as they are.
    """
    midnight = F.floor(ext_clock / DAY_S) * DAY_S
    before, same, after = (midnight + of_day + shift for shift in (-DAY_S, 0.0, DAY_S))
    gap_b, gap_s, gap_a = (F.abs(c - ext_clock) for c in (before, same, after))
    nearest = (
        F.when((gap_b <= gap_s) & (gap_b <= gap_a), before).when(gap_s <= gap_a, same).otherwise(after)
    )
    return F.when(ext_clock.isNull(), of_day).otherwise(nearest)
