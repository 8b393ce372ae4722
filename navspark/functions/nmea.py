"""NMEA 0183 sentences as Spark expressions.

Missing or unreadable numbers are NULL, never NaN, so the built-in aggregates
skip them. Each output field picks its source text by formatter first and is
converted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from navspark.functions.once import computed_once

# Recognised formatters, and the two that carry a UTC field.
FORMATTERS = ("RMC", "GGA", "GSA", "GSV", "VTG", "GLL", "ZDA")
ANCHORS = ("RMC", "GGA")
MIN_FIELDS = {"RMC": 9, "GGA": 10, "GSA": 18, "GSV": 4, "VTG": 8}

# Position of each numeric field, per formatter.
NUMERIC_FIELDS = {
    "sog_rmc_knots": {"RMC": 7},
    "cog_rmc_deg": {"RMC": 8},
    "fix_quality": {"GGA": 6},
    "num_satellites": {"GGA": 7},
    "hdop": {"GGA": 8},
    "altitude": {"GGA": 9},
    "fix_mode": {"GSA": 2},
    "pdop": {"GSA": 15},
    "hdop_gsa": {"GSA": 16},
    "vdop": {"GSA": 17},
    "cog_true": {"VTG": 1},
    "cog_magnetic": {"VTG": 3},
    "sog_vtg_knots": {"VTG": 5},
    "sog_vtg_kmh": {"VTG": 7},
}
COORDINATE_FIELDS = {
    "lat_deg": {"RMC": (3, 4), "GGA": (2, 3)},
    "lon_deg": {"RMC": (5, 6), "GGA": (4, 5)},
}
FIELD_SOURCES = {
    **{name: tuple(where) for name, where in COORDINATE_FIELDS.items()},
    **{name: tuple(where) for name, where in NUMERIC_FIELDS.items()},
}

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_HEX_PAIR = r"^[0-9A-Fa-f]{1,2}$"


def number(text: Column) -> Column:
    """Plain decimal text to DOUBLE; anything else (blank, nan, inf, junk) to NULL."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def clock_seconds(text: Column) -> Column:
    """``HHMMSS.sss`` to seconds since midnight. Ranges are not validated."""
    t = number(text)
    hours = (t / 10000.0).cast("long")
    minutes = (F.pmod(t, F.lit(10000.0)) / 100.0).cast("long")
    return hours * 3600 + minutes * 60 + F.pmod(t, F.lit(100.0))


def coordinate(text: Column, hemisphere: Column) -> Column:
    """``(D)DDMM.MMMM`` plus hemisphere letter to signed decimal degrees."""
    v = number(text)
    whole = (v / 100.0).cast("long")
    degrees = whole + (v - whole * 100) / 60.0
    return F.when(hemisphere.isin("S", "W"), -degrees).otherwise(degrees)


def formatter(sentence: Column) -> Column:
    """Three-letter formatter whatever the talker; NULL for proprietary or foreign text."""
    header = F.substring_index(F.substring(sentence, 2, 1 << 30), ",", 1)
    code = F.right(header, F.lit(3))
    usable = (
        F.substring(sentence, 1, 1).isin("$", "!")
        & (F.length(header) >= 5)
        & ~header.startswith("P")
        & code.isin(*FORMATTERS)
    )
    return F.when(usable, code)


def without_checksum(sentence: Column) -> Column:
    tail = F.substring_index(sentence, "*", -1)
    starred = sentence.contains("*")
    return F.when(
        starred, sentence.substr(F.lit(1), F.length(sentence) - F.length(tail) - 1)
    ).otherwise(sentence)


def split_fields(sentence: Column) -> Column:
    return F.split(without_checksum(sentence), ",", -1)


def xor_of(text: Column) -> Column:
    """XOR over the characters' code points."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, ch: acc.bitwiseXOR(F.ascii(ch)))


def checksum_ok(sentence: Column) -> Column:
    """True when the checksum matches or there is none."""
    claimed = F.trim(F.substring(F.trim(F.substring_index(sentence, "*", -1)), 1, 2))
    body = F.regexp_replace(without_checksum(sentence), r"^[$!]+", "")
    matches = claimed.rlike(_HEX_PAIR) & (F.conv(claimed, 16, 10).cast("int") == xor_of(body))
    return ~sentence.contains("*") | matches


def snr_values(fields: Column) -> Column:
    """SNR slots of a GSV sentence: every fourth field from the eighth, blanks left out."""
    slots = F.when(
        F.size(fields) >= 8,
        F.transform(F.sequence(F.lit(7), F.size(fields) - 1, F.lit(4)), lambda i: number(F.get(fields, i))),
    )
    return F.filter(slots, lambda v: v.isNotNull())


def _pick(fields: Column, source: Column, where: dict[str, int]) -> Column:
    chosen = None
    for code, position in where.items():
        value = F.get(fields, F.lit(position))
        chosen = F.when(source == code, value) if chosen is None else chosen.when(source == code, value)
    return chosen


def parse_sentences(
    df: DataFrame, payload: str = "payload", validate_checksums: bool = True, keep_rejected: bool = False
) -> DataFrame:
    """Keep recognised sentences and add their typed fields.

    ``source`` names the formatter whose fields the row carries; it is NULL for a
    sentence too short to be parsed or of a recognised but unused kind. Presence
    (``source``) and value are separate because a present-but-empty field still
    overwrites an earlier value when sentences of one second are merged. With
    ``keep_rejected`` unrecognised or damaged sentences stay as rows without ``fmt``.
    """
    text = F.col(payload)
    rows = df.withColumn("fmt", formatter(text))
    if keep_rejected and validate_checksums:
        rows = rows.withColumn("fmt", F.when(F.col("fmt").isNotNull() & checksum_ok(text), F.col("fmt")))
    elif not keep_rejected:
        rows = rows.where(F.col("fmt").isNotNull())
        rows = rows.where(checksum_ok(text)) if validate_checksums else rows
    least = None
    for code, n in MIN_FIELDS.items():
        test = F.col("fmt") == code
        least = F.when(test, F.lit(n)) if least is None else least.when(test, F.lit(n))
    rows = rows.withColumn("_fields", split_fields(text)).withColumn(
        "source", F.when(F.size("_fields") >= least, F.col("fmt"))
    )
    rows = computed_once(rows, ["fmt", "_fields", "source"])

    fields, source = F.col("_fields"), F.col("source")
    parsed = {
        "utc_of_day": clock_seconds(F.when(source.isin(*ANCHORS), F.get(fields, F.lit(1)))),
        "snrs": F.when(source == "GSV", snr_values(fields)),
    }
    for name, where in COORDINATE_FIELDS.items():
        parsed[name] = coordinate(
            _pick(fields, source, {c: p[0] for c, p in where.items()}),
            _pick(fields, source, {c: p[1] for c, p in where.items()}),
        )
    for name, where in NUMERIC_FIELDS.items():
        parsed[name] = number(_pick(fields, source, where))
    kept = [c for c in df.columns if c != payload]
    return rows.select(*kept, "fmt", "source", *[col.alias(name) for name, col in parsed.items()])
