"""Sentence queries: ``events`` written out as NMEA text, then parsed back.

Each event becomes one sentence of the kind its type stands for, so the stream mixes
anchors (RMC, GGA) with sentences that attach to them. The parity of the user is the
device and the event id is the arrival order. Text is assembled from integers, as
number formatting differs between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navspark.catalogue import MICROS, Query, read, rounded
from navspark.functions.clock import absolute_utc, split_log_lines
from navspark.functions.nmea import FIELD_SOURCES, checksum_ok, formatter, parse_sentences, xor_of
from navspark.functions.once import computed_once
from navspark.operators.epochs import attach_to_anchor, merge_epochs
from navspark.operators.neighbours import Lookup, lookup_neighbours
from navspark.session import stage

SEGMENT_EVENTS = 65536


def _pad(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {width}, '0')"


def _int(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


# Plain SQL that both engines read alike; {us} is the event time in microseconds.
_CLOCK = (
    "concat(" + _pad("hour(ts)", 2) + ", " + _pad("minute(ts)", 2) + ", " + _pad("second(ts)", 2) + ", '.', "
    + _pad(_int("({us} % 1000000) / 10000"), 2) + ")"
)
_LAT = "concat(" + _pad("40 + user_id % 5", 2) + ", " + _pad(_int("value % 60"), 2) + ", '.', " + _pad("(event_id * 37) % 10000", 4) + ")"
_LON = "concat(" + _pad("28 + user_id % 3", 3) + ", " + _pad("event_id % 60", 2) + ", '.', " + _pad("(event_id * 91) % 10000", 4) + ")"
_SOG = "concat(CAST(" + _int("value % 20") + " AS STRING), '.', CAST(event_id % 10 AS STRING))"
_COG = "concat(CAST(" + _int("value * 3") + " AS STRING), '.', CAST(user_id % 10 AS STRING))"
_SNR = "CAST(30 + (user_id + {k}) % 20 AS STRING)"

BODY = f"""CASE event_type
  WHEN 'click' THEN concat('GNRMC,', {_CLOCK}, ',A,', {_LAT}, ',N,', {_LON}, ',', CASE WHEN user_id % 4 = 0 THEN 'W' ELSE 'E' END,
    ',', CASE WHEN value < 4 THEN '' ELSE {_SOG} END, ',', {_COG}, ',010124,,,A')
  WHEN 'view' THEN concat('GPGGA,', {_CLOCK}, ',', CASE WHEN value < 6 THEN '' ELSE {_LAT} END, ',S,', {_LON}, ',E,1,', {_pad('user_id % 13', 2)},
    ',0.', CAST(event_id % 10 AS STRING), ',', CAST({_int('value')} AS STRING), '.25,M,0.0,M,,')
  WHEN 'purchase' THEN concat('GPVTG,', {_COG}, ',T,', CASE WHEN value < 50 THEN '' ELSE {_COG} END, ',M,', {_SOG}, ',N,', {_SOG}, ',K,A')
  WHEN 'signup' THEN concat('GPGSA,A,', CAST(2 + user_id % 2 AS STRING), ',01,02,03,04,05,06,07,08,,,,,1.', CAST(event_id % 10 AS STRING),
    ',0.9,1.', CAST(user_id % 10 AS STRING))
  ELSE concat('GPGSV,2,1,08,01,40,083,', {_SNR.format(k=1)}, ',02,17,308,', {_SNR.format(k=4)}, ',03,07,344,',
    CASE WHEN value < 20 THEN '' ELSE {_SNR.format(k=9)} END, ',04,22,228,', {_SNR.format(k=16)})
END"""
# Sentence endings: some without checksum, some with a wrong one, most correct.
_ENDING_SPARK = "CASE WHEN value > 90 THEN '' WHEN value < 3 THEN '*00' ELSE concat('*', lpad(hex(_xor), 2, '0')) END"
_ENDING_DUCK = "CASE WHEN value > 90 THEN '' WHEN value < 3 THEN '*00' ELSE concat('*', printf('%02X', _xor)) END"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``device, event_id, ts_s, payload``."""
    events = read(spark, sf_dir, "events")
    body = events.select(
        F.expr("CAST(user_id % 2 AS INT)").alias("device"), "event_id", "event_type", "user_id", "value",
        F.expr(MICROS).alias("us"), F.expr(BODY.replace("{us}", MICROS)).alias("_body"),
    )
    summed = body.withColumn("_xor", xor_of(F.col("_body")))
    written = summed.select(
        "device", "event_id", "us", F.concat(F.lit("$"), F.col("_body"), F.expr(_ENDING_SPARK)).alias("payload")
    )
    return computed_once(written, ["payload"])


_DUCK_XOR = "list_reduce(list_transform(string_split({t}, ''), lambda c: unicode(c)), lambda a, b: xor(a, b))"

STREAM_SQL = f"""
bodies AS (
  SELECT CAST(user_id % 2 AS INT) AS device, event_id, event_type, user_id, value, epoch_us(ts) AS us,
         {BODY.replace('{us}', 'epoch_us(ts)')} AS _body
  FROM events
),
stream AS (
  SELECT device, event_id, event_type, user_id, value, us, concat('$', _body, {_ENDING_DUCK}) AS payload
  FROM (SELECT *, {_DUCK_XOR.format(t='_body')} AS _xor FROM bodies)
)"""

_DUCK_NUMBER = "CASE WHEN regexp_matches({x}, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN TRY_CAST({x} AS DOUBLE) END"


def _duck_coord(text: str, hemi: str) -> str:
    v = "(" + _DUCK_NUMBER.format(x=text) + ")"
    degrees = f"(trunc({v} / 100) + ({v} - trunc({v} / 100) * 100) / 60)"
    return f"CASE WHEN {hemi} IN ('S', 'W') THEN -{degrees} ELSE {degrees} END"


def _duck_fields() -> str:
    from navspark.functions.nmea import COORDINATE_FIELDS, NUMERIC_FIELDS

    t = "(" + _DUCK_NUMBER.format(x="f[2]") + ")"
    parts = [
        f"CASE WHEN source IN ('RMC', 'GGA') THEN trunc({t} / 10000) * 3600 + trunc(({t} % 10000) / 100) * 60 + {t} % 100 END AS utc_of_day"
    ]
    for name, where in COORDINATE_FIELDS.items():
        cases = " ".join(f"WHEN '{c}' THEN {_duck_coord(f'f[{a + 1}]', f'f[{b + 1}]')}" for c, (a, b) in where.items())
        parts.append(f"CASE source {cases} END AS {name}")
    for name, where in NUMERIC_FIELDS.items():
        cases = " ".join(f"WHEN '{c}' THEN {_DUCK_NUMBER.format(x=f'f[{a + 1}]')}" for c, a in where.items())
        parts.append(f"CASE source {cases} END AS {name}")
    return ", ".join(parts)


_TAIL = "string_split(payload, '*')[-1]"
_UNSTARRED = f"CASE WHEN contains(payload, '*') THEN substr(payload, 1, length(payload) - length({_TAIL}) - 1) ELSE payload END"

CHECK_SQL = f"""
checked AS (
  SELECT *, CASE WHEN length(header) >= 5 AND header NOT LIKE 'P%' AND right(header, 3) IN ('RMC', 'GGA', 'GSA', 'GSV', 'VTG', 'GLL', 'ZDA')
                 THEN right(header, 3) END AS fmt,
         NOT contains(payload, '*')
         OR TRY_CAST('0x' || upper(substr(trim({_TAIL}), 1, 2)) AS INT) = {_DUCK_XOR.format(t='ltrim(bare, chr(36) || chr(33))')} AS valid
  FROM (SELECT *, {_UNSTARRED} AS bare, split_part(substr(payload, 2), ',', 1) AS header FROM stream)
)"""

PARSE_SQL = f"""
WITH {STREAM_SQL}, {CHECK_SQL},
split_rows AS (SELECT * , string_split(bare, ',') AS f FROM checked WHERE valid AND fmt IS NOT NULL),
sourced AS (
  SELECT *, CASE WHEN len(f) >= CASE fmt WHEN 'RMC' THEN 9 WHEN 'GGA' THEN 10 WHEN 'GSA' THEN 18 WHEN 'GSV' THEN 4 WHEN 'VTG' THEN 8 ELSE 1000 END
            THEN fmt END AS source
  FROM split_rows
),
parsed AS (
  SELECT device, event_id, us, fmt, source, {_duck_fields()},
         CASE WHEN source = 'GSV' THEN list_filter(list_transform(range(8, len(f) + 1, 4), lambda i: {_DUCK_NUMBER.format(x='f[i]')}),
              lambda v: v IS NOT NULL) END AS snrs
  FROM sourced
)"""


def nmea_checksum(spark, sf_dir):
    """Per formatter: how many sentences there are and how many carry a wrong checksum."""
    rows = stream(spark, sf_dir).select(
        formatter(F.col("payload")).alias("fmt"), checksum_ok(F.col("payload")).alias("valid")
    )
    return rows.groupBy("fmt").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("n_bad"))


NMEA_CHECKSUM_SQL = f"""
WITH {STREAM_SQL}, {CHECK_SQL}
SELECT fmt, count(*) AS n, count(*) FILTER (WHERE NOT valid) AS n_bad FROM checked GROUP BY fmt"""


def parsed_stream(spark, sf_dir) -> DataFrame:
    return parse_sentences(stream(spark, sf_dir).select("device", "event_id", "us", "payload"))


def _parse_query(fmt: str):
    names = [n for n, sources in FIELD_SOURCES.items() if fmt in sources]
    if fmt in ("RMC", "GGA"):
        names = ["utc_of_day", *names]

    def run(spark, sf_dir):
        rows = parsed_stream(spark, sf_dir).where(F.col("source") == fmt)
        return rounded(rows.select("device", "event_id", *names), names, 9)

    cols = ", ".join(f"round({n}, 9) AS {n}" for n in names)
    return Query(run, f"{PARSE_SQL} SELECT device, event_id, {cols} FROM parsed WHERE source = '{fmt}'")


def gsv_snr_stats(spark, sf_dir):
    """SNR statistics per device and hour over the GSV sentences of that hour."""
    from navspark.operators.epochs import snr_statistics

    rows = parsed_stream(spark, sf_dir).where("source = 'GSV'")
    hours = rows.select("device", F.expr("CAST(floor(us / 3600e6) AS BIGINT)").alias("hour"), F.explode_outer("snrs").alias("snr"))
    out = hours.groupBy("device", "hour").agg(*snr_statistics())
    return rounded(out, ["mean_snr", "std_snr"])


GSV_SQL = f"""{PARSE_SQL},
hours AS (SELECT device, CAST(floor(us / 3600e6) AS BIGINT) AS hour, unnest(snrs) AS snr FROM parsed WHERE source = 'GSV')
SELECT device, hour, round(avg(snr), 6) AS mean_snr, round(stddev_pop(snr), 6) AS std_snr,
       min(snr) AS min_snr, max(snr) AS max_snr, count(snr) AS num_sats_with_snr
FROM hours GROUP BY device, hour"""

# Log lines: the prefix style follows the event type, the logger runs 250 ms late.
_HMS = "concat(" + _pad("hour(ts)", 2) + ", ':', " + _pad("minute(ts)", 2) + ", ':', " + _pad("second(ts)", 2) + ")"
_MS = _pad(_int("({us} % 1000000) / 1000"), 3)
LINE = f"""CASE
  WHEN event_type = 'click' THEN concat({_pad('month(ts)', 2)}, '/', {_pad('dayofmonth(ts)', 2)}, '/', {_pad('year(ts)', 4)}, ',', {_HMS}, '.', {_MS}, ',$GPZDA,x')
  WHEN event_type = 'view' THEN concat({_pad('year(ts)', 4)}, '-', {_pad('month(ts)', 2)}, '-', {_pad('dayofmonth(ts)', 2)}, 'T', {_HMS}, '.', {_MS}, 'Z $GPZDA,y')
  WHEN event_type = 'error' THEN concat({_pad('year(ts)', 4)}, '-', {_pad('month(ts)', 2)}, '-', {_pad('dayofmonth(ts)', 2)}, ' ', {_HMS}, ', !AIVDM,z')
  WHEN event_type = 'signup' AND value < 10 THEN concat('13/45/2024,', {_HMS}, ',$GPZDA,bad')
  WHEN event_type = 'signup' THEN '$GPZDA,bare'
  ELSE 'operator note, no sentence'
END"""


def _lines(spark, sf_dir) -> DataFrame:
    lines = read(spark, sf_dir, "events").select(
        F.expr("CAST(user_id % 2 AS INT)").alias("device"), "event_id", F.expr(f"{MICROS} % 86400000000 / 1e6").alias("of_day"),
        F.expr(LINE.replace("{us}", MICROS)).alias("line"),
    )
    return computed_once(lines, ["line"])


def log_prefix_split(spark, sf_dir):
    """External clock and sentence of every usable log line, and the UTC it implies."""
    rows = split_log_lines(_lines(spark, sf_dir))
    # The sentence clock is taken 12 hours ahead so that it may belong to a neighbouring day.
    shifted = F.pmod(F.col("of_day") + 43000.0, F.lit(86400.0))
    out = rows.select("event_id", "ext_clock", "payload", absolute_utc(shifted, F.col("ext_clock")).alias("utc"))
    return rounded(out, ["ext_clock", "utc"])


LINES_SQL = f"""
lines AS (
  SELECT CAST(user_id % 2 AS INT) AS device, event_id, event_type, value, epoch_us(ts) % 86400000000 / 1e6 AS of_day, epoch_us(ts) AS us,
         {LINE.replace('{us}', 'epoch_us(ts)')} AS line
  FROM events
),
split_lines AS (
  SELECT device, event_id, of_day,
    CASE WHEN event_type = 'signup' THEN NULL
         WHEN event_type = 'error' THEN CAST(us // 1000000 AS DOUBLE)
         ELSE us // 1000000 + (us % 1000000 // 1000) / 1000e0 END AS ext_clock,
    CASE event_type WHEN 'click' THEN '$GPZDA,x' WHEN 'view' THEN '$GPZDA,y' WHEN 'error' THEN '!AIVDM,z' ELSE '$GPZDA,bare' END AS payload
  FROM lines
  WHERE event_type <> 'purchase' AND NOT (event_type = 'signup' AND value < 10)
)"""

LOG_PREFIX_SQL = f"""
WITH {LINES_SQL},
days AS (SELECT *, (of_day + 43000) % 86400 AS s, floor(ext_clock / 86400) * 86400 AS midnight FROM split_lines)
SELECT event_id, round(ext_clock, 6) AS ext_clock, payload,
  round(CASE WHEN ext_clock IS NULL THEN s
       WHEN abs(midnight + s - 86400 - ext_clock) <= abs(midnight + s - ext_clock)
        AND abs(midnight + s - 86400 - ext_clock) <= abs(midnight + s + 86400 - ext_clock) THEN midnight + s - 86400
       WHEN abs(midnight + s - ext_clock) <= abs(midnight + s + 86400 - ext_clock) THEN midnight + s
       ELSE midnight + s + 86400 END, 6) AS utc
FROM days"""


def clock_carry(spark, sf_dir):
    """Bare lines take the last external clock of their device."""
    rows = split_log_lines(_lines(spark, sf_dir)).withColumn("segment", F.floor(F.col("event_id") / SEGMENT_EVENTS))
    out = lookup_neighbours(
        rows, ["device"], ["segment"], "event_id",
        [Lookup("clock", F.col("ext_clock").isNotNull(), ("ext_clock",), "back")],
    )
    return rounded(out.select("device", "event_id", F.col("clock.ext_clock").alias("ext_clock")), ["ext_clock"])


CLOCK_CARRY_SQL = f"""
WITH {LINES_SQL}
SELECT device, event_id, round(last_value(ext_clock IGNORE NULLS) OVER (PARTITION BY device ORDER BY event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS ext_clock
FROM split_lines"""


def _attached(spark, sf_dir) -> DataFrame:
    # The anchor time is the sentence clock on the hour grid, so that epochs collect several sentences.
    parsed = stage(parsed_stream(spark, sf_dir), "sentences").withColumn("segment", F.floor(F.col("event_id") / SEGMENT_EVENTS))
    hourly = F.floor(F.col("us") / 3600e6) * 3600.0
    anchored = parsed.withColumn("anchor_time", F.when(F.col("utc_of_day").isNotNull(), hourly)).drop("us", "utc_of_day")
    return attach_to_anchor(anchored, ["device"], ["segment"], "event_id")


def anchor_carry(spark, sf_dir):
    """Time of the anchor every sentence belongs to."""
    return _attached(spark, sf_dir).select("device", "event_id", "fmt", "utc_time")


ATTACH_SQL = f"""{PARSE_SQL},
anchored AS (
  SELECT *, CASE WHEN source IN ('RMC', 'GGA') AND utc_of_day IS NOT NULL THEN floor(us / 3600e6) * 3600e0 END AS anchor_time FROM parsed
),
carried AS (
  SELECT *, last_value(anchor_time IGNORE NULLS) OVER (PARTITION BY device ORDER BY event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS utc_time
  FROM anchored
),
attached AS (
  SELECT * FROM carried
  WHERE utc_time IS NOT NULL AND source IS NOT NULL AND (fmt NOT IN ('RMC', 'GGA') OR anchor_time IS NOT NULL)
)"""
ANCHOR_CARRY_SQL = f"{ATTACH_SQL} SELECT device, event_id, fmt, utc_time FROM attached"


def epoch_merge(spark, sf_dir):
    """Sentences merged into epochs: last writer wins per field, SNRs pooled, motion canonical."""
    out = merge_epochs(_attached(spark, sf_dir), ["device"], "event_id")
    doubles = [n for n, t in out.dtypes if t == "double" and n != "utc_time"]
    return rounded(out, doubles)


def _epoch_merge_sql() -> str:
    fields = ", ".join(
        f"arg_max_null({n}, event_id) FILTER (WHERE source IN ({', '.join(repr(s) for s in sources)})) AS {n}"
        for n, sources in FIELD_SOURCES.items()
    )
    names = list(FIELD_SOURCES)
    return f"""{ATTACH_SQL},
merged AS (SELECT device, utc_time, {fields} FROM attached GROUP BY device, utc_time),
snr AS (
  SELECT device, utc_time, avg(s) AS mean_snr, stddev_pop(s) AS std_snr, min(s) AS min_snr, max(s) AS max_snr, count(s) AS num_sats_with_snr
  FROM (SELECT device, utc_time, unnest(snrs) AS s FROM attached) GROUP BY device, utc_time
)
SELECT device, utc_time, {', '.join(f'round({n}, 6) AS {n}' for n in names)},
       round(mean_snr, 6) AS mean_snr, round(std_snr, 6) AS std_snr, min_snr, max_snr, coalesce(num_sats_with_snr, 0) AS num_sats_with_snr,
       round(coalesce(sog_rmc_knots, sog_vtg_knots), 6) AS sog_knots, round(coalesce(cog_rmc_deg, cog_true), 6) AS cog_deg
FROM merged LEFT JOIN snr USING (device, utc_time)"""


QUERIES = {
    "nmea_checksum": Query(nmea_checksum, NMEA_CHECKSUM_SQL),
    **{f"nmea_parse_{fmt.lower()}": _parse_query(fmt) for fmt in ("RMC", "GGA", "GSA", "VTG")},
    "gsv_snr_stats": Query(gsv_snr_stats, GSV_SQL),
    "log_prefix_split": Query(log_prefix_split, LOG_PREFIX_SQL),
    "clock_carry": Query(clock_carry, CLOCK_CARRY_SQL),
    "anchor_carry": Query(anchor_carry, ANCHOR_CARRY_SQL),
    "epoch_merge": Query(epoch_merge, _epoch_merge_sql()),
}
