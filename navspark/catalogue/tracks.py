"""Track queries: ``events`` read as the epochs of two receivers per recording.

``recording`` is the event type and the parity of the user picks the receiver.
Events span 30 days, so windows and tolerances are scaled from seconds to hours.
The column expressions are plain SQL that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navspark.catalogue import MICROS, Query, read, rounded
from navspark.operators.asof import nearest_asof
from navspark.operators.dynamics import align_epochs, epoch_frame, with_pairs
from navspark.operators.features import recording_features
from navspark.operators.inject import inject
from navspark.operators.neighbours import with_span
from navspark.operators.ordered import exact_quantiles
from navspark.operators.windows import (
    assign_windows,
    circular_std_deg,
    pair_baseline,
    sliding_windows,
    window_features,
)
from navspark.schema import DERIVED_KEYS, PAIR_KEYS, STATS, drop_families, feature_names, series_keys

WINDOW_S = 86400.0
STRIDE_S = 43200.0
MIN_EPOCHS = 4
TOL_S = 1200.0
TRANSIT_SOG = 8.0
TRANSIT_COG = 150.0

# A scale without a short decimal form keeps averages off the exact rounding ties.
READING = "value * 0.99731415926535e0"

# Epoch fields derived from an event; readable by both engines.
FIELDS = {
    "lat_deg": "CASE WHEN value < 1 THEN NULL ELSE 40 + value / 1000 END",
    "lon_deg": "29 + user_id / 1000e0",
    "sog_knots": "CASE WHEN value > 60 THEN NULL ELSE value % 20 END",
    "cog_deg": "CASE WHEN value > 90 THEN NULL ELSE (value * 7) % 360 END",
    "num_satellites": "CAST(6 + user_id % 7 AS DOUBLE)",
    "hdop": "0.5e0 + (value % 10) / 10",
    "altitude": "value / 8",
    "pdop": "1e0 + (value % 5) / 4",
    "hdop_gsa": "0.5e0 + (value % 6) / 16",
    "vdop": "CASE WHEN value < 3 THEN NULL ELSE 1e0 + (value % 7) / 8 END",
    "fix_mode": "CAST(2 + user_id % 2 AS DOUBLE)",
    "mean_snr": "35 + (value % 9)",
    "std_snr": "(value % 4) / 2",
    "min_snr": "30 + (value % 3)",
    "max_snr": "45 + (value % 3)",
    "num_sats_with_snr": "CAST(user_id % 9 AS BIGINT)",
    "sog_vtg_knots": "value % 20",
    "sog_vtg_kmh": "(value % 20) * 1.852e0",
    "cog_true": "(value * 7) % 360",
    "cog_magnetic": "CASE WHEN value >= 0 THEN NULL ELSE value END",
}


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs, one per (recording, receiver, instant); the latest event of an instant wins."""
    events = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("recording"),
        F.expr("CAST(1 + user_id % 2 AS INT)").alias("receiver"),
        F.expr(f"{MICROS} / 1e6").alias("utc_time"),
        "event_id", "user_id", F.expr(READING).alias("value"),
    )
    merged = events.groupBy("recording", "receiver", "utc_time").agg(
        F.max_by("user_id", "event_id").alias("user_id"), F.max_by("value", "event_id").alias("value")
    )
    return merged.selectExpr(
        "recording", "receiver", "utc_time", *[f"{sql} AS {name}" for name, sql in FIELDS.items()]
    )


TRACK_SQL = f"""
track AS (
  SELECT recording, receiver, utc_time, {', '.join(f'{sql} AS {name}' for name, sql in FIELDS.items())}
  FROM (
    SELECT event_type AS recording, CAST(1 + user_id % 2 AS INT) AS receiver, epoch_us(ts) / 1e6 AS utc_time,
           event_id, user_id, {READING} AS value
    FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 2, ts ORDER BY event_id DESC) = 1
  )
)"""


def sql_haversine(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    h = (
        f"(pow(sin(radians({b_lat} - {a_lat}) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat}))"
        f" * pow(sin(radians({b_lon} - {a_lon}) / 2), 2))"
    )
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def sql_angle(a: str, b: str) -> str:
    gap = f"(abs({a} - {b}) % 360)"
    return f"(CASE WHEN {gap} <= 180 THEN {gap} ELSE 360 - {gap} END)"


def sql_bearing(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    east = f"sin(radians({b_lon} - {a_lon})) * cos(radians({b_lat}))"
    north = (
        f"cos(radians({a_lat})) * sin(radians({b_lat}))"
        f" - sin(radians({a_lat})) * cos(radians({b_lat})) * cos(radians({b_lon} - {a_lon}))"
    )
    return f"((degrees(atan2({east}, {north})) + 360) % 360)"


def dynamics_sql(source: str, partition: str, keep: str, name: str) -> str:
    """Two CTEs: ``source`` with lagged columns, then the six derived series."""
    over = f"OVER (PARTITION BY {partition} ORDER BY utc_time)"
    jump = sql_haversine("p_lat", "p_lon", "lat_deg", "lon_deg")
    return f"""
{name}_lag AS (
  SELECT *, lag(utc_time) {over} AS p_t, lag(lat_deg) {over} AS p_lat,
         lag(lon_deg) {over} AS p_lon, lag(cog_deg) {over} AS p_cog
  FROM {source}
),
{name}_dt AS (
  SELECT *, CASE WHEN utc_time - p_t < -80000 THEN utc_time - p_t + 86400 ELSE utc_time - p_t END AS time_delta,
         {jump} AS position_jump_m
  FROM {name}_lag
),
{name} AS (
  SELECT {keep}, position_jump_m,
         CASE WHEN time_delta > 0 THEN position_jump_m / time_delta * 1.94384 END AS computed_sog_knots,
         CASE WHEN time_delta > 0 THEN abs(sog_knots - position_jump_m / time_delta * 1.94384) END AS sog_discrepancy,
         CASE WHEN time_delta > 0 THEN {sql_angle('cog_deg', 'p_cog')} / time_delta END AS cog_change_rate,
         CASE WHEN time_delta > 0 THEN {sql_angle('cog_deg', sql_bearing('p_lat', 'p_lon', 'lat_deg', 'lon_deg'))} END
           AS cog_heading_discrepancy,
         time_delta
  FROM {name}_dt
)"""


def pairing_sql(source: str, partition: str, name: str, keep: str) -> str:
    """CTEs pairing receiver 1 with the nearest receiver-2 epoch and comparing the two."""
    keys = [k.strip() for k in partition.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    b_cols = "b.utc_time AS {p}_t, b.lat_deg AS {p}_lat, b.lon_deg AS {p}_lon, b.sog_knots AS {p}_sog, b.cog_deg AS {p}_cog"
    pick = "(lo_t IS NULL OR abs(hi_t - utc_time) <= abs(lo_t - utc_time))"
    # NULL hi makes the comparison NULL, which falls through to lo.
    cols = ", ".join(f"CASE WHEN {pick} THEN hi_{c} ELSE lo_{c} END AS m_{c}" for c in ("t", "lat", "lon", "sog", "cog"))
    masked = ", ".join(
        f"CASE WHEN abs(m_t - utc_time) <= {TOL_S} THEN m_{c} END AS m_{c}" for c in ("t", "lat", "lon", "sog", "cog")
    )
    movable = "(utc_time <> m_t AND m_sog IS NOT NULL AND m_cog IS NOT NULL AND m_lat IS NOT NULL AND m_lon IS NOT NULL)"
    metres = "(m_sog * 0.514444 * (utc_time - m_t))"
    return f"""
{name}_rx2 AS (SELECT * FROM {source} WHERE receiver = 2),
{name}_lo AS (
  SELECT a.*, {b_cols.format(p='lo')}
  FROM (SELECT * FROM {source} WHERE receiver = 1) a
  ASOF LEFT JOIN {name}_rx2 b ON {on} AND a.utc_time >= b.utc_time
),
{name}_hi AS (
  SELECT a.*, {b_cols.format(p='hi')}
  FROM {name}_lo a ASOF LEFT JOIN {name}_rx2 b ON {on} AND a.utc_time <= b.utc_time
),
{name}_best AS (SELECT * EXCLUDE (lo_t, lo_lat, lo_lon, lo_sog, lo_cog, hi_t, hi_lat, hi_lon, hi_sog, hi_cog), {cols} FROM {name}_hi),
{name}_tol AS (SELECT * EXCLUDE (m_t, m_lat, m_lon, m_sog, m_cog), {masked} FROM {name}_best),
{name}_lat AS (
  SELECT *, CASE WHEN {movable} THEN m_lat + {metres} * cos(radians(m_cog)) / 111320 ELSE m_lat END AS d_lat FROM {name}_tol
),
{name}_lon AS (
  SELECT *, CASE WHEN {movable}
    THEN m_lon + {metres} * sin(radians(m_cog)) / (111320 * greatest(cos(radians(d_lat)), 1e-6)) ELSE m_lon END AS d_lon
  FROM {name}_lat
),
{name} AS (
  SELECT {keep}, m_t AS matched_t, {sql_haversine('lat_deg', 'lon_deg', 'd_lat', 'd_lon')} AS inter_rx_distance_m,
         abs(sog_knots - m_sog) AS inter_rx_sog_diff, {sql_angle('cog_deg', 'm_cog')} AS inter_rx_cog_diff
  FROM {name}_lon
)"""


def stats_sql(keys: list[str]) -> str:
    parts = []
    for k in keys:
        parts += [
            f"avg({k}) AS {k}_mean", f"stddev_pop({k}) AS {k}_std", f"CAST(min({k}) AS DOUBLE) AS {k}_min",
            f"CAST(max({k}) AS DOUBLE) AS {k}_max", f"median({k}) AS {k}_median",
        ]
    return ", ".join(parts)


def round_sql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


# --- queries ---------------------------------------------------------------------------------


def epoch_dynamics(spark, sf_dir):
    frame = epoch_frame(track(spark, sf_dir), ["recording"])
    return rounded(frame.select("recording", "receiver", "utc_time", *DERIVED_KEYS), DERIVED_KEYS)


EPOCH_DYNAMICS_SQL = f"""
WITH {TRACK_SQL}, {dynamics_sql('track', 'recording, receiver', 'recording, receiver, utc_time', 'dyn')}
SELECT recording, receiver, utc_time, {round_sql(DERIVED_KEYS)} FROM dyn"""


def nearest_pairing(spark, sf_dir):
    aligned = align_epochs(track(spark, sf_dir), ["recording"]).where(F.col("receiver") == 1)
    paired = with_pairs(aligned, tol=TOL_S)
    return rounded(paired.select("recording", "utc_time", *PAIR_KEYS), PAIR_KEYS)


NEAREST_PAIRING_SQL = f"""
WITH {TRACK_SQL}, {pairing_sql('track', 'recording', 'pair', 'recording, utc_time')}
SELECT recording, utc_time, {round_sql(PAIR_KEYS)} FROM pair"""


def nearest_attach(spark, sf_dir):
    """Receiver-2 epochs snapped to the nearest receiver-1 epoch, earlier one on ties."""
    epochs = track(spark, sf_dir).select("recording", "receiver", "utc_time", "sog_knots")
    late = epochs.where(F.col("receiver") == 2).select("recording", "utc_time", "sog_knots")
    grid = epochs.where(F.col("receiver") == 1).select(
        "recording", "utc_time", F.col("sog_knots").alias("anchor_sog")
    )
    out = nearest_asof(late, grid, ["recording"], "utc_time", ["anchor_sog"], 600.0, tie="earlier")
    return out.select(
        "recording", "utc_time", "sog_knots",
        F.col("match.utc_time").alias("anchor_t"), F.col("match.anchor_sog").alias("anchor_sog"),
    )


NEAREST_ATTACH_SQL = f"""
WITH {TRACK_SQL},
a AS (SELECT recording, utc_time, sog_knots FROM track WHERE receiver = 2),
b AS (SELECT recording, utc_time, sog_knots FROM track WHERE receiver = 1),
lo AS (SELECT a.*, b.utc_time AS lo_t, b.sog_knots AS lo_s FROM a ASOF LEFT JOIN b
       ON a.recording = b.recording AND a.utc_time >= b.utc_time),
hi AS (SELECT lo.*, b.utc_time AS hi_t, b.sog_knots AS hi_s FROM lo ASOF LEFT JOIN b
       ON lo.recording = b.recording AND lo.utc_time <= b.utc_time),
best AS (SELECT recording, utc_time, sog_knots,
    CASE WHEN lo_t IS NULL OR abs(hi_t - utc_time) < abs(lo_t - utc_time) THEN hi_t ELSE lo_t END AS anchor_t,
    CASE WHEN lo_t IS NULL OR abs(hi_t - utc_time) < abs(lo_t - utc_time) THEN hi_s ELSE lo_s END AS anchor_sog
  FROM hi)
SELECT recording, utc_time, sog_knots,
       CASE WHEN abs(anchor_t - utc_time) <= 600 THEN anchor_t END AS anchor_t,
       CASE WHEN abs(anchor_t - utc_time) <= 600 THEN anchor_sog END AS anchor_sog
FROM best"""


def pair_features(spark, sf_dir):
    """Five statistics of each pair series per recording."""
    from navspark.operators.features import series_statistics

    aligned = align_epochs(track(spark, sf_dir), ["recording"]).where(F.col("receiver") == 1)
    paired = with_pairs(aligned, tol=TOL_S)
    out = series_statistics(
        paired.select("recording", *PAIR_KEYS), ["recording"], PAIR_KEYS,
        [F.count("inter_rx_distance_m").alias("n_distances")],
    )
    names = [f"{k}_{s}" for k in PAIR_KEYS for s in STATS]
    return rounded(out.select("recording", "n_distances", *names), names)


PAIR_FEATURES_SQL = f"""
WITH {TRACK_SQL}, {pairing_sql('track', 'recording', 'pair', 'recording, utc_time')},
agg AS (SELECT recording, count(inter_rx_distance_m) AS n_distances, {stats_sql(PAIR_KEYS)} FROM pair GROUP BY recording)
SELECT recording, n_distances, {round_sql([f'{k}_{s}' for k in PAIR_KEYS for s in STATS])} FROM agg"""


def recording_features_full(spark, sf_dir):
    out = recording_features(track(spark, sf_dir), ["recording"], "full", tol=TOL_S)
    return rounded(out, [n for n in feature_names("full") if not n.startswith("n_epochs")])


def _recording_features_sql(profile: str) -> str:
    raw = [k for k in series_keys(profile) if k not in DERIVED_KEYS + PAIR_KEYS]
    names = [n for n in feature_names(profile) if not n.startswith("n_epochs")]
    single = [n for n in names if not n.startswith("inter_rx") and n != "clock_regularity"]
    keep = ", ".join(dict.fromkeys(["recording", "receiver", "utc_time", *raw]))
    return f"""
WITH {TRACK_SQL},
{dynamics_sql('track', 'recording, receiver', keep, 'dyn')},
{pairing_sql('track', 'recording', 'pair', 'recording, utc_time')},
main AS (
  SELECT recording, {stats_sql(raw + DERIVED_KEYS)}
  FROM dyn JOIN (SELECT recording, min(receiver) AS receiver FROM track GROUP BY recording) USING (recording, receiver)
  GROUP BY recording
),
pairs AS (SELECT recording, {stats_sql(PAIR_KEYS)} FROM pair GROUP BY recording),
sizes AS (
  SELECT recording, count(*) FILTER (WHERE receiver = 1) AS n_epochs_rx1,
         count(*) FILTER (WHERE receiver = 2) AS n_epochs_rx2 FROM track GROUP BY recording
)
SELECT recording, {round_sql(single)}, round(time_delta_std, 6) AS clock_regularity,
       {round_sql([n for n in names if n.startswith('inter_rx')])}, n_epochs_rx1, n_epochs_rx2
FROM main JOIN sizes USING (recording) LEFT JOIN pairs USING (recording)"""


def window_grid_query(spark, sf_dir):
    out = sliding_windows(
        track(spark, sf_dir), ["recording"], WINDOW_S, STRIDE_S, MIN_EPOCHS
    )
    return rounded(out, ["window_start"], 6)


WINDOWS_SQL = f"""
spans AS (SELECT recording, min(utc_time) AS t0, max(utc_time) AS t1 FROM track WHERE receiver = 1 GROUP BY recording),
grid AS (
  SELECT recording, t0 + k * {STRIDE_S} AS window_start
  FROM (SELECT *, unnest(range(0, CAST(floor((t1 - t0) / {STRIDE_S}) AS BIGINT) + 2)) AS k FROM spans)
  WHERE t0 + k * {STRIDE_S} + {WINDOW_S} <= t1 + 1e-9
),
placed AS (
  SELECT track.*, window_start FROM track JOIN grid
    ON track.recording = grid.recording AND utc_time >= window_start AND utc_time < window_start + {WINDOW_S}
)"""

SLIDING_WINDOWS_SQL = f"""
WITH {TRACK_SQL}, {WINDOWS_SQL}
SELECT recording, round(window_start, 6) AS window_start, count(*) AS n_epochs
FROM placed WHERE receiver = 1 GROUP BY recording, window_start HAVING count(*) >= {MIN_EPOCHS}"""


def _windows(spark, sf_dir):
    return window_features(
        track(spark, sf_dir), ["recording"], WINDOW_S, STRIDE_S, MIN_EPOCHS, "deployable", TOL_S,
        TRANSIT_SOG, TRANSIT_COG,
    )


def window_features_query(spark, sf_dir):
    out = _windows(spark, sf_dir)
    names = [n for n in feature_names("deployable") if not n.startswith("n_epochs")]
    return rounded(out, ["window_start", *names, "sog_med_kn", "cog_circ_std_deg"])


def _window_features_ctes() -> str:
    raw = [k for k in series_keys("deployable") if k not in DERIVED_KEYS + PAIR_KEYS]
    keep = ", ".join(dict.fromkeys(["recording", "window_start", "receiver", "utc_time", *raw]))
    circ = (
        "CASE WHEN count(cog_deg) >= 2 THEN degrees(sqrt(-2 * ln(least(greatest(sqrt("
        "pow(avg(sin(radians(cog_deg))), 2) + pow(avg(cos(radians(cog_deg))), 2)), 1e-12), 1)))) END"
    )
    return f"""
WITH {TRACK_SQL}, {WINDOWS_SQL},
{dynamics_sql('placed', 'recording, window_start, receiver', keep, 'dyn')},
{pairing_sql('placed', 'recording, window_start', 'pair', 'recording, window_start, utc_time')},
main AS (
  SELECT recording, window_start, {stats_sql(raw + DERIVED_KEYS)}, {circ} AS cog_circ_std_deg, count(*) AS n_epochs_rx1
  FROM dyn WHERE receiver = 1 GROUP BY recording, window_start HAVING count(*) >= {MIN_EPOCHS}
),
pairs AS (SELECT recording, window_start, {stats_sql(PAIR_KEYS)} FROM pair GROUP BY recording, window_start),
others AS (SELECT recording, window_start, count(*) AS n2 FROM placed WHERE receiver = 2 GROUP BY recording, window_start),
win AS (
  SELECT *, coalesce(n2, 0) AS n_epochs_rx2, time_delta_std AS clock_regularity, n_epochs_rx1 AS n_epochs_win,
         sog_knots_median AS sog_med_kn,
         CAST(coalesce(sog_knots_median >= {TRANSIT_SOG} AND cog_circ_std_deg <= {TRANSIT_COG}, false) AS INT) AS transit_tag
  FROM main LEFT JOIN pairs USING (recording, window_start) LEFT JOIN others USING (recording, window_start)
)"""


_WINDOW_NAMES = [n for n in feature_names("deployable") if not n.startswith("n_epochs")]
WINDOW_FEATURES_SQL = f"""{_window_features_ctes()}
SELECT recording, {round_sql(['window_start', *_WINDOW_NAMES, 'sog_med_kn', 'cog_circ_std_deg'])},
       n_epochs_rx1, n_epochs_rx2, n_epochs_win, transit_tag
FROM win"""


def circular_std_transit(spark, sf_dir):
    """Steady-transit tag per window from median speed and circular course spread."""
    epochs = track(spark, sf_dir).where(F.col("receiver") == 1).select(
        "recording", "receiver", "utc_time", "sog_knots", "cog_deg"
    )
    placed = assign_windows(with_span(epochs, ["recording"], "utc_time", F.lit(True)), WINDOW_S, STRIDE_S)
    keys = ["recording", "window_start"]
    spread = placed.groupBy(*keys).agg(
        circular_std_deg("cog_deg").alias("cog_circ_std_deg"), F.count(F.lit(1)).alias("n_epochs_win")
    )
    speed = exact_quantiles(placed.select(*keys, "sog_knots"), keys, "sog_knots", {"sog_med_kn": 0.5})
    steady = (F.col("sog_med_kn") >= TRANSIT_SOG) & (F.col("cog_circ_std_deg") <= TRANSIT_COG)
    out = (
        spread.join(speed, keys)
        .where(F.col("n_epochs_win") >= MIN_EPOCHS)
        .withColumn("transit_tag", F.coalesce(steady.cast("int"), F.lit(0)))
    )
    return rounded(out, ["window_start", "sog_med_kn", "cog_circ_std_deg"])


CIRCULAR_SQL = f"""{_window_features_ctes()}
SELECT recording, {round_sql(['window_start', 'sog_med_kn', 'cog_circ_std_deg'])}, n_epochs_win, transit_tag FROM win"""


def cruise_baseline_mad(spark, sf_dir):
    return rounded(pair_baseline(_windows(spark, sf_dir), ["recording"]), ["median", "mad"])


CRUISE_BASELINE_SQL = f"""{_window_features_ctes()},
v AS (SELECT recording, inter_rx_distance_m_median AS v FROM win WHERE inter_rx_distance_m_median IS NOT NULL),
c AS (SELECT recording, median(v) AS med, count(*) AS n FROM v GROUP BY recording)
SELECT recording, round(any_value(med), 6) AS median, round(median(abs(v - med)), 6) AS mad, any_value(n) AS n
FROM v JOIN c USING (recording) GROUP BY recording"""


def decimate_buckets(spark, sf_dir):
    """Earliest epoch per hour bucket of each receiver, as the 1 Hz decimation does per second."""
    from navspark.sources.r2r import earliest_per_bucket

    rows = track(spark, sf_dir).select("recording", "receiver", "utc_time", "sog_knots", "lat_deg")
    return earliest_per_bucket(rows, ["recording", "receiver"], "utc_time", 3600.0)


DECIMATE_SQL = f"""
WITH {TRACK_SQL}
SELECT recording, receiver, utc_time, sog_knots, lat_deg FROM track
QUALIFY row_number() OVER (PARTITION BY recording, receiver, floor(utc_time / 3600) ORDER BY utc_time) = 1"""


def logger_lag(spark, sf_dir):
    """Median clock offset per device; here the offset of an event to its full minute."""
    offsets = track(spark, sf_dir).select(
        "recording", "receiver", (F.col("utc_time") - F.floor(F.col("utc_time") / 60) * 60).alias("offset_s")
    )
    out = exact_quantiles(offsets, ["recording", "receiver"], "offset_s", {"lag_s": 0.5})
    return rounded(out, ["lag_s"])


LOGGER_LAG_SQL = f"""
WITH {TRACK_SQL}
SELECT recording, receiver, round(median(utc_time - floor(utc_time / 60) * 60), 6) AS lag_s
FROM track GROUP BY recording, receiver"""


INJECT = {
    "inject_drift": dict(kind="drift", drift_mps=0.5, offset_m=50.0, capture_sigma_m=0.0),
    "inject_replay": dict(kind="replay", drift_mps=0.5, offset_m=50.0, capture_sigma_m=0.0),
    "inject_capture": dict(kind="drift", drift_mps=0.0, offset_m=0.0, capture_sigma_m=0.5),
}


def shared_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs on a shared 10-minute clock, so that both receivers have equal instants."""
    ticks = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("recording"),
        F.expr("CAST(1 + user_id % 2 AS INT)").alias("receiver"),
        F.expr(f"floor({MICROS} / 6e8) * 600e0").alias("utc_time"),
        "event_id", "user_id", "value",
    )
    merged = ticks.groupBy("recording", "receiver", "utc_time").agg(
        F.max_by("user_id", "event_id").alias("user_id"), F.max_by("value", "event_id").alias("value")
    )
    return merged.select(
        "recording", "receiver", "utc_time",
        *[F.expr(FIELDS[c]).alias(c) for c in ("lat_deg", "lon_deg", "sog_knots", "cog_deg")],
    )


SHARED_CLOCK_SQL = f"""
clocked AS (
  SELECT recording, receiver, utc_time, {', '.join(f'{FIELDS[c]} AS {c}' for c in ('lat_deg', 'lon_deg', 'sog_knots', 'cog_deg'))}
  FROM (
    SELECT event_type AS recording, CAST(1 + user_id % 2 AS INT) AS receiver,
           floor(epoch_us(ts) / 6e8) * 600e0 AS utc_time, event_id, user_id, value
    FROM events
    QUALIFY row_number() OVER (
      PARTITION BY event_type, user_id % 2, floor(epoch_us(ts) / 6e8) ORDER BY event_id DESC) = 1
  )
)"""


def _inject_query(name: str):
    def run(spark, sf_dir):
        out = inject(shared_clock(spark, sf_dir), ["recording"], bearing_deg=45.0, onset_frac=0.5, seed=7, **INJECT[name])
        return rounded(out.select("recording", "receiver", "utc_time", "lat_deg", "lon_deg", "attacked"),
                       ["lat_deg", "lon_deg"], 9)

    return run


def _inject_sql(kind: str, drift_mps: float, offset_m: float, capture_sigma_m: float) -> str:
    def noise(axis: str) -> str:
        key = f"md5('7|' || a.recording || '|' || CAST(CAST(round(a.utc_time * 1e6) AS BIGINT) AS VARCHAR) || '|{axis}')"
        u1 = f"((CAST('0x' || substr({key}, 1, 8) AS BIGINT) + 1) / 4294967297e0)"
        u2 = f"(CAST('0x' || substr({key}, 9, 8) AS BIGINT) / 4294967296e0)"
        return f"(sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2}) * {capture_sigma_m})"

    metres = f"({drift_mps} * (utc_time - onset))" if kind == "drift" else f"({offset_m})"
    scale = "(111320 * greatest(cos(radians({lat})), 1e-6))"
    return f"""
WITH {SHARED_CLOCK_SQL},
span AS (SELECT recording, min(utc_time) + 0.5 * (max(utc_time) - min(utc_time)) AS onset FROM clocked GROUP BY recording),
timed AS (SELECT clocked.*, onset, utc_time >= onset AS attacked FROM clocked JOIN span USING (recording)),
captured AS (
  SELECT a.recording, a.receiver, a.utc_time, a.onset, a.attacked,
    CASE WHEN a.receiver = 2 AND a.attacked AND b.utc_time IS NOT NULL
         THEN b.lat_deg + {noise('lat')} / 111320 ELSE a.lat_deg END AS lat_deg,
    CASE WHEN a.receiver = 2 AND a.attacked AND b.utc_time IS NOT NULL
         THEN CASE WHEN b.lat_deg IS NOT NULL
              THEN b.lon_deg + {noise('lon')} / {scale.format(lat='b.lat_deg')} END
         ELSE a.lon_deg END AS lon_deg
  FROM timed a LEFT JOIN (SELECT * FROM clocked WHERE receiver = 1) b
    ON a.recording = b.recording AND a.utc_time = b.utc_time
)
SELECT recording, receiver, utc_time,
  round(CASE WHEN attacked AND lat_deg IS NOT NULL AND lon_deg IS NOT NULL
        THEN lat_deg + {metres} * cos(radians(45)) / 111320 ELSE lat_deg END, 9) AS lat_deg,
  round(CASE WHEN attacked AND lat_deg IS NOT NULL AND lon_deg IS NOT NULL
        THEN lon_deg + {metres} * sin(radians(45)) / {scale.format(lat='lat_deg')} ELSE lon_deg END, 9) AS lon_deg,
  attacked
FROM captured"""


def family_ablation(spark, sf_dir):
    """Recording features with the SNR and GSA families left out by column name."""
    out = recording_features(track(spark, sf_dir), ["recording"], "full", tol=TOL_S)
    kept = drop_families([c for c in out.columns if c != "recording"])
    rounding = [c for c in kept if not c.startswith("n_epochs")]
    return rounded(out.select("recording", *kept), rounding)


def onset_traces(spark, sf_dir):
    """Receiver-1 course and speed against seconds since the start, two recordings per class."""
    from navspark.plans.onset import pick_per_class, receiver_traces

    epochs = track(spark, sf_dir)
    meta = epochs.groupBy("recording").agg(F.min("utc_time").alias("_first")).select(
        F.col("recording").alias("filename"), F.lit("A2").alias("scenario"),
        F.when(F.col("recording").isin("click", "view", "error"), F.lit("spoofed"))
        .otherwise(F.lit("unspoofed")).alias("label"),
    )
    picks = pick_per_class(meta, "A2", 2, order="filename")
    return rounded(receiver_traces(epochs, picks), ["seconds"])


ONSET_SQL = f"""
WITH {TRACK_SQL},
meta AS (SELECT DISTINCT recording AS filename,
    CASE WHEN recording IN ('click', 'view', 'error') THEN 'spoofed' ELSE 'unspoofed' END AS label FROM track),
picks AS (SELECT * FROM meta QUALIFY row_number() OVER (PARTITION BY label ORDER BY filename) <= 2)
SELECT filename, label, round(utc_time - min(utc_time) OVER (PARTITION BY filename), 6) AS seconds, cog_deg, sog_knots
FROM track JOIN picks ON recording = filename WHERE receiver = 1"""


_FULL = _recording_features_sql("full")
_ABLATED = drop_families(feature_names("full"))

QUERIES = {
    "epoch_dynamics": Query(epoch_dynamics, EPOCH_DYNAMICS_SQL),
    "nearest_pairing": Query(nearest_pairing, NEAREST_PAIRING_SQL),
    "nearest_attach": Query(nearest_attach, NEAREST_ATTACH_SQL),
    "pair_features": Query(pair_features, PAIR_FEATURES_SQL),
    "recording_features": Query(recording_features_full, _FULL),
    "sliding_windows": Query(window_grid_query, SLIDING_WINDOWS_SQL),
    "window_features": Query(window_features_query, WINDOW_FEATURES_SQL),
    "circular_std_transit": Query(circular_std_transit, CIRCULAR_SQL),
    "cruise_baseline_mad": Query(cruise_baseline_mad, CRUISE_BASELINE_SQL),
    "decimate_buckets": Query(decimate_buckets, DECIMATE_SQL),
    "logger_lag": Query(logger_lag, LOGGER_LAG_SQL),
    "family_ablation": Query(
        family_ablation, f"SELECT recording, {', '.join(_ABLATED)} FROM ({_FULL}) AS features"
    ),
    "onset_traces": Query(onset_traces, ONSET_SQL),
    **{name: Query(_inject_query(name), _inject_sql(**args)) for name, args in INJECT.items()},
}
