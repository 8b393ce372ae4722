"""Neighbour look-ups, pairing, windows and features against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from navspark.operators.asof import nearest_asof
from navspark.operators.dynamics import align_epochs, epoch_frame, with_derived, with_pairs
from navspark.operators.features import recording_features
from navspark.operators.windows import pair_baseline, sliding_windows, window_features
from navspark.schema import RAW_KEYS, feature_names


def random_track(seed, n=160, phase=0.55, recordings=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for rec in recordings:
        for rx, shift in ((1, 0.0), (2, phase)):
            times = np.cumsum(rng.choice([1.0, 1.0, 1.0, 2.0, 25.0], n, p=[0.4, 0.3, 0.2, 0.08, 0.02])) + 5000 + shift
            for t in times:
                row = {"recording": rec, "receiver": rx, "utc_time": float(t)}
                for key in ("lat_deg", "lon_deg", *RAW_KEYS):
                    row[key] = None if rng.random() < 0.05 else float(rng.normal(40, 0.01))
                row["sog_knots"] = None if rng.random() < 0.05 else float(rng.uniform(0, 20))
                row["cog_deg"] = None if rng.random() < 0.05 else float(rng.uniform(0, 360))
                row["num_sats_with_snr"] = int(rng.integers(0, 9))
                rows.append(row)
    return pd.DataFrame(rows)


def to_spark(spark, pdf):
    kinds = {"recording": "string", "receiver": "int", "num_sats_with_snr": "bigint"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in pdf.columns)
    clean = pdf.astype(object).where(pdf.notna(), None)
    for c, kind in kinds.items():
        if c in clean and kind != "string":
            clean[c] = clean[c].map(int)
    return spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)], schema)


def dist(a, b, c, d):
    if any(v is None or math.isnan(v) for v in (a, b, c, d)):
        return math.nan
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def turn(a, b):
    if math.isnan(a) or math.isnan(b):
        return math.nan
    g = abs(a - b) % 360
    return min(g, 360 - g)


def expected_pairs(rx1, rx2, tol):
    """For each receiver-1 row: distance, speed and course difference to the nearest partner."""
    out = []
    for e in rx1.itertuples():
        best = None
        for m in rx2.itertuples():
            gap = abs(m.utc_time - e.utc_time)
            if best is None or gap < best[0] or (gap == best[0] and m.utc_time > best[1].utc_time):
                best = (gap, m)
        if best is None or best[0] > tol:
            out.append((math.nan,) * 3)
            continue
        m = best[1]
        la, lo, dt = m.lat_deg, m.lon_deg, e.utc_time - m.utc_time
        if dt != 0 and not any(math.isnan(v) for v in (m.sog_knots, m.cog_deg, la, lo)):
            run = m.sog_knots * 0.514444 * dt
            la = la + run * math.cos(math.radians(m.cog_deg)) / 111320
            lo = lo + run * math.sin(math.radians(m.cog_deg)) / (111320 * max(math.cos(math.radians(la)), 1e-6))
        out.append((dist(e.lat_deg, e.lon_deg, la, lo), abs(e.sog_knots - m.sog_knots), turn(e.cog_deg, m.cog_deg)))
    return np.array(out, dtype=float).reshape(-1, 3)


def five(values):
    v = np.asarray(values, dtype=float)
    v = v[~np.isnan(v)]
    return [np.nan] * 5 if not len(v) else [v.mean(), v.std(), v.min(), v.max(), np.median(v)]


def same(got, want, tol=1e-6):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert got.shape == want.shape
    assert np.array_equal(np.isnan(got), np.isnan(want))
    ok = ~np.isnan(got)
    assert np.allclose(got[ok], want[ok], rtol=1e-9, atol=tol)


@pytest.mark.parametrize("segment_s", [7.0, 60.0, 1e6])
def test_alignment_does_not_depend_on_segments(spark, segment_s):
    pdf = random_track(1)
    rows = with_pairs(align_epochs(to_spark(spark, pdf), ["recording"], segment_s), tol=0.5).where("receiver = 1")
    got = rows.select("recording", "utc_time", "inter_rx_distance_m", "inter_rx_sog_diff", "inter_rx_cog_diff").toPandas()
    for rec, part in pdf.groupby("recording"):
        rx1, rx2 = part[part.receiver == 1], part[part.receiver == 2]
        mine = got[got.recording == rec].sort_values("utc_time").iloc[:, 2:].to_numpy(dtype=float)
        same(mine, expected_pairs(rx1.sort_values("utc_time"), rx2, 0.5))


@pytest.mark.parametrize("segment_s", [9.0, 1e6])
def test_previous_epoch_per_receiver(spark, segment_s):
    pdf = random_track(2)
    frame = epoch_frame(to_spark(spark, pdf), ["recording"], segment_s).toPandas()
    for _, part in frame.groupby(["recording", "receiver"]):
        part = part.sort_values("utc_time")
        same(part.time_delta, part.utc_time.diff())
        jump = [math.nan] + [
            dist(a.lat_deg, a.lon_deg, b.lat_deg, b.lon_deg)
            for a, b in zip(part.iloc[:-1].itertuples(), part.iloc[1:].itertuples())
        ]
        same(part.position_jump_m, jump)
        same(part.computed_sog_knots, np.array(jump) / part.utc_time.diff() * 1.94384)
        turns = [math.nan] + [turn(a, b) for a, b in zip(part.cog_deg.iloc[1:], part.cog_deg.iloc[:-1])]
        same(part.cog_change_rate, np.array(turns) / part.utc_time.diff().to_numpy())
    assert len(frame) == len(pdf) and len(frame.columns) == 1 + 28


@pytest.mark.parametrize("tie,expected", [("later", 11.0), ("earlier", 9.0)])
def test_tie_and_inclusive_tolerance(spark, tie, expected):
    left = spark.createDataFrame([("r", 10.0), ("r", 20.0), ("r", 30.0), ("other", 10.0)], "k string, t double")
    right = spark.createDataFrame([("r", 9.0, 1), ("r", 11.0, 2), ("r", 21.0, 3)], "k string, t double, v int")
    got = {
        (r["k"], r["t"]): r["match"]
        for r in nearest_asof(left, right, ["k"], "t", ["v"], 1.0, tie, segment_s=4.0).collect()
    }
    assert got[("r", 10.0)]["t"] == expected
    assert got[("r", 20.0)]["v"] == 3  # exactly at the tolerance
    assert got[("r", 30.0)] is None and got[("other", 10.0)] is None


def features_by_hand(rx1, rx2, tol=0.5):
    primary = rx1 if len(rx1) else rx2
    primary = primary.sort_values("utc_time")
    out = {}
    for key in RAW_KEYS:
        for stat, value in zip(("mean", "std", "min", "max", "median"), five(primary[key])):
            out[f"{key}_{stat}"] = value
    dt = primary.utc_time.diff().to_numpy()[1:]
    jump = [
        dist(a.lat_deg, a.lon_deg, b.lat_deg, b.lon_deg)
        for a, b in zip(primary.iloc[:-1].itertuples(), primary.iloc[1:].itertuples())
    ]
    for stat, value in zip(("mean", "std", "min", "max", "median"), five(jump)):
        out[f"position_jump_m_{stat}"] = value
    for stat, value in zip(("mean", "std", "min", "max", "median"), five(dt)):
        out[f"time_delta_{stat}"] = value
    out["clock_regularity"] = out["time_delta_std"]
    pairs = expected_pairs(rx1.sort_values("utc_time"), rx2, tol) if len(rx1) and len(rx2) else np.full((1, 3), np.nan)
    for i, key in enumerate(("inter_rx_distance_m", "inter_rx_sog_diff", "inter_rx_cog_diff")):
        for stat, value in zip(("mean", "std", "min", "max", "median"), five(pairs[:, i])):
            out[f"{key}_{stat}"] = value
    out["n_epochs_rx1"], out["n_epochs_rx2"] = len(rx1), len(rx2)
    return out


def test_recording_features(spark):
    """Recording 'c' has only a second receiver."""
    pdf = random_track(3, n=60, recordings=("a", "b", "c"))
    pdf = pdf[~((pdf.recording == "c") & (pdf.receiver == 1))]
    table = recording_features(to_spark(spark, pdf), ["recording"], "full").toPandas()
    assert list(table.columns) == ["recording", *feature_names("full")]
    assert len(table) == 3
    for row in table.to_dict("records"):
        part = pdf[pdf.recording == row["recording"]]
        for name, value in features_by_hand(part[part.receiver == 1], part[part.receiver == 2]).items():
            same([row[name]], [value])


def test_window_features_equal_recomputing_inside(spark):
    pdf = random_track(4, n=150)
    window, stride, least = 40.0, 20.0, 8
    got = window_features(
        to_spark(spark, pdf), ["recording"], window, stride, least, "full", segment_s=15.0
    ).toPandas()
    seen = 0
    for rec, part in pdf.groupby("recording"):
        rx1, rx2 = part[part.receiver == 1], part[part.receiver == 2]
        start, end = rx1.utc_time.min(), rx1.utc_time.max()
        while start + window <= end + 1e-9:
            w1 = rx1[(rx1.utc_time >= start) & (rx1.utc_time < start + window)]
            w2 = rx2[(rx2.utc_time >= start) & (rx2.utc_time < start + window)]
            mine = got[(got.recording == rec) & (got.window_start == start)]
            if len(w1) < least:
                assert mine.empty
            else:
                assert len(mine) == 1
                row = mine.iloc[0]
                for name, value in features_by_hand(w1, w2).items():
                    same([row[name]], [value])
                assert row["n_epochs_win"] == len(w1)
                seen += 1
            start += stride
    assert seen == len(got) >= 15
    grid = sliding_windows(to_spark(spark, pdf), ["recording"], window, stride, least)
    assert grid.count() == seen


def test_circular_spread_and_baseline(spark):
    from navspark.operators.windows import circular_std_deg

    df = spark.createDataFrame([(359.0,), (1.0,), (2.0,), (None,)], "a double")
    assert df.agg(circular_std_deg("a")).first()[0] == pytest.approx(1.2472561, abs=1e-6)
    assert df.limit(1).agg(circular_std_deg("a")).first()[0] is None
    w = spark.createDataFrame([("c", 1.0), ("c", 2.0), ("c", 4.0), ("c", None)], "cruise_id string, inter_rx_distance_m_median double")
    row = pair_baseline(w, ["cruise_id"]).first()
    assert (row["median"], row["mad"], row["n"]) == (2.0, 1.0, 3)


def test_midnight_repair(spark):
    df = spark.createDataFrame(
        [(86399.0, 40.0, 1.0, 1.0, 1.0, 0.5)], "prev_t double, lat_deg double, lon_deg double, sog_knots double, cog_deg double, utc_time double"
    ).withColumn("prev", F.struct(F.col("prev_t").alias("utc_time"), "lat_deg", "lon_deg", "cog_deg"))
    assert with_derived(df).first()["time_delta"] == 1.5
