import gzip
import json
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from navspark.operators.dynamics import align_epochs, epoch_frame, with_pairs
from navspark.operators.features import recording_features
from navspark.operators.windows import sliding_windows, window_features
from navspark.plans.cruise import baseline_document, log_windows, prepare_cruise
from navspark.plans.extract import error_rows, extract_features, label_balance
from navspark.schema import META_COLUMNS, feature_names
from navspark.sources.pcap import RECEIVERS, capture_epochs, read_captures
from navspark.sources.r2r import discover_files, earliest_per_bucket, read_pair
from navspark.sources.tables import read_feature_table, read_manifest, read_predictions
from navspark.sources.textlog import interleaved_epochs, read_lines
from tests.makers import SNRS, Ferry, Sighting, capture, capture_ng, checked, datagram, save_lines

DAY = datetime(2021, 3, 7, tzinfo=timezone.utc)
SECONDS = 75


def of_day(t):
    return (DAY + timedelta(seconds=t)).timestamp()


# --- captures ---------------------------------------------------------------------------


def first_second(link="ethernet"):
    return [datagram(Sighting(19800.0).gga(), ip, port, link) for ip, port in RECEIVERS]


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    """Ten files of one crossing and its fragments: every format, and every way to be broken."""
    root = tmp_path_factory.mktemp("crossing")
    whole = list(Ferry().datagrams(SECONDS))
    foreign = [datagram(Sighting(1.0).vtg(), "172.16.0.3", 9), b"", bytes(33)]
    files = {
        "plain.pcap": capture(whole),
        "nano_big.pcap": capture(whole[:36], ">", 0xA1B23C4D),
        "modern.pcapng": capture_ng(whole),
        "modern_big.pcapng": capture_ng(first_second(), ">"),
        "packed.pcap.gz": gzip.compress(capture(whole[:60])),
        "cooked.pcap": capture(first_second("cooked"), link=113),
        "vlan.pcap": capture(foreign + first_second("tagged")),
        "cut.pcap": capture(whole[:24])[:-11],
        "cut.pcapng": capture_ng(whole[:24])[:-11],
        "text.pcap": b"#!/bin/sh\necho this is no capture\n",
    }
    for name, content in files.items():
        (root / name).write_bytes(content)
    names = [*files, "nowhere.pcap"]
    manifest = [
        {"filename": n, "scenario": "A2" if i < 4 else "A3", "label": "unspoofed" if i % 3 else "spoofed", "index": i,
         "parameters": [{}, {"delay": 0.5}, {"delay": "2", "power": 1}][i % 3]}
        for i, n in enumerate(names)
    ]
    (root / "dataset.json").write_text(json.dumps(manifest))
    return root


@pytest.mark.parametrize("name", ["plain.pcap", "modern.pcapng"])
def test_a_crossing_from_capture_to_features(spark, recordings, name):
    epochs, status = capture_epochs(read_captures(spark, [str(recordings / name)]), validate_checksums=True)
    assert status.select("read_status", "n_packets").first() == ("ok", 2 * 6 * SECONDS)
    epochs = epochs.withColumnRenamed("path", "recording").cache()
    rows = epochs.where("receiver = 2").orderBy("utc_time").collect()
    assert [r["utc_time"] for r in rows] == [Ferry.start + k for k in range(SECONDS)]
    for r in rows:
        assert (r["mean_snr"], r["min_snr"], r["max_snr"], r["num_sats_with_snr"]) == (np.mean(SNRS), min(SNRS), max(SNRS), len(SNRS))
        assert r["std_snr"] == pytest.approx(np.std(SNRS))
        assert (r["sog_knots"], r["cog_deg"], r["pdop"], r["hdop"]) == (11.0, 300.0, 2.6, 1.4)
    features = recording_features(epochs, ["recording"], "full").first().asDict()
    assert set(features) == {"recording", *feature_names("full")}
    assert features["n_epochs_rx1"] == features["n_epochs_rx2"] == SECONDS
    # The antennas are 9 m apart and slide 8 cm a second.
    apart = 9.0 + 0.08 * np.arange(SECONDS)
    for stat, value in (("min", apart[0]), ("max", apart[-1]), ("mean", apart.mean()), ("median", np.median(apart))):
        assert features[f"inter_rx_distance_m_{stat}"] == pytest.approx(value, abs=0.05)
    assert features["mean_snr_mean"] == np.mean(SNRS) and features["inter_rx_sog_diff_max"] == 0.0
    assert set(recording_features(epochs, ["recording"], "deployable").columns) == {"recording", *feature_names("deployable")}
    assert epoch_frame(epochs, ["recording"]).count() == 2 * SECONDS


def test_every_file_keeps_a_row(spark, recordings, tmp_path):
    table = extract_features(spark, str(recordings), epochs_dir=str(tmp_path / "series"), out_path=str(tmp_path / "table"))
    rows = {r["filename"]: r for r in table.collect()}
    counts = {name: (r["read_status"], r["n_epochs_rx1"]) for name, r in rows.items()}
    assert counts == {
        "plain.pcap": ("ok", SECONDS), "modern.pcapng": ("ok", SECONDS), "nano_big.pcap": ("ok", 3), "packed.pcap.gz": ("ok", 5),
        "modern_big.pcapng": ("ok", 1), "cooked.pcap": ("ok", 1), "vlan.pcap": ("ok", 1),
        "cut.pcap": ("truncated", 2), "cut.pcapng": ("truncated", 2),
        "text.pcap": ("not a capture file", None), "nowhere.pcap": ("missing", None),
    }
    failed = {r["filename"]: r["_error"] for r in error_rows(table).collect()}
    assert failed == {"text.pcap": "not a capture file", "nowhere.pcap": "missing"}
    assert rows["text.pcap"]["hdop_mean"] is None and rows["cut.pcap"]["hdop_mean"] == 1.4
    assert table.columns[: len(META_COLUMNS)] == META_COLUMNS and table.columns[-1] == "_error"
    middle = table.columns[len(META_COLUMNS) : -3]
    assert middle == sorted(middle) and set(feature_names("full")) <= set(middle)
    assert {r["label"]: r["count"] for r in label_balance(table).collect()} == {"spoofed": 4, "unspoofed": 7}
    written = read_feature_table(spark, str(tmp_path / "table"), "parquet")
    assert {r["filename"] for r in written.select("filename").collect()} == set(rows) - set(failed)
    series = spark.read.parquet(str(tmp_path / "series"))
    assert series.where("recording = 'modern.pcapng'").count() == 2 * SECONDS and "scenario" in series.columns


def test_manifest(spark, recordings, tmp_path):
    rows = {r["index"]: r for r in read_manifest(spark, str(recordings / "dataset.json")).collect()}
    parameters = lambda r: tuple(r[f"param_{k}_{part}"] for k in (1, 2) for part in ("name", "value"))
    assert parameters(rows[0]) == (None, None, None, None)
    assert parameters(rows[1]) == ("delay", 0.5, None, None)
    assert parameters(rows[2]) == ("delay", 2.0, "power", 1.0)
    entry = {"filename": "f", "scenario": "A4", "label": "spoofed", "index": 0, "parameters": dict.fromkeys("pqr", 1)}
    (tmp_path / "m.json").write_text(json.dumps([entry]))
    with pytest.raises(Exception, match="more than two parameters"):
        read_manifest(spark, str(tmp_path / "m.json")).collect()


def test_feature_and_verdict_tables(spark, tmp_path):
    save_lines(tmp_path / "t.csv", ["filename,scenario,label,index,gap_max,_error", "u,A2,spoofed,0,,", "v,A2,spoofed,1,8,late", "w,A3,unspoofed,2,-2.25,"])
    found = {r["filename"]: r["gap_max"] for r in read_feature_table(spark, str(tmp_path / "t.csv")).collect()}
    assert found == {"u": None, "w": -2.25}
    save_lines(tmp_path / "v.csv", ["filename,says", "u,0", "v,n/a", "w,1"])
    verdicts = read_predictions(spark, str(tmp_path / "v.csv"), "says")
    assert {r["filename"]: r["baseline_pred"] for r in verdicts.collect()} == {"u": 0.0, "v": None, "w": 1.0}


# --- interleaved logs -------------------------------------------------------------------


def stamp(style, t):
    at = DAY + timedelta(seconds=t)
    return at.strftime("%m/%d/%Y,%H:%M:%S.") + f"{at.microsecond // 1000:03d}," if style == "scs" else at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z "


def logged(style, seconds, receiver=1, delay=0.25):
    """Positions and motion once a second, each line stamped a quarter of a second late."""
    ferry = Ferry()
    for k in range(seconds):
        s = ferry.at(ferry.start + k, receiver)
        yield stamp(style, s.t + delay) + s.gga()
        yield stamp(style, s.t + delay + 0.02) + s.vtg()


def epochs_of(spark, folder, **options):
    lines = read_lines(spark, str(folder)).withColumn("unit", F.lit("u1"))
    return interleaved_epochs(lines, ["unit"], **options)


@pytest.mark.parametrize("style", ["scs", "iso"])
def test_interleaved_logs(spark, tmp_path, style):
    save_lines(tmp_path / "log" / "day.log", ["*** logger started", *logged(style, 310), stamp(style, 1.0) + "$GPVTG,brok"])
    epochs = epochs_of(spark, tmp_path / "log").withColumn("receiver", F.lit(1)).cache()
    times = sorted(r["utc_time"] for r in epochs.collect())
    assert times == [of_day(Ferry.start + k) for k in range(310)]
    assert epochs.where("sog_knots <> 11 OR cog_deg <> 300").count() == 0
    # Windows of 120 s every 60 s fit at 0, 60, 120 and 180 s into 309.
    assert sliding_windows(epochs, ["unit"], 120, 60, 60).count() == 4
    row = window_features(epochs, ["unit"], tags=False).first()
    assert row["cog_deg_mean"] == pytest.approx(300.0) and row["inter_rx_distance_m_median"] is None


def test_who_owns_a_line(spark, tmp_path):
    """Motion belongs to the last readable position before it; the last writer of a field wins."""
    noon = 43200.0
    quiet = lambda k: Sighting(noon + k, knots=2.0 + k, course=20.0 * k)
    empty = checked("GPGGA,120004.00,,N,01009.0,E,1,05,1.4,18.2,M,44.1,M,,")
    clockless = checked("GPGGA,,5419.2,N,01009.0,E,1,06,1.4,18.2,M,44.1,M,,")
    spoiled = Sighting(3.0).gga()[:-2] + "ZZ"
    save_lines(tmp_path / "log" / "a.log", [
        stamp("scs", noon + 3) + quiet(9).vtg(),        # nothing to belong to
        stamp("scs", noon + 4) + quiet(4).rmc(),
        stamp("scs", noon + 4) + empty,                 # same second: its empty latitude is the last word
        stamp("scs", noon + 4) + quiet(1).vtg(),
        stamp("scs", noon + 5) + clockless,             # no clock, no epoch
        stamp("scs", noon + 5) + quiet(2).vtg(),        # so this is still the second before
        stamp("scs", 86400 + noon) + spoiled,           # rejected, yet the logger's clock moves on a day
        quiet(8).gga(),                                 # no stamp of its own
    ])
    first, second = epochs_of(spark, tmp_path / "log").orderBy("utc_time").collect()
    assert first["utc_time"] == of_day(noon + 4) and second["utc_time"] == of_day(86400 + noon + 8)
    assert first["lat_deg"] is None and first["num_satellites"] == 5
    assert first["cog_true"] == 40.0 and first["sog_knots"] == 6.0
    assert second["lat_deg"] == pytest.approx(54.32)


def test_splits_do_not_matter(spark, tmp_path):
    save_lines(tmp_path / "log" / "a.log", logged("iso", 90))
    rows = lambda: sorted(map(str, epochs_of(spark, tmp_path / "log").collect()))
    whole, keys = rows(), {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert read_lines(spark, str(tmp_path / "log")).select("block").distinct().count() >= 4
        assert rows() == whole and len(whole) == 90
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_windows_of_a_cruise_folder(spark, tmp_path):
    lines = list(logged("iso", 250))
    save_lines(tmp_path / "in" / "north" / "rx1" / "1.log", lines[:200])
    save_lines(tmp_path / "in" / "north" / "rx1" / "2.log", lines[200:])
    save_lines(tmp_path / "in" / "north" / "rx2" / "only.log", logged("scs", 250, receiver=2))
    windows = log_windows(spark, str(tmp_path / "in"), str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r["cruise_id"], r["window_start"]) for r in windows] == [("north", of_day(Ferry.start + 60 * k)) for k in range(3)]
    for k, r in enumerate(windows):
        assert r["n_epochs_rx1"] == r["n_epochs_rx2"] == 120
        assert r["inter_rx_distance_m_min"] == pytest.approx(9 + 0.08 * 60 * k, abs=0.05)
        assert set(r.asDict()) == {"cruise_id", "window_start", *feature_names("deployable")}


# --- split-family archives --------------------------------------------------------------

DELAY, RUN = 0.45, 260


def family_file(folder, unit, family, lines, copy=""):
    save_lines(folder / f"COM{unit}-{family}-RAW_20210307-053000{copy}.raw", lines)


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """Bridge: positions five times, RMC once, motion every other second. Mast: all once, 0.4 s later in the second, 22 m apart."""
    root = tmp_path_factory.mktemp("archive")
    ferry = Ferry(beam_m=22.0, slide_mps=0.0)

    def write(folder, unit, receiver, ticks, talker):
        for family, times in ticks.items():
            sightings = [ferry.at(ferry.start + t, receiver, talker) for t in times]
            family_file(folder, unit, family, [stamp("scs", s.t + DELAY) + getattr(s, family.lower())() for s in sightings])

    bridge, mast = root / "bridge", root / "mast" / "raw"
    write(bridge, "3-NAVBOX", 1, {"GGA": [k / 5 for k in range(5 * RUN)], "RMC": range(RUN), "VTG": range(0, RUN, 2)}, "GN")
    write(mast, "44-Top9", 2, {f: [k + 0.4 for k in range(RUN)] for f in ("GGA", "RMC", "VTG")}, "GP")
    family_file(bridge, "3-NAVBOX", "GGA", ["a second download"], "_2")
    family_file(bridge, "3-NAVBOX", "ZDA", ["not wanted"])
    return str(bridge), str(root / "mast")


def test_archive_discovery(spark, archive):
    found = discover_files(spark, archive[0]).collect()
    assert {r["family"]: r["path"].rpartition("-")[2] for r in found} == dict.fromkeys(("GGA", "RMC", "VTG"), "053000.raw")
    assert {r["stamp"] for r in found} == {"20210307-053000"}


def test_archive_epochs(spark, archive):
    epochs, stats = read_pair(spark, "leg", *archive)
    epochs = epochs.cache()
    for r in stats.collect():
        own = epochs.where(F.col("receiver") == r["receiver"])
        phase, every = (0.0, 2) if r["receiver"] == 1 else (0.4, 1)
        times = sorted(x["utc_time"] for x in own.collect())
        assert times == pytest.approx([of_day(Ferry.start + k + phase) for k in range(RUN)], abs=1e-3)
        assert r["n_epochs"] == RUN and r["lag_s"] == pytest.approx(DELAY, abs=0.005)
        assert (r["attached"], r["attach_dropped"]) == (RUN // every, 0)
        assert own.where("cog_true = 300").count() == RUN // every
    gaps = with_pairs(align_epochs(epochs, ["cruise_id"])).where("inter_rx_distance_m IS NOT NULL")
    # The 0.4 s between their epochs are bridged by the motion; what is left is the beam.
    assert gaps.agg(F.median("inter_rx_distance_m")).first()[0] == pytest.approx(22.0, abs=0.1)


def test_prepared_cruise(spark, archive, tmp_path):
    result = prepare_cruise(spark, "leg", *archive, out_dir=str(tmp_path))
    rows = result["windows"].collect()
    assert len(rows) == 3 and all(r["transit_tag"] == 1 for r in rows)
    document = json.loads(spark.read.text(str(tmp_path / "leg" / "baseline.json"), wholetext=True).first()[0])
    assert document["cruise_id"] == "leg" and document["n_windows"] == 3
    assert document["rx2_stats"]["n_epochs"] == RUN
    assert document["inter_rx_distance_m"]["median"] == pytest.approx(22.0, abs=0.1)
    assert "inter_rx_distance_m" not in baseline_document(prepare_cruise(spark, "leg", archive[1]), "leg")


def test_attachment_rules(spark, tmp_path):
    """A line goes to the nearest position within 0.6 s, the earlier of two equally near; the first to arrive stays."""
    turn = lambda at, course: stamp("scs", at) + Sighting(0, course=course).vtg()
    family_file(tmp_path, "5-X", "GGA", [stamp("scs", k) + Sighting(float(k)).gga() for k in (7, 8, 9)])
    family_file(tmp_path, "5-X", "VTG", [turn(8.5, 80.0), turn(7.9, 70.0), turn(20.0, 10.0), Sighting(0).vtg()])
    epochs, stats = read_pair(spark, "c", str(tmp_path))
    assert {r["utc_time"] - of_day(0): r["cog_true"] for r in epochs.collect()} == {7.0: None, 8.0: 80.0, 9.0: None}
    only = stats.first()
    assert (only["lag_s"], only["attached"], only["attach_dropped"], only["n_epochs"]) == (0.0, 2, 2, 3)


def test_a_device_without_external_clock_keeps_its_rows(spark, tmp_path):
    family_file(tmp_path, "6-Y", "GGA", [Sighting(float(k)).gga() for k in range(4)])
    family_file(tmp_path, "6-Y", "VTG", [Sighting(0).vtg()])
    epochs, stats = read_pair(spark, "c", str(tmp_path))
    assert epochs.count() == 4
    only = stats.first()
    assert (only["lag_s"], only["attached"], only["attach_dropped"], only["n_epochs"]) == (0.0, 0, 1, 4)


def test_archive_without_files(spark, tmp_path):
    save_lines(tmp_path / "readme.md", ["empty"])
    assert [part.count() for part in read_pair(spark, "c", str(tmp_path))] == [0, 0]


def test_decimation_keeps_the_earliest(spark):
    rows = spark.createDataFrame([("p", 5.6), ("q", 6.5), ("p", 5.25), ("p", 6.0)], "who string, at double")
    kept = sorted(tuple(r) for r in earliest_per_bucket(rows, ["who"], "at").collect())
    assert kept == [("p", 5.25), ("p", 6.0), ("q", 6.5)]


def test_staged_tables_are_deleted_on_request(spark):
    from navspark.session import clear_staging, run_folder, stage

    kept = stage(spark.range(3), "some")
    assert kept.count() == 3
    folder = run_folder(spark).removeprefix("file:")
    assert any(p.name.startswith("some-") for p in __import__("pathlib").Path(folder).iterdir())
    other = f"{folder}-not-this-one"
    spark.range(1).write.parquet(other)
    clear_staging(spark)
    assert not __import__("os").path.exists(folder) and __import__("os").path.exists(other)
