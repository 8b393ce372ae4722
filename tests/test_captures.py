"""Captures read through Spark's data source interface."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

from navspark.sources.captures import CaptureReader, register_captures
from navspark.sources.pcap import RECEIVERS, read_captures

from .makers import capture, capture_ng, datagram

KNOWN = sorted(RECEIVERS, key=RECEIVERS.get)


@pytest.fixture
def folder(spark, tmp_path):
    register_captures(spark)
    packets = [datagram(f"$GPGGA,{i}", *KNOWN[i % 2], "ethernet") for i in range(9)]
    packets.append(datagram("hello", "10.0.0.1", 99, "ethernet"))
    (tmp_path / "below").mkdir()
    (tmp_path / "a.pcap").write_bytes(capture(packets))
    (tmp_path / "below" / "b.pcapng").write_bytes(capture_ng(packets[:4]))
    (tmp_path / "below" / "c.pcap.gz").write_bytes(gzip.compress(capture(packets[:3])))
    (tmp_path / "broken.pcap").write_bytes(capture(packets)[:-5])
    (tmp_path / "notes.txt").write_text("no capture")
    return tmp_path


def load(spark, folder, **options):
    return spark.read.format("gnss_capture").options(**options).load(str(folder))


def test_same_rows_as_the_list_of_files(spark, folder):
    files = [folder / "a.pcap", folder / "below" / "b.pcapng", folder / "below" / "c.pcap.gz", folder / "broken.pcap"]
    expected = read_captures(spark, [str(f) for f in files])
    found = load(spark, folder, filesPerTask=1)
    assert found.rdd.getNumPartitions() == 4
    rows = sorted(map(str, found.select(expected.columns).collect()))
    assert rows == sorted(map(str, expected.collect()))
    by = {r["receiver"]: r["count"] for r in found.where("status IS NULL").groupBy("receiver").count().collect()}
    assert by == {1: 5 + 2 + 2 + 5, 2: 4 + 2 + 1 + 4, None: 1}
    assert {r["status"] for r in found.where("status IS NOT NULL").collect()} == {"ok", "truncated"}


def test_conditions_reach_the_reader(spark, folder):
    found = load(spark, folder, filesPerTask=1)
    one = found.where(F.col("path").endswith("b.pcapng") & (F.col("receiver") == 2))
    assert one.rdd.getNumPartitions() == 1
    assert sorted(bytes(r["payload"]) for r in one.collect()) == [b"$GPGGA,1", b"$GPGGA,3"]
    assert " Filter " not in one._jdf.queryExecution().executedPlan().toString()
    for condition in ("receiver = 1", "receiver IN (1, 7)", "receiver IS NULL", "receiver IS NOT NULL", "receiver = 1 AND receiver = 2", "path LIKE '%below%' AND pkt_no > 0", "path LIKE 'file:%' AND NOT receiver = 1"):
        every = sorted(str(r) for r in load(spark, folder).collect())
        kept = sorted(str(r) for r in spark.createDataFrame(load(spark, folder).collect(), found.schema).where(condition).collect())
        assert sorted(str(r) for r in load(spark, folder).where(condition).collect()) == kept
        assert len(kept) < len(every)


def test_reader_takes_what_it_can_decide(folder):
    reader = CaptureReader({"path": str(folder)})
    rest = GreaterThan(("pkt_no",), 3)
    assert list(reader.pushFilters([EqualTo(("receiver",), 1), rest, StringEndsWith(("path",), "a.pcap")])) == [rest]
    assert [p.rpartition("/")[2] for part in reader.partitions() for p in part.paths] == ["a.pcap"]


def test_own_receivers_single_files_and_nothing(spark, folder):
    own = load(spark, folder / "a.pcap", receivers=json.dumps({"10.0.0.1:99": 5}))
    assert [(bytes(r["payload"]), r["receiver"]) for r in own.where("receiver IS NOT NULL").collect()] == [(b"hello", 5)]
    (folder / "empty").mkdir()
    assert load(spark, folder / "empty").count() == 0
    assert [r["status"] for r in load(spark, folder / "absent.pcap").collect()] == ["missing"]
