"""Packet captures to one row per UDP datagram.

The list of captures is a DataFrame, dealt to tasks a few files each; a capture is decoded front to
back with bounded memory. Labelled recordings are two minutes long, so there are many
small files rather than a few large ones. Everything after the bytes are split into
datagrams is SQL.
"""

from __future__ import annotations

import gzip
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from navspark.functions.nmea import parse_sentences
from navspark.functions.once import computed_once
from navspark.operators.epochs import attach_to_anchor, merge_epochs
from navspark.session import stage

# Capture file signatures (byte order), link types with the length of their header and the place
# of the protocol in it, and the addresses of the two simulated receivers.
SIGNATURES = {
    b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">",
    b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\x3c\x4d": ">",
}
SECTION, SECTION_ORDER = b"\n\r\r\n", {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
INTERFACE_BLOCK, OLD_PACKET_BLOCK, SIMPLE_PACKET_BLOCK, PACKET_BLOCK = 1, 2, 3, 6
GZIP = b"\x1f\x8b"
LINK_RAW, LINK_IPV4, LINK_NULL = 101, 228, 0
LINK_HEADERS = {1: (14, 12), 113: (16, 14), 276: (20, 0)}  # Ethernet, Linux cooked, Linux cooked v2
ETHERTYPE_IPV4, ETHERTYPE_VLAN = 0x0800, (0x8100, 0x88A8)
UDP = 17
RECEIVERS = {("192.168.0.10", 62996): 1, ("192.168.0.11", 62997): 2}
PACKET_SCHEMA = "path string, pkt_no bigint, src_ip string, src_port int, payload binary, status string"
SEGMENT_PACKETS = 100_000
FILES_PER_TASK = 8
_BATCH = 4096
_LARGEST = 1 << 26


def ipv4_offset(packet: bytes, link: int) -> int | None:
    """Where the IPv4 header starts, or None for anything else."""
    if link in (LINK_RAW, LINK_IPV4):
        return 0
    if link == LINK_NULL:
        return 4
    if link not in LINK_HEADERS:
        return None
    at, place = LINK_HEADERS[link]
    kind = int.from_bytes(packet[place : place + 2], "big")
    while kind in ETHERTYPE_VLAN and len(packet) >= at + 4:
        kind = int.from_bytes(packet[at + 2 : at + 4], "big")
        at += 4
    return at if kind == ETHERTYPE_IPV4 else None


def udp_datagram(packet: bytes, link: int) -> tuple[str, int, bytes] | None:
    """Source address, source port and non-empty payload of an IPv4/UDP packet."""
    at = ipv4_offset(packet, link)
    if at is None or len(packet) < at + 28 or packet[at] >> 4 != 4 or packet[at + 9] != UDP:
        return None
    header = (packet[at] & 0x0F) * 4
    if int.from_bytes(packet[at + 6 : at + 8], "big") & 0x1FFF:
        return None  # a later fragment has no UDP header
    end = min(at + int.from_bytes(packet[at + 2 : at + 4], "big"), len(packet))
    udp = at + header
    stop = min(udp + int.from_bytes(packet[udp + 4 : udp + 6], "big"), end)
    body = packet[udp + 8 : stop]
    if not body:
        return None
    source = ".".join(str(b) for b in packet[at + 12 : at + 16])
    return source, int.from_bytes(packet[udp : udp + 2], "big"), body


class Damaged(Exception):
    """The capture ends or breaks in the middle of something."""


class _Ahead:
    """A stream whose first bytes have been looked at."""

    def __init__(self, stream, first: bytes):
        self.stream, self.first = stream, first

    def read(self, n: int = -1) -> bytes:
        taken, self.first = (self.first, b"") if n < 0 else (self.first[:n], self.first[n:])
        return taken + self.stream.read(n - len(taken) if n >= 0 else n)


def _exactly(stream, n: int, may_end: bool = False) -> bytes:
    """The next n bytes; none at all where the stream may end."""
    data = stream.read(n) if 0 <= n <= _LARGEST else b""
    if len(data) != n and (data or not may_end):
        raise Damaged
    return data


def _classic(stream, order: str) -> Iterator[tuple[int, bytes]]:
    """(link type, packet) of a pcap file behind its signature."""
    link = struct.unpack(order + "16xI", _exactly(stream, 20))[0] & 0x0FFFFFFF
    while record := _exactly(stream, 16, may_end=True):
        yield link, _exactly(stream, struct.unpack(order + "8xI4x", record)[0])


def _sections(stream) -> Iterator[tuple[int, bytes]]:
    """(link type, packet) of a pcapng file behind the type of its first block."""
    kind, order, links = SECTION, "<", []
    while kind:
        size = _exactly(stream, 4)
        if kind == SECTION:
            magic = _exactly(stream, 4)
            if magic not in SECTION_ORDER:
                raise Damaged
            order, links = SECTION_ORDER[magic], []
            _exactly(stream, struct.unpack(order + "I", size)[0] - 12)
        else:
            number, body = struct.unpack(order + "I", kind)[0], _exactly(stream, struct.unpack(order + "I", size)[0] - 8)[:-4]
            if number == INTERFACE_BLOCK:
                links.append(struct.unpack(order + "H", body[:2])[0])
            elif number in (PACKET_BLOCK, OLD_PACKET_BLOCK) and len(body) >= 20:
                port = struct.unpack(order + ("I" if number == PACKET_BLOCK else "H"), body[: 4 if number == PACKET_BLOCK else 2])[0]
                held = struct.unpack(order + "I", body[12:16])[0]
                yield links[port] if port < len(links) else -1, body[20 : 20 + held]
            elif number == SIMPLE_PACKET_BLOCK and links:
                yield links[0], body[4 : 4 + struct.unpack(order + "I", body[:4])[0]]
        kind = _exactly(stream, 4, may_end=True)


def read_packets(stream, path: str) -> Iterator[tuple]:
    """Rows of one capture, pcap or pcapng, plain or gzip; the last row tells how reading ended.

    A damaged or truncated file yields what precedes the damage, and says so in
    ``status`` instead of hiding it.
    """
    status, number = "ok", 0
    try:
        head = stream.read(4)
        if head[:2] == GZIP:
            stream = gzip.GzipFile(fileobj=_Ahead(stream, head))
            head = stream.read(4)
        if head != SECTION and head not in SIGNATURES:
            status = "not a capture file"
        else:
            packets = _sections(stream) if head == SECTION else _classic(stream, SIGNATURES[head])
            for link, packet in packets:
                found = udp_datagram(packet, link)
                if found:
                    yield (path, number, *found, None)
                number += 1
    except (Damaged, EOFError, zlib.error, gzip.BadGzipFile):
        status = "truncated"
    yield (path, number, None, None, None, status)


def packets_of(path: str) -> Iterator[tuple]:
    """Rows of the capture at a URI, as ``read_packets`` gives them; a single one if it cannot be opened."""
    from pyarrow import fs

    try:
        system, where = fs.FileSystem.from_uri(path)
        stream = system.open_input_stream(where, compression=None, buffer_size=1 << 20)
    except (OSError, ValueError):
        yield (path, 0, None, None, None, "missing")
        return
    with stream:
        yield from read_packets(stream, path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packet rows of the captures named in the batches."""
    names = ["path", "pkt_no", "src_ip", "src_port", "payload", "status"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip(names, types)))

    for paths in batches:
        for path in paths.column(0).to_pylist():
            packets = packets_of(path)
            while rows := list(islice(packets, _BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), types)], schema=schema)


def to_uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def read_captures(spark: SparkSession, paths: list[str] | DataFrame, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """Datagrams of the captures in ``paths``, a list or a DataFrame with a column of URIs."""
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame([(to_uri(p),) for p in paths], "path string")
    paths = paths.select(paths.columns[0]).distinct()
    tasks = max(1, -(-paths.count() // files_per_task))
    return paths.repartition(tasks).mapInArrow(_decode, PACKET_SCHEMA)


def receiver_table(spark: SparkSession, receivers: dict) -> DataFrame:
    rows = [(ip, int(port), int(rx)) for (ip, port), rx in receivers.items()]
    return spark.createDataFrame(rows, "src_ip string, src_port int, receiver int")


def capture_epochs(
    packets: DataFrame,
    receivers: dict | None = None,
    validate_checksums: bool = False,
    durable: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Epochs keyed ``path, receiver`` and one status row per file (``n_packets, read_status``).

    Times are seconds since midnight. A datagram is read as one sentence even if it
    holds several.
    """
    known = F.broadcast(receiver_table(packets.sparkSession, receivers or RECEIVERS))  # a handful of addresses
    located = packets.join(known, ["src_ip", "src_port"], "left").where(
        F.col("receiver").isNotNull() | F.col("status").isNotNull()
    )
    sentences = located.select("path", "receiver", "pkt_no", "status", _ascii(F.col("payload")).alias("sentence"))
    parsed = parse_sentences(
        computed_once(sentences, ["sentence"]), "sentence", validate_checksums, keep_rejected=True
    ).withColumnRenamed("utc_of_day", "anchor_time")
    if durable:  # decoded once, although status, segment summaries and detail all read it
        parsed = stage(parsed, "sentences")
    status = parsed.where(F.col("status").isNotNull()).select(
        "path", F.col("pkt_no").alias("n_packets"), F.col("status").alias("read_status")
    )
    placed = parsed.where(F.col("fmt").isNotNull()).drop("status").withColumn(
        "segment", F.floor(F.col("pkt_no") / SEGMENT_PACKETS)
    )
    attached = attach_to_anchor(placed, ["path", "receiver"], ["segment"], "pkt_no").drop("segment")
    return merge_epochs(attached, ["path", "receiver"], "pkt_no"), status


def _ascii(payload):
    """ASCII characters of a datagram, other bytes dropped, outer white space removed."""
    latin = F.decode(payload, "ISO-8859-1")
    return F.regexp_replace(F.regexp_replace(latin, r"[^\x00-\x7F]", ""), r"^\s+|\s+$", "")
