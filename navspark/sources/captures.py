"""Packet captures as a Spark data source: ``spark.read.format("gnss_capture").load(folder)``.

One row per UDP datagram and, for each file, a last one with ``status``; ``receiver`` is the number of the known sender
or null. Partitions are groups of files. Conditions on ``path`` leave files out before any is opened,
those on ``receiver`` drop datagrams before they become rows. Needs ``spark.sql.python.filterPushdown.enabled``, which
``register_captures`` sets; without it Spark filters, with the same result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith,
)

from navspark.sources.pcap import FILES_PER_TASK, RECEIVERS, packets_of, to_uri

SUFFIXES = (".pcap", ".pcapng", ".cap", ".pcap.gz", ".pcapng.gz", ".cap.gz")
COLUMNS = "path string, pkt_no bigint, src_ip string, src_port int, payload binary, status string, receiver int"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int32()]
_BATCH = 4096


def capture_files(location: str) -> list[str]:
    """URIs of the captures in a folder and those below it, or of the one file named."""
    from pyarrow import fs

    uri = to_uri(location)
    system, where = fs.FileSystem.from_uri(uri)
    if system.get_file_info(where).type != fs.FileType.Directory:
        return [uri]
    head = uri[: len(uri) - len(where)] if uri.endswith(where) else uri[: uri.index("://") + 3]
    found = system.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted(head + f.path for f in found if f.is_file and f.path.lower().endswith(SUFFIXES))


@dataclass
class Files(InputPartition):
    paths: list[str]


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.location = options["path"]
        self.per_task = int(options.get("filesPerTask", FILES_PER_TASK))
        known = json.loads(options["receivers"]) if "receivers" in options else {f"{ip}:{port}": rx for (ip, port), rx in RECEIVERS.items()}
        self.known = {(k.rpartition(":")[0], int(k.rpartition(":")[2])): int(v) for k, v in known.items()}
        self.path_tests: list[Filter] = []
        self.receivers: set[int] | None = None
        self.located = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes all conditions that it decides exactly; the others go back to Spark."""
        for f in filters:
            if f.__class__ in (EqualTo, In, StringStartsWith, StringEndsWith, StringContains, IsNotNull) and f.attribute == ("path",):
                self.path_tests.append(f)
            elif isinstance(f, IsNotNull) and f.attribute == ("receiver",):
                self.located = True
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("receiver",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.receivers = wanted if self.receivers is None else self.receivers & wanted
            else:
                yield f

    def _chosen(self, path: str) -> bool:
        tests = {
            EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: path.startswith,
            StringEndsWith: path.endswith, StringContains: lambda v: v in path,
        }
        return all(isinstance(f, IsNotNull) or tests[type(f)](f.value) for f in self.path_tests)

    def partitions(self) -> list[Files]:
        paths = [p for p in capture_files(self.location) if self._chosen(p)]
        return [Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [Files([])]

    def _rows(self, paths: list[str]) -> Iterator[tuple]:
        for path in paths:
            for row in packets_of(path):
                receiver = self.known.get((row[2], row[3]))
                if (receiver is not None or not self.located) and (self.receivers is None or receiver in self.receivers and receiver is not None):
                    yield (*row, receiver)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        rows = self._rows(partition.paths)
        while held := list(islice(rows, _BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES, strict=True)], names)


class CaptureSource(DataSource):
    """Options: ``path`` (or ``load``'s argument), ``filesPerTask``, and ``receivers`` as JSON from "address:port" to number."""

    @classmethod
    def name(cls) -> str:
        return "gnss_capture"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def register_captures(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
