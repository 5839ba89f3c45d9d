"""spark.read.format("capture"): datagrams of capture files, with filters that are applied before a row is made."""

from __future__ import annotations

import operator
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.session import SparkSession

from sparkloom.sources.capture import frames_of

SCHEMA = "path string, seq long, ts double, linktype int, proto string, src string, sport int, dst string, dport int, payload binary, error string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_ARROW = pa.schema(list(zip(_NAMES, [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.string()])))
#: Columns whose filters are taken over: that of a frame's record first, those of its headers after.
FROM_RECORD, FROM_HEADERS = ("ts", "linktype", "seq"), ("proto", "src", "sport", "dst", "dport")
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def parsed(frame: bytes) -> tuple[str, str, int, str, int, bytes] | None:
    """proto, src, sport, dst, dport, payload of an Ethernet frame with IPv4 and UDP or TCP, as packets.datagram has them; None of any other."""
    ip = 18 if frame[12:14] == b"\x81\x00" else 14
    if frame[ip - 2 : ip] != b"\x08\x00" or len(frame) < ip + 20 or frame[ip] >> 4 != 4:
        return None
    size, fragment, proto = struct.unpack_from(">H2xHxB", frame, ip + 2)
    l4 = ip + frame[ip] % 16 * 4
    if fragment & 0x1FFF or proto not in (6, 17) or len(frame) < l4 + (8 if proto == 17 else 20):
        return None
    sport, dport, length = struct.unpack_from(">3H", frame, l4)
    begin = l4 + (8 if proto == 17 else frame[l4 + 12] >> 4 << 2)
    if len(frame) < begin:
        return None
    end = min(ip + size, l4 + length) if proto == 17 else ip + size
    dotted = lambda at: ".".join(map(str, frame[at : at + 4]))
    return "udp" if proto == 17 else "tcp", dotted(ip + 12), sport, dotted(ip + 16), dport, frame[begin : max(begin, end)]


@dataclass
class CaptureFile(InputPartition):
    path: str


class CaptureSource(DataSource):
    """Options: path, a file or a folder on a file system that Arrow's tasks and the driver can open. A partition is a file, read as a stream.

    A file that can't be read to its end gives a row with only path, seq and error; like every
    row with nulls, it meets no filter on the columns that it lacks.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.tests: list[tuple[str, Callable, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ())[-1:]
            if name and name[0] in FROM_RECORD + FROM_HEADERS and type(f) in _COMPARED:
                self.tests.append((name[0], _COMPARED[type(f)], f.value))
            elif name and name[0] in FROM_RECORD + FROM_HEADERS and isinstance(f, In):
                self.tests.append((name[0], _held_in, frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[CaptureFile]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(place)
        found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(place, recursive=True)) if x.is_file]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        host = self.path[len(scheme) :].split("/")[0] if scheme and not place.startswith(self.path[len(scheme) :].rstrip("/")) else ""
        return [CaptureFile(scheme + host + x.path) for x in sorted(found, key=lambda x: x.path) if not x.base_name.startswith(("_", "."))]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        of_record = [t for t in self.tests if t[0] in FROM_RECORD]
        of_headers = [(FROM_HEADERS.index(t[0]), *t[1:]) for t in self.tests if t[0] in FROM_HEADERS]
        system, place = fs.FileSystem.from_uri(partition.path)
        rows, size, seq = [], 0, -1
        with system.open_input_stream(place, compression=None, buffer_size=2**20) as f:
            try:
                for seq, (ts, link, frame) in enumerate(frames_of(f)):
                    record = {"ts": ts, "linktype": link, "seq": seq}
                    if not all(test(record[name], value) for name, test, value in of_record):
                        continue
                    said = parsed(frame)
                    if said is None or not all(test(said[i], value) for i, test, value in of_headers):
                        continue
                    rows.append((partition.path, seq, ts, link, *said, None))
                    size += len(said[5])
                    if len(rows) == 10_000 or size > 2**23:
                        yield _batch(rows)
                        rows, size = [], 0
            except (ValueError, OSError) as e:
                if not self.tests:
                    rows.append((partition.path, seq + 1, *[None] * 8, str(e)))
        if rows:
            yield _batch(rows)


def _held_in(value: object, values: frozenset) -> bool:
    return value in values


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
