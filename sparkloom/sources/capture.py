"""Packet captures (pcap and pcapng) as tables of frames."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.packets import with_datagrams
from sparkloom.functions.text import payload_kind

#: error: why a file could not be read further, in a row without a frame.
FRAMES = "path string, seq long, ts double, linktype int, frame binary, error string"
# Fixed values of the file formats.
_CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6), b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}
_SECTION, _INTERFACE, _SIMPLE, _ENHANCED = 0x0A0D0D0A, 1, 3, 6


def frames_of(source: bytes | BinaryIO) -> Iterator[tuple[float, int, bytes]]:
    """(seconds, link type, frame) of a capture, read as a stream; it may end in a record cut short. Simple packet blocks have no time: 0."""
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    magic = f.read(4)
    if magic in _CLASSIC:
        return _classic(f, *_CLASSIC[magic])
    if magic == b"\x0a\x0d\x0d\x0a":
        return _blocks(f)
    raise ValueError("neither pcap nor pcapng")


def _classic(f: BinaryIO, order: str, unit: float) -> Iterator[tuple[float, int, bytes]]:
    rest = f.read(20)
    link = struct.unpack(order + "I", rest[16:])[0] & 0xFFFF if len(rest) == 20 else 0
    while len(head := f.read(16)) == 16:
        s, fraction, n, _ = struct.unpack(order + "4I", head)
        frame = f.read(n)
        if len(frame) < n:
            return
        yield s + fraction * unit, link, frame


def _blocks(f: BinaryIO) -> Iterator[tuple[float, int, bytes]]:
    order, interfaces, head = "<", [], b"\x0a\x0d\x0d\x0a" + f.read(4)
    while len(head) == 8:
        body = b""
        if head[:4] == b"\x0a\x0d\x0d\x0a":  # a section says its byte order first
            body = f.read(4)
            order, interfaces = ("<" if body == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack(order + "2I", head)
        body += f.read(max(0, size - 8 - len(body)))
        if size < 12 or len(body) < size - 8:
            return
        body = body[:-4]
        if kind == _INTERFACE:
            interfaces.append((struct.unpack_from(order + "H", body)[0], _resolution(body[8:], order)))
        elif kind == _ENHANCED and len(body) >= 20:
            which, high, low, n = struct.unpack_from(order + "4I", body)
            link, unit = interfaces[which] if which < len(interfaces) else (1, 1e-6)
            yield (high << 32 | low) * unit, link, body[20 : 20 + n]
        elif kind == _SIMPLE and len(body) >= 4:
            yield 0.0, interfaces[0][0] if interfaces else 1, body[4 : 4 + struct.unpack_from(order + "I", body)[0]]
        head = f.read(8)


def _resolution(options: bytes, order: str) -> float:
    """Seconds in a time unit: option 9, by default a microsecond."""
    at = 0
    while at + 4 <= len(options):
        code, n = struct.unpack_from(order + "2H", options, at)
        if code == 9 and n:
            value = options[at + 4]
            return 2.0 ** -(value & 0x7F) if value & 0x80 else 10.0**-value
        if code == 0:
            break
        at += 4 + (n + 3) // 4 * 4
    return 1e-6


def _rows(path: str, opened: Callable[[], bytes | BinaryIO]) -> Iterator[pd.DataFrame]:
    """FRAMES of one file, in frames of bounded size; a file that can't be read gives one row with the reason."""
    rows, seq, size = [], 0, 0
    try:
        for ts, link, frame in frames_of(opened()):
            rows.append((path, seq, ts, link, frame, None))
            seq, size = seq + 1, size + len(frame)
            if len(rows) == 10_000 or size > 2**23:
                yield pd.DataFrame(rows, columns=_NAMES)
                rows, size = [], 0
    except (ValueError, OSError) as e:
        rows.append((path, seq, 0.0, 0, None, str(e)))
    yield pd.DataFrame(rows, columns=_NAMES)


_NAMES = [x.split()[0] for x in FRAMES.split(", ")]


def frames_in(contents: DataFrame) -> DataFrame:
    """FRAMES of captures that are values of a table: path, content. A capture is one row, so at most 2 GB; it is read where Arrow has it, without copies."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("ts", pa.float64()), ("linktype", pa.int32()), ("frame", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                for rows in _rows(path.as_py(), lambda: pa.BufferReader(content.as_buffer()) if content.is_valid else b""):  # noqa: B023
                    yield pa.RecordBatch.from_pandas(rows, types, preserve_index=False)

    return contents.select("path", "content").mapInArrow(parsed, FRAMES)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """FRAMES of all capture files below a path, by any file system that Spark reads. A file is a row of one task; see stream_frames for large ones."""
    return frames_in(spark.read.format("binaryFile").load(path))


def stream_frames(spark: SparkSession, path: str) -> DataFrame:
    """FRAMES of all capture files below a path, each read in its task as a stream, whatever its size.

    Spark lists the files, without their contents; tasks open them by Arrow's file systems, so
    the path must be one that those know (local or mounted folders, HDFS, object stores).
    Captures can't be split: parallelism is by file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for file in batch["path"]:
                system, place = fs.FileSystem.from_uri(file)
                with system.open_input_stream(place, buffer_size=2**20) as f:
                    yield from _rows(file, lambda: f)  # noqa: B023

    return files.select("path").mapInPandas(parsed, FRAMES)


def datagrams(frames: DataFrame) -> DataFrame:
    """frames' datagrams: proto, src, sport, dst, dport, payload and its kind; other frames are left out."""
    return with_datagrams(frames).drop("frame", "error", "tcp_seq", "tcp_flags").withColumn("kind", payload_kind(F.col("payload")))


def inventory(found: DataFrame, keys: tuple[str, ...] = ("proto", "dport")) -> DataFrame:
    """Packets, bytes, times (0 is none), destinations and the commonest payload kind of each flow or port."""
    counts = found.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("b"), F.min(F.when(F.col("ts") != 0, F.col("ts"))).alias("t0"), F.max(F.when(F.col("ts") != 0, F.col("ts"))).alias("t1"), F.collect_set("dst").alias("d"))
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("packets"), F.sum("b").alias("bytes"), F.min("t0").alias("begin"), F.max("t1").alias("end"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("d")))).alias("destinations"), F.min_by("kind", F.struct((-F.col("n")).alias("n"), "kind")).alias("kind")
    )


def flow_streams(found: DataFrame) -> DataFrame:
    """proto, src, sport, dst, dport, stream: the payloads of each flow one after the other, by file and place.

    A stream is one value, so a flow has at most 2 GB; flow_blocks has no such bound.
    """
    parts = F.transform(F.sort_array(F.collect_list(F.struct("path", "seq", F.hex("payload").alias("hexed")))), lambda x: x["hexed"])
    return found.groupBy("proto", "src", "sport", "dst", "dport").agg(F.unhex(F.array_join(parts, "")).alias("stream"))


def flow_blocks(found: DataFrame, packets: int = 10_000) -> DataFrame:
    """proto, src, sport, dst, dport, path, block, stream: flows as blocks of the payloads of so many places of a file, which follow each other by path and block."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", F.hex("payload").alias("hexed")))), lambda x: x["hexed"])
    return found.groupBy("proto", "src", "sport", "dst", "dport", "path", F.floor(F.col("seq") / packets).alias("block")).agg(F.unhex(F.array_join(parts, "")).alias("stream"))
