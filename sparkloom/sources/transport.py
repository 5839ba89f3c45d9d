"""Transport streams: whole packets found again behind junk, counts and faults by packet identifier, sections and program tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the format.
SIZE, SYNC = 188, 0x47
ASSOCIATION, MAP = 0, 2  # kinds of tables
#: Packets in a row that begin with the sync octet where the pitch is found anew.
CONFIRMED = 3
#: block: numbers in a stream's order; packets: whole packets one after the other; junk: octets of a block that are no packet's.
BLOCKS = "stream string, block long, junk long, packets binary"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def whole_packets(chunks: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """(octets of junk, whole packets) of a stream, as its chunks come; how it is cut into chunks changes neither sum.

    A packet follows another if it begins with the sync octet. Where one doesn't, the pitch is
    looked for from the next octet on: CONFIRMED sync octets at a packet's distance, fewer only
    if the stream ends before. A last packet cut short is junk.
    """
    held, locked, last, feed = b"", False, False, iter(chunks)
    while not last:
        chunk = next(feed, None)
        last = chunk is None
        held += chunk or b""
        octets = np.frombuffer(held, np.uint8)
        at, junk, runs = 0, 0, []
        while True:
            if not locked:
                found, locked = _pitch(held, at, last)
                junk, at = junk + found - at, found
                if not locked:
                    break
            begins = octets[at::SIZE][: (len(octets) - at) // SIZE]
            other = np.flatnonzero(begins != SYNC)
            n = int(other[0]) if len(other) else len(begins)
            runs.append(held[at : at + n * SIZE])
            at += n * SIZE
            if n == len(begins):
                break
            locked = False
        if last:
            junk, at = junk + len(held) - at, len(held)
        held = held[at:]
        if junk or runs:
            yield junk, b"".join(runs)


def _pitch(octets: bytes, at: int, last: bool) -> tuple[int, bool]:
    """Where the next packet begins, and whether that is certain; else the first place that more octets may make one."""
    end = len(octets)
    while (at := octets.find(SYNC, at)) >= 0:
        if at + SIZE * (CONFIRMED - 1) >= end and not last:
            return at, False
        if at + SIZE <= end and all(octets[k] == SYNC for k in range(at + SIZE, min(end, at + SIZE * (CONFIRMED - 1) + 1), SIZE)):
            return at, True
        at += 1
    return end, False


def blocks_of(df: DataFrame, stream: str, order: str, data: str) -> DataFrame:
    """BLOCKS of a binary column whose values each hold whole packets and, before or between them, junk: datagrams, or blocks cut at packets. Null is as empty."""

    @F.arrow_udf("binary")
    def packets(values: pa.Array) -> pa.Array:
        return pa.array([b"".join(p for _, p in whole_packets([d.as_py()] if d.is_valid else [])) for d in values], pa.binary())

    found = df.select(F.col(stream).cast("string").alias("stream"), F.col(order).cast("long").alias("block"), F.col(data).alias("data")).withColumn("packets", packets("data"))
    junk = F.coalesce(F.octet_length("data") - F.octet_length("packets"), F.lit(0)).cast("long")
    return found.select("stream", "block", junk.alias("junk"), "packets")


def read_blocks(spark: SparkSession, path: str, chunk: int = 2**20) -> DataFrame:
    """BLOCKS of the files of a folder: a file is one task's work, read as a stream with a chunk in memory."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for place in batch["path"]:
                system, local = fs.FileSystem.from_uri(place)
                with system.open_input_stream(local, compression=None) as f:
                    for k, (junk, packets) in enumerate(whole_packets(iter(lambda: f.read(chunk) or None, None))):
                        yield pd.DataFrame({"stream": [place], "block": [k], "junk": [junk], "packets": [packets]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(read, BLOCKS)


def _octets(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all packets of an array of blocks: their octets where Arrow has them, a row each, the numbers of their blocks in the array, and their identifiers."""
    if not len(values):
        values = pa.array([b""])
    values = values.cast(pa.large_binary())
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    a = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].reshape(-1, SIZE)
    return a, np.repeat(np.arange(len(values)), np.diff(ends) // SIZE), (a[:, 1].astype(np.int64) & 0x1F) << 8 | a[:, 2]


def _by_block(of: np.ndarray, n: int, **columns: pa.Array) -> pa.Array:
    """A list of records for each of n blocks; of: the records' blocks, rising."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _records(blocks: DataFrame, records: Column) -> DataFrame:
    """stream, block and what records gives of a block, a row each.

    The lists are a column first, so that blocks are cut and read by one step in Python; an
    inner inline would put a filter on it below, which takes that step twice.
    """
    return blocks.select("stream", "block", records.alias("records")).select("stream", "block", F.inline_outer("records")).where("pid IS NOT NULL")


def identifiers(blocks: DataFrame) -> DataFrame:
    """stream, pid, packets, carrying, faults: of the packets that carry a payload, how many have not the counter behind the last one's.

    Tasks count within blocks, many at a time, so that a window meets only a row a block and pid.
    """

    @F.arrow_udf("array<struct<pid: int, packets: long, carrying: long, faults: long, first: int, last: int>>")
    def count(values: pa.Array) -> pa.Array:
        a, of, pids = _octets(values)
        name = of << 13 | pids
        order = np.argsort(name, kind="stable")
        names, which, n = np.unique(name[order], return_inverse=True, return_counts=True)
        carries = a[order, 3] & 0x10 > 0
        pid, counter = which[carries], a[order[carries], 3].astype(np.int32) & 15
        broken = (pid[1:] == pid[:-1]) & ((counter[:-1] + 1) % 16 != counter[1:])
        carrying = np.bincount(pid, minlength=len(names))
        begin = np.concatenate([[0], np.cumsum(carrying)])
        edge = lambda at: pa.array(np.append(counter, 0)[at], pa.int32(), mask=carrying == 0)
        faults = np.bincount(pid[1:], broken, len(names)).astype(np.int64)
        return _by_block(names >> 13, len(values), pid=pa.array(names & 0x1FFF, pa.int32()), packets=pa.array(n), carrying=pa.array(carrying), faults=pa.array(faults), first=edge(begin[:-1]), last=edge(begin[1:] - 1))

    rows = _records(blocks, count("packets"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("stream", "pid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    torn = (F.col("first").isNotNull() & before.isNotNull() & ((before + 1) % 16 != F.col("first"))).cast("long")
    return rows.withColumn("torn", torn).groupBy("stream", "pid").agg(F.sum("packets").alias("packets"), F.sum("carrying").alias("carrying"), F.sum(F.col("faults") + F.col("torn")).alias("faults"))


def crc(data: bytes) -> int:
    """The check of a section, most significant bit first: that of zlib with all bits turned round. 0 over a section with its own check."""
    turned = zlib.crc32(data.translate(_REVERSED)) ^ 0xFFFFFFFF
    return int(f"{turned:032b}"[::-1], 2)


class Sections:
    """Puts one identifier's packets together to sections."""

    def __init__(self) -> None:
        self.held: bytes | None = None  # None until a section begins
        self.counter: int | None = None

    def feed(self, packet: bytes) -> Iterator[bytes | None]:
        """Sections that the packet ends; None for one that is broken off or has another check."""
        if not packet[3] & 0x10:
            return
        counter, before = packet[3] & 15, self.counter
        if counter == before:  # sent twice
            return
        self.counter = counter
        if packet[1] & 0x80 or before is not None and (before + 1) % 16 != counter:
            if self.held:
                yield None
            self.held = None
            if packet[1] & 0x80:
                return
        payload = packet[5 + packet[4] if packet[3] & 0x20 else 4 :]
        if packet[1] & 0x40:
            if not payload:
                return
            begin = 1 + payload[0]
            if self.held is not None:
                self.held += payload[1:begin]
                yield from self._whole()
                if self.held:
                    yield None
            self.held = payload[begin:]
        elif self.held is not None:
            self.held += payload
        if self.held is not None:
            yield from self._whole()

    def _whole(self) -> Iterator[bytes | None]:
        held = self.held
        while len(held) >= 3 and held[0] != 0xFF:
            n = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < n:
                break
            yield held[:n] if not held[1] & 0x80 or n > 7 and crc(held[:n]) == 0 else None
            held = held[n:]
        self.held = b"" if held[:1] == b"\xff" else held


def sections(blocks: DataFrame, pids: list[int]) -> DataFrame:
    """stream, pid, block, section: each section where it differs from the one before it of its kind and number; section is null for one that is broken.

    Only packets of these identifiers are shuffled. Each identifier of a stream is put in order
    and gone through as it comes, with a section in memory.
    """
    wanted = np.array(sorted(pids), dtype=np.int64)

    @F.arrow_udf("array<struct<at: long, pid: int, packet: binary>>")
    def chosen(values: pa.Array) -> pa.Array:
        a, of, pids = _octets(values)
        at = np.flatnonzero(np.isin(pids, wanted))
        return _by_block(of[at], len(values), at=pa.array(at), pid=pa.array(pids[at], pa.int32()), packet=pa.array([p.tobytes() for p in a[at]], pa.binary()))

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, last = None, None, {}
        for batch in batches:
            out = []
            for stream, block, pid, packet in zip(batch["stream"], batch["block"], batch["pid"], batch["packet"]):
                if (stream, pid) != key:
                    key, state, last = (stream, pid), Sections(), {}
                for s in state.feed(packet):
                    name = None if s is None else (s[0], s[3:5], s[6:7])
                    if s is None or last.get(name) != s:
                        out.append((stream, pid, block, s))
                        last[name] = s
            yield pd.DataFrame(out, columns=["stream", "pid", "block", "section"])

    rows = _records(blocks, chosen("packets"))
    return rows.repartition("stream", "pid").sortWithinPartitions("stream", "pid", "block", "at").mapInPandas(folded, "stream string, pid int, block long, section binary")


def _entries(section: Column) -> Column:
    """(program, pid, kind) of a table: of an association its programs' maps, of a map its elementary streams."""

    @F.pandas_udf("array<struct<program: int, pid: int, kind: int>>")
    def read(values: pd.Series) -> pd.Series:
        return pd.Series([_read(bytes(s)) for s in values])

    return read(section)


def _read(s: bytes) -> list[dict]:
    word, end = lambda at: s[at] << 8 | s[at + 1], len(s) - 4
    if s[0] == ASSOCIATION:
        return [{"program": word(at), "pid": word(at + 2) & 0x1FFF, "kind": None} for at in range(8, end - 3, 4) if word(at)]
    out, at = [], 12 + (word(10) & 0x0FFF) if end >= 12 else end
    while at + 5 <= end:
        out.append({"program": word(3), "pid": word(at + 1) & 0x1FFF, "kind": s[at]})
        at += 5 + (word(at + 3) & 0x0FFF)
    return out


def programs(blocks: DataFrame) -> DataFrame:
    """stream, pid, program, stream_type of elementary streams, as their stream's tables last said.

    The tables' identifiers are gathered over all streams: there are 8,192 at most. Then the
    blocks are gone through once more, for the tables of both kinds.
    """
    read = lambda found, kind: found.where((F.hex(F.substring("section", 1, 1)) == f"{kind:02X}")).select("stream", F.col("pid").alias("table"), "block", F.explode(_entries(F.col("section"))).alias("x"))
    mapped = lambda found: read(found.where("pid = 0"), ASSOCIATION).select("stream", F.col("x.program").alias("program"), F.col("x.pid").alias("table")).distinct()
    pids = [r[0] for r in mapped(sections(blocks, [0])).select("table").distinct().collect()]
    found = sections(blocks, [0, *pids])
    said = read(found.where(F.col("pid").isin(pids)), MAP).select("stream", "table", "block", "x.*").join(mapped(found), ["stream", "table", "program"], "left_semi")
    return said.groupBy("stream", "pid").agg(F.max_by(F.struct("program", "kind"), F.struct("block", "program", "kind")).alias("x")).select("stream", "pid", "x.program", F.col("x.kind").alias("stream_type"))


def with_check(body: bytes) -> bytes:
    """A section: body, whose length field is set, and its check."""
    n = len(body) - 3 + 4
    body = body[:1] + bytes([body[1] & 0xF0 | n >> 8, n & 0xFF]) + body[3:]
    return body + crc(body).to_bytes(4, "big")


def packed(section: bytes, pid: int, counter: int = 0) -> list[bytes]:
    """A section as packets of its own, the last one filled up."""
    data, out = b"\0" + section, []
    for k in range(0, len(data), SIZE - 4):
        head = bytes([SYNC, (0x40 if k == 0 else 0) | pid >> 8, pid & 0xFF, 0x10 | (counter + len(out)) % 16])
        out.append(head + data[k : k + SIZE - 4].ljust(SIZE - 4, b"\xff"))
    return out
