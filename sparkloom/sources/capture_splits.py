"""Large captures in parallel: ranges that begin at records, though a capture has no marks to find records by.

A task takes a range of a file's bytes and guesses the first record in it: a place from which
headers follow each other plausibly. From there it goes along the headers to the first record
beyond its range. Where a range ends must be where the next one began. Where it isn't, a payload
looked like headers, and the next range is gone along again from there (with those behind it
that don't fit either), until all joints fit: the first range begins behind the file's header, so what fits from there on is right. A section
and its interfaces, which records of pcapng need, are handed to all ranges behind them.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.scratch import written
from sparkloom.sources.capture import _CLASSIC, _INTERFACE, FRAMES, frames_of

SPLIT = 64 * 2**20
#: Headers that must follow each other at a guess; bytes that are looked at at a time; the longest record that is guessed.
CHAIN, WINDOW, LONGEST = 6, 2**18, 2**18
_SECTION = b"\x0a\x0d\x0d\x0a"


def orders_of(head: bytes) -> tuple[bool, tuple[str, ...], float]:
    """(whether it is classic, byte orders to try, fractions of a second) of a file that begins so."""
    if head[:4] in _CLASSIC:
        order, unit = _CLASSIC[head[:4]]
        return True, (order,), round(1 / unit)
    if head[:4] == _SECTION:
        return False, ("<", ">"), 0
    raise ValueError("neither pcap nor pcapng")


def size_at(f: BinaryIO, at: int, length: int, classic: bool, order: str, fractions: float, strict: bool) -> int:
    """Bytes of the record or block at a place; 0 if there is no whole one. strict: only what is plausible."""
    f.seek(at)
    head = f.read(16 if classic else 12)
    if classic:
        if len(head) < 16:
            return 0
        seconds, fraction, n, whole = struct.unpack(order + "4I", head)
        if strict and not (0 < n <= min(whole, LONGEST) and whole <= LONGEST and fraction < fractions and seconds):
            return 0
        return 16 + n if at + 16 + n <= length else 0
    if len(head) < 12:
        return 0
    if head[:4] == _SECTION:
        order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
    n = struct.unpack_from(order + "I", head, 4)[0]
    if n < 12 or at + n > length or strict and (n % 4 or n > LONGEST):
        return 0
    if strict:
        f.seek(at + n - 4)
        if f.read(4) != head[4:8]:
            return 0
    return n


def guessed(f: BinaryIO, begin: int, length: int, head: bytes) -> int:
    """The first place from ``begin`` on from which CHAIN plausible headers, or all up to the file's end, follow each other; else the file's length."""
    classic, orders, fractions = orders_of(head)
    for window in range(begin, length, WINDOW):
        f.seek(window)
        data = np.frombuffer(f.read(WINDOW + 15), np.uint8).astype(np.uint32)
        m = min(WINDOW, len(data) - (15 if classic else 11))
        if m <= 0:
            return length
        places: set[tuple[int, str]] = set()
        for order in orders:
            word = lambda k: sum(data[k + i : k + i + m] << (8 * (i if order == "<" else 3 - i)) for i in range(4))  # noqa: B023, E731
            if classic:
                n, whole = word(8), word(12)
                good = (n > 0) & (n <= whole) & (whole <= LONGEST) & (word(4) < fractions) & (word(0) > 0)
            else:
                n = word(4)
                good = (n >= 12) & (n % 4 == 0) & (n <= LONGEST) & (word(0) != 0)
            places |= {(int(p), order) for p in np.flatnonzero(good)}
        for p, order in sorted(places):
            at = window + p
            for _ in range(CHAIN):
                n = size_at(f, at, length, classic, order, fractions, strict=True)
                if not n:
                    break
                at += n
                if at == length:
                    return window + p
            else:
                return window + p
    return length


def walked(f: BinaryIO, begin: int, stop: int, length: int, head: bytes, before: bytes) -> tuple[int, int, bytes]:
    """(where the first record at or behind ``stop`` begins, frames on the way, the section and interfaces on the way) from a record's place on. before: the section in force."""
    classic, orders, fractions = orders_of(head)
    order = "<" if before[8:12] == b"\x4d\x3c\x2b\x1a" else ">" if before else orders[0]
    at, frames, found = begin, 0, b""
    while at < stop:
        f.seek(at)
        kind = f.read(12)
        if not classic and kind[:4] == _SECTION:
            order = "<" if kind[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        n = size_at(f, at, length, classic, orders[0] if classic else order, fractions, strict=False)
        if not n:
            return length, frames, found  # what is left is cut short
        if classic:
            frames += 1
        else:
            type_of = struct.unpack_from(order + "I", kind)[0]
            if kind[:4] == _SECTION or type_of == _INTERFACE:
                f.seek(at)
                block = f.read(n)
                found = block if kind[:4] == _SECTION else found + block
            frames += type_of in (3, 6) and n >= (16 if type_of == 3 else 32)
        at += n
    return at, frames, found


def _opened(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(quote(path, safe="/:@"))  # Spark gives names as they are
    return system.open_input_file(place)


def splits(spark: SparkSession, path: str, size: int = SPLIT) -> DataFrame:
    """path, k, begin, stop, first (the number of its first frame), prelude (what a reader must know before) of the ranges of all captures below a path, about ``size`` bytes each.

    Ranges fit without gaps, however many payloads look like headers. A range in which no record
    begins is empty. Files that are no captures have none; an empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    n = F.ceil(F.col("length") / size).cast("int")
    ranges = files.select("path", "length", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("k", "i")).select("path", "length", "k", (F.col("k").cast("long") * size).alias("low"), F.least((F.col("k").cast("long") + 1) * size, F.col("length")).alias("high"))
    state = "path string, length long, k int, low long, high long, begin long, end long, frames long, found binary"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                with _opened(r.path) as f:
                    head = f.read(24)
                    try:
                        classic, _, _ = orders_of(head)
                    except ValueError:
                        continue
                    begin = (24 if classic else 0) if r.k == 0 else guessed(f, r.low, r.length, head)
                    rows.append((r.path, r.length, r.k, r.low, r.high, begin, *walked(f, begin, r.high, r.length, head, b"")))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in state.split(", ")])

    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Ranges that follow each other, none of which begins where the one before ended: gone along in one go."""
        out, due, before = [], None, b""
        with _opened(key[0]) as f:
            head = f.read(24)
            for r in rows.sort_values("k").itertuples():
                if due is None:
                    due, before = int(r.due), bytes(r.before) if r.before is not None else b""
                end, frames, found = (int(r.end), int(r.frames), bytes(r.found)) if due == r.begin else walked(f, due, int(r.high), int(r.length), head, before)
                out.append((r.path, r.length, r.k, r.low, r.high, due, end, frames, found))
                due, before = end, found if found[:4] == _SECTION else before + found
        return pd.DataFrame(out, columns=[x.split()[0] for x in state.split(", ")])

    count = max(1, min(ranges.count(), 100_000))
    known = written(ranges.repartition(count).mapInPandas(first, state))
    by_file = Window.partitionBy("path").orderBy("k")  # a row a range
    section = lambda c: F.substring(c, 1, 4) == F.lit(_SECTION)
    while True:
        # the blocks in force at a range's begin: the last section before it and all interfaces since
        upto = known.withColumns({"due": F.lag("end").over(by_file), "group": F.sum(F.coalesce(section("found"), F.lit(False)).cast("int")).over(by_file)})
        hexed = F.array_join(F.collect_list(F.hex("found")).over(Window.partitionBy("path", "group").orderBy("k")), "")
        upto = upto.withColumn("so_far", F.unhex(hexed)).withColumn("before", F.lag("so_far").over(by_file))
        joints = upto.withColumn("wrong", F.coalesce(F.col("due") != F.col("begin"), F.lit(False)))
        if joints.where("wrong").isEmpty():
            break
        # each file's first joints that don't fit are right afterwards, so this ends
        run = F.sum((~F.col("wrong")).cast("int")).over(by_file)
        wrong = joints.withColumn("run", run).where("wrong").groupBy("path", "run").applyInPandas(again, state)
        known = written(joints.where("NOT wrong").select(*known.columns).unionByName(wrong))
    start = F.coalesce(F.sum("frames").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joints.select("path", "k", "begin", F.col("end").alias("stop"), start.alias("first"), F.coalesce("before", F.lit(b"")).alias("prelude"))


def read_splits(ranges: DataFrame) -> DataFrame:
    """FRAMES of the ranges of splits(), a task a range; as reading each file in one pass gives them."""

    class Range(io.RawIOBase):
        """A file's header or prelude, and then its bytes from one place to another."""

        def __init__(self, f: BinaryIO, before: bytes, begin: int, stop: int) -> None:
            self.f, self.before, self.left = f, before, stop - begin
            f.seek(begin)

        def read(self, n: int = -1) -> bytes:
            out, self.before = self.before[:n], self.before[n:]
            more = self.f.read(min(n - len(out), self.left)) if len(out) < n and self.left else b""
            self.left -= len(more)
            return out + more

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FRAMES.split(", ")]
        for batch in batches:
            for r in batch.itertuples():
                rows, size = [], 0
                with _opened(r.path) as f:
                    head = f.read(24)
                    before = head if head[:4] in _CLASSIC else bytes(r.prelude)
                    part = Range(f, before, r.begin, r.stop) if r.stop > r.begin else io.BytesIO(before or b"\x0a\x0d\x0d\x0a")
                    for i, (ts, link, frame) in enumerate(frames_of(io.BufferedReader(_Readable(part), 2**20))):
                        rows.append((r.path, r.first + i, ts, link, frame, None))
                        size += len(frame)
                        if len(rows) == 10_000 or size > 2**23:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    ranges = written(ranges)
    return ranges.repartition(max(1, min(ranges.count(), 100_000))).mapInPandas(parsed, FRAMES)


class _Readable(io.RawIOBase):
    """What io.BufferedReader asks for, of anything with read()."""

    def __init__(self, f) -> None:
        self.f = f

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.f.read(len(into))
        into[: len(data)] = data
        return len(data)
