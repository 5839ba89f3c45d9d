"""WARC archives as chunked record tables.

A payload is never one value on its way between an archive and Spark: it is rows of (record,
chunk number, at most ``chunk`` bytes), each with the size and the SHA-1 of the payload up to
its own end. So a task holds a chunk and a hash state, however long a record is, and the last
chunk's row has the digest of all.

Writing: a row's payload is cut into chunks in the JVM, and a task appends them, as they come,
to an archive of its own (a gzip member a record). What a task returns is the index of its
records. The index is written as a table, so Spark's commit decides whose archives count: a
task that is lost leaves a file that no index names. Reading: an index is cut into ranges of
bounded size, each read by a task from its first record's offset on; files without an index are
read whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, written

#: bytes and digest (bare base32 SHA-1) are those of the payload up to the end of this chunk; last marks a record's last
#: chunk, and every record has one. stated and stated_bytes are what the record's headers say of the full payload.
CHUNKS = "archive string, offset long, kind string, record_id string, uri string, refers_to string, stated string, stated_bytes long, chunk int, data binary, bytes long, digest string, last boolean, error string"
INDEX = "archive string, offset long, length long, record_id string"
CHUNK = 256 * 1024
#: Compressed bytes of an index's records that a task reads; bytes after which a task begins another archive.
SPLIT, ARCHIVE = 16 * 2**20, 2**30
#: Groups of copies that are broadcast when there are no more; a larger number is joined by shuffle.
BROADCAST_GROUPS = 200_000
#: A record's or a response's header lines may take so many bytes.
LONGEST_HEAD = 64 * 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(key: Column) -> Column:
    """The record's name: a urn with the key, or 'null'."""
    return F.concat(F.lit("urn:record:"), F.coalesce(key.cast("string"), F.lit("null")))


def key_of(name: str) -> Column:
    """The key (long) in a column of record names; null of null and of 'null'."""
    return F.regexp_extract(name, r"^urn:record:(-?\d+)$", 1).try_cast("long")


def with_revisits(rows: DataFrame, least: int) -> DataFrame:
    """rows (id, bytes, sha1, uri, ...) with keeper and keeper_uri: the largest id among equal payloads of at least so many bytes, or null where the row is a response itself.

    A group with over a thousandth of all copies is broadcast, of which there can't be a
    thousand; so the join has no hot key.
    """
    groups = rows.where(F.col("bytes") >= least).groupBy("sha1").agg(F.count("*").alias("n"), F.max("id").alias("keeper"), F.max_by("uri", "id").alias("keeper_uri"))
    groups = written(groups.where("n > 1"))
    n_groups, n_copies = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = F.col("n") > n_copies / 1000
    named = lambda df, end: df.select(F.col("sha1").alias(f"sha1_{end}"), F.col("keeper").alias(f"keeper_{end}"), F.col("keeper_uri").alias(f"uri_{end}"))
    large, small = named(groups.where(hot), "a"), named(groups.where(~hot), "b")
    found = rows.join(F.broadcast(large), F.col("sha1") == F.col("sha1_a"), "left")
    # a row that has its group meets no other: its key is one that no group has
    key = F.when(F.col("keeper_a").isNull(), F.col("sha1")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "sha1").cast("string")))
    found = found.withColumn("__key", key).join(F.broadcast(small) if n_groups <= BROADCAST_GROUPS else small, F.col("__key") == F.col("sha1_b"), "left")
    keeper, uri = F.coalesce("keeper_a", "keeper_b"), F.coalesce("uri_a", "uri_b")
    again = keeper.isNotNull() & (keeper != F.col("id"))
    return found.withColumns({"keeper": F.when(again, keeper), "keeper_uri": F.when(again, uri)}).select(*rows.columns, "keeper", "keeper_uri")


def clean(value: str) -> str:
    """A header's value without white space and control characters: they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", value)


def heads(row: dict, date: str) -> tuple[bytes, int]:
    """The header lines of a record and of the response in it; the payload's bytes that follow."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    follow = 0 if revisit else row["bytes"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {clean(row['uri'])}"] if row["uri"] is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32(row['sha1'])}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
        lines += [f"WARC-Refers-To-Target-URI: {clean(row['refers_uri'])}"] if row["refers_uri"] is not None else []
    lines += [f"Content-Length: {len(http) + follow}", "", ""]
    return "\r\n".join(lines).encode() + http, follow


class _Archive:
    """A file being written: a gzip member a record."""

    def __init__(self, folder: str) -> None:
        from pyarrow import fs

        self.name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        system, place = fs.FileSystem.from_uri(self.name)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.file, self.at = system.open_output_stream(place, compression=None), 0

    def begin(self, head: bytes) -> None:
        self.start, self.gzip = self.at, zlib.compressobj(6, zlib.DEFLATED, 31)
        self.add(head)

    def add(self, data: bytes) -> None:
        self._put(self.gzip.compress(data))

    def end(self) -> tuple[str, int, int]:
        self.add(b"\r\n\r\n")
        self._put(self.gzip.flush())
        return self.name, self.start, self.at - self.start

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)


def archived(chunks: DataFrame, folder: str, date: str, most: int = ARCHIVE) -> DataFrame:
    """INDEX of the records that tasks write below a folder. chunks: record_id, uri, bytes, sha1, refers_to, refers_uri, chunk, data, a record's rows one after the other in a partition.

    A revisit is one row without data. To be written as a table: each run of it writes archives anew.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, name, left, done = None, None, 0, []
        for batch in batches:
            for row in batch.to_dict("records"):
                if row["chunk"] == 0:
                    if left:
                        raise ValueError(f"record {name} lacks {left} bytes")
                    if archive is None or archive.at >= most:
                        if archive is not None:
                            archive.file.close()
                        archive = _Archive(folder)
                    head, left = heads(row, date)
                    name = row["record_id"]
                    archive.begin(head)
                elif archive is None or row["record_id"] != name:
                    raise ValueError(f"chunk {row['chunk']} of {row['record_id']} comes after {name}")
                if row["data"]:
                    archive.add(row["data"])
                    left -= len(row["data"])
                if left < 0:
                    raise ValueError(f"record {name} has more bytes than it states")
                if left == 0:
                    done.append((*archive.end(), name))
            yield pd.DataFrame(done, columns=[x.split()[0] for x in INDEX.split(", ")])
            done = []
        if left:
            raise ValueError(f"record {name} lacks {left} bytes")
        if archive is not None:
            archive.file.close()

    return chunks.mapInPandas(put, INDEX)


def write(df: DataFrame, folder: str, key: str = "page_id", payload: str = "html", uri: str | None = "url", least: int = 0, chunk: int = CHUNK, date: str | None = None) -> DataFrame:
    """One record a row of df in archives below a folder, which executors share; returns their INDEX, which is written.

    Among rows with equal payloads of at least ``least`` bytes that with the largest key is a
    response and the others are revisits of it; all other rows are responses. A null payload is
    an empty one. A null key is smaller than any other. Rows that share both key and payload are
    alike: all responses, if the key is the largest. A null uri is left out; white space and control
    characters in one are percent-encoded. An empty df gives no archive and an empty index.
    Other columns of df are not looked at.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), (F.col(uri).cast("string") if uri else F.lit(None).cast("string")).alias("uri"), body.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    rows = with_revisits(rows, least)
    named = lambda c: F.when(F.col(c).isNotNull(), record_id(F.nullif(c, F.lit(NULL_ID))))
    records = rows.select(named("id").alias("record_id"), "uri", "bytes", "sha1", named("keeper").alias("refers_to"), F.col("keeper_uri").alias("refers_uri"), F.when(F.col("keeper").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"))
    n = F.greatest(F.ceil(F.octet_length("payload") / chunk), F.lit(1)).cast("int")
    # the generator makes the pieces, so that no row of a piece carries the whole
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("payload", i * chunk + 1, F.lit(chunk)))
    cut = records.select(*[c for c in records.columns if c != "payload"], F.posexplode(pieces).alias("chunk", "data"))
    return written(archived(cut, folder, date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")))


class _Stream:
    """The bytes of an archive from an offset on, plain or of gzip members, a bounded number at a time."""

    def __init__(self, file: BinaryIO, start: int = 0) -> None:
        self.file, self.buffer, self.fed, self.pending, self.gzip = file, b"", start, b"", None
        file.seek(start)
        self.pending = file.read(2)
        self.fed += len(self.pending)
        self.packed = self.pending == b"\x1f\x8b"
        #: Where the member (of a plain file: the byte) is from which the next byte comes.
        self.at = start

    def fill(self, n: int) -> bool:
        """At least n bytes in the buffer, if there are."""
        while len(self.buffer) < n:
            if self.packed and self.gzip is not None and self.gzip.eof:
                self.pending, self.gzip = self.gzip.unused_data, None
            if not self.pending:
                self.pending = self.file.read(CHUNK)
                self.fed += len(self.pending)
                if not self.pending:
                    if self.gzip is not None:
                        raise ValueError("a gzip member is cut short")
                    return False
            if not self.packed:
                self.buffer, self.pending = self.buffer + self.pending, b""
                continue
            if self.gzip is None:
                if not self.buffer:
                    self.at = self.fed - len(self.pending)
                self.gzip = zlib.decompressobj(31)
            # a little may come out as very much, so what comes out is bounded too
            self.buffer += self.gzip.decompress(self.pending, CHUNK)
            self.pending = b"" if self.gzip.eof else self.gzip.unconsumed_tail
        return True

    def take(self, n: int) -> bytes:
        self.fill(n)
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        if not self.packed:
            self.at += len(out)
        return out

    def head(self) -> bytes | None:
        """The lines up to an empty one; None at the end of the file."""
        size = 0
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if size > LONGEST_HEAD:
                raise ValueError("header lines don't end")
            size = len(self.buffer) + 1
            if not self.fill(size):
                if self.buffer.strip():
                    raise ValueError("header lines are cut short")
                return None
        return self.take(end + 4)


def fields(head: bytes) -> dict[str, str]:
    """Header lines by their lower-case names."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def chunks_of(archive: str, file: BinaryIO, start: int = 0, stop: int | None = None, chunk: int = CHUNK) -> Iterator[tuple]:
    """CHUNKS of the records of an archive that begin between two offsets. What can't be read ends it with a row that says why."""
    known: tuple = (archive, start, *[None] * 6)
    try:
        stream = _Stream(file, start)
        while stream.fill(1) and (stop is None or stream.at < stop):
            at = stream.at
            known = (archive, at, *[None] * 6)
            head = stream.head()
            if head is None:
                return
            if not head.startswith(b"WARC/"):
                raise ValueError("no record begins here")
            f = fields(head)
            left = int(f.get("content-length", ""))
            stated = re.sub(r"^sha1:", "", f.get("warc-payload-digest", "")) or None
            bare = lambda name: f[name].strip("<>") if name in f else None  # noqa: B023, E731
            stated_bytes = None
            if f.get("content-type", "").startswith("application/http") and left:
                before = stream.head() or b""
                left -= len(before)
                stated_bytes = fields(before).get("content-length")
            known = (archive, at, f.get("warc-type"), bare("warc-record-id"), f.get("warc-target-uri"), bare("warc-refers-to"), stated, None if stated_bytes is None else int(stated_bytes))
            sha1, size, k = hashlib.sha1(), 0, 0
            while True:
                data = stream.take(min(chunk, left))
                left -= len(data)
                size += len(data)
                if left and len(data) < chunk:
                    raise ValueError(f"a payload is {left} bytes short")
                sha1.update(data)
                yield (*known, k, data, size, base64.b32encode(sha1.digest()).decode(), left == 0, None)
                k += 1
                if not left:
                    break
            if stream.take(4) != b"\r\n\r\n":
                raise ValueError("a record is longer than it states")
    except (ValueError, OSError, zlib.error) as e:
        yield (*known, None, None, None, None, None, str(e))


_NAMES = [x.split()[0] for x in CHUNKS.split(", ")]


def read_ranges(ranges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """CHUNKS of ranges (archive, start, stop) of archives; a null stop is a file's end. Tasks open archives by Arrow's file systems."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for name, start, stop in zip(batch["archive"], batch["start"], batch["stop"]):
                system, place = fs.FileSystem.from_uri(name)
                rows, size = [], 0
                with system.open_input_file(place) as file:
                    for row in chunks_of(name, file, int(start), None if pd.isna(stop) else int(stop), chunk):
                        rows.append(row)
                        size += len(row[9] or b"")
                        if size > 2**23 or len(rows) == 5000:
                            yield pd.DataFrame(rows, columns=_NAMES).astype({"stated_bytes": "Int64", "chunk": "Int32", "bytes": "Int64"})
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=_NAMES).astype({"stated_bytes": "Int64", "chunk": "Int32", "bytes": "Int64"})

    return ranges.select("archive", "start", "stop").mapInPandas(parsed, CHUNKS)


def read(index: DataFrame, split: int = SPLIT, chunk: int = CHUNK) -> DataFrame:
    """CHUNKS of the records that an INDEX names, in ranges of about so many compressed bytes a task."""
    part = F.floor(F.col("offset") / split)
    ranges = written(index.groupBy("archive", part.alias("part")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop")))
    n = ranges.count()
    return read_ranges(ranges.repartition(max(1, min(n, 100_000))), chunk)


def read_files(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """CHUNKS of all archives below a path, gzipped by record or plain; a file is a task's, read as a stream."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"))
    return read_ranges(files, chunk)


def records(chunks: DataFrame) -> DataFrame:
    """A row a record, without data: its last chunk's, whose digest is that of the whole payload. payload_bytes and payload_digest of a revisit are those that it states.

    fault: why a record is not what it says, else null.
    """
    revisit = F.col("kind") == "revisit"
    last = chunks.where("last OR error IS NOT NULL")
    fault = F.when(F.col("error").isNotNull(), F.col("error")).when(~revisit & (F.col("digest") != F.col("stated")), "the payload's digest is not the stated one")
    return last.select("archive", "offset", "kind", "record_id", "uri", "refers_to", F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(revisit, F.col("stated")).otherwise(F.col("digest")).alias("payload_digest"), fault.alias("fault"))


def dangling(records: DataFrame) -> DataFrame:
    """The revisits whose payload no sound response in the table holds: none of this digest has the name they refer to."""
    held = records.where("kind = 'response' AND fault IS NULL").select(F.col("record_id").alias("refers_to"), "payload_digest").distinct()
    return records.where("kind = 'revisit'").join(held, ["refers_to", "payload_digest"], "left_anti")
