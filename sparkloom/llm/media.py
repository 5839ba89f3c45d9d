"""Media payloads in content-defined chunks.

A gear hash of the last 32 bytes rolls over a payload and cuts it where its high bits are
zero, so equal stretches of different payloads come to equal chunks. A chunk is stored once,
as a compressed frame under its SHA-256, with the payload that owns it (of those that have it
the one whose name is least); Spark's joins on digests find the owners. What is stored of a
payload is its ordered chunk list and the frames it owns. Reading back, frames owned elsewhere
are joined in, every frame is opened and held against its digest, and the pieces in order are
the payload.

A payload's name, its blob, is the first KEY bytes of its text's SHA-256: equal texts are one
payload, and each row takes what its text gives.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import text_of, written

UNIT = 192
LEAST, LARGEST, MASK_BITS = 512, 8192, 11
WINDOW = 32
LEVEL = 6
#: Bytes of a digest by which Spark joins chunks and payloads; whole digests verify what is read back.
KEY = 16
MAGIC = b"CDC1"
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)


def payload_of(text: str) -> bytes:
    """UTF-8, filled up with spaces to a positive multiple of UNIT bytes."""
    data = text.encode()
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def candidates(data: np.ndarray) -> np.ndarray:
    """Where the gear hash of the WINDOW bytes before a place allows a cut."""
    found, block = [], 2**20
    for begin in range(0, len(data), block):
        h, shift = _GEAR[data[max(0, begin - WINDOW + 1) : begin + block]], 1
        while shift < WINDOW:
            more = h.copy()
            more[shift:] += h[:-shift] << np.uint32(shift)
            h, shift = more, 2 * shift
        at = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + max(0, begin - WINDOW + 1) + 1
        found.append(at[at > begin])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(payload: bytes) -> list[int]:
    """Ends of a payload's chunks: at candidates at least LEAST after the last cut, at LARGEST bytes without one."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    places, ends, at = candidates(np.frombuffer(payload, np.uint8)), [], 0
    while n - at > LEAST:
        k = np.searchsorted(places, at + LEAST)
        at = min(int(places[k]) if k < len(places) else n, at + LARGEST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(payload: bytes) -> list[bytes]:
    ends = cuts(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def manifest(digests: list[bytes], lengths: list[int]) -> bytes:
    """The ordered chunk list as bytes."""
    return MAGIC + struct.pack("<I", len(digests)) + b"".join(d + struct.pack("<I", n) for d, n in zip(digests, lengths))


def opened(frames: list[bytes], digests: list[bytes]) -> bytes:
    """The payload that frames hold, each verified."""
    decompress, parts = zstandard.ZstdDecompressor().decompress, []
    for frame, digest in zip(frames, digests, strict=True):
        part = decompress(frame)
        if hashlib.sha256(part).digest() != digest:
            raise ValueError("a stored chunk is not what its digest says")
        parts.append(part)
    return b"".join(parts)


def feature(payload: bytes, lengths: list[int]) -> str:
    """Of the samples read back: chunks, level, spread, peaks and sign changes about the mean."""
    x = np.frombuffer(payload, np.uint8)
    high = x > x.mean()
    return f"chunks={len(lengths)};longest={max(lengths)};mean={x.mean():.6f};std={x.std():.6f};min={x.min()};max={x.max()};crossings={int((high[1:] != high[:-1]).sum())}"


READ = "blob binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def read_back(blob: bytes, digests: list[bytes], lengths: list[int], frames: list[bytes]) -> tuple:
    payload = opened(frames, digests)
    stored = manifest(digests, lengths) + b"".join(frames)
    return blob, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).digest(), feature(payload, lengths)


def blob_of(text: str) -> Column:
    return F.substring(F.unhex(F.sha2(text_of(text), 256)), 1, KEY)


def chunk_keys(known: DataFrame) -> DataFrame:
    """blob, key of every chunk of blob, text: the first KEY bytes of its digest."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(blob, hashlib.sha256(c).digest()[:KEY]) for blob, text in zip(batch["blob"].array, batch["text"].array) for c in chunks(payload_of(text))]
            yield pd.DataFrame(rows, columns=["blob", "key"])

    return known.mapInPandas(listed, "blob binary, key binary")


def wrapped(known: DataFrame) -> DataFrame:
    """blob, whole: texts compressed for their way to the store."""

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        for batch in batches:
            yield pd.DataFrame({"blob": batch["blob"], "whole": [compress(t.encode()) for t in batch["text"].array]})

    return known.mapInPandas(wrap, "blob binary, whole binary")


STORED = "blob binary, digests array<binary>, lengths array<int>, frames array<binary>, lent array<boolean>, foreign array<binary>"


def kept(payloads: DataFrame) -> DataFrame:
    """STORED rows of blob, whole, others (keys of chunks that another one owns) and lent (of owned ones that others have too).

    frames are in the order of digests, empty where a chunk is owned elsewhere or stood before; lent marks those that others fetch.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compress, open_ = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for begin in range(0, len(batch), 500):
                rows = []
                for r in batch.iloc[begin : begin + 500].itertuples(index=False):
                    foreign, lent = ({bytes(d) for d in x} if x is not None else set() for x in (r.others, r.lent))
                    parts = chunks(payload_of(open_(r.whole).decode()))
                    digests, frames, held = [hashlib.sha256(c).digest() for c in parts], [], set()
                    for d, c in zip(digests, parts):
                        frames.append(b"" if d in held or d[:KEY] in foreign else compress(c))
                        held.add(d)
                    rows.append((r.blob, digests, [len(c) for c in parts], frames, [f != b"" and d[:KEY] in lent for d, f in zip(digests, frames)], sorted({d for d in digests if d[:KEY] in foreign})))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in STORED.split(", ")])

    return payloads.select("blob", "whole", "others", "lent").mapInPandas(keep, STORED)


def store(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Writes docs' payloads to path (else to the shared folder): STORED rows, read from there, one of each text.

    A row holds both the ordered chunk list and the frames that its payload owns, so most are
    read back without a join; payload_lists and chunk_table are the two parts.
    """
    known = docs.select(blob_of(text).alias("blob"), text_of(text).alias("text"))
    keys = written(chunk_keys(known))
    owners = written(keys.groupBy("key").agg(F.min("blob").alias("owner"), F.max("blob").alias("last")).where("owner != last"))
    own = F.col("blob") == F.col("owner")
    marks = written(keys.join(owners, "key").groupBy("blob").agg(F.collect_set(F.when(~own, F.col("key"))).alias("others"), F.collect_set(F.when(own, F.col("key"))).alias("lent")))
    once = wrapped(known).dropDuplicates(["blob"])  # a repeated text goes once from each task
    table = kept(once.join(marks, "blob", "left"))
    if path is None:
        return written(table)
    table.write.parquet(path)
    return docs.sparkSession.read.schema(STORED).parquet(path)


def payload_lists(table: DataFrame) -> DataFrame:
    """blob, place, digest, length of every chunk of each payload in a stored table."""
    each = table.select("blob", F.posexplode(F.arrays_zip("digests", "lengths")).alias("place", "x"))
    return each.select("blob", "place", F.col("x.digests").alias("digest"), F.col("x.lengths").alias("length"))


def chunk_table(table: DataFrame, lent: bool = False) -> DataFrame:
    """digest, frame of each chunk in a stored table, or of those only that several payloads share."""
    each = table.select(F.explode(F.arrays_zip("digests", "frames", "lent")).alias("x"))
    return each.where(F.col("x.lent") if lent else F.octet_length("x.frames") > 0).select(F.col("x.digests").alias("digest"), F.col("x.frames").alias("frame")).dropDuplicates(["digest"])


def read(table: DataFrame) -> DataFrame:
    """READ rows of the payloads in a stored table, all from the bytes stored."""

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                digests = [bytes(d) for d in r.digests]
                frames = {d: bytes(f) for d, f in zip(digests, r.frames) if len(f)}
                if r.fetched is not None:
                    frames |= {bytes(x["digest"]): bytes(x["frame"]) for x in r.fetched}
                rows.append(read_back(r.blob, digests, r.lengths.tolist(), [frames[d] for d in digests]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])

    fields = ["blob", "digests", "lengths", "frames"]
    whole = table.where(F.size("foreign") == 0).select(*fields, F.lit(None).cast("array<struct<digest: binary, frame: binary>>").alias("fetched")).mapInPandas(back, READ)
    partial = table.where(F.size("foreign") > 0).select(*fields, "foreign")
    lacks = partial.select("blob", F.explode("foreign").alias("digest"))
    fetched = lacks.join(chunk_table(table, lent=True), "digest").groupBy("blob").agg(F.collect_list(F.struct("digest", "frame")).alias("fetched"))
    return whole.unionByName(partial.join(fetched, "blob").select(*fields, "fetched").mapInPandas(back, READ))


def media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_bytes and the columns of READ but blob, digests in hex, for each row of docs: what its stored payload gives, read back.

    The payloads are stored first, at path if it is given (see store), and every value is computed
    from the stored bytes. A null text is an empty one, whose payload is UNIT spaces. Rows with
    equal texts get equal values, whatever their ids, null ones too. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), blob_of(text).alias("blob"))
    joined = rows.join(read(store(docs, text, path)), "blob", "left")
    return joined.select("doc_id", "n_bytes", *[F.lower(F.hex(c)).alias(c) if c.endswith("sha256") else c for c in (x.split()[0] for x in READ.split(", ")[1:])])
