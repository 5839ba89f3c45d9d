"""Line dedup by a sharded minimal perfect hash.

Spark counts the documents of each distinct line hash. The hashes that are common enough are
split into shards of bounded size; each shard becomes one row: a minimal perfect hash (hash and
displace) and, at its slots, fingerprint, count (up to 255) and keeper arrays. Documents' line
hashes are dealt to the shards and stream past the arrays; a shard is copied, and its probes
are salted, as often as their number asks for, so that a line in every document is spread over
tasks. Lines are never joined to lines.

A line is known by 128 bits of its key's hash: 64 place it, and the other 64 are the
fingerprint that a slot must hold for the line to be the one counted there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, partitions, written

#: The white space that a key loses at both ends.
SPACES = b" \t\n\x0b\x0c\r"
#: Keys of a shard; more if there would be over MOST_SHARDS of them.
SHARD_KEYS, MOST_SHARDS = 50_000, 500_000
KEYS_A_BUCKET = 4
#: Probes for which a shard gets one more copy.
PROBES_A_COPY = 100_000


def keys_of(text: str, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, 16 byte hash) of each line whose key has min_chars code points; A-Z fold to lower case."""
    found = []
    for i, line in enumerate(text.encode().lower().split(b"\n")):
        key = line.strip(SPACES)
        if len(key) >= min_chars and len(key.decode()) >= min_chars:
            found.append((i, xxhash.xxh3_128_digest(key)))
    return found


def hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, twin, line, place, fingerprint of each long line; twin tells rows of one doc_id and different texts apart."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, twins, at, digests = [], [], [], []
            for doc, twin, text in zip(batch["doc_id"].array, batch["twin"].array, batch["text"].array):
                for i, digest in keys_of(text, min_chars):
                    ids.append(doc)
                    twins.append(twin)
                    at.append(i)
                    digests.append(digest)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pd.DataFrame({"doc_id": ids, "twin": twins, "line": at, "place": halves[:, 0], "fingerprint": halves[:, 1]})

    return docs.select("doc_id", "twin", "text").mapInPandas(lines, "doc_id long, twin long, line int, place long, fingerprint long")


def _mixed(x: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64 bit finaliser of x and seed."""
    x = (x ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def perfect_hash(keys: np.ndarray) -> np.ndarray:
    """A seed for each bucket, such that slots() sends distinct uint64 keys to distinct slots of len(keys)."""
    n, buckets = len(keys), max(1, math.ceil(len(keys) / KEYS_A_BUCKET))
    home = (_mixed(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    sizes = np.bincount(home, minlength=buckets)
    ends = np.cumsum(sizes)
    seeds, taken = np.zeros(buckets, dtype=np.uint32), np.zeros(n, dtype=bool)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        own, start = keys[order[ends[b] - sizes[b] : ends[b]]], 1
        while True:  # many seeds at a time
            tries = np.arange(start, start + 64, dtype=np.uint64)
            slots_of = _mixed(own[None, :], tries[:, None]) % np.uint64(n)
            good = ~taken[slots_of].any(axis=1)
            if len(own) > 1:
                good &= (np.diff(np.sort(slots_of, axis=1), axis=1) != 0).all(axis=1)
            if good.any():
                k = int(good.argmax())
                seeds[b] = tries[k]
                taken[slots_of[k]] = True
                break
            start += 64
    return seeds


def slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    home = (_mixed(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    return (_mixed(keys, seeds[home].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def line_counts(lines: DataFrame) -> DataFrame:
    """place, fingerprint, n_docs, keeper (the largest doc_id) of each distinct line."""
    return lines.select("place", "fingerprint", "doc_id").distinct().groupBy("place", "fingerprint").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def index(common: DataFrame, shards: int) -> DataFrame:
    """One row a shard: seeds, fingerprints, counts and keepers as little-endian arrays in slot order. Places are distinct."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["place"].to_numpy(np.int64).view(np.uint64)
        seeds = perfect_hash(keys)
        at = slots(keys, seeds, len(keys))
        arrays = []
        for column, kind in (("fingerprint", "<i8"), ("n_docs", "u1"), ("keeper", "<i8")):
            values = np.empty(len(keys), dtype=kind)
            values[at] = group[column].clip(upper=255) if kind == "u1" else group[column]
            arrays.append(values.tobytes())
        return pd.DataFrame([(group["shard"].iloc[0], seeds.astype("<u4").tobytes(), *arrays)], columns=["shard", "seeds", "fingerprints", "counts", "keepers"])

    return common.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, seeds binary, fingerprints binary, counts binary, keepers binary")


def probed(lines: DataFrame, shard_rows: DataFrame, copies: DataFrame, least: int, shards: int, min_docs: int) -> DataFrame:
    """doc_id, twin, line, keeper of each line that the index has with min_docs documents.

    Each (shard, salt) is a run of rows in a sorted partition: first the shard's arrays, then the
    hashes that look them up, which stream past in batches of any number. copies has a row
    (shard, copies) for the shards that have more copies than ``least``, MOST_SHARDS at most.
    """
    # zeros, not nulls, of which pandas would make floats
    nothing = [F.lit(0).cast(kind).alias(name) for name, kind in (("doc_id", "long"), ("twin", "long"), ("line", "int"), ("place", "long"), ("fingerprint", "long"))]
    several = F.broadcast(copies)
    n = F.coalesce("copies", F.lit(least))
    arrays = shard_rows.join(several, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"), F.lit(0).alias("kind"), *nothing, "seeds", "fingerprints", "counts", "keepers")
    empty = [F.lit(None).cast("binary").alias(x) for x in ("seeds", "fingerprints", "counts", "keepers")]
    asks = lines.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).join(several, "shard", "left")
    asks = asks.select("shard", F.pmod(F.xxhash64("doc_id", "twin", "line"), n).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "twin", "line", "place", "fingerprint", *empty)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for batch in batches:
            where = list(zip(batch["shard"].array, batch["salt"].array))
            cuts = [0, *(i for i in range(1, len(where)) if where[i] != where[i - 1]), len(where)]
            for a, b in zip(cuts, cuts[1:]):
                run = batch.iloc[a:b]
                if a < b and where[a] != at:
                    at, held = where[a], None
                if a < b and run["kind"].iloc[0] == 0:
                    row = run.iloc[0]
                    held = np.frombuffer(row["seeds"], "<u4"), np.frombuffer(row["fingerprints"], "<i8"), np.frombuffer(row["counts"], "u1"), np.frombuffer(row["keepers"], "<i8")
                    run = run.iloc[1:]
                if held is None or not len(run):
                    continue
                seeds, prints, counts, keepers = held
                slot = slots(run["place"].to_numpy(np.int64).view(np.uint64), seeds, len(prints))
                hit = (prints[slot] == run["fingerprint"].to_numpy(np.int64)) & (counts[slot] >= min(min_docs, 255))
                yield run.loc[hit, ["doc_id", "twin", "line"]].astype("int64").assign(keeper=keepers[slot[hit]])

    dealt = arrays.unionByName(asks).repartition(partitions(lines.sparkSession), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return dealt.mapInPandas(look_up, "doc_id long, twin long, line int, keeper long")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its text less repeated lines, and n_lines, n_dropped (replaced if docs has such columns).

    A line whose key (white space off both ends, A-Z folded) has min_chars code points and is
    found in min_docs documents stays only in the largest doc_id that holds it, there as often as
    it occurs. A null or empty text is one empty line. Rows with the same doc_id are one document
    when documents are counted and each loses its own lines; a null doc_id is the smallest.
    An empty table gives no rows.
    """
    known = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    lines = written(hashed(known.withColumn("twin", F.xxhash64("text")), min_chars))
    common = line_counts(lines).where(F.col("n_docs") >= min_docs)
    # places are nearly always distinct; where two lines share one, both are told apart by the rest of their hash
    common = written(common)
    if not common.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        lines, common = (x.withColumn("place", F.xxhash64("place", "fingerprint")) for x in (lines, common))
    n = common.count()
    shards = max(1, math.ceil(n / max(SHARD_KEYS, n / MOST_SHARDS)))
    least = 1 + lines.count() // shards // PROBES_A_COPY  # all lines fall to the shards alike, but for common ones
    of = common.groupBy(F.pmod("place", F.lit(shards)).cast("int").alias("shard")).agg((F.floor(F.sum("n_docs") / PROBES_A_COPY) + least).cast("int").alias("copies"))
    hits = probed(lines, index(common, shards), of.where(F.col("copies") > least), least, shards, min_docs).where("keeper != doc_id")
    dropped = hits.groupBy("doc_id", "twin").agg(F.collect_set("line").alias("__lines")).withColumnsRenamed({"doc_id": "__id", "twin": "__twin"})

    @F.pandas_udf("string")
    def kept(texts: pd.Series, drops: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts.array, drops.array):
            if gone is not None:
                gone = set(gone.tolist())
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            out.append(text)
        return pd.Series(out, dtype=object)

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), "__hash": F.xxhash64(whole)})
    joined = keyed.join(dropped, (F.col("__doc") == F.col("__id")) & (F.col("__hash") == F.col("__twin")), "left")
    counted = joined.withColumns({"n_lines": (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long"), "n_dropped": F.coalesce(F.size("__lines"), F.lit(0)).cast("long")})
    return counted.withColumn(text, F.when(F.col("n_dropped") > 0, kept(whole, F.col("__lines"))).otherwise(whole)).drop("__doc", "__hash", "__id", "__twin", "__lines")
