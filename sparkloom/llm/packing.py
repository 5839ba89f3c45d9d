"""Best-fit packing of tokenised documents by minimum bin slack.

Tokens never leave the executors' rows: what decides a packing is how many pieces there are
of each length, a histogram of at most ``capacity`` numbers however large the corpus is. The
driver solves that histogram: each step seeds a sequence with the longest length left, a
bitset dynamic programme over the lengths left (as many of each as there are) finds the
fullest content, and that pattern is used as often as the counts allow. Spark numbers the
pieces within each length, salted so that a common length is spread over tasks, and a piece's
number picks its place in a pattern.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import id_and_text, written

#: Bytes of words and ids that a Python worker remembers, about; later words are encoded each time.
MEMO_BYTES = 48_000_000
ROWS_A_BUCKET = 50_000


class _Loose(Exception):
    """White space follows a space, so words can't be encoded one by one."""


def little(ids: list[int]) -> bytes:
    """Unsigned little-endian 32 bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Encoder(dict):
    """Ids of ' ' + word as little-endian bytes, by word.

    Byte-level BPE never joins across a space that a non-space follows, so a text's ids are
    those of its space-led words in a row. Other texts are encoded whole.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(json_path) as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.json_path, self.full, self.room = json_path, None, MEMO_BYTES
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Loose
        ids = self._ids(" " + word)
        if self.room > 0:
            self[word] = ids
            self.room -= 200 + 4 * len(word) + len(ids)
        return ids

    def _ids(self, text: str) -> bytes:
        return little(self.bpe.encode_ordinary(text))

    def encode(self, text: str) -> bytes:
        if "<|" in text and any(s in text for s in self.special):
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.json_path)
            return little(self.full.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        try:
            return (self._ids(first) if first else b"") + b"".join(map(self.__getitem__, rest))
        except _Loose:
            return self._ids(text)


@cache
def encoder(json_path: str, ranks_path: str) -> _Encoder:
    """The one of this worker."""
    return _Encoder(json_path, ranks_path)


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids]: each document's ids and the end id, cut into pieces of at most ``capacity``.

    Of a document of more than ``capacity`` ids all pieces but the first are full. A null or
    empty text is the end id alone. Repeated rows give their pieces once per row.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(json_path, ranks_path).encode, np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].array, batch["text"].array):
                ids = encode(text) + end
                n, view = len(ids) // 4, memoryview(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = view[4 * a : 4 * b]
                    out.append((doc, i, a, b - a, zlib.crc32(part), *((np.frombuffer(part, "<u4").astype("int32"),) if keep_ids else ())))
            yield pd.DataFrame(out, columns=names)

    kinds = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"} | ({"ids": "array<int>"} if keep_ids else {})
    names = list(kinds)
    return id_and_text(docs).mapInPandas(pieces, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def fullest(counts: list[int], room: int) -> list[int]:
    """The multiset of lengths, each at most counts[length] times, with the largest sum up to room: subset sums as bits of an int."""
    reach, stages = 1, []
    mask = (1 << (room + 1)) - 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        if not counts[length]:
            continue
        stages.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:  # copies in powers of two
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(stages):
        while not before >> total & 1:
            total -= length
            chosen.append(length)
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) patterns that use up the histogram exactly."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    patterns = []
    for seed in range(capacity, 0, -1):
        while counts[seed]:
            counts[seed] -= 1
            content = [seed, *sorted(fullest(counts, capacity - seed), reverse=True)]
            counts[seed] += 1
            need = {x: content.count(x) for x in content}
            times = min(counts[x] // k for x, k in need.items())
            for x, k in need.items():
                counts[x] -= times * k
            patterns.append((times, content))
    return patterns


def pack(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """token_pieces plus sequence_id and offset: sequences of at most ``capacity`` ids, gapless from offset 0.

    An empty table gives no rows. Equal lengths are interchangeable; which of them shares a
    sequence with which others is decided by a hash of id and piece.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, json_path, ranks_path, capacity, end_id, keep_ids))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    patterns = minimum_bin_slack(histogram, capacity)
    used, first, places = dict.fromkeys(histogram, 0), 0, []
    for times, content in patterns:
        offset = 0
        for length in content:
            places.append((length, used[length], first, offset))
            used[length] += times
            offset += length
        first += times
    places.sort()
    table = np.array(places, dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast((table[:, 0] * 2**44 + table[:, 1], table[:, 1:]))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        keys, rows = shared.value
        number = number.to_numpy(np.int64)
        at = np.searchsorted(keys, length.to_numpy(np.int64) * 2**44 + number, side="right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 1] + number - rows[at, 0], "offset": rows[at, 2]})

    buckets = max(64, sum(histogram.values()) // ROWS_A_BUCKET)
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["length", "bucket"])
    place = placed("length", (F.col("first") + F.col("nth")).cast("long"))
    return numbered.withColumn("place", place).select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *["ids"] * keep_ids)
