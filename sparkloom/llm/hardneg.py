"""Hard-negative mining with coordinate pruning in the manner of LEMP.

All rows are laid out by falling length: Spark deals them in ranges of length to groups, and a
task cuts its group into buckets. A bucket holds its vectors, its greatest length and, for each
coordinate, the list of its vectors by that coordinate of the vector scaled to length 1. Blocks
of anchors stream past the groups. For an anchor q that needs a score of at least s in a bucket
of length l, a vector must make an angle with q whose cosine is at least t = s / (|q| l):

- if t > 1, no vector of the bucket does, and none of the group if l is the group's;
- else, for each coordinate, such a vector's value is in a range around q's own. The ranges for
  the anchor's focus coordinates, its largest ones, are cut out of the sorted lists, and only
  what all of them hold is a candidate. Candidates' integer scores are then worked out exactly.

The score needed rises as rows are found. Three searches of this kind follow each other: the
group of the longest vectors gives each anchor a first bound; all groups give its best rows of
the same label; and all groups give the best rows of other labels between the bounds that each
of those sets. A group gives at most as many rows an anchor (and positive) as are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import NULL_ID, partitions, written
from sparkloom.llm.whitening import sound, steps_of

#: Rows of a bucket and anchors of a block, at most; entries of a group's vectors, about (26 bytes each in a task).
BUCKET, BLOCK, GROUP_ENTRIES = 2048, 256, 2**22
FOCUS = 3
#: What rounding may move a bound of a range or a cosine by, and more.
SLACK = 1e-9
#: Scores below this are exact as doubles.
EXACT = 2**53
NOTHING = -(2**62)


@dataclass
class Bucket:
    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    longest: float
    #: For each coordinate the vectors' numbers by their value in it, and those values.
    order: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, ids: bytes, labels: bytes, matrix: bytes, order: bytes) -> Bucket:
        i = np.frombuffer(ids, "<i8")
        m = np.frombuffer(matrix, "<i4").reshape(len(i), -1).astype(np.float64)
        o = np.frombuffer(order, "<u2").reshape(m.shape[1], len(i))
        unit, lengths = scaled(m)
        return cls(i, np.frombuffer(labels, "<i8"), m, float(lengths.max()), o, np.take_along_axis(unit.T, o.astype(np.int64), axis=1))

    def candidates(self, q: np.ndarray, length: float, least: float, focus: int = FOCUS) -> np.ndarray | None:
        """Numbers of the vectors that may have a score of at least ``least`` with q, of that length; None if that may be any."""
        if least <= 0:
            return None  # scores of zero and less have no range
        reach = length * self.longest
        t = least / reach if reach else 2.0
        if t > 1 + SLACK:
            return np.empty(0, np.int64)
        t, q = min(t, 1.0), q / length
        at = np.argpartition(np.abs(q), -min(focus, len(q)))[-focus:]
        away = np.sqrt((1 - t * t) * np.maximum(1 - q[at] ** 2, 0))
        low, high = np.where(q[at] < -t, -1.0, t * q[at] - away), np.where(q[at] > t, 1.0, t * q[at] + away)
        seen, lists = None, 0
        for f, a, b in zip(at, low, high):
            i, j = np.searchsorted(self.values[f], (a - SLACK, b + SLACK))
            if j - i == len(self.ids):
                continue
            if seen is None:
                seen = np.zeros(len(self.ids), np.uint8)
            seen[self.order[f, i:j]] += 1
            lists += 1
        return None if seen is None else np.flatnonzero(seen == lists)

    def scores(self, q: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """The scores of the chosen vectors with q: integers, exact as doubles."""
        return self.matrix[chosen] @ q if 2 * len(chosen) < len(self.ids) else (self.matrix @ q)[chosen]


def scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 (zeros stay), and their lengths."""
    lengths = np.sqrt(np.square(m).sum(axis=1))
    return m / np.where(lengths, lengths, 1)[:, None], lengths


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by falling score, then by id."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def rows_of(df: DataFrame, key: str, label: str, vector: str, scale: int, anchor: Column) -> DataFrame:
    """id (null: NULL_ID), label, x, norm2, anchor of the rows that take part."""
    rows = df.where(sound(F.col(vector)) & F.col(label).isNotNull())
    rows = rows.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(label).cast("long").alias("label"), steps_of(F.col(vector), scale, 0).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return rows.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double")))


def _packed(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of up to so many consecutive rows."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        while batch.num_rows:
            n = most - sum(b.num_rows for b in held)
            held.append(batch.slice(0, n))
            batch = batch.slice(n)
            if sum(b.num_rows for b in held) == most:
                yield _joined(held)
                held = []
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(held)
    number = lambda c: t.column(c).to_numpy().astype(np.int64)
    x = np.concatenate([b.column("x").flatten().to_numpy(zero_copy_only=False) for b in held])
    return number("id"), number("label"), x.reshape(t.num_rows, -1)


PARTS = "ids binary, labels binary, matrix binary"


def buckets_of(rows: DataFrame, groups: int) -> DataFrame:
    """group, bucket, longest, ids, labels, matrix, order: rows by falling length in so many groups. Rows of one length fall to as many groups as they fill."""
    # a number of its own for each row, so that no length makes a group too large
    dealt = rows.select("id", "label", "x", "norm2", F.monotonically_increasing_id().alias("row")).repartitionByRange(groups, F.desc("norm2"), "row").sortWithinPartitions(F.desc("norm2"), "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal group
            for b in batches:
                if b.num_rows:
                    group = b.column("group")[0].as_py()
                    yield b

        for k, (ids, labels, x) in enumerate(_packed(noted(), BUCKET)):
            unit, lengths = scaled(x.astype(np.float64))
            order = np.argsort(unit.T, axis=1, kind="stable").astype("<u2")
            row = [group, k, float(lengths.max()), *(a.astype(kind).tobytes() for a, kind in ((ids, "<i8"), (labels, "<i8"), (x, "<i4"))), order.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, _BUCKET)], names=["group", "bucket", "longest", "ids", "labels", "matrix", "order"])

    return dealt.select(F.spark_partition_id().alias("group"), "id", "label", "x").mapInArrow(cut, f"group int, bucket int, longest double, {PARTS}, order binary")


_BUCKET = [pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4]


def blocks_of(anchors: DataFrame, n: int) -> DataFrame:
    """block, ids, labels, matrix of n anchors, at most BLOCK a block; an anchor's number is block * BLOCK and its place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 24
        for k, (ids, labels, x) in enumerate(_packed(batches, BLOCK)):
            row = [part + k, *(a.astype(kind).tobytes() for a, kind in ((ids, "<i8"), (labels, "<i8"), (x, "<i4")))]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, [pa.int64(), *[pa.binary()] * 3])], names=["block", "ids", "labels", "matrix"])

    return anchors.select("id", "label", "x").repartition(max(1, -(-n // BLOCK))).mapInArrow(cut, f"block long, {PARTS}")


#: What a search finds: place is the positive's for which a row is found, or 0.
FOUND = "anchor long, place int, id long, score long"


def search(buckets: DataFrame, blocks: DataFrame, longest: dict[int, float], copies: int, visit: Callable) -> DataFrame:
    """FOUND of blocks of anchors in the groups of buckets that ``longest`` names.

    blocks: block, ids, labels, matrix, bounds (place, thing, low, high of anchors), need: the
    least cosine times length that any of the block's anchors asks for, or null if there is no
    bound; groups whose longest vector doesn't reach it don't see the block. Each group is there
    in so many copies, over which its blocks are dealt. visit(held, ids, labels, matrix, bounds)
    gives (place in the block, place, ids, scores).
    """
    known = F.lit(list(longest.values())) if longest else F.array().cast("array<double>")
    numbers = F.lit(list(longest)) if longest else F.array().cast("array<int>")
    reached = F.filter(F.arrays_zip(numbers.alias("g"), known.alias("l")), lambda x: F.col("need").isNull() | (x["l"] * (1 + SLACK) >= F.col("need")))
    asks = blocks.select(F.explode(reached).alias("to"), *blocks.columns).select(F.col("to.g").alias("group"), F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("salt"), F.lit(1).alias("kind"), "block", *PARTS_NAMES, F.lit(None).cast("binary").alias("order"), "bounds")
    empty = F.lit(None).cast("array<struct<at:int,place:int,low:bigint,high:bigint>>").alias("bounds")
    data = buckets.where(F.col("group").isin(list(longest))).select("group", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("salt"), F.lit(0).alias("kind"), F.col("bucket").cast("long").alias("block"), *PARTS_NAMES, "order", empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                where = (row["group"].as_py(), row["salt"].as_py())
                if where != at:
                    at, held = where, []
                parts = [row[c].as_buffer() for c in PARTS_NAMES]
                if row["kind"].as_py() == 0:
                    held.append(Bucket.of(*parts, row["order"].as_buffer()))
                    continue
                if not held:
                    continue
                ids, labels = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<i8")
                matrix = np.frombuffer(parts[2], "<i4").reshape(len(ids), -1).astype(np.float64)
                out = [(row["block"].as_py() * BLOCK + i, p, r, s) for i, p, found, scores in visit(held, ids, labels, matrix, row["bounds"].as_py() or []) for r, s in zip(found.tolist(), scores.astype(np.int64).tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "place", "id", "score"])

    dealt = data.unionByName(asks).repartition(partitions(buckets.sparkSession), "group", "salt").sortWithinPartitions("group", "salt", "kind", "block")
    return dealt.mapInArrow(run, FOUND)


PARTS_NAMES = [x.split()[0] for x in PARTS.split(", ")]


def same_label(k: int) -> Callable:
    """A visit for each anchor's k best rows of its label and another id. bounds: (at, 0, a score that the k-th reaches, -)."""

    def visit(held, ids, labels, matrix, bounds):
        least = np.full(len(ids), float(NOTHING))
        for x in bounds:
            least[x["at"]] = x["low"]
        lengths = np.sqrt(np.square(matrix).sum(axis=1))
        for i, q in enumerate(matrix):
            found, scores = np.empty(0, np.int64), np.empty(0)
            for b in held:
                near = b.candidates(q, lengths[i], least[i])
                near = np.flatnonzero(b.labels == labels[i]) if near is None else near[b.labels[near] == labels[i]]
                near = near[b.ids[near] != ids[i]]
                s = b.scores(q, near)
                good = s >= least[i]
                found, scores = np.concatenate([found, b.ids[near[good]]]), np.concatenate([scores, s[good]])
                keep = best(scores, found, k)
                found, scores = found[keep], scores[keep]
                if len(scores) == k:
                    least[i] = max(least[i], scores[-1])
            if len(found):
                yield i, 0, found, scores

    return visit


def other_labels(k: int) -> Callable:
    """A visit for each anchor and positive's k best rows of other labels with a score between two bounds. bounds: (at, place, low, high)."""

    def visit(held, ids, labels, matrix, bounds):
        asked: dict[int, list] = {}
        for x in bounds:
            asked.setdefault(x["at"], []).append([x["place"], float(x["low"]), float(x["high"]), np.empty(0, np.int64), np.empty(0)])
        lengths = np.sqrt(np.square(matrix).sum(axis=1))
        for i, wants in asked.items():
            q, most = matrix[i], max(w[2] for w in wants)
            for b in held:
                least = min(w[1] for w in wants)
                near = b.candidates(q, lengths[i], least)
                near = np.flatnonzero(b.labels != labels[i]) if near is None else near[b.labels[near] != labels[i]]
                s = b.scores(q, near)
                good = (s >= least) & (s <= most)
                near, s = b.ids[near[good]], s[good]
                for w in wants:
                    mine = (s >= w[1]) & (s <= w[2])
                    if mine.any():
                        found, scores = np.concatenate([w[3], near[mine]]), np.concatenate([w[4], s[mine]])
                        keep = best(scores, found, k)
                        w[3], w[4] = found[keep], scores[keep]
                        if len(keep) == k:
                            w[1] = max(w[1], w[4][-1])
            for place, _, _, found, scores in wants:
                if len(found):
                    yield i, place, found, scores

    return visit


def ranked(found: DataFrame, k: int) -> DataFrame:
    """found with rank from 1: the k first of each anchor and place. There are at most k of them a group."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bounded(blocks: DataFrame, bounds: DataFrame) -> DataFrame:
    """blocks with their anchors' bounds (anchor, place, low, high), of which a block has few, and need."""
    at = F.pmod("anchor", F.lit(BLOCK)).cast("int")
    of = bounds.groupBy(F.floor(F.col("anchor") / BLOCK).alias("block")).agg(F.collect_list(F.struct(at.alias("at"), "place", "low", "high")).alias("bounds"))
    rows = blocks.join(of, "block", "left")

    @F.pandas_udf("double")
    def need(sizes: pd.Series, matrices: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for n, m, b in zip(sizes, matrices, marks):
            lengths = np.sqrt(np.square(np.frombuffer(m, "<i4").reshape(n, -1).astype(np.float64)).sum(axis=1))
            low = np.full(n, -np.inf)
            least: dict[int, int] = {}
            for x in b if b is not None else ():
                least[x["at"]] = min(x["low"], least.get(x["at"], x["low"]))
            for i, v in least.items():
                low[i] = v
            low = np.where(low > 0, low / np.where(lengths > 0, lengths, 1), -np.inf)
            out.append(None if not n or np.isneginf(low.min()) else float(low.min()))
        return pd.Series(out, dtype="Float64")

    return rows.withColumn("need", need((F.octet_length("ids") / 8).cast("int"), "matrix", "bounds"))


def mine(df: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows that the column ``anchors`` marks.

    A component c counts as floor(scale * c), a score is the inner product of two rows. An
    anchor's positives are its first rows with its label and another id by falling score, then
    by id; a positive's negatives the first rows of other labels whose score is at least low
    and at most high per cent of the positive's. All, where there are fewer.

    Rows with a null label, or whose vector is null, empty or has a null or non-finite entry,
    take no part. A null id is smaller than any other, is no anchor unless it is marked, and
    comes out as null. Rows that share an id are rows of their own, each an anchor if it is
    marked, but none another's positive. An empty table, or one without anchors, gives no rows.
    Vectors of different lengths, and scores from 2^53 on, are errors. Other columns aren't looked at.
    """
    spark = df.sparkSession
    rows = rows_of(df, key, label, vector, scale, anchors)
    n, n_anchors, least, d, longest2 = rows.agg(F.count("*"), F.count_if("anchor"), F.min(F.size("x")), F.max(F.size("x")), F.max("norm2")).first()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if least != d:
        raise ValueError(f"vectors of {least} and of {d} entries")
    if longest2 >= EXACT:
        raise OverflowError("scores from 2^53 on aren't exact")
    buckets = written(buckets_of(rows, max(partitions(spark), -(-n * d // GROUP_ENTRIES))))
    longest = {r.group: r.l for r in buckets.groupBy("group").agg(F.max("longest").alias("l")).collect()}  # two numbers a group
    blocks = written(blocks_of(rows.where("anchor"), n_anchors))
    nothing = blocks.select("*", F.array().cast("array<struct<at:int,place:int,low:bigint,high:bigint>>").alias("bounds"), F.lit(None).cast("double").alias("need"))

    first = min(longest, key=lambda g: (-longest[g], g))
    seeds = ranked(search(buckets, nothing, {first: longest[first]}, partitions(spark), same_label(positives)), positives)
    seeds = seeds.where(F.col("rank") == positives).select("anchor", "place", F.col("score").alias("low"), F.lit(0).cast("long").alias("high"))
    found = written(ranked(search(buckets, bounded(blocks, seeds), longest, 1, same_label(positives)), positives))
    # decimals, since doubles may be one off
    lowest, highest = (F.expr(f"CAST({rounded}(CAST(score * {share} AS DECIMAL(20, 0)) / 100) AS BIGINT)") for rounded, share in (("ceil", low), ("floor", high)))
    wants = found.select("anchor", F.col("rank").alias("place"), lowest.alias("low"), highest.alias("high")).where("low <= high")
    asked = bounded(blocks, wants).where("bounds IS NOT NULL")
    hard = ranked(search(buckets, asked, longest, 1, other_labels(negatives)), negatives)
    names = blocks.select("block", F.posexplode(ids_of("ids")).alias("at", "anchor_id")).select((F.col("block") * BLOCK + F.col("at")).alias("anchor"), "anchor_id")
    pairs = found.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "anchor")
    named = lambda c: F.nullif(c, F.lit(NULL_ID)).alias(c)
    return hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "place"]).select(named("anchor_id"), named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")


def ids_of(packed: str) -> Column:
    """The longs in a binary column of little-endian ones."""

    @F.pandas_udf("array<long>")
    def unpacked(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.frombuffer(v, "<i8"))

    return unpacked(packed)
