"""Removal of repeated byte spans by prefix doubling over positions.

A position's rank at length L names the L bytes that start there: equal ranks, equal bytes.
Ranks double: the one at 2L is made of those at p and p + L. A rank is a 64 bit name made from
its two halves, so tasks need no shuffle to double up to any length within their own text, and
Spark's sorts bring equal ranks of all documents together.

Sorting every byte's rank would write many times the corpus to disk, so the first sort takes a
sample that misses nothing. Of the ``GRAM`` byte ranks in the ``span`` bytes at p, the least
one is p's anchor; equal spans have equal anchors at equal places. Consecutive positions with
one anchor are a segment, and the first sort is by the anchor's rank and then by the name of
all that the segment's spans cover. Segments that are alone with their anchor are unique and
drop out. Of segments that cover equal bytes all but the first repeat it whole. Where one
anchor has several kinds of segment, the first of each kind goes on: the second sort compares
positions by the pair of ranks (64 bytes at p, the rest of the span at p + 64). The kinds of
one anchor come to it together with the bytes that they cover, and their positions are ranked
there; where an anchor has more than ``KINDS_TOGETHER`` kinds, Spark sorts their positions one
by one.

Each task first settles what repeats within itself, so that a passage in a third of all
documents gives a sort one row for each task. A phrase that stands amid ever other text is no
such passage: its anchor has as many kinds as it has places. A share of the documents, ranked
beforehand, shows such anchors; they have several kinds for sure, so their kinds are dealt to
many tasks, and which anchors are found so changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, partitions, written

GRAM = 32
#: Bytes named at once; a longer text is cut into overlapping blocks. Places in a block take 20 bits.
BLOCK = 2**18
#: Rows that a task holds to settle repeats within itself.
ROWS_HELD = 500_000
KINDS_TOGETHER = 1_000
#: One of so many documents is ranked beforehand. An anchor with HOT_KINDS kinds or one in HOT_SHARE of all kinds there, whichever is more, is dealt to SALTS tasks; there are HOT_SHARE such anchors at most.
SAMPLED, HOT_KINDS, HOT_SHARE, SALTS = 32, 64, 20_000, 256

_rng = np.random.Generator(np.random.PCG64(20))
_BYTE_NAMES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FACTORS = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64(2**20 - 1)


def pair(first: np.ndarray, second: np.ndarray, k: int) -> np.ndarray:
    """The name of two named halves."""
    x = first * _FACTORS[k]
    x ^= x >> np.uint64(31)
    x += second
    x *= _FACTORS[15]
    x ^= x >> np.uint64(29)
    return x


def ranks(data: np.ndarray, span: int) -> tuple[dict[int, np.ndarray], list[int]]:
    """Names at lengths 1, 2, 4 ... below span of each position, doubled, and the lengths whose sum is the part of the span after the longest."""
    names = {1: _BYTE_NAMES[data]}
    length, k = 1, 0
    while 2 * length <= span:
        half = names[length]
        names[2 * length] = pair(half[:-length], half[length:], k) if len(half) > length else half[:0]
        length, k = 2 * length, k + 1
    rest = [1 << b for b in reversed(range((span - length).bit_length())) if (span - length) >> b & 1]
    return names, rest


def blocks(ids: list, twins: list, texts: list[bytes], span: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int, int]]]]:
    """(bytes, parts): a part is (row, where it begins in the text, from, to, positions) of the bytes."""
    held, parts, size = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while at + span <= len(text):
            piece = text[at : at + BLOCK + span - 1]
            parts.append((row, at, size, size + len(piece), len(piece) - span + 1))
            held.append(piece)
            size += len(piece)
            at += BLOCK
            if size >= BLOCK:
                yield np.frombuffer(b"".join(held), np.uint8), parts
                held, parts, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(held), np.uint8), parts


def segments(data: np.ndarray, parts: list, span: int) -> tuple[np.ndarray, ...]:
    """part, start in the block, positions, anchor's rank, name of what is covered: for each run of positions with one anchor."""
    names, _ = ranks(data, span)
    gram, long = names[GRAM], names[64]
    window = span - GRAM + 1
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    valid = np.zeros(len(least) + 2, dtype=bool)
    for _, _, a, _, n in parts:
        valid[a + 1 : a + 1 + n] = True
    changes = np.ones(len(least) + 1, dtype=bool)
    np.not_equal(least[1:], least[:-1], out=changes[1:-1])
    edge = np.zeros(len(least) + 2, dtype=bool)  # where a part begins, a run does
    edge[[a + 1 for _, _, a, _, _ in parts]] = True
    inside = valid[1:-1]
    lo = np.flatnonzero(inside & (changes[:-1] | ~valid[:-2] | edge[1:-1]))
    hi = np.flatnonzero(inside & (changes[1:] | ~valid[2:] | edge[2:]))
    anchor = pair(gram[(least[lo] & _PLACE).astype(np.int64)], np.uint64(0), 9)
    tail = hi + span - 64
    covered = pair(pair(long[lo], long[(lo + tail) // 2], 10), long[tail] + (hi - lo).astype(np.uint64), 11)
    part = np.searchsorted(np.array([a for _, _, a, _, _ in parts]), lo, side="right") - 1
    return part, lo, hi - lo + 1, anchor.view(np.int64), covered.view(np.int64)


def merged(doc: np.ndarray, twin: np.ndarray, start: np.ndarray, length: np.ndarray) -> pd.DataFrame:
    """Intervals joined where they touch or overlap, as closed rows of ROWS."""
    if not len(doc):
        return _rows(doc, twin, start, length, False)
    order = np.lexsort((start, twin, doc))
    doc, twin, start, stop = doc[order], twin[order], start[order], (start + length)[order]
    other = np.ones(len(doc), dtype=bool)
    other[1:] = (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])
    # running ends restart at each text: lift each text's ends above all of the one before
    lift = np.cumsum(other) * np.int64(2**33)
    ends = np.maximum.accumulate(stop + lift) - lift
    new = other.copy()
    new[1:] |= start[1:] > ends[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return _rows(doc[first], twin[first], start[first], ends[last] - start[first], False)


ROWS = "doc long, twin long, start long, length long, open boolean, key long"


def _rows(doc, twin, start, length, is_open: bool, key=0) -> pd.DataFrame:
    return pd.DataFrame({"doc": doc, "twin": twin, "start": start, "length": length, "open": is_open, "key": key})


#: What the sorts deal out. size 0: an interval (start, name) that is known to go, not to be sorted.
KEYED = "key long, name long, doc long, twin long, start long, size int, salt int"


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    if not len(some):
        return np.zeros(len(keys), dtype=bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def settled_here(rows: list[tuple[np.ndarray, ...]], extra: Callable[[np.ndarray], np.ndarray], hot: np.ndarray) -> Iterator[pd.DataFrame]:
    """Of a task's (key, name, doc, twin, start, size): the first of each (key, name); the rest as intervals of extra(size) bytes. Keys in hot (sorted) are salted by name."""
    key, name, doc, twin, start, size = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((start, doc, name, key))
    key, name, doc, twin, start, size = (x[order] for x in (key, name, doc, twin, start, size))
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    stays = (doc == doc[first]) & (start == start[first])  # the same place in a repeated row is not an earlier one
    yield pd.DataFrame({"key": key[stays], "name": name[stays], "doc": doc[stays], "twin": twin[stays], "start": start[stays], "size": size[stays].astype(np.int32), "salt": np.where(among(key[stays], hot), name[stays] & (SALTS - 1), 0).astype(np.int32)})
    gone = ~stays
    known = merged(doc[gone], twin[gone], start[gone], extra(size[gone]))
    spread = known["doc"].to_numpy() * np.int64(0x9E3779B97F4A7C1) + known["start"].to_numpy()
    yield pd.DataFrame({"key": spread, "name": known["length"], "doc": known["doc"], "twin": known["twin"], "start": known["start"], "size": np.int32(0), "salt": np.int32(0)})


def hot_anchors(docs: DataFrame, span: int) -> np.ndarray:
    """Anchors, sorted, that have very many kinds in the documents whose hash falls to the sample."""
    some = docs.where(F.pmod(F.xxhash64("doc", "twin"), F.lit(SAMPLED)) == 0)
    kinds = written(first_ranks(some, span, np.zeros(0, np.int64)).where("size > 0").select("key", "name").distinct().groupBy("key").agg(F.count("*").alias("n")))
    most = kinds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HOT_SHARE
    return np.array(sorted(r["key"] for r in kinds.where(F.col("n") >= max(HOT_KINDS, most)).collect()), dtype=np.int64)


def first_ranks(docs: DataFrame, span: int, hot: np.ndarray) -> DataFrame:
    """KEYED rows of all segments."""

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in batches:
            ids, twins, texts = batch["doc"].to_numpy(np.int64), batch["twin"].to_numpy(np.int64), [t.encode() for t in batch["text"].array]
            for data, parts in blocks(ids, twins, texts, span):
                part, lo, n, anchor, covered = segments(data, parts, span)
                row, at, begin = (np.array([p[k] for p in parts], dtype=np.int64)[part] for k in (0, 1, 2))
                held.append((anchor, covered, ids[row], twins[row], at + lo - begin, n.astype(np.int32)))
                count += len(part)
                if count >= ROWS_HELD:
                    yield from settled_here(held, lambda n: n - 1 + span, hot)
                    held, count = [], 0
        if held:
            yield from settled_here(held, lambda n: n - 1 + span, hot)

    return docs.select("doc", "twin", "text").mapInPandas(ranked, KEYED)


def sorted_out(keyed: DataFrame, span: int, goes_on: bool, hot: np.ndarray) -> DataFrame:
    """ROWS after a sort by rank: closed intervals of what repeats an earlier row; with goes_on, as open ones the first of each kind whose key has several kinds, as all in hot have."""

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key0 = name0 = doc0 = start0 = None  # of the first row of the kind at hand
        waiting = None  # first rows of the last key, as a frame, and whether the key has other kinds
        for batch in batches:
            known = batch["size"].to_numpy() == 0
            if known.any():
                x = batch[known]
                yield _rows(x["doc"].to_numpy(), x["twin"].to_numpy(), x["start"].to_numpy(), x["name"].to_numpy(), False)
                batch = batch[~known]
            if not len(batch):
                continue
            key, name, doc, twin, start, size = (batch[c].to_numpy() for c in ("key", "name", "doc", "twin", "start", "size"))
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
            new[0] = key0 is None or key[0] != key0 or name[0] != name0
            kind = np.cumsum(new)  # 0: the kind that was at hand
            at = np.flatnonzero(new)
            docs_of = np.concatenate(([doc0 if doc0 is not None else 0], doc[at]))
            starts_of = np.concatenate(([start0 if start0 is not None else -1], start[at]))
            stays = (doc == docs_of[kind]) & (start == starts_of[kind])
            gone = ~stays
            if gone.any():
                yield merged(doc[gone], twin[gone], start[gone], size[gone].astype(np.int64) - 1 + span)
            if goes_on:
                firsts = pd.DataFrame({"key": key[stays], "name": name[stays], "doc": doc[stays], "twin": twin[stays], "start": start[stays], "length": size[stays].astype(np.int64), "several": among(key[stays], hot)})
                if waiting is not None:
                    firsts = pd.concat([waiting, firsts], ignore_index=True)
                if len(firsts):
                    k, m = firsts["key"].to_numpy(), firsts["name"].to_numpy()
                    differs = (k[1:] == k[:-1]) & (m[1:] != m[:-1])
                    several = firsts["several"].to_numpy().copy()
                    several[1:] |= differs
                    several[:-1] |= differs
                    # rows of one kind at one place (repeated ids) share their kind's fate
                    kinds = np.cumsum(np.concatenate(([True], (k[1:] != k[:-1]) | (m[1:] != m[:-1]))))
                    several = np.bincount(kinds, several)[kinds] > 0
                    firsts["several"] = several
                    done = kinds < kinds[-1]
                    waiting = firsts[~done]
                    out = firsts[done & several]
                    yield _rows(*(out[c].to_numpy() for c in ("doc", "twin", "start", "length")), True, out["key"].to_numpy())
            key0, name0, doc0, start0 = key[-1], name[-1], docs_of[kind[-1]], starts_of[kind[-1]]
        if waiting is not None and waiting["several"].any():
            out = waiting[waiting["several"]]
            yield _rows(*(out[c].to_numpy() for c in ("doc", "twin", "start", "length")), True, out["key"].to_numpy())

    by = ("key", "salt") if goes_on else ("key", "name")  # the last ranks need no other of their key
    dealt = keyed.repartition(partitions(keyed.sparkSession), *by).sortWithinPartitions("key", "name", "doc", "start")
    return dealt.mapInPandas(settle, ROWS)


def pair_ranks(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the longest power of two of bytes at each position, and of the rest of its span."""
    names, rest = ranks(data, span)
    place = max(names)
    n, name = len(data) - span + 1, None
    first = names[place][:n]
    for k, length in enumerate(rest):
        piece = names[length][place : place + n]
        name = piece if name is None else pair(name, piece, k)
        place += length
    return first.view(np.int64), (np.zeros(n, np.uint64) if name is None else name).view(np.int64)


#: KEYED, and the bytes that a segment covers; none for single positions.
COVERED = KEYED + ", bytes binary"


def last_ranks(docs: DataFrame, span: int) -> DataFrame:
    """COVERED rows of each text's open segments (opened: start, length, key, crowded): whole, or if crowded position by position."""

    def single(held: list[tuple[np.ndarray, ...]]) -> Iterator[pd.DataFrame]:
        for rows in settled_here(held, lambda n: n - 1 + span, np.zeros(0, np.int64)):
            yield rows.assign(bytes=b"")

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in batches:
            whole = []
            for doc, twin, text, opened in zip(batch["doc"].array, batch["twin"].array, batch["text"].array, batch["opened"].array):
                data = text.encode()
                for x in opened:
                    start, n = x["start"], x["length"]
                    covers = data[start : start + n - 1 + span]
                    if x["crowded"]:
                        key, name = pair_ranks(np.frombuffer(covers, np.uint8), span)
                        held.append((key, name, np.full(n, doc, np.int64), np.full(n, twin, np.int64), start + np.arange(n), np.ones(n, np.int32)))
                        count += n
                    else:
                        whole.append((x["key"], 0, doc, twin, start, n, 0, covers))
                if count >= ROWS_HELD:
                    yield from single(held)
                    held, count = [], 0
                if len(whole) >= 10_000:
                    yield pd.DataFrame(whole, columns=names)
                    whole = []
            yield pd.DataFrame(whole, columns=names)
        if held:
            yield from single(held)

    names = [x.split()[0] for x in COVERED.split(", ")]
    return docs.mapInPandas(ranked, COVERED)


def repeats_among(rows: pd.DataFrame, span: int) -> pd.DataFrame:
    """ROWS of positions of COVERED rows whose span an earlier position of the same key has."""
    pieces = rows["bytes"].tolist()
    first, second = pair_ranks(np.frombuffer(b"".join(pieces), np.uint8), span)
    sizes = rows["size"].to_numpy(np.int64)
    row = np.repeat(np.arange(len(rows)), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begins = np.cumsum(sizes + span - 1) - (sizes + span - 1)
    at = begins[row] + within
    key, doc, start = rows["key"].to_numpy()[row], rows["doc"].to_numpy()[row], rows["start"].to_numpy()[row] + within
    a, b = first[at], second[at]
    order = np.lexsort((start, doc, b, a, key))
    key, a, b, doc, start, row = (x[order] for x in (key, a, b, doc, start, row))
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    of = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = (doc != doc[of]) | (start != start[of])
    return merged(doc[gone], rows["twin"].to_numpy()[row[gone]], start[gone], np.full(gone.sum(), span, np.int64))


def together(covered: DataFrame, span: int) -> DataFrame:
    """ROWS of what repeats among the segments of each key, which are KINDS_TOGETHER at most."""

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None  # the last key's rows
        for batch in batches:
            rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            last = rows["key"].to_numpy() == rows["key"].iloc[-1] if len(rows) else np.zeros(0, bool)
            waiting, rows = rows[last], rows[~last]
            if len(rows):
                yield repeats_among(rows, span)
        if waiting is not None and len(waiting):
            yield repeats_among(waiting, span)

    dealt = covered.repartition(partitions(covered.sparkSession), "key").sortWithinPartitions("key", "doc", "start")
    return dealt.mapInPandas(settle, ROWS)


def cut(text: str, gone: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text's bytes, and how many bytes in how many runs go; gone: (start, length)."""
    data, left, at, removed, runs, end = text.encode(), [], 0, 0, 0, -1
    for start, length in sorted(gone):
        stop = start + length
        if start > end:
            runs += 1
            left.append(data[at:start])
        removed += max(0, stop - max(start, at))
        at = end = max(at, stop)
    return b"".join(left) + data[at:], removed, runs


def remove_repeats(docs: DataFrame, span: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary): the UTF-8 bytes of its text without those that an earlier ``span`` byte string covers.

    A byte goes if it lies in a string of ``span`` bytes that also starts earlier: in a smaller
    doc_id, or further left in the same one; overlapping strings count and all are judged on
    the input. A null or empty text has no bytes; a null doc_id is the smallest. Repeated rows
    are one document: a string at the same start of the same doc_id is not an earlier one.
    Equality of strings is that of two 64 bit names.
    kept can end amid a character. Columns of docs with these names are replaced.
    span is 2 * GRAM + 1 or more and less than 2 * 64 + GRAM.
    """
    assert 2 * GRAM < span < 128
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.withColumns({"__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), "__twin": F.xxhash64(whole)})
    texts = base.select(F.col("__doc").alias("doc"), F.col("__twin").alias("twin"), whole.alias("text"))
    hot = hot_anchors(texts, span)
    first = written(sorted_out(first_ranks(texts, span, hot), span, True, hot))
    crowds = written(first.where("open").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > KINDS_TOGETHER))
    going_on = first.where("open").join(crowds, "key", "left").withColumn("crowded", F.col("n").isNotNull())
    opened = going_on.groupBy("doc", "twin").agg(F.collect_list(F.struct("start", "length", "key", "crowded")).alias("__opened"))
    # with every column of docs, so that the exchange of texts is the one that the last join has, and Spark writes it once
    opened = opened.withColumnsRenamed({"doc": "__d", "twin": "__t"})
    again = base.join(opened, (F.col("__doc") == F.col("__d")) & (F.col("__twin") == F.col("__t"))).select(F.col("__d").alias("doc"), F.col("__t").alias("twin"), whole.alias("text"), F.col("__opened").alias("opened"), F.struct(*docs.columns).alias("carried"))
    ranked = last_ranks(again, span)
    intervals = first.where("NOT open").unionByName(together(ranked.where("octet_length(bytes) > 0"), span))
    if not crowds.isEmpty():
        intervals = intervals.unionByName(sorted_out(ranked.where("octet_length(bytes) = 0").drop("bytes"), span, False, hot))
    gone = intervals.groupBy("doc", "twin").agg(F.collect_set(F.struct("start", "length")).alias("__gone")).withColumnsRenamed({"doc": "__d", "twin": "__t"})

    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def left_over(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut(t, [(x["start"], x["length"]) for x in g]) for t, g in zip(texts.array, gone.array)], columns=["kept", "n_removed", "n_spans"])

    joined = base.join(gone, (F.col("__doc") == F.col("__d")) & (F.col("__twin") == F.col("__t")), "left")
    cut_up = joined.withColumn("__cut", F.when(F.col("__gone").isNotNull(), left_over(whole, F.coalesce("__gone", F.array().cast("array<struct<start:bigint,length:bigint>>")))))
    columns = {"n_bytes": F.octet_length(whole).cast("long"), "kept": F.coalesce("__cut.kept", F.encode(whole, "UTF-8"))} | {c: F.coalesce(f"__cut.{c}", F.lit(0)).cast("long") for c in ("n_removed", "n_spans")}
    return cut_up.withColumns(columns).drop("__doc", "__twin", "__d", "__t", "__gone", "__cut")
