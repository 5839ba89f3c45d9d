"""Near-duplicate classes by BagMinHash.

A document is the multiset of its five-word shingles, a shingle's count its weight. The weight
axis is cut into [0, 1), [1, 2), [2, 4), [4, 8) ...; over each piece runs a Poisson process,
seeded by the shingle and the piece, whose points come in order of their value. A point also
has a register and a height within its piece, and counts if its height is below the shingle's
weight. Each register keeps the least value, so two documents agree in a register with the
probability of their weighted Jaccard similarity, and a process ends once its next value
exceeds all that the document's registers hold.

Registers are read in bands, and documents that share a band are candidates: its bucket. A
document's popularity is how often it meets others in its buckets, and a bucket's most popular
document is its hub; documents of one bucket are so in one hub's group, and near copies mostly in
the group of the text that they were made from. Links are verified on the multisets
themselves, in two steps. First each group streams past its hub, however large it is. Then the
documents whose class is not their hub's are compared with all of their group, in blocks of
bounded size, of which only links between different classes come out. A group of more than one
block is cut into grades of size beforehand, such that documents alike are of one grade or of
two next to each other. After each step the classes are contracted: of all links each document
keeps one, to its class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import partitions, text_of, written
from sparkloom.operators.reports import numbered

SHINGLE = 5
#: Bands of 8 registers, none in two bands. A pair at 0.8 shares none of 48 with probability 1.5e-4.
BAND_ROWS, BANDS = 8, 48
REGISTERS = BAND_ROWS * BANDS
WORDS_KEPT = 100_000
#: Members of a group that are compared with its hub in one run of rows.
RUN = 2_000
#: Shingles of one side of a block.
SIDE = 250_000
#: Links that a task holds to contract them.
LINKS_HELD = 250_000
#: Ids from here on are numbered from here, in their order; names of documents without an id follow from NULL_NAMES on.
HIGH_IDS, NULL_NAMES = 2**62, 2**62 + 2**61
#: Shingles that a task signs at once.
BLOCK = 120_000
#: Gaps of a process are whole multiples of 1 / GRAIN, so their sums are exact however they are added up.
GRAIN = 2.0**32

_rng = np.random.Generator(np.random.PCG64(8))
_FACTORS = _rng.integers(0, 2**62, 8, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
_BANDS = _rng.permutation(REGISTERS).reshape(BANDS, BAND_ROWS)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS_KEPT and len(word) <= 64:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: _Words | None = None) -> np.ndarray:
    """64 bit names of a text's five-word shingles in order: lower-cased words between white space. A shorter text is one shingle; one without words has none."""
    parts = text.lower().split()
    h = np.fromiter(map((_Words() if words is None else words).__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
    out = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, dtype=np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out += h[k : k + n] * _FACTORS[k]
    return mixed(out)


class Bag:
    """A multiset of shingles: sorted names, how often each stands, and how many there are."""

    def __init__(self, of: np.ndarray) -> None:
        self.names, self.counts = np.unique(of, return_counts=True)
        self.n = len(of)

    def likeness(self, other: Bag) -> float:
        """The weighted Jaccard similarity; of two empty multisets 1."""
        small, large = (self, other) if len(self.names) <= len(other.names) else (other, self)
        if not small.n:
            return float(not large.n)
        at = np.minimum(np.searchsorted(large.names, small.names), len(large.names) - 1)
        both = int(np.minimum(small.counts, large.counts[at])[large.names[at] == small.names].sum())
        return both / (self.n + other.n - both)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    return Bag(a).likeness(Bag(b))


def signatures(bags: list[np.ndarray]) -> np.ndarray:
    """BagMinHash registers of each multiset of shingles; an empty one's are infinite."""
    docs = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    registers = np.full((len(bags), REGISTERS), np.inf)
    if not len(docs):
        return registers
    all_of = np.concatenate(bags)
    key = all_of ^ (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # alike only for equal shingles of one document
    order = np.lexsort((all_of, key))
    key, all_of, docs = key[order], all_of[order], docs[order]
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (docs[1:] != docs[:-1]))))
    weight = np.diff(np.append(new, len(key)))
    shingle, doc = all_of[new], docs[new]
    pieces = np.where(weight > 1, np.floor(np.log2(np.maximum(weight - 1, 1))).astype(np.int64) + 2, 1)
    take = np.repeat(np.arange(len(new)), pieces)
    piece = np.arange(len(take)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    doc, weight = doc[take], weight[take]
    base = np.where(piece == 0, 0, 1 << np.maximum(piece - 1, 0))  # the piece's lower end
    width = np.where(piece == 0, 1, base)
    seed = mixed(shingle[take] + piece.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    value, point = np.zeros(len(take)), 0
    flat = registers.reshape(-1)
    while len(doc):
        steps = int(min(64, max(1, BLOCK // (2 * len(doc)))))
        t = np.arange(point, point + steps, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = mixed(seed[:, None] + t[None, :])
        gaps = np.rint(-np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * GRAIN)
        sums = value[:, None] + np.cumsum(gaps, axis=1)
        values = sums / (GRAIN * width[:, None])  # exact too, by powers of two
        more = mixed(bits + np.uint64(0x2545F4914F6CDD1D))
        height = base[:, None] + ((more >> np.uint64(8)) % width[:, None].astype(np.uint64)).astype(np.int64)
        counts = height < weight[:, None]
        at = doc[:, None] * REGISTERS + (more % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(flat, at[counts], values[counts])
        value = sums[:, -1]
        go_on = values[:, -1] < registers.max(axis=1)[doc]
        doc, weight, base, width, seed, value = (x[go_on] for x in (doc, weight, base, width, seed, value))
        point += steps
    return registers


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64 bit key for each band of each signature."""
    bits = registers.view(np.uint64)
    out = np.zeros((len(registers), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        out = mixed(out * _FACTORS[7] + bits[:, _BANDS[:, k]])
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc, copy, keys: of each row the hash of its text and its band keys (none for a text without words, null for one that stood before in its batch)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc"], "copy": batch["copy"], "keys": None})[batch["copy"].duplicated()]
            rows = batch[~batch["copy"].duplicated()]
            texts, at = rows["text"].array, 0
            while at < len(texts):
                begin, bags, size = at, [], 0
                while at < len(texts) and size < BLOCK:
                    bags.append(shingles(texts[at], words))
                    size += max(len(bags[-1]), 32)  # a short text has as many registers
                    at += 1
                keys = bands(signatures(bags))
                some = rows.iloc[begin:at]
                yield pd.DataFrame({"doc": some["doc"].to_numpy(), "copy": some["copy"].to_numpy(), "keys": [k if len(b) else k[:0] for k, b in zip(keys, bags)]})

    return docs.select("doc", F.md5("text").alias("copy"), "text").mapInPandas(sign, "doc long, copy string, keys array<long>")


def against_hubs(given: DataFrame, threshold: float) -> DataFrame:
    """hub, doc, n (shingles), linked (with the hub) of given: hub, salt, member (0: the hub itself), doc, text."""

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, at, held = _Words(), None, []  # the hub's bags: one for each of its texts
        for batch in batches:
            out = []
            for hub, salt, member, doc, text in zip(*(batch[c].array for c in ("hub", "salt", "member", "doc", "text"))):
                bag = Bag(shingles(text, words))
                if not member:
                    if at != (hub, salt):
                        at, held = (hub, salt), []
                    held.append(bag)
                    if salt == 0:
                        out.append((hub, doc, bag.n, True))
                else:
                    out.append((hub, doc, bag.n, any(bag.likeness(x) >= threshold for x in held)))
            yield pd.DataFrame(out, columns=["hub", "doc", "n", "linked"])

    dealt = given.repartition(partitions(given.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "member")
    return dealt.mapInPandas(met, "hub long, doc long, n long, linked boolean")


def across(loose: list[Bag], own: np.ndarray, members: list[Bag], of: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between different labels, no more than join them: loose bags with the labels own, each against all members with the labels of."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    _, ids = np.unique(np.concatenate([b.names for b in members]), return_inverse=True)
    names = np.concatenate([b.names for b in members])
    place = np.zeros(ids.max() + 1, dtype=np.uint64)
    place[ids] = names  # sorted, each name once
    counts, sizes = np.concatenate([b.counts for b in members]), np.array([b.n for b in members])
    begins = np.cumsum([0, *(len(b.names) for b in members[:-1])])
    held, links = np.zeros(len(place), dtype=counts.dtype), []
    for bag, label in zip(loose, own.tolist()):
        at = np.minimum(np.searchsorted(place, bag.names), len(place) - 1)
        there = place[at] == bag.names
        held[at[there]] = bag.counts[there]
        both = np.add.reduceat(np.minimum(held[ids], counts), begins)
        held[at] = 0
        for other in np.unique(of[(both / (sizes + bag.n - both) >= threshold) & (of != label)]).tolist():
            a, b = find(label), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((max(label, other), min(label, other)))
    return links


#: A block: the hub, and of loose documents and of members the grade and the part of it.
BLOCK_OF = ("hub", "loose_grade", "row", "grade", "column")


def blocks(loose: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """BLOCK_OF, loose, label, text: the loose documents of each group beside all its members. loose: hub, doc, n, label, loose, all_n (of the group).

    Documents alike have sizes that differ by no more than the threshold's factor, so in a group of
    more than one block a loose document goes only to members of its own grade of size and of the
    two beside it.
    """
    step = max(-math.log(threshold), 0.01) * 1.0001  # wider than needed, so that no rounding parts two sizes
    loose_n, all_n = F.sum(F.when(F.col("loose"), F.col("n"))), F.sum("n")
    whole = loose.groupBy("hub").agg(loose_n.alias("loose_n"))
    grade = F.when(F.greatest("loose_n", "all_n") > SIDE, F.floor(F.ln(F.greatest("n", F.lit(1))) / step)).otherwise(0).cast("int")
    graded = loose.join(whole, "hub").withColumn("grade", grade).drop("loose_n", "all_n")
    parts = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / SIDE).cast("int")
    cells = graded.groupBy("hub", "grade").agg(F.when(F.max("loose"), F.greatest(parts(loose_n), F.lit(1))).otherwise(0).alias("rows"), F.greatest(parts(all_n), F.lit(1)).alias("columns"))
    beside = cells.select("hub", "rows", "columns", F.col("grade").alias("of"), F.explode(F.array(*[F.col("grade") + i for i in (-1, 0, 1)])).alias("grade"))
    own = F.col("of") == F.col("grade")
    reach = beside.groupBy("hub", "grade").agg(F.collect_list(F.struct("of", "rows", "columns")).alias("near"), F.max(F.when(own, F.col("rows"))).alias("rows"), F.max(F.when(own, F.col("columns"))).alias("columns"))
    at = F.pmod(F.xxhash64("doc"), F.when(F.col("side"), F.col("rows")).otherwise(F.col("columns"))).cast("int")
    # the hub's class needs its members only as the other side; a loose document stands on both
    sided = graded.join(reach, ["hub", "grade"]).withColumn("side", F.explode(F.when(F.col("loose"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    each = lambda x, n: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(x["of"].alias("grade"), i.alias("part")))
    met = F.flatten(F.transform("near", lambda x: F.when(F.col("side"), each(x, x["columns"])).otherwise(each(x, x["rows"]))))
    spread = sided.select("hub", "doc", "label", "side", F.struct("grade", at.alias("part")).alias("own"), F.explode(met).alias("other"))
    a, b = (F.when(F.col("side") == is_loose, F.col("own")).otherwise(F.col("other")) for is_loose in (True, False))
    placed = spread.select("hub", a.alias("a"), b.alias("b"), F.col("side").alias("loose"), "label", "doc")
    named = placed.select("doc", "hub", F.col("a.grade").alias("loose_grade"), F.col("a.part").alias("row"), F.col("b.grade").alias("grade"), F.col("b.part").alias("column"), "loose", "label")
    return named.join(known, "doc").drop("doc")


def within_groups(given: DataFrame, threshold: float) -> DataFrame:
    """a, c: links between labels. given: BLOCK_OF, loose, label, text; each BLOCK_OF is a block of bounded size."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        words = _Words()
        group = group[group["text"].str.strip() != ""]  # another text of an id may be empty
        bags, is_loose, labels = [Bag(shingles(t, words)) for t in group["text"].array], group["loose"].to_numpy(), group["label"].to_numpy()
        two_sides = is_loose.any() and not is_loose.all()
        links = across([bags[i] for i in np.flatnonzero(is_loose)], labels[is_loose], [bags[i] for i in np.flatnonzero(~is_loose)], labels[~is_loose], threshold) if two_sides else []
        return pd.DataFrame(links, columns=["a", "c"]).astype("int64")

    return given.groupBy(*BLOCK_OF).applyInPandas(settle, "a long, c long")


def forest(links: DataFrame) -> DataFrame:
    """a, c: for each task's links (a, c) as few that join the same documents, c the least of them."""

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        def out() -> pd.DataFrame:
            pairs = [(x, top) for x in root if (top := find(x)) != x]
            return pd.DataFrame(pairs, columns=["a", "c"]).astype("int64")

        for batch in batches:
            for link in zip(batch["a"].tolist(), batch["c"].tolist()):
                x, y = (find(root.setdefault(node, node)) for node in link)
                root[max(x, y)] = min(x, y)
            if len(root) > LINKS_HELD:
                yield out()
                root.clear()
        yield out()

    return links.mapInPandas(joined, "a long, c long")


def components(links: DataFrame) -> DataFrame:
    """node, label: of each node of links (a, c) but the least of a component the least node that it is connected with.

    Each round a node keeps one link, to the least of its neighbours, and hands the others down to
    that one; then it jumps to where that one's own link leads. There are never more links than
    at first, and no more than nodes once nothing moves.
    """
    edges = written(forest(links.where("a != c")))
    while True:
        low = edges.groupBy("a").agg(F.min("c").alias("low"))
        rest = edges.join(low, "a").where("c != low").select(F.greatest("c", "low").alias("a"), F.least("c", "low").alias("c"), F.lit(True).alias("moved"))
        onward = low.select(F.col("a").alias("low"), F.col("low").alias("next"))
        jumped = low.join(onward, "low", "left").select("a", F.coalesce("next", "low").alias("c"), F.col("next").isNotNull().alias("moved"))
        edges = written(jumped.unionByName(rest))
        if edges.where("moved").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("c").alias("label"))
        edges = edges.select("a", "c")


def relabelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """rows with column replaced by its label, where it has one."""
    named = labels.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    return rows.join(named, F.col(column) == F.col("__node"), "left").withColumn(column, F.coalesce("__label", column)).drop("__node", "__label")


def hub_groups(firsts: DataFrame) -> DataFrame:
    """hub, doc, size (of the hub's group) for the documents of each bucket that has several; of firsts' doc and keys.

    Buckets, and documents below, are joined by sorting at any size: what is small enough to be
    broadcast on a small table isn't on a large one.
    """
    rows = firsts.select("doc", F.explode("keys").alias("key"))
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(rows.join(crowded.hint("merge"), "key"))
    popular = buckets.groupBy("doc").agg(F.sum("n").alias("popularity"))
    hubs = buckets.join(popular, "doc").groupBy("key").agg(F.max(F.struct("popularity", F.bitwise_not("doc").alias("least"))).alias("most")).select("key", F.bitwise_not("most.least").alias("hub"))
    pairs = written(buckets.join(hubs, "key").select("hub", "doc").distinct())
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("size")).where("size > 1")
    return pairs.join(sizes, "hub")


def labels_of(known: DataFrame, threshold: float) -> DataFrame:
    """doc, label of each row of known (doc, text)."""
    signs = written(signed(known))
    firsts = written(signs.groupBy("copy").agg(F.min("doc").alias("doc"), F.any_value("keys", True).alias("keys")))
    reps = signs.select("doc", "copy").join(firsts.select("copy", F.col("doc").alias("rep")), "copy")
    # first against the hubs
    members = hub_groups(firsts)
    runs, is_hub = F.ceil(F.col("size") / RUN).cast("int"), F.col("hub") == F.col("doc")
    salts = F.when(is_hub, F.sequence(F.lit(0), runs - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), runs).cast("int")))
    given = members.hint("merge").join(known, "doc").select("hub", F.explode(salts).alias("salt"), F.when(is_hub, 0).otherwise(1).alias("member"), "doc", "text")
    met = written(against_hubs(given, threshold))
    links = met.where("linked").select(F.greatest("doc", "hub").alias("a"), F.least("doc", "hub").alias("c"))
    several = signs.groupBy("doc").agg(F.min("copy").alias("low"), F.max("copy").alias("high")).where("low != high")  # ids of more than one text
    one_id = several.select("doc").join(reps, "doc").select(F.greatest("doc", "rep").alias("a"), F.least("doc", "rep").alias("c"))
    labels = components(links.unionByName(one_id))
    # then whoever is not of the hub's class against the whole group
    rows = relabelled(met.select("hub", "doc", "n", F.col("doc").alias("label")), "label", labels)
    core, others = F.max(F.when(is_hub, F.col("label"))).alias("core"), F.when(~is_hub, F.col("label"))
    open_groups = rows.groupBy("hub").agg(core, F.min(others).alias("low"), F.max(others).alias("high"), F.sum("n").alias("all_n")).where("low != high").drop("low", "high")
    loose = written(rows.join(open_groups, "hub").withColumn("loose", F.col("label") != F.col("core")))
    if not loose.isEmpty():
        more = written(within_groups(blocks(loose, known, threshold), threshold))
        if not more.isEmpty():
            roots = components(more)
            labels = written(relabelled(labels, "label", roots).unionByName(roots))  # a label is no node of labels
    return relabelled(reps.select("doc", F.col("rep").alias("label")), "label", labels)


def high_names(docs: DataFrame, doc_id: str) -> DataFrame | None:
    """id, name of docs' ids from HIGH_IDS on; None if there are none."""
    ids = docs.select(F.col(doc_id).cast("long").alias("id")).where(F.col("id") >= HIGH_IDS)
    return None if ids.isEmpty() else written(numbered(ids.distinct(), ["id"]).select("id", (F.col("place") + (HIGH_IDS - 1)).alias("name")))


def keyed(docs: DataFrame, doc_id: str, text: str, names: DataFrame | None) -> DataFrame:
    """doc, text, row (of all docs' columns): an empty text for a null one, a name of its own for each text of a null id and the high_names."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("text"), F.struct(*docs.columns).alias("row"))
    doc = F.coalesce("id", F.lit(NULL_NAMES) + F.pmod(F.xxhash64("text"), F.lit(NULL_NAMES - HIGH_IDS))).alias("doc")
    if names is None:
        return rows.select(doc, "text", "row")
    low = rows.where(F.col("id").isNull() | (F.col("id") < HIGH_IDS))  # apart, so that null ids are no key of the join
    return low.select(doc, "text", "row").unionByName(rows.join(names, "id").select(F.col("name").alias("doc"), "text", "row"))


def unnamed(rows: DataFrame, column: str, names: DataFrame | None) -> DataFrame:
    """rows with the ids that column's names stand for, null for those of null ids."""
    low = lambda some: some.withColumn(column, F.when(F.col(column) < HIGH_IDS, F.col(column)))
    if names is None:
        return low(rows)
    high = F.col(column).between(HIGH_IDS, NULL_NAMES - 1)
    of = names.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    back = rows.where(high).join(of, F.col(column) == F.col("__name")).withColumn(column, F.col("__id")).drop("__id", "__name")
    return low(rows.where(~high)).unionByName(back)


def classes(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id of each row of docs: the least doc_id that it is linked with, over any number of links.

    Documents are linked if their texts are equal or the weighted Jaccard similarity of their
    five-word shingles is the threshold or more. Texts without words are only linked with
    equal texts; a null text is an empty one. Rows that share a doc_id are one document, linked
    as any of its texts is, and all get its class. Rows without an id are documents of their
    own, one for each text; their class is null unless they are linked with an id. Links between equal texts are not compared, and a link's
    verification is exact up to 64 bit shingle names; a link is overlooked if none of its
    BANDS agrees. An empty table gives no rows.
    """
    names = high_names(docs, doc_id)
    out = labels_of(keyed(docs, doc_id, text, names).select("doc", "text"), threshold)
    if names is not None:
        out = written(out)
    return unnamed(unnamed(out, "doc", names), "label", names).select(F.col("doc").alias("doc_id"), F.col("label").alias("class_id"))


def one_of_each(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each class: of its least doc_id; where several rows have that, the one whose hash is least."""
    rows = keyed(docs, doc_id, text, high_names(docs, doc_id))
    first = labels_of(rows.select("doc", "text"), threshold).where("doc = label").select("doc").distinct()
    kept = rows.join(first, "doc", "left_semi")
    return kept.groupBy("doc").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
