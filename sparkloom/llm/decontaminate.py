"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A window is ``span`` consecutive words of a benchmark item. Both sides keep, for each window,
the least k-gram hash in it (with k words a gram, a window holds span - k + 1 of them), with
its place. Equal windows keep equal grams, so joining the kept grams finds every shared
window. Where a document and an item share a gram, the item is laid on the document at that
shift, once however many grams they share there, and the hit is extended to every run of at
least ``span`` words that agree. Items shorter than ``span`` are one window
of their own length, with a winnowing of that length.

Where words repeat with a period of up to a gram's length, the same gram is kept again and
again. Such places are held as one progression (first, last, step), which stands in a stretch of
that period. Two stretches of one period, in a document and an item, share the windows that lie
inside both, which is arithmetic on their ends, and windows that hold an end of the document's
stretch, or of the item's: there the two stretches begin or end alike, so the item is laid on
the text at these two shifts only, and not at every place of one against every place of the
other. Stretches reach less than REACH words beyond their progression: in a window that is
inside a stretch the first of its least grams is kept, so a place of the progression that is
missing has an end of the stretch within the window that begins there.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, written

#: What separates words once A-Z are lower-cased: ASCII without digits and a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 5
#: A window of 10 words, less a gram, and a period of up to a gram: no stretch goes on so far beyond its progression.
REACH = 16
#: Bits of a kept gram that hold its place; a text has fewer than 2**28 words.
PLACE_BITS = 28
#: Kept grams of a benchmark that are broadcast; a larger benchmark is joined by shuffle.
BROADCAST_GRAMS = 200_000
#: The same of documents with candidates and of these together, and of items and their words.
BROADCAST_DOCS, BROADCAST_ITEMS = 100_000, 1_000_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; of null none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, GAP), "")


def kept_grams(hashes: str, span: int) -> Column:
    """Of an array column of word hashes: for each window of span words its least gram's hash, with the gram's place in the low bits; each once."""
    k = min(GRAM, span)
    w = span - k + 1
    h, n = F.col(hashes), F.size(hashes)
    none = F.array().cast("array<bigint>")
    gram = lambda i: F.shiftleft(F.shiftright(F.xxhash64(F.lit(span), *[F.get(h, i + j) for j in range(k)]), PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("bigint"))
    grams = F.when(n >= span, F.transform(F.sequence(F.lit(0), n - k), gram)).otherwise(none)
    if w == 1:
        return grams
    # the grams are named once, as a lambda's argument, and not worked out anew for each window
    least = lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - w), lambda i: F.least(*[F.get(g, i + j) for j in range(w)]))
    return F.array_distinct(F.flatten(F.transform(F.filter(F.array(grams), lambda g: F.size(g) >= w), least)))


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))


def alike_runs(a: str, b: str, least: str) -> Column:
    """(start, stop) of the runs of places at which array columns a and b of one length agree, of at least so many places each."""
    runs = F.array().cast("array<struct<start:int,stop:int>>")
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), runs.alias("runs"))

    def add(acc: Column, same: Column) -> Column:
        ended = F.struct((acc["at"] - acc["run"]).alias("start"), acc["at"].alias("stop"))
        out = F.when(~same & (acc["run"] >= F.col(least)), F.concat(acc["runs"], F.array(ended))).otherwise(acc["runs"])
        return F.struct((acc["at"] + 1).alias("at"), F.when(same, acc["run"] + 1).otherwise(0).alias("run"), out.alias("runs"))

    alike = F.zip_with(F.col(a), F.col(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(F.concat(alike, F.array(F.lit(False))), begin, add, lambda acc: acc["runs"])


def progressions(places: Column, k: Column) -> Column:
    """(first, last, step) of a sorted array of places: those that follow each other at one distance of up to k words are one, and a place without such is one of step 0."""

    def of(p: Column) -> Column:
        gap = lambda i: F.when(F.get(p, i) - F.get(p, i - 1) <= k, F.get(p, i) - F.get(p, i - 1)).otherwise(0)
        begins = lambda i: (i == 0) | (gap(i) == 0) | ((i > 1) & (gap(i - 1) != 0) & (gap(i) != gap(i - 1)))
        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), begins)

        def runs(at: Column) -> Column:
            def run(i: Column, j: Column) -> Column:
                last = F.coalesce(F.get(at, j + 1), F.size(p)) - 1
                return F.struct(F.get(p, i).alias("first"), F.get(p, last).alias("last"), F.when(last > i, F.get(p, i + 1) - F.get(p, i)).otherwise(0).alias("step"))

            return F.transform(at, run)

        return F.flatten(F.transform(F.array(starts), runs))

    return F.flatten(F.transform(F.array(places), of))


def on(words: Column, at: Column, step: Column, way: int) -> Column:
    """How many words from a place on, forwards (1) or backwards (-1), are those a step before (behind) them."""
    same = lambda i: F.coalesce(F.get(words, at + i * way) == F.get(words, at + i * way - way * step), F.lit(False))
    begin = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(REACH - 1)), begin, lambda acc, i: F.struct((acc["n"] + (acc["open"] & same(i)).cast("int")).alias("n"), (acc["open"] & same(i)).alias("open")), lambda acc: acc["n"])


def stretch(words: Column, first: Column, last: Column, step: Column, k: Column) -> Column:
    """(begin, end) of the words around a progression of grams that go on with its step."""
    return F.struct((first - on(words, first - 1, step, -1)).alias("begin"), (last + k + on(words, last + k, step, 1)).alias("end"))


def inside(x: Column, s: Column) -> Column:
    """(start, stop) of the document's words in windows that lie inside both stretches; stop is not above start if there are none.

    A window may begin in the document where the item has one at the same phase: at phases 0 to
    ``room`` from the item's begin on. x: an ask of step > 0; s: the document's stretch.
    """
    room = x["d"] - x["span"] - x["c"]
    phase = lambda at: F.pmod(at - x["first"] + x["q"] - x["c"], x["step"])
    low = s["begin"] + F.when(phase(s["begin"]) <= room, 0).otherwise(x["step"] - phase(s["begin"]))
    final = s["end"] - x["span"]
    high = final - F.greatest(phase(final) - room, F.lit(0))
    return F.struct(low.alias("start"), F.when((room >= 0) & (high >= low), high + x["span"]).otherwise(low).alias("stop"))


def gram_places(df: DataFrame, span: int, *keep: str) -> DataFrame:
    """keep, span, key, place of the grams kept of each row's hashes."""
    grams = df.select(*keep, F.lit(span).alias("span"), F.explode(kept_grams("hashes", span)).alias("gram"))
    return grams.select(*keep, "span", F.shiftright("gram", PLACE_BITS).alias("key"), F.col("gram").bitwiseAND(2**PLACE_BITS - 1).cast("int").alias("place"))


def item_grams(items: DataFrame, spans: list[int]) -> DataFrame:
    """item, item_n, span, key, q, own, head, stretches: each place of a kept gram, the step of its progression (0: none), whether it is that one's first, and the stretch around it for each period from 1 to GRAM."""
    places = functools.reduce(DataFrame.union, [gram_places(items.where(F.col("span") == s), s, "item") for s in spans])
    k = F.least(F.lit(GRAM), F.col("span"))
    runs = places.groupBy("item", "span", "key").agg(F.sort_array(F.collect_set("place")).alias("places")).select("item", "span", "key", F.explode(progressions(F.col("places"), k)).alias("x"))
    each = F.when(F.col("x.step") > 0, F.sequence(F.col("x.first"), F.col("x.last"), F.greatest("x.step", F.lit(1)))).otherwise(F.array("x.first"))
    rows = runs.select("item", "span", "key", F.col("x.last").alias("last"), F.col("x.step").alias("own"), F.posexplode(each).alias("nth", "q")).join(items.select("item", "item_n", "words").dropDuplicates(["item"]), "item")
    upto = lambda step: F.when((F.col("nth") == 0) & (F.col("own") == step), F.col("last")).otherwise(F.col("q"))
    stretches = F.array(*[stretch(F.col("words"), F.col("q"), upto(p), F.lit(p), k) for p in range(1, GRAM + 1)])
    return rows.select("item", "item_n", "span", "key", "q", "own", (F.col("nth") == 0).alias("head"), stretches.alias("stretches"))


def document_grams(docs: DataFrame, spans: list[int]) -> DataFrame:
    """doc_id, twin, n_words, is_first, key, p: the kept grams of each row of docs, for each span, and before them one row (is_first) with a key that no item has.

    What is said of all words comes before the grams are dealt out: a gram's row holds no words,
    so what a text costs is in proportion to its length.
    """
    known = hashed(docs.select("doc_id", F.xxhash64("text").alias("twin"), words(F.col("text")).alias("words")))
    known = known.select("doc_id", "twin", F.size("words").alias("n_words"), "hashes")
    grams = known.select("doc_id", "twin", "n_words", F.explode(F.concat(F.array(F.lit(-1).cast("bigint")), *[kept_grams("hashes", s) for s in spans])).alias("gram"))
    is_first = F.col("gram") == -1
    nowhere = F.lit(2**40) + F.pmod(F.xxhash64("doc_id", "twin"), F.lit(2**20))  # spread, and above all keys
    return grams.select("doc_id", "twin", "n_words", is_first.alias("is_first"), F.when(is_first, nowhere).otherwise(F.shiftright("gram", PLACE_BITS)).alias("key"), F.col("gram").bitwiseAND(2**PLACE_BITS - 1).cast("int").alias("p"))


def hits(docs: DataFrame, benchmark: DataFrame, span: int = 10, item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, twin, n_words of each row of docs; doc_id, twin, item_id, start, stop of the runs of words that items share).

    docs has doc_id and text without nulls; twin tells texts of one doc_id apart.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(item_text)).alias("words")).distinct().where(F.size("words") > 0)
    items = hashed(items).withColumns({"span": F.least(F.lit(span), F.size("words")), "item": F.xxhash64("item_id", "words"), "item_n": F.size("words")})
    spans = sorted(r["span"] for r in items.select("span").distinct().collect())  # at most ``span`` values
    if not spans:
        return document_grams(docs, []).select("doc_id", "twin", "n_words"), docs.sparkSession.createDataFrame([], "doc_id long, twin long, item_id string, start int, stop int")
    of_items = written(item_grams(items, spans))
    small = of_items.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    keys = of_items.select("key", F.col("span").alias("of_span")).distinct()
    met = written(document_grams(docs, spans).join(F.broadcast(keys) if small else keys, "key", "left").where("is_first OR of_span IS NOT NULL").select("doc_id", "twin", "n_words", "is_first", "key", "of_span", "p"))
    # places of one gram in one text, as progressions; then what is to be laid on the text: a shift, or a progression against an item's stretch
    found = met.where("NOT is_first").groupBy("doc_id", "twin", "key", "of_span").agg(F.sort_array(F.collect_set("p")).alias("places"))
    found = found.select("doc_id", "twin", "key", F.explode(progressions(F.col("places"), F.least(F.lit(GRAM), F.col("of_span")))).alias("x"))
    pairs = found.join(F.broadcast(of_items) if small else of_items, "key").where("head OR (x.step > 0 AND own > 0 AND x.step <> own)")
    step = F.when(F.col("x.step") > 0, F.col("x.step")).otherwise(F.col("own"))
    item_stretch = F.get("stretches", step - 1)
    ask = F.when(step == 0, F.struct("item", "item_n", "span", step.alias("step"), (F.col("x.first") - F.col("q")).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("q"), F.lit(0).alias("c"), F.lit(0).alias("d"))).otherwise(
        F.struct("item", "item_n", "span", step.alias("step"), F.col("x.first").alias("first"), F.col("x.last").alias("last"), F.col("q").alias("q"), item_stretch["begin"].alias("c"), item_stretch["end"].alias("d"))
    )
    # equal texts at one shift against an item are compared once, however many grams they share
    asks = pairs.groupBy("doc_id", "twin").agg(F.collect_set(ask).alias("asks"))
    if asks.limit(BROADCAST_DOCS + 1).select(F.size("asks").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)) + F.count("*")).first()[0] <= BROADCAST_DOCS:
        asks = F.broadcast(asks)
    texts = docs.withColumn("twin", F.xxhash64("text")).join(asks, ["doc_id", "twin"]).dropDuplicates(["doc_id", "twin"])
    texts = texts.select("doc_id", "twin", "asks", words(F.col("text")).alias("words"))
    w = F.col("words")
    begin = lambda x: F.greatest(x["shift"], F.lit(0))
    # words by their places: a slice would go through the whole text for each shift
    piece = lambda x: F.transform(F.sequence(begin(x), F.least(F.size(w), x["shift"] + x["item_n"]) - 1), lambda i: F.get(w, i))
    at = lambda x, shift: F.struct(x["item"].alias("item"), x["item_n"].alias("item_n"), shift.alias("shift"))

    def two(x: Column) -> Column:
        around = stretch(w, x["first"], x["last"], x["step"], F.least(F.lit(GRAM), x["span"]))
        return F.flatten(F.transform(F.array(around), lambda s: F.array(at(x, s["begin"] - x["c"]), at(x, s["end"] - x["d"]))))

    shifts = F.array_distinct(F.flatten(F.transform("asks", lambda x: F.when(x["step"] == 0, F.array(at(x, x["first"]))).otherwise(two(x)))))
    laid = F.transform(shifts, lambda x: F.struct(x["item"].alias("item"), x["shift"].alias("shift"), piece(x).alias("here"), F.lit(0).alias("start"), F.lit(0).alias("stop")))
    within = F.transform(F.filter("asks", lambda x: x["step"] > 0), lambda x: F.struct(x["item"].alias("item"), inside(x, stretch(w, x["first"], x["last"], x["step"], F.least(F.lit(GRAM), x["span"]))).alias("s")))
    whole = F.transform(F.filter(within, lambda y: y["s"]["stop"] > y["s"]["start"]), lambda y: F.struct(y["item"].alias("item"), F.lit(0).alias("shift"), F.lit(None).cast("array<string>").alias("here"), y["s"]["start"].alias("start"), y["s"]["stop"].alias("stop")))
    here = texts.select("doc_id", "twin", F.explode(F.concat(laid, whole)).alias("x")).select("doc_id", "twin", "x.*")
    lists = items.select("item", "item_id", "span", F.col("words").alias("item_words"))
    if items.limit(BROADCAST_ITEMS + 1).agg(F.coalesce(F.sum("item_n"), F.lit(0)) + F.count("*")).first()[0] <= BROADCAST_ITEMS:
        lists = F.broadcast(lists)
    there = F.slice("item_words", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("here"))
    agreed = F.when(F.col("here").isNull(), F.array(F.struct("start", "stop"))).otherwise(alike_runs("here", "there", "span"))
    runs = here.join(lists, "item").withColumn("there", there).select("doc_id", "twin", "item_id", begin(F.struct("shift")).alias("from"), F.explode(agreed).alias("run"))
    return met.where("is_first").select("doc_id", "twin", "n_words"), runs.select("doc_id", "twin", "item_id", (F.col("from") + F.col("run.start")).alias("start"), (F.col("from") + F.col("run.stop")).alias("stop"))


def covered(runs: Column) -> Column:
    """How many places a set of (start, stop) runs covers."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
    add = lambda acc, x: F.struct((acc["n"] + F.greatest(x["stop"] - F.greatest(x["start"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], x["stop"]).alias("upto"))
    return F.aggregate(F.array_sort(runs), start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, twin, n_words, n_hit, n_items, items (sorted as strings) for each row of docs.

    Null and empty texts have no words and no hits; items without words have no windows. Items
    with one id count as one item, a null item_id counts in n_hit only. Rows of docs that are
    repeated come once each; a null doc_id is a document like any other. An empty benchmark
    hits nothing, an empty docs gives no rows.
    """
    known = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows, found = hits(known, benchmark, span, item_id, item_text)
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("item_id", "string"), ("start", "int"), ("stop", "int"))]
    both = rows.select("*", *nothing, F.lit(True).alias("first")).unionByName(found.select("*", F.lit(None).cast("int").alias("n_words"), F.lit(False).alias("first")))
    runs = F.collect_set(F.when(~F.col("first"), F.struct("start", "stop")))
    each = both.groupBy("doc_id", "twin").agg(F.max("n_words").cast("long").alias("n_words"), runs.alias("runs"), F.array_sort(F.collect_set("item_id")).alias("items"), F.count_if("first").alias("n"))
    one = each.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    return one.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "twin", "n_words", covered(F.col("runs")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that share no window with the benchmark."""
    bad = contamination(docs, benchmark, span, doc_id, text).where("n_hit > 0").select(F.col("doc_id").alias("__id"), F.col("twin").alias("__twin")).distinct()
    twin = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.join(bad, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (twin == F.col("__twin")), "left_anti")
