"""Sequence checks and ordered operators: runs, gaps, continuity, sessions, sliding counts, latches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.times import at_micros, micros


def runs(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """keys, begin, end, length of every run of consecutive numbers; repeated numbers count once."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    marked = df.select(*keys, number).distinct().withColumn("island", F.col(number) - nth)
    return marked.groupBy(*keys, "island").agg(F.min(number).alias("begin"), F.max(number).alias("end"), F.count("*").alias("length")).drop("island")


def gaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """keys, after, before, missing of every gap between two neighbouring numbers."""
    following = F.lead(number).over(Window.partitionBy(*keys).orderBy(number))
    pairs = df.select(*keys, number).distinct().withColumn("before", following)
    return pairs.where(F.col("before") - F.col(number) > 1).select(*keys, F.col(number).alias("after"), "before", (F.col("before") - F.col(number) - 1).alias("missing"))


def audit(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """keys, seen, distinct, first, last, missing, duplicates and a verdict: complete, duplicates, or gaps."""
    counts = df.groupBy(*keys, number).agg(F.count("*").alias("c"))
    out = counts.groupBy(*keys).agg(F.sum("c").alias("seen"), F.count("*").alias("distinct"), F.min(number).alias("first"), F.max(number).alias("last"))
    out = out.withColumns({"missing": F.col("last") - F.col("first") + 1 - F.col("distinct"), "duplicates": F.col("seen") - F.col("distinct")})
    return out.withColumn("verdict", F.when(F.col("missing") > 0, "gaps").when(F.col("duplicates") > 0, "duplicates").otherwise("complete"))


def numbers_in(text: str | Column, mark: str = "SEQ=") -> Column:
    """All numbers that follow a mark in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(f"\\Q{mark}\\E(\\d+)"), F.lit(1))
    return F.transform(found, lambda x: x.cast("bigint"))


def gap_audit(df: DataFrame, keys: Sequence[str], number: str, first: int | None = None) -> DataFrame:
    """keys, missing, gaps, longest and a cause, of numbers that should be consecutive, from ``first`` on if it is given.

    The cause is 'none' without a gap, 'late start' if the only one lies before all that was
    seen, 'single losses' if none is longer than 1, else 'bursts'.
    """
    begin = F.lead(number).over(Window.partitionBy(*keys).orderBy(number))
    seen = df.select(*keys, number).distinct()
    inner = seen.withColumn("before", begin).select(*keys, (F.col("before") - F.col(number) - 1).alias("n"), F.lit(False).alias("front"))
    front = seen.groupBy(*keys).agg((F.min(number) - (F.min(number) if first is None else first)).alias("n")).select(*keys, "n", F.lit(True).alias("front"))
    some = F.col("n") > 0
    out = inner.unionByName(front).groupBy(*keys).agg(F.sum(F.when(some, F.col("n")).otherwise(0)).alias("missing"), F.count_if(some).alias("gaps"), F.coalesce(F.max(F.when(some, F.col("n"))), F.lit(0)).alias("longest"), F.coalesce(F.bool_or(some & F.col("front")), F.lit(False)).alias("late"))
    cause = F.when(F.col("gaps") == 0, "none").when((F.col("gaps") == 1) & F.col("late"), "late start").when(F.col("longest") == 1, "single losses").otherwise("bursts")
    return out.withColumn("cause", cause).drop("late")


def continuity_faults(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: Column, modulus: int = 16) -> DataFrame:
    """keys, n, faults: how often a counter is not its predecessor plus one, modulo modulus."""
    before = F.lag("counter").over(Window.partitionBy(*keys).orderBy(*order))
    marked = df.select(*keys, *order, counter.alias("counter")).withColumn("before", before)
    return marked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if((F.col("before") + 1) % modulus != F.col("counter")).alias("faults"))


def hits_in_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, n: int) -> DataFrame:
    """df with hits: in how many of its last n rows, itself included, the condition holds."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn("hits", F.sum(hit.cast("int")).over(window))


def upto_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column) -> DataFrame:
    """The rows up to each key's last one for which the condition holds; keys without one are left out."""
    after = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("__more", F.max(hit.cast("int")).over(after)).where("__more = 1").drop("__more")


def every_kth(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Each key's first row and every k-th one from there."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where((F.col("__nth") - 1) % k == 0).drop("__nth")


def sessions(df: DataFrame, keys: Sequence[str], at: str, timeout_s: float, order: Sequence[str]) -> DataFrame:
    """keys, session, begin, end, n: rows of a key belong together until more than timeout_s pass."""
    window = Window.partitionBy(*keys).orderBy(at, *order)
    new = (micros(at) - micros(F.lag(at).over(window)) > int(timeout_s * 1e6)).cast("int")
    numbered = df.withColumn("__new", F.coalesce(new, F.lit(1))).withColumn("session", F.sum("__new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min(at).alias("begin"), F.max(at).alias("end"), F.count("*").alias("n"))


def latched(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, at: int = 3) -> DataFrame:
    """df with evidence and latched: +1 for a hit, -1 otherwise, never below 0; latched for good once it is at ``at``.

    The floored sum is the running sum less its lowest value so far (0 at most), so windows suffice.
    """
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("__sum", F.sum(F.when(hit, 1).otherwise(-1)).over(window))
    floored = summed.withColumn("evidence", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(window)))
    return floored.withColumn("latched", F.max("evidence").over(window) >= at).drop("__sum")


def since_first(df: DataFrame, keys: Sequence[str], at: str, speed: float = 1.0) -> DataFrame:
    """df with offset_s: seconds since its key's first row, at a speed."""
    first = F.min(micros(at)).over(Window.partitionBy(*keys))
    return df.withColumn("offset_s", (micros(at) - first) / 1e6 / speed)


def shifted(df: DataFrame, keys: Sequence[str], at: str, target: Column) -> DataFrame:
    """df with its times moved so that each key begins at target; spacing stays."""
    first = F.min(at).over(Window.partitionBy(*keys))
    return df.withColumn(at, at_micros(micros(at) - micros(first) + micros(target)))


def trimmed_buckets(df: DataFrame, keys: Sequence[str], at: str, seconds: int) -> DataFrame:
    """keys, buckets, low, mean, high of counts by time bucket: empty ones count 0, the first and last are left out."""
    bucket = F.floor(micros(at) / F.lit(seconds * 1_000_000))
    counts = df.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    ends = counts.groupBy(*keys).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("b - a >= 2")
    every = ends.select(*keys, F.explode(F.sequence(F.col("a") + 1, F.col("b") - 1)).alias("bucket"))
    filled = every.join(counts, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.groupBy(*keys).agg(F.count("*").alias("buckets"), F.min("n").alias("low"), F.avg("n").alias("mean"), F.max("n").alias("high"))
