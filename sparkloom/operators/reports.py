"""Ordered reports: numbered rows, the first of them with a mark that there are more, filters on flows and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.scratch import written


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of an order, with place (from 1) and truncated: whether df has more. A report, so n is small."""
    some = df.orderBy(*order).limit(n + 1)
    placed = some.withColumns({"place": F.row_number().over(Window.orderBy(*order)), "__n": F.count("*").over(Window.partitionBy())})  # n + 1 rows at most
    return placed.withColumn("truncated", F.col("__n") > n).drop("__n").where(F.col("place") <= n)


def numbered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """All rows with place, their number (from 1) in an order that tells them apart.

    Rows are dealt by ranges of the order and written, so that the parts and their sizes stay as
    they are; a part's rows are numbered from the sum of the parts before it, one row a part.
    """
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(2**33 - 1)}))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    return parts.join(F.broadcast(starts), "__part").withColumn("place", F.col("__before") + F.col("__row") + 1).drop("__part", "__row", "__before")


def first_of_each_source(df: DataFrame, source: str, seq: str, n: int) -> DataFrame:
    """The first n rows of each source by a number from 0, with truncated: whether the source has more."""
    more = df.groupBy(source).agg((F.max(seq) >= n).alias("truncated"))
    return df.where(F.col(seq) < n).join(more, source)


def of_flow(proto: str | None = None, src: str | None = None, sport: int | None = None, dst: str | None = None, dport: int | None = None, host: str | None = None) -> Column:
    """Whether a datagram has all that is given, host at either end, and a payload."""
    given = {"proto": proto, "src": src, "sport": sport, "dst": dst, "dport": dport}
    fits = F.octet_length("payload") > 0
    for name, value in given.items():
        if value is not None:
            fits &= F.col(name) == value
    return fits if host is None else fits & ((F.col("src") == host) | (F.col("dst") == host))


def of_label(groups: DataFrame, label: str, name: str, aliases: dict[str, str]) -> DataFrame:
    """The groups whose label, worked out over all their rows, is what a friendly name stands for; a name that stands for nothing is a label itself."""
    return groups.where(F.lower(label) == aliases.get(name.lower(), name).lower())


def distinct_in_order(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each distinct record once, with first (the least order, as a struct) and place: the order in which they were first seen."""
    firsts = df.groupBy(*columns).agg(F.min(F.struct(*order)).alias("first"))
    return numbered(firsts, ["first", *columns])


def groups_in_time(df: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """keys, begin, n, place: groups in the order of their first time, ties by key."""
    return numbered(df.groupBy(*keys).agg(F.min(at).alias("begin"), F.count("*").alias("n")), ["begin", *keys])
