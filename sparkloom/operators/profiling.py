"""Grouped profiles: counts by label, common labels, presence, medians, first and last values."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.scratch import written


def label_counts(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """keys, label, n."""
    return df.groupBy(*keys, label).agg(F.count("*").alias("n"))


def top_labels(df: DataFrame, keys: Sequence[str], label: str, k: int = 1) -> DataFrame:
    """keys, label, n, place: each key's k most common labels. Ties go by label, so every run gives the same."""
    place = Window.partitionBy(*keys).orderBy(F.desc("n"), label)
    return label_counts(df, keys, label).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def histogram(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """keys, histogram: a map from label to count, in label order."""
    entries = F.sort_array(F.collect_list(F.struct(label, "n")))
    return label_counts(df, keys, label).groupBy(*keys).agg(F.map_from_entries(entries).alias("histogram"))


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], **aggregates: Column) -> DataFrame:
    """Several groupings in one pass over df: the grouped columns (null where a set lacks them), level and the aggregates."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id(*columns).cast("int").alias("level"), *[a.alias(name) for name, a in aggregates.items()])


def presence(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """For each key and column the whole per cent of rows in which it is not null."""
    wide = df.groupBy(*keys).agg(*[F.expr(f"count(`{c}`) * 100 div count(*)").alias(c) for c in columns])
    return wide.unpivot(list(keys), list(columns), "field", "present")


def upper_median(df: DataFrame, keys: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """keys, n, low, median, high, where median is element n div 2 of the sorted values: no mean of two.

    Each distinct value is counted, and the counts are dealt by ranges of (keys, value) to so many
    parts (by default the session's shuffle partitions). A key's parts, of which there are few,
    say which of them holds the middle, and only that one's values are put in order. So no key
    is ordered in one task, and values are only compared: any type that has an order will do,
    infinities are values, and NaN is above all of them. Nulls don't count; a key may be null.
    """
    spark, names = df.sparkSession, [f"__k{i}" for i in range(len(keys))]
    known = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(name) for k, name in zip(keys, names)], F.col(value).alias("__v"))
    counts = known.groupBy(*names, "__v").agg(F.count("*").alias("c"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = written(counts.repartitionByRange(parts, *names, "__v").withColumn("__part", F.spark_partition_id()))
    sums = cells.groupBy(*names, "__part").agg(F.sum("c").alias("c"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    all_of, before = Window.partitionBy(*names), Window.partitionBy(*names).orderBy("__part")
    sums = sums.select(*names, "__part", "c", F.sum("c").over(before).alias("upto"), F.sum("c").over(all_of).alias("n"), F.min("low").over(all_of).alias("low"), F.max("high").over(all_of).alias("high"))
    rank = F.expr("n div 2")
    middle = sums.where((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank))
    middle = middle.select(*[F.col(c).alias(f"{c}_") for c in names], F.col("__part").alias("__part_"), (rank - F.col("upto") + F.col("c")).alias("rank"), "n", "low", "high")
    same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names], F.col("__part") == F.col("__part_"))
    inside = cells.join(middle, same).withColumn("upto", F.sum("c").over(Window.partitionBy(*names).orderBy("__v")))
    found = inside.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    return found.select(*[F.col(c).alias(k) for c, k in zip(names, keys)], "n", "low", F.col("__v").alias("median"), "high")


def first_last(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """keys, first, last: a column's values at the ends of an order."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("first"), F.max_by(value, F.struct(*order)).alias("last"))


def distinct_set(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "values") -> DataFrame:
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(name))


def majority(df: DataFrame, keys: Sequence[str], condition: Column, least: int = 5, share: float = 0.8) -> DataFrame:
    """keys, hits, n of the keys with at least so many hits, which are at least so large a share of their rows."""
    votes = df.groupBy(*keys).agg(F.count_if(condition).alias("hits"), F.count("*").alias("n"))
    return votes.where((F.col("hits") >= least) & (F.col("hits") >= share * F.col("n")))


def span(df: DataFrame, keys: Sequence[str], at: str, stated: Column) -> DataFrame:
    """keys, begin, end over the rows in which the time is stated."""
    return df.groupBy(*keys).agg(F.min(F.when(stated, F.col(at))).alias("begin"), F.max(F.when(stated, F.col(at))).alias("end"))


def field_inventory(df: DataFrame, fields: Column) -> DataFrame:
    """field, rows: how many rows a map column has each of its keys in."""
    return df.select(F.explode(F.map_keys(fields)).alias("field")).groupBy("field").agg(F.count("*").alias("rows"))


def markup_inventory(df: DataFrame, markup: str, record: str) -> DataFrame:
    """family, name, n: what documents of a markup hold, for whoever must read them.

    Families: 'framing' (prolog, several, none: with one, with more than one and without any
    record element), 'encoding' (ascii, utf-8), 'element' and 'attribute' (element@attribute)
    by occurrence, and 'records', how many documents have so many record elements.
    """
    m = F.coalesce(F.col(markup), F.lit(""))
    n_records = F.size(F.regexp_extract_all(m, F.lit(f"<{record}[\\s/>]"), F.lit(0)))
    facts = F.array(
        F.when(m.rlike(r"^\s*<[?!]"), F.struct(F.lit("framing").alias("family"), F.lit("prolog").alias("name"))),
        F.when(n_records > 1, F.struct(F.lit("framing").alias("family"), F.lit("several").alias("name"))),
        F.when(n_records == 0, F.struct(F.lit("framing").alias("family"), F.lit("none").alias("name"))),
        F.struct(F.lit("encoding").alias("family"), F.when(F.octet_length(m) == F.length(m), "ascii").otherwise("utf-8").alias("name")),
        F.struct(F.lit("records").alias("family"), n_records.cast("string").alias("name")),
    )
    tags = F.regexp_extract_all(m, F.lit(r"<[A-Za-z][^<>]*>"), F.lit(0))
    element = lambda tag: F.regexp_extract(tag, r"^<([A-Za-z][\w:.-]*)", 1)
    elements = F.transform(tags, lambda t: F.struct(F.lit("element").alias("family"), element(t).alias("name")))
    attributes = F.flatten(F.transform(tags, lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\s([A-Za-z_:][\w:.-]*)\s*="), F.lit(1)), lambda a: F.struct(F.lit("attribute").alias("family"), F.concat(element(t), F.lit("@"), a).alias("name")))))
    rows = df.select(F.explode(F.concat(F.array_compact(facts), elements, attributes)).alias("x"))
    return rows.groupBy("x.family", "x.name").agg(F.count("*").alias("n"))


def sizes(df: DataFrame, value: str) -> DataFrame:
    """n, least, mean, most: the octets of a column's values."""
    size = F.octet_length(value)
    return df.agg(F.count(value).alias("n"), F.min(size).alias("least"), F.avg(size).alias("mean"), F.max(size).alias("most"))


def with_remainder(df: DataFrame, order: Sequence[Column | str], k: int, label: str, value: str) -> DataFrame:
    """The first k rows as (label, value), and one row that adds up the others under a null label."""
    top = df.orderBy(*order).limit(k).select(label, value)
    total = df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("all"))
    rest = total.crossJoin(top.agg(F.coalesce(F.sum(value), F.lit(0)).alias("shown"))).select(F.lit(None).cast("string").alias(label), (F.col("all") - F.col("shown")).alias(value))  # two rows of one number
    return top.unionByName(rest)
