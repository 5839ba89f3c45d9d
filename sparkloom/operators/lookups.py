"""Joins that stand for lookups: prefixes, wildcards, routes, distance, set differences, layers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.scratch import written

#: Rows of a cell of the distance join that one task takes, of either side.
CELL_ROWS = 10_000
#: A lookup table is broadcast up to so many rows; a larger one is joined by shuffle.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def prefixes(key: Column, separator: str) -> Column:
    """All prefixes of a key that end at a separator or at its end."""
    parts = F.split(key, f"\\Q{separator}\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def longest_prefix(df: DataFrame, key: str, entries: DataFrame, prefix: str, separator: str) -> DataFrame:
    """df with the columns of the entry whose prefix is the longest of the key's; null where none fits.

    Each distinct key is looked up once.
    """
    keys = df.select(key).distinct()
    tried = keys.withColumn("__prefix", F.explode(prefixes(F.col(key), separator)))
    found = tried.join(small(entries), F.col("__prefix") == F.col(prefix))
    best = found.groupBy(key).agg(F.max_by(F.struct(*entries.columns), F.length("__prefix")).alias("__best"))
    return df.join(best, key, "left").select(*df.columns, *[F.col(f"__best.{c}").alias(c) for c in entries.columns])


def routed(df: DataFrame, columns: Sequence[str], rules: DataFrame, target: str, default: str) -> DataFrame:
    """df with a target for each rule that fits, where '*' in a rule fits all; rows that none fits go to default once.

    Each distinct kind of row stands for the 2 ** len(columns) patterns that fit it, so rules of
    any number are met by an equi-join. A null fits '*' only.
    """
    kinds = df.select(*columns).distinct()
    patterns = kinds
    for c in columns:
        patterns = patterns.withColumn(f"__{c}", F.explode(F.array_distinct(F.array(F.lit("*"), F.coalesce(F.col(c).cast("string"), F.lit("*"))))))
    renamed = rules.withColumnsRenamed({c: f"__{c}" for c in columns})
    fits = patterns.join(small(renamed, 1000), [f"__{c}" for c in columns]).select(*[F.col(c).alias(f"__of_{c}") for c in columns], target)
    met = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in columns])
    return df.join(fits, met, "left").drop(*[f"__of_{c}" for c in columns]).withColumn(target, F.coalesce(target, F.lit(default)))


def within_distance(a: DataFrame, b: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of rows no further apart than radius, with their distance: an equi-join on grid cells, b's rows in the nine around.

    a and b have no column names in common but x and y, which come as ax, ay, bx and by. A cell of
    more than CELL_ROWS rows of either side is cut into parts by hashes of whole rows, and each part
    of one side meets each of the other. Rows without a coordinate are in no pair.
    """
    left = a.withColumnsRenamed({x: "ax", y: "ay"}).withColumns({"__i": F.floor(F.col("ax") / radius), "__j": F.floor(F.col("ay") / radius)})
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.withColumnsRenamed({x: "bx", y: "by"}).withColumn("__d", F.explode(near))
    right = right.withColumns({"__i": F.floor(F.col("bx") / radius) + F.col("__d.i"), "__j": F.floor(F.col("by") / radius) + F.col("__d.j")}).drop("__d")
    left, right = _parts(left, right)
    pairs = left.join(right, ["__i", "__j", "__a", "__b"]).drop("__i", "__j", "__a", "__b")
    return pairs.withColumn("distance", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))).where(F.col("distance") <= radius)


def _parts(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """left and right with __a and __b: in crowded cells the part of a row's own side, and each part of the other."""

    def crowd(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("__i", "__j").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(name)).where(F.col(name) > 1)

    crowded = written(crowd(left, "__na").join(crowd(right, "__nb"), ["__i", "__j"], "full").fillna(1, ["__na", "__nb"]))
    if crowded.isEmpty():
        return tuple(side.withColumns({"__a": F.lit(0), "__b": F.lit(0)}) for side in (left, right))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        known = rows.withColumn("__h", F.xxhash64(*rows.columns)).join(small(crowded), ["__i", "__j"], "left").fillna(1, ["__na", "__nb"])
        placed = known.withColumn(f"__{own}", F.pmod("__h", f"__n{own}").cast("int"))
        return placed.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.col(f"__n{other}") - 1))).drop("__h", "__na", "__nb")

    return dealt(left, "a", "b"), dealt(right, "b", "a")


def key_audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side ('left', 'right', 'both') of every distinct key of two tables."""
    one, two = (d.select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((a, "__a"), (b, "__b")))
    side = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "left").otherwise("right")
    return one.join(two, key, "full").select(key, side.alias("side"))


def layers(**tables: DataFrame) -> DataFrame:
    """Tables one below the other, with the name of each row's table; columns that a table lacks are null."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("layer", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def layers_of(sources: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """layers of the sources that can be planned, and of each other one why it can't: a source fails alone."""
    tables, failures = {}, {}
    for name, source in sources.items():
        try:
            tables[name] = source()
        except AnalysisException as e:  # no such path or column
            failures[name] = e.getCondition() or type(e).__name__
    return layers(**tables), failures


def labelled(df: DataFrame, code: str, labels: DataFrame, key: str, label: str, otherwise: str = "") -> DataFrame:
    """df with the label of a code from a dictionary with one row a key; codes that it lacks get otherwise, or are their own label."""
    named = small(labels.select(F.col(key).alias("__key"), label))
    return df.join(named, F.col(code) == F.col("__key"), "left").withColumn(label, F.coalesce(label, F.lit(otherwise) if otherwise else F.col(code).cast("string"))).drop("__key")


def shortest_of_each(df: DataFrame, keys: Sequence[str], size: Column, order: Sequence[str]) -> DataFrame:
    """One whole row for each key: the one of least size, ties by order."""
    best = F.min_by(F.struct(*df.columns), F.struct(size.alias("s"), *order))
    return df.groupBy(*keys).agg(best.alias("__row")).select("__row.*")


def stratified(df: DataFrame, keys: Sequence[str], id: str, n: int, seed: int = 0) -> DataFrame:
    """A sampling operator: n rows of each stratum, those whose hashed ids come first; of rows with one id, those whose hash is least.

    Tasks keep their first n rows of a stratum before anything is shuffled. Spark does that up to a
    limit to n; beyond it, strata are cut into parts whose first n rows are found before the strata's.
    """
    order = [F.col("__md5"), F.col("__row")]
    rows = df.withColumns({"__md5": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string"))), "__row": F.xxhash64(*df.columns)})
    first = lambda some, *of: some.withColumn("__nth", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("__nth") <= n).drop("__nth")
    conf = df.sparkSession.conf
    if n > int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        rows = first(rows.withColumn("__part", F.pmod("__row", F.lit(int(conf.get("spark.sql.shuffle.partitions"))))), *keys, "__part").drop("__part")
    return first(rows, *keys).drop("__md5", "__row")
