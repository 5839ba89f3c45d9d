"""Distinct counts out of stored sketches that are united."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketches of 2^LG registers.
LG = 14


def error_of(lg: int = LG) -> float:
    """The relative error that a united sketch of 2^lg registers keeps in all but about one case in ten thousand: four standard errors."""
    return 4 * 1.04 / 2 ** (lg / 2)


def sketched(df: DataFrame, day: Column, keys: list[str], what: str, lg: int = LG) -> DataFrame:
    """day, keys, n, sketch: of each day and key the rows, and the sketch of the different values of a column. Null values are rows but no values; -0.0 is 0.0."""
    kind = dict(df.dtypes)[what]
    value = F.col(what) if kind in ("int", "bigint", "string", "binary") else (F.col(what) + F.lit(0.0)).cast("string") if kind in ("double", "float") else F.col(what).cast("string")
    return df.groupBy(day.alias("day"), *keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(value, F.lit(lg)).alias("sketch"))


def refresh(sketches: DataFrame, path: str) -> None:
    """Days of sketches into a table by day: those that are there already are replaced, all others stay. A run that is repeated changes nothing."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def united(stored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, days, n, estimate over all stored days that are given; what is shuffled is a sketch a day and key, partly united before."""
    counts = stored.groupBy(*keys).agg(F.count_distinct("day").alias("days"), F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))
    return counts.select(*keys, "days", "n", F.hll_sketch_estimate("sketch").alias("estimate"))
