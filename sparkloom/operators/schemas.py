"""Schemas that records themselves show: paths with their types and presence, and a typed schema."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.scratch import written

_CONTAINERS = ("OBJECT", "ARRAY")


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """path, type, n, percent of all values in a column of JSON texts: '' is a record, '.a' a member of it, '[]' an array's elements.

    n counts values, and percent those of a member's path, whatever their types, in a hundred
    objects that might have it; it is null of records and elements. Texts that are no JSON
    have the type INVALID, nulls are left out. Counts of parts of a table may be added up.
    There is a pass a level of nesting, each with one shuffle of (path, type, n), so no
    number of different paths is too large.
    """
    spark = df.sparkSession
    texts = df.where(F.col(column).isNotNull()).select(F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.try_parse_json(column).alias("v"))
    level, levels = texts, []
    while True:
        kind = F.coalesce(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0), F.lit("INVALID"))
        found = written(level.groupBy("path", "parent", kind.alias("type")).agg(F.count("*").alias("n")))
        levels.append(found)
        if found.where(F.col("type").isin(*_CONTAINERS)).isEmpty():
            break
        inside = level.select(F.col("path").alias("above"), "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        named = F.col("key").isNotNull()
        level = inside.select(F.concat("above", F.when(named, F.concat(F.lit("."), "key")).otherwise("[]")).alias("path"), F.when(named, F.col("above")).alias("parent"), F.col("value").alias("v"))
    rows = reduce(DataFrame.unionByName, levels)
    objects = rows.where("type = 'OBJECT'").groupBy(F.col("path").alias("parent")).agg(F.sum("n").alias("objects"))
    present = rows.groupBy("path").agg(F.sum("n").alias("present"))
    out = rows.join(present, "path").join(objects, "parent", "left")
    return out.select("path", "type", "n", (100.0 * F.col("present") / F.col("objects")).alias("percent"))


def json_schema(df: DataFrame, column: str) -> StructType:
    """The least schema that all objects of a column of JSON texts fit, by one aggregation; what has several types is VARIANT. Texts that are no objects are left out."""
    v = F.try_parse_json(column)
    said = df.select(v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT")).agg(F.schema_of_variant_agg("v")).first()[0]
    ddl = re.sub(r"(?<![`\w])OBJECT<", "STRUCT<", said)
    kind = df.sparkSession.createDataFrame([], f"x {ddl}").schema["x"].dataType
    return kind if isinstance(kind, StructType) else StructType([])
