"""Text formats that the library reads and writes besides Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_semicolon_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=";", header=True)


def write_semicolon_csv(df: DataFrame, path: str, decimals: int = 7) -> None:
    """Doubles with fixed decimals, nulls empty."""
    columns = [F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    df.select(*columns).write.csv(path, sep=";", header=True, emptyValue="")


def write_comma_csv(df: DataFrame, path: str) -> None:
    """Comma-separated files that spreadsheets take for UTF-8: each begins with a byte order mark."""
    first, *rest = df.columns
    df.withColumnRenamed(first, "\ufeff" + first).select("\ufeff" + first, *rest).write.csv(path, header=True, emptyValue="")


def read_comma_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_comma_csv wrote; Spark's reader passes over the mark."""
    return spark.read.schema(schema).csv(path, header=True)


def parsed_json_lines(spark: SparkSession, path: str, schema: str, bad: str = "_corrupt_record") -> DataFrame:
    """All lines of a log but blank ones: their fields, and in column ``bad`` a line that isn't what the schema says."""
    parsed = F.from_json("value", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    return spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("row")).select("row.*")


def read_json_lines(spark: SparkSession, path: str, schema: str, rejects: str | None = None) -> DataFrame:
    """The good lines of a log; the others are written to the folder rejects, if it is given."""
    bad = "_corrupt_record"
    rows = parsed_json_lines(spark, path, schema, bad)
    if rejects:
        rows.where(F.col(bad).isNotNull()).select(F.col(bad).alias("value")).write.mode("append").text(rejects)
    return rows.where(F.col(bad).isNull()).drop(bad)


def write_json_lines(df: DataFrame, path: str) -> None:
    """A line a row; nulls are left out."""
    df.write.json(path)


def write_json_segments(df: DataFrame, name: str, path: str) -> None:
    """A line {name, data} a row, data all its other columns as a record."""
    df.select(name, F.struct(*[c for c in df.columns if c != name]).alias("data")).write.json(path)


def write_xml(df: DataFrame, path: str, root: str, row: str) -> None:
    """Indented XML, in each file all rows below one root; a column whose name begins with _ is an attribute."""
    df.write.format("xml").option("rootTag", root).option("rowTag", row).option("attributePrefix", "_").save(path)


def read_xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).option("attributePrefix", "_").schema(schema).load(path)


def dictionary(spark: SparkSession, path: str, element: str, key: str, value: str) -> DataFrame:
    """key, value of <element key="" value=""/> in text files, the first of a key's: by file, then as they stand in it."""
    at = lambda name: F.regexp_extract("line", f'\\b{name}="([^"]*)"', 1)
    # ids of rows rise within a split of a file
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(place.alias("split"), F.posexplode(F.regexp_extract_all("value", F.lit(f"<{element}\\b[^>]*>"), F.lit(0))).alias("nth", "line"))
    return lines.select("split", "nth", at(key).alias("key"), at(value).alias("value")).where("key != ''").groupBy("key").agg(F.min_by("value", F.struct("split", "nth")).alias("value"))


def line_feature(points: Column, properties: Column) -> Column:
    """A GeoJSON feature of an array of (lon, lat): a LineString from two points on, a Point of one, null of none; 7 decimals."""
    rounded = F.transform(points, lambda p: F.array(F.round(p["lon"], 7), F.round(p["lat"], 7)))
    line = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), rounded.alias("coordinates")).alias("geometry"), properties.alias("properties"))
    point = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.get(rounded, F.lit(0)).alias("coordinates")).alias("geometry"), properties.alias("properties"))
    return F.when(F.size(points) >= 2, F.to_json(line)).when(F.size(points) == 1, F.to_json(point))


def write_features(df: DataFrame, feature: str, path: str) -> None:
    """One GeoJSON feature a line (GeoJSON text sequences without separators), which many tasks can write."""
    df.where(F.col(feature).isNotNull()).select(F.col(feature).alias("value")).write.text(path)
