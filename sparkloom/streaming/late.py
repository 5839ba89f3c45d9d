"""Rows that come behind the watermark, kept apart instead of lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.functions.times import micros


def account(stream: DataFrame, at: str, delay: int, path: str, checkpoint: str) -> None:
    """What is there now, as one run: every row goes to path/rows, by batch and by whether it is late; path/marks has each batch's mark.

    A row is late if its time is more than ``delay`` seconds behind the latest time of all
    batches before its own, as Spark's watermark has it; so is one without a time. A batch that
    is run again overwrites its own folders and reads the marks of those before it alone, so
    it gives the same rows once. Late and kept rows together are the input.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        before = _mark(spark, path, number)
        kept = F.lit(True) if before is None else micros(at) >= before - delay * 1_000_000
        place = f"{path}/rows/batch={number}"
        batch.withColumn("late", ~F.coalesce(kept & F.col(at).isNotNull(), F.lit(False))).write.mode("overwrite").partitionBy("late").parquet(place)
        latest = spark.read.schema(_with(batch.schema, late="boolean")).parquet(place).agg(F.max(micros(at)).alias("latest"))
        latest.select(F.greatest("latest", F.lit(before).cast("long")).alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put)
    writer.start().awaitTermination()


def _mark(spark: SparkSession, path: str, number: int) -> int | None:
    """The latest time, in microseconds, of all batches before this one."""
    if number == 0:
        return None
    return spark.read.schema("latest long, batch long").parquet(f"{path}/marks").where(F.col("batch") < number).agg(F.max("latest")).first()[0]


def accounted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows so far with batch and late; a filter on either reads only its folders."""
    return spark.read.schema(_with(schema, batch="long", late="boolean")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def _with(schema: StructType, **more: str) -> StructType:
    out = StructType(list(schema))
    for name, kind in more.items():
        out.add(name, kind)
    return out
