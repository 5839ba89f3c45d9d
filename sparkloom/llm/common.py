"""Small things that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.scratch import scratch_dir, written

__all__ = ["NULL_ID", "id_and_text", "partitions", "scratch_dir", "text_of", "written"]

#: Stands in for a null doc_id wherever ids are compared: it sorts before every other id.
NULL_ID = -(2**63)


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Just doc_id (long) and text (null: empty); whatever else docs carries can't clash with an operator's own columns."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))


def text_of(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
