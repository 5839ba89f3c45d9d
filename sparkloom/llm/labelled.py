"""The bounded samples of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import id_and_text

#: Labelled rows that a classifier is fitted on, at most: those whose ids hash lowest.
SAMPLE_ROWS = 20_000


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal digits, modulo folds; of a null id 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label (0 or 1) of at most ``rows`` labelled ids outside the held-out fold.

    Null ids and labels are left out; an id that is labelled twice counts once, as 1 if either is.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    ids = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(fold("doc_id", folds) != held_out)
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # at most ``rows`` pairs of numbers
