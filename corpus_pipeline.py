"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result
and reads it back for the next, so a stage that fails starts again from what is written.

All but the last return the columns of docs, whatever these are besides doc_id and text, with
their values; only n_chars, if there is one, follows the text. A null
text is an empty one: it is clean, one empty line, alike to other empty texts, and a piece of one
token. Rows without an id are documents of their own. Rows that share an id are judged by their
own texts in the first, second and fourth stage and are one document in the third, which keeps
one of them. Empty tables give empty results. Workers must be able to import this repository.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, linededup, neardup, packing, queries, toxicity
from sparkloom.scratch import settled

#: A document goes at this score, the threshold of op3's predictions.
TOXIC = 0.3


def _apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work on docs whose other columns have names that no operator has, with their own names and values again."""
    names = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return work(docs.withColumnsRenamed(names)).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below TOXIC."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"), folds=4, held_out=2)
    return _apart(docs, lambda rows: toxicity.score(rows, model, into="__score").where(F.col("__score") < TOXIC))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less lines that three or more of them hold, which stay in the largest doc_id. n_chars follows the text."""
    kept = _apart(docs, lambda rows: linededup.drop_repeated_lines(rows, min_docs=3, min_chars=20))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return _apart(docs, lambda rows: neardup.one_of_each(rows, threshold=0.8))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with the benchmark."""
    return _apart(docs, lambda rows: decontaminate.decontaminate(rows, queries.table(spark, sf_dir, "benchmark"), span=10))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of at most 1024 tokens."""
    return packing.pack(docs, *queries.byte_bpe(), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: Models and signatures have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023
    return STAGES[-1][1](spark, docs, sf_dir)
