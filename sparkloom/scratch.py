"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Without that setting a local one, if all runs in one process; else an error, since executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sparkloom-")


#: Folders of the tables that the present settled() has made, in this thread; None outside one.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends here and a lost executor costs nothing."""
    path = scratch_dir(df.sparkSession)
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, written; the tables that it has written on the way are deleted then, also if it fails.

    Only make's own tables go: other threads', and those made before, are left. Within another
    settled() the result is one of that one's tables.
    """
    own: list[str] = []
    outer = _made.get()
    token = _made.set(own)
    path = scratch_dir(spark)
    try:
        df = make()
        df.write.parquet(path)
    finally:
        _made.reset(token)
        for place in own:
            delete(spark, place)
    if outer is not None:
        outer.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """A folder and all below it, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
