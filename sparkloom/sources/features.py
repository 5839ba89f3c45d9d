"""format("features"): GeoJSON features of many tasks as one valid FeatureCollection."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

HEAD, TAIL = b'{"type":"FeatureCollection","features":[\n', b"]}\n"
#: Octets that the joining step holds at once.
CHUNK = 2**22


class FeatureSource(DataSource):
    """Options: path, the document to be. The frame has one column, features as JSON texts; nulls are left out."""

    @classmethod
    def name(cls) -> str:
        return "features"

    def writer(self, schema: StructType, overwrite: bool) -> FeatureWriter:
        if len(schema) != 1 or not isinstance(schema[0].dataType, StringType):
            raise ValueError("features are one column of texts")
        return FeatureWriter(self.options["path"], overwrite)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    place: str
    features: int


class FeatureWriter(DataSourceWriter):
    """Tasks write parts of their own; the commit joins those that Spark counts and puts the document in place.

    One document is one file, so its bytes go through the driver's copy in chunks. Until the end
    nothing is at its path; a job that fails leaves neither the document nor a part.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        self.parts = f"{path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator) -> Part:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.parts)
        system.create_dir(folder, recursive=True)
        context, place, n = TaskContext.get(), f"{folder}/{uuid.uuid4().hex}", 0
        with system.open_output_stream(place) as f:
            for (feature,) in iterator:
                if feature is not None:
                    f.write((",\n" if n else "").encode() + feature.encode())
                    n += 1
        return Part(context.partitionId() if context else 0, place, n)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(self.path)
        if not self.overwrite and system.get_file_info(place).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        folder = fs.FileSystem.from_uri(self.parts)[1]
        system.create_dir(folder, recursive=True)
        whole, begun = f"{folder}/whole", False
        with system.open_output_stream(whole) as out:
            out.write(HEAD)
            for part in sorted((m for m in messages if m and m.features), key=lambda m: m.partition):
                out.write(b",\n" if begun else b"")
                begun = True
                with system.open_input_stream(part.place, compression=None) as f:
                    while chunk := f.read(CHUNK):
                        out.write(chunk)
            out.write((b"\n" if begun else b"") + TAIL)
        system.move(whole, place)
        system.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.parts)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


def write_collection(features: DataFrame, path: str, overwrite: bool = False) -> None:
    """A frame of one column of features as the FeatureCollection at path."""
    features.sparkSession.dataSource.register(FeatureSource)
    features.write.format("features").mode("overwrite" if overwrite else "append").save(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """feature: the texts of a document that write_collection wrote, in which a line is a feature, read in parts by many tasks."""
    lines = spark.read.text(path).where(F.col("value").startswith('{"type":"Feature",'))
    return lines.select(F.regexp_replace("value", ",$", "").alias("feature"))
