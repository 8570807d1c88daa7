"""Image folders as DataFrames and back: a source on binaryFile, a sink as a Python data source, a stream of frame folders."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import codecs

COLUMNS = "path string, height int, width int, channels int, data binary"


def _decoded(files: DataFrame, flags: int) -> DataFrame:
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path, content in zip(p["path"], p["content"], strict=True):
                a = codecs.imdecode(content, flags)
                if a is not None:  # bytes that are no image are left out, as imread gives nothing for them
                    a = a[..., None] if a.ndim == 2 else a
                    out.append((path, *a.shape, a.tobytes()))
            yield pd.DataFrame(out, columns=["path", "height", "width", "channels", "data"])

    return files.select("path", "content").mapInPandas(work, COLUMNS)


#: Spark packs files into tasks as if each had megabytes; so many of those tasks are one here, as far as the bytes allow.
TOGETHER, MOST = 32, 32 << 20


def read(spark: SparkSession, path: str, flags: int = 1) -> DataFrame:
    """Decoded images of a folder; the path's filters are pushed to the listing. A task reads about a thousand small files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // TOGETHER, -(-size // MOST))
    return _decoded(files.coalesce(wanted), flags)


def read_stream(spark: SparkSession, path: str, flags: int = 1) -> DataFrame:
    """New image files of a folder as they come."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _decoded(spark.readStream.format("binaryFile").schema(schema).load(path), flags)


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, ext: str):
        self.folder, self.ext = folder, ext

    def write(self, rows) -> WriterCommitMessage:
        import uuid

        import numpy as np
        from pyarrow import fs

        # By the folder's scheme: a mounted disk, HDFS or an object store.
        where, folder = fs.FileSystem.from_uri(self.folder if "://" in self.folder else Path(self.folder).absolute().as_uri())
        where.create_dir(folder, recursive=True)
        for r in rows:
            a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
            part = f"{folder}/.{r.name}-{uuid.uuid4().hex}"
            with where.open_output_stream(part) as f:
                f.write(codecs.imencode(self.ext, a)[1].tobytes())
            where.move(part, f"{folder}/{r.name}{self.ext}")  # a retried task overwrites its own file
        return WriterCommitMessage()


class ImageSink(DataSource):
    """df.write.format("rasterloom_images").option("path", folder): one file per row of (name, height, width, channels, data)."""

    @classmethod
    def name(cls) -> str:
        return "rasterloom_images"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("ext", ".png"))


def write(df: DataFrame, path: str, ext: str = ".png") -> None:
    df.sparkSession.dataSource.register(ImageSink)
    cast = df.select(F.col("name").cast("string").alias("name"), "height", "width", "channels", "data")
    cast.write.format("rasterloom_images").option("path", path).option("ext", ext).mode("append").save()
