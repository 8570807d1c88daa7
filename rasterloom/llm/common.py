"""Session plumbing shared by the text operators: code shipping, the shared folder, Arrow text buffers."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 21  # bytes of text that a kernel holds at a time; a longer text is a chunk of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per Spark context, so that workers import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_rasterloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    # The driver serves this file to the executors; it needs no shared disk.
    path = Path(tempfile.mkdtemp(prefix="rasterloom-")) / f"rasterloom_{zlib.crc32(data.getvalue()):08x}.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))
    sc._rasterloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder in spark.checkpoint.dir; one of this machine only where that is unset and Spark runs on this machine alone, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_rasterloom_dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
            found = spark.sparkContext._rasterloom_dir = "file://" + tempfile.mkdtemp(prefix="rasterloom-shared-")
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again. Survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rasterloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    path = getattr(df, "_rasterloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fold(column: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't use yet (names compare without case, as Spark resolves them)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches that hold about limit bytes of text, with bytes and offsets. No text is cut."""
    for batch in batches:
        data, off = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
    release()


def release() -> None:
    """Gives freed memory back: a worker is used again by other stages, and the driver by other fits."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps it
        pass


def arrow_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def workers_path(name: str) -> str:
    """A public vocabulary file's place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def local_scratch() -> str:
    """A task's own scratch folder: lost with its executor, and made again by the retried task."""
    return tempfile.mkdtemp(prefix="rasterloom-task-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
