"""Queries that write and read files: images, videos, networks and cascades."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .kernels import detect
from .operators import images as im
from .session import shared_folder
from .sources import spark_images, video
from .streaming import frames as st


def through_files(spark: SparkSession, d: str, ext: str) -> DataFrame:
    """Every image written as a file of the shared folder, and read again."""
    folder = shared_folder(spark, "images")
    spark_images.write(fx.images8(spark, d).withColumnRenamed("img_id", "name"), folder, ext)
    back = spark_images.read(spark, folder, 0)
    return back.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("bigint").alias("img_id"), "height", "width", "channels", "data")


def _mounted(folder: str) -> str:
    """Containers are written by seeking, so their folder must be a mounted one."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("videos need a mounted shared folder")
    path = folder.removeprefix("file://")
    Path(path).mkdir(parents=True, exist_ok=True)
    return path


def videos(spark: SparkSession, d: str) -> DataFrame:
    """(stream_id, path, frames): a stream's frames in order as one container, by the task that has them. A stream's video must fit its task."""
    im._ship(fx.images8(spark, d))
    folder = _mounted(shared_folder(spark, "videos"))

    def write(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame_idx")
        path = f"{folder}/{key[0]}.rlv"
        shots = (np.frombuffer(x, np.uint8).reshape(h, w) for x, h, w in zip(p["data"], p["height"], p["width"], strict=True))
        return pd.DataFrame({"stream_id": [key[0]], "path": [path], "frames": [video.write_video(path, shots)]})

    made = st.frames(fx.images8(spark, d)).groupBy("stream_id").applyInPandas(write, "stream_id bigint, path string, frames bigint")
    # Written once; what follows reads the list of files, not the frames again.
    made.write.parquet(listed := shared_folder(spark, "list"))
    return spark.read.parquet(listed)


def watched(spark: SparkSession, d: str, f: Callable[[str], Iterator[tuple[int, int, int]]]) -> DataFrame:
    """f of every video file: (stream_id, frame_idx, total, spread) of the frames that it gives."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(int(k), *r) for k, path in zip(p["stream_id"], p["path"], strict=True) for r in f(path)]
            yield pd.DataFrame(rows, columns=["stream_id", "frame_idx", "total", "spread"])

    return videos(spark, d).mapInPandas(work, "stream_id bigint, frame_idx bigint, total bigint, spread bigint")


def _sums(i: int, a: np.ndarray) -> tuple[int, int, int]:
    return i, int(a.sum(dtype=np.int64)), int((a.ravel().astype(np.int64) * np.arange(1, a.size + 1)).sum())


def captured(path: str) -> Iterator[tuple[int, int, int]]:
    """A camera's frames, saved while they run through."""
    copy = path.replace(".rlv", "-saved.rlv")
    video.video_capture(frames=video.read_video(path), save_path=copy)
    yield from (_sums(i, a) for i, a in enumerate(video.read_video(copy)))


def extracted(path: str) -> Iterator[tuple[int, int, int]]:
    """Every third frame as a file of its own."""
    folder = path.replace(".rlv", "-frames")
    video.extract_images_from_video(path, folder, 3)
    yield from (_sums(3 * i, a) for i, a in enumerate(video.read_video(folder)))


def assembled(path: str) -> Iterator[tuple[int, int, int]]:
    """All frames as files, and those as a video again."""
    folder, again = path.replace(".rlv", "-all"), path.replace(".rlv", "-again.rlv")
    video.extract_images_from_video(path, folder, 1)
    video.extract_video_from_images([str(p) for p in Path(folder).iterdir()], again)
    yield from (_sums(i, a[..., 0] if a.ndim == 3 else a) for i, a in enumerate(video.read_video(again)))


# networks: a linear layer of whole weights, written in the exchange format by hand


def _field(number: int, value: int | bytes | str) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def _tensor(name: str, a: np.ndarray) -> bytes:
    return b"".join(_field(1, n) for n in a.shape) + _field(2, 1) + _field(8, name) + _field(9, struct.pack(f"<{a.size}f", *a.ravel()))


def _value(name: str, shape: tuple[int, ...]) -> bytes:
    dims = b"".join(_field(1, _field(1, n)) for n in shape)
    return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, dims)))


WEIGHTS = np.array([[i % 7 - 3, i % 5 - 2] for i in range(64)], np.float32)
BIAS = np.array([5, -3], np.float32)


@lru_cache(1)
def network() -> bytes:
    """ONNX bytes of flatten, multiply and add over 1x1x8x8 inputs."""
    node = lambda op, ins, out: _field(1, b"".join(_field(1, i) for i in ins) + _field(2, out) + _field(4, op))
    graph = node("Flatten", ["in"], "flat") + node("MatMul", ["flat", "w"], "sum") + node("Add", ["sum", "b"], "out")
    graph += _field(2, "linear") + _field(5, _tensor("w", WEIGHTS)) + _field(5, _tensor("b", BIAS)) + _field(11, _value("in", (1, 1, 8, 8))) + _field(12, _value("out", (1, 2)))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


@lru_cache(4)
def _net(reader: str, model: bytes | str, framework: str | None) -> detect.Net:
    """One session per Python worker."""
    f = getattr(detect, reader)
    return f(model, framework=framework) if framework else f(model)


def scored(spark: SparkSession, d: str, reader: str) -> DataFrame:
    """Both outputs of the network for every image: blob, session, forward."""
    model: bytes | str = network()
    if reader == "readNetFromTensorflow":  # by a file's path
        model = _mounted(shared_folder(spark, "models")) + "/linear.onnx"
        Path(model).write_bytes(network())
    framework = "onnx" if reader == "readNet" else None

    def f(a: np.ndarray) -> list[tuple]:
        net = _net(reader, model, framework)
        net.setInput(detect.blobFromImage(a))
        return [tuple(int(v) for v in net.forward()[0])]

    return im.rows(fx.images8(spark, d), f, "first_score bigint, second_score bigint", ["first_score", "second_score"]).drop("idx")


CASCADE = """<opencv_storage><cascade><width>8</width><height>8</height><stages>
<_><stageThreshold>0.5</stageThreshold><weakClassifiers><_><internalNodes>0 -1 0 0.02</internalNodes><leafValues>0 1</leafValues></_></weakClassifiers></_>
<_><stageThreshold>0.5</stageThreshold><weakClassifiers><_><internalNodes>0 -1 1 0.01</internalNodes><leafValues>1 0</leafValues></_></weakClassifiers></_>
</stages><features><_><rects><_>0 0 8 8 -1</_><_>0 0 8 4 2</_></rects></_><_><rects><_>0 0 8 8 -1</_><_>0 0 4 8 2</_></rects></_></features></cascade></opencv_storage>"""


@lru_cache(1)
def cascade() -> detect.CascadeClassifier:
    """Two stages: brighter above than below, and not brighter on the left."""
    return detect.CascadeClassifier(io.StringIO(CASCADE))


def faces(a: np.ndarray) -> list[tuple]:
    return [tuple(map(int, r)) for r in cascade().detectMultiScale(a, minNeighbors=1)]
