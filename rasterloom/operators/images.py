"""Kernels over image rows: Arrow batches in, whole stacks of equal shape to a kernel, no shuffle.

An image must fit a task's memory several times over; larger ones are cut into tiles with a halo before
(`tiles`), and their results cropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import IMAGE, PLANES


def _ship(df: DataFrame) -> None:
    """Sends this package along once, for executors that don't have it."""
    import tempfile
    import zipfile
    from pathlib import Path

    sc = df.sparkSession.sparkContext
    if getattr(sc, "_rasterloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="rasterloom-")) / "rasterloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(path))
    sc._rasterloom_shipped = True


def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The batch's images as (height, width, channels) views."""
    h, w, c = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("height", "width", "channels"))
    data = batch.column(batch.schema.get_field_index("data"))
    return [np.frombuffer(d.as_buffer(), np.uint8).reshape(i, j, k) for d, i, j, k in zip(data, h, w, c, strict=True)]


#: Values of the images that a kernel gets at once, and rows that are handed on at once: what a task holds doesn't grow with its images.
BLOCK, ROWS = 1 << 18, 1 << 14
#: Bytes of a source's files that a task gets at most, on average.
SHARE = 2 << 20


def blocks(batch: pa.RecordBatch, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many values, or of one image."""
    h, w, c = (batch.column(batch.schema.get_field_index(n)).to_numpy().astype(np.int64) for n in ("height", "width", "channels"))
    end, at = (h * w * c).cumsum(), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(end, most + (end[at - 1] if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to


def spread(images: DataFrame) -> DataFrame:
    """Images dealt out anew where the source has fewer splits than there are cores, or than its files' bytes ask for: kernels cost more than moving them. For plans without a shuffle."""
    known = int(str(images._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(images.sparkSession.sparkContext.defaultParallelism, min(-(-known // SHARE), 1 << 14) if known < 1 << 50 else 0)
    return images.repartition(wanted) if images.rdd.getNumPartitions() < wanted else images


def _planes(ids: pa.Array, out: list[np.ndarray]) -> pa.RecordBatch:
    out = [np.asarray(a, float) for a in out]
    out = [a.reshape(1, 1, 1) if a.ndim == 0 else a[None, :, None] if a.ndim == 1 else a[..., None] if a.ndim == 2 else a for a in out]
    size = np.array([a.size for a in out])
    flat = np.concatenate([a.ravel() for a in out]) if out else np.zeros(0)
    values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat))
    dims = [pa.array([a.shape[i] for a in out], pa.int32()) for i in range(3)]
    return pa.RecordBatch.from_arrays([ids, *dims, values], names=["img_id", "height", "width", "channels", "v"])


def run(images: DataFrame, f: Callable, *args: Any, grey: bool = True, **kw: Any) -> DataFrame:
    """f(image, *args) of every image, as planes of doubles. grey: one-channel images come as (height, width)."""
    _ship(images)
    stack = getattr(f, "stack", None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in blocks(whole)):
            a = arrays(batch)
            out: list = [None] * len(a)
            if stack:
                groups: dict[tuple, list[int]] = {}
                for i, x in enumerate(a):
                    groups.setdefault(x.shape, []).append(i)
                for which in groups.values():
                    found = stack(np.stack([a[i] for i in which]), *args, **kw)
                    found = found[-1] if isinstance(found, tuple) else found
                    for i, x in zip(which, found, strict=True):
                        out[i] = x
            else:
                for i, x in enumerate(a):
                    found = f(x[..., 0] if grey and x.shape[2] == 1 else x, *args, **kw)
                    out[i] = found[-1] if isinstance(found, tuple) else found
            yield _planes(batch.column(batch.schema.get_field_index("img_id")), out)

    return images.select("img_id", "height", "width", "channels", "data").mapInArrow(work, PLANES)


def rows(images: DataFrame, f: Callable, schema: str, names: list[str]) -> DataFrame:
    """f(image) gives any number of tuples; one row each, with its number in the image."""
    _ship(images)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in blocks(whole)):
            ids = batch.column(batch.schema.get_field_index("img_id")).to_pylist()
            out: list[tuple] = []
            for k, x in zip(ids, arrays(batch), strict=True):
                for i, t in enumerate(f(x[..., 0] if x.shape[2] == 1 else x)):
                    out.append((k, i, *map(_plain, t)))
                    if len(out) == ROWS:
                        yield _columns(out, names)
                        out = []
            if out:
                yield _columns(out, names)

    return images.select("img_id", "height", "width", "channels", "data").mapInArrow(lambda b: _cast(work(b), schema), f"img_id bigint, idx int, {schema}")


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["img_id", "idx", *names])


def _plain(v: Any) -> Any:
    return v.item() if isinstance(v, np.generic) else v


def _cast(batches: Iterator[pa.RecordBatch], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field("img_id", pa.int64()), pa.field("idx", pa.int32()), *(pa.field(n.strip().split()[0], kinds[n.strip().split()[1]]) for n in schema.split(","))]
    for b in batches:
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, fields, strict=True)], schema=pa.schema(fields))


def from_px(px: DataFrame) -> DataFrame:
    """Image rows of a pixel relation without gaps."""
    byte = lambda e: F.lpad(F.hex(e.getField("v")), 2, "0")
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "c", "v")))
    data = F.unhex(F.array_join(F.transform("cells", byte), ""))
    size = [(F.max(n) + 1).cast("int").alias(m) for n, m in (("y", "height"), ("x", "width"), ("c", "channels"))]
    return px.groupBy("img_id").agg(*size, cells.alias("cells")).select("img_id", "height", "width", "channels", data.alias("data"))


def to_px(planes: DataFrame, digits: int | None = None) -> DataFrame:
    """(img_id, y, x, c, v) of planes. With digits, v is an integer of that many decimal places."""
    v: Column = F.floor(F.col("v") * 10.0**digits + 0.5).cast("bigint") if digits is not None else F.col("v")
    at = planes.select("img_id", "width", "channels", F.posexplode("v").alias("i", "v"))
    place = [F.expr(e).cast("int").alias(n) for n, e in (("y", "i div (width * channels)"), ("x", "(i div channels) % width"), ("c", "i % channels"))]
    return at.select("img_id", *place, v.alias("v"))


def tiles(images: DataFrame, size: int, halo: int) -> DataFrame:
    """Images cut into tiles of at most size pixels a side, each with a halo: (img_id, ty, tx, top, left, then an image row)."""
    _ship(images)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, a in zip(batch.column(0).to_pylist(), arrays(batch), strict=True):
                for y in range(0, a.shape[0], size):
                    for x in range(0, a.shape[1], size):
                        t, u = max(y - halo, 0), max(x - halo, 0)
                        part = np.ascontiguousarray(a[t : y + size + halo, u : x + size + halo])
                        yield pa.RecordBatch.from_pydict({"img_id": pa.array([k], pa.int64()), "ty": pa.array([y // size], pa.int32()), "tx": pa.array([x // size], pa.int32()), "top": pa.array([y - t], pa.int32()), "left": pa.array([x - u], pa.int32()), "height": pa.array([part.shape[0]], pa.int32()), "width": pa.array([part.shape[1]], pa.int32()), "channels": pa.array([part.shape[2]], pa.int32()), "data": pa.array([part.tobytes()])})

    return images.select(*[c.split()[0] for c in IMAGE.split(", ")]).mapInArrow(work, "img_id bigint, ty int, tx int, top int, `left` int, height int, width int, channels int, data binary")
