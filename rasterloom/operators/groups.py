"""Kernels over small groups of rows: one shuffle by key, then whole batches; a group that a batch cuts is carried on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .images import _ship


def by_key(df: DataFrame, key: str, order: str, columns: list[str], f: Callable[[np.ndarray], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    """f(rows of the integer columns, in order) of every group gives tuples; the key precedes each. A group must fit a task's memory."""
    _ship(df)
    spark = df.sparkSession
    # A stated number of parts: by their bytes alone, small rows that take long to work on would come to one task.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = df.select(key, order, *[c for c in columns if c not in (key, order)]).repartition(parts, key).sortWithinPartitions(key, order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(keys: np.ndarray, values: np.ndarray) -> list[tuple]:
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            return [(int(k[0]), *t) for k, v in zip(np.split(keys, cuts), np.split(values, cuts), strict=True) for t in f(v)] if len(keys) else []

        held_k, held_v = np.zeros(0, np.int64), np.zeros((0, len(columns)), np.int64)
        for b in batches:
            held_k = np.concatenate([held_k, b.column(0).to_numpy().astype(np.int64)])
            held_v = np.concatenate([held_v, np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in columns])])
            whole = int(np.searchsorted(held_k, held_k[-1])) if len(held_k) else 0
            if found := answer(held_k[:whole], held_v[:whole]):
                yield made(found)
            held_k, held_v = held_k[whole:], held_v[whole:]
        if found := answer(held_k, held_v):
            yield made(found)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [pa.int64(), *(kinds[c.split()[1]] for c in schema.split(","))]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], names=[key, *names])

    return spread.mapInArrow(work, f"{key} bigint, {schema}")
