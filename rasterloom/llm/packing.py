"""Best-fit packing of tokenised texts into sequences of bounded length.

Hierarchical residual packing: every partition packs its own pieces by best fit (longest first) and emits the
nearly full bins. Underfull bins go on as items: a tree of ever fewer partitions packs them by best fit again
until one partition has seen the rest. What goes up the tree is (bin, load) alone. Of the bins over half full at
most one per partition below can still take one of the bins up to half full (best fit leaves at most one of those
per partition), so only as many of the emptiest are carried; the others are final as they are, whatever follows.

Defined results: a null or empty text is one piece with the end id alone; a text of n ids over the capacity is cut
into full pieces, and the first piece takes n modulo the capacity; repeated rows are packed each for itself; an
empty table gives an empty table. `<|endoftext|>` in a text is its one special id, as the tokenizer's file has it. Extra columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common

FAN = 16  # partitions whose underfull bins meet at the next level
SLACK = 8  # free tokens up to which a bin is nearly full


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the bins' loads. Longest first, each into the fullest bin that it fits."""
    bins, offsets, loads = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    open_, stacks = 0, [[] for _ in range(capacity + 1)]  # a bit for every free size that some bin has
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                open_ ^= 1 << free
            offsets[i] = capacity - free
            loads[b] += size
        else:
            b, free = len(loads), capacity
            loads.append(size)
        bins[i] = b
        if free > size:
            stacks[free - size].append(b)
            open_ |= 1 << (free - size)
    return bins, offsets, np.array(loads, np.int64)


def carried(loads: np.ndarray, capacity: int, partitions: int, slack: int) -> np.ndarray:
    """Which bins go up the tree."""
    under = loads < capacity - slack
    big = np.flatnonzero(under & (loads * 2 > capacity))
    if len(big) > partitions:
        under[big[np.argsort(loads[big], kind="stable")[partitions:]]] = False
    return under


def number(level: int, partition: int, bins: np.ndarray) -> np.ndarray:
    return bins | (level << 56 | partition << 30)


def token_pieces(batches: Iterator[pa.RecordBatch], text: str, path: str, capacity: int, end: int, with_ids: bool, names: list[str], special: dict[str, int]) -> Iterator[pa.RecordBatch]:
    coder = bpe.worker(path)
    for batch, data, off in common.chunks(batches, text):
        ids, at = coder.encode_special(data, off, special)
        n = len(off) - 1
        flat = np.insert(ids, at[1:], end).astype("<u4")
        at = at + np.arange(n + 1)
        # The first piece takes what full ones leave.
        size = np.diff(at)
        many, first = -(-size // capacity), (size - 1) % capacity + 1
        rows = np.repeat(np.arange(n), many)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
        start = np.where(piece > 0, first[rows] + (piece - 1) * capacity, 0)
        length = np.where(piece > 0, capacity, first[rows])
        edge = np.concatenate([[0], np.cumsum(length)])
        raw = memoryview(flat).cast("B")
        crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        kept = batch.select([c for c in batch.schema.names if c != text]).take(pa.array(rows, pa.int64()))
        more = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        if with_ids:
            more.append(bpe.list_of(flat.astype(np.int32), edge))
        yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*kept.schema.names, *names])


def pack_texts(df: DataFrame, text: str = "text", capacity: int = 1024, end: int = 2, path: str | None = None, with_ids: bool = False, slack: int = SLACK, special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: df's columns but the text, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    special: strings with ids of their own, as the public tokenizer finds them in texts.
    """
    spark = df.sparkSession
    common.ship(spark)
    path = path or common.workers_path("byte_bpe_50k.tiktoken")
    special = bpe.special_tokens(common.workers_path("byte_bpe_50k.json")) if special is None else special
    kept = df.select(*[c for c in df.columns if c != text], text)
    rest = kept.drop(text)
    names = []
    for c in ("piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset", "carried"):
        names.append(common.free_name(rest, c))
    kinds = ["int", "bigint", "bigint", "bigint", *(["array<int>"] if with_ids else []), "bigint", "bigint", "boolean"]
    length, partitions = names[2], max(1, kept.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(token_pieces(batches, text, path, capacity, end, with_ids, names[:-3], special))
        if not found:
            return
        sizes = np.concatenate([b.column(b.schema.get_field_index(length)).to_numpy() for b in found])
        bins, offsets, loads = best_fit(sizes, capacity)
        up, at, sequence = carried(loads, capacity, partitions, slack)[bins], 0, number(0, TaskContext.get().partitionId(), bins)
        for b in found:
            own = slice(at, at + b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence[own]), pa.array(offsets[own]), pa.array(up[own])], names=[*b.schema.names, *names[-3:]])
            at += b.num_rows

    schema = ", ".join(filter(None, [common.arrow_schema(rest), *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))]))
    local = common.written(kept.mapInArrow(run, schema), "packed")
    return _climb(local, names[2], *names[-3:], capacity, partitions, slack)


def _climb(local: DataFrame, length: str, sequence: str, offset: str, up: str, capacity: int, partitions: int, slack: int) -> DataFrame:
    """Merges the carried bins level by level and puts the pieces at their final places."""
    load = local.where(F.col(up)).groupBy(F.col(sequence).alias("bin")).agg(F.sum(length).cast("bigint").alias("load"))
    items, places, level = common.written(load, "bins"), None, 0
    while True:
        level += 1
        below, partitions = partitions, -(-partitions // FAN)

        def run(batches: Iterator[pa.RecordBatch], level: int = level, below: int = below) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if b.num_rows]
            if not parts:
                return
            table = pa.Table.from_batches(parts)
            table = table.sort_by([("load", "descending"), ("bin", "ascending")])
            sizes, ids = table.column("load").to_numpy(), table.column("bin").to_numpy()
            bins, offsets, loads = best_fit(sizes, capacity)
            go = carried(loads, capacity, below, slack)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(number(level, TaskContext.get().partitionId(), bins)), pa.array(offsets), pa.array(loads[bins]), pa.array(go[bins])], names=["bin", "parent", "shift", "load", "go"])

        spread = items.select("bin", "load").repartition(partitions, F.xxhash64("bin")) if partitions > 1 else items.select("bin", "load").coalesce(1)
        done = common.written(spread.mapInArrow(run, "bin bigint, parent bigint, shift bigint, load bigint, go boolean"), f"level{level}")
        step = done.select("bin", "parent", "shift")
        if places is None:
            places = step
        else:  # a bin of the leaves moves along with the bin that holds it
            above = step.select(F.col("bin").alias("parent"), F.col("parent").alias("next"), F.col("shift").alias("more"))
            places = places.join(above, "parent", "left").select("bin", F.coalesce("next", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        if partitions == 1:
            break
        items = done.where("go").groupBy(F.col("parent").alias("bin")).agg(F.first("load").alias("load"))
    final = local.where(F.col(up)).join(places.withColumnRenamed("bin", sequence), sequence)
    columns = [c for c in local.columns if c != up]
    moved = final.withColumn(offset, F.col(offset) + F.col("shift")).withColumn(sequence, F.col("parent")).select(*columns)
    return local.where(~F.col(up)).select(*columns).union(moved)
