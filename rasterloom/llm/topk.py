"""Exact top-k search by inner product over a bit-sliced index.

Components become integers floor(scale * x). An index block holds the rows of one Arrow batch as bitmaps: for every
component the top `bits` bits of its distance from the block's minimum, one bitmap a bit. A query's coarse scores
are sums of those slices: each pair of query bit and slice is a bitmap of one weight, and full adders on whole
bitmaps reduce the bitmaps of each weight to one (negative components take complemented slices). The k-th largest
coarse score is found from the most significant slice downward; whatever lies within the rounding error of it is
the boundary, and its rows' scores are computed exactly. So the result is exact whatever was cut from the slices.

Queries run against all rows in blocks: a block of queries of bounded size (`query_bytes`) is broadcast at a time.
Every index block returns each query's k best; the k best of those are the result.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; a shorter vector
counts as zero beyond its end; a row isn't its own candidate, but rows with the same id are no candidates of each
other either; ties go to the smaller id; rows of equal id and score are kept once each; an empty table gives an empty
table. Other columns than id and vector, whatever their names, take no part and aren't returned. Where scores of a
block might not fit 62 bits, they are computed in integers of any size; one among a block's k best that fits no long is an
error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FULL = np.uint64(2**64 - 1)


def quantised(vectors: pa.Array, scale: float) -> np.ndarray:
    """Rows of whole numbers, padded with zeros to the longest: int64, or Python integers where a component has over 40 bits."""
    size = np.array(vectors.value_lengths().to_pylist(), np.int64)
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    flat = np.floor(scale * flat)
    wide = bool((np.abs(flat) >= 2.0**40).any())
    out = np.zeros((len(size), int(size.max(initial=0))), object if wide else np.int64)
    if not np.isfinite(flat).all():
        raise OverflowError("a scaled component is beyond the range of doubles")
    out[np.arange(out.shape[1]) < size[:, None]] = [int(x) for x in flat.tolist()] if wide else flat.astype(np.int64)
    return out


def _bitmap(flags: np.ndarray) -> np.ndarray:
    return np.packbits(np.pad(flags, (0, -len(flags) % 64)), bitorder="little").view(np.uint64)


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def add_up(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bit-sliced sum of bitmaps by weight, least significant first: three bitmaps of a weight become two of the next sums."""
    out, w = [], 0
    todo = {k: list(v) for k, v in columns.items()}
    while todo:
        here = todo.pop(w, [])
        while len(here) > 2:
            a, b, c = here.pop(), here.pop(), here.pop()
            x = a ^ b
            here.insert(0, x ^ c)
            todo.setdefault(w + 1, []).append((a & b) | (x & c))
        if len(here) == 2:
            a, b = here
            todo.setdefault(w + 1, []).append(a & b)
            here = [a ^ b]
        out.append(here[0] if here else None)
        w += 1
    return out


class Block:
    """The bit-sliced index of some rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, bits: int = 6):
        self.ids, self.values, self.n = ids, values, len(ids)
        self.most = max((abs(int(x)) for x in (values.min(), values.max())), default=0) if values.size else 0
        self.plain = values.dtype != object
        if not self.plain:  # no slices: every row's score is computed
            return
        self.low = values.min(0) if values.size else np.zeros(values.shape[1], np.int64)
        span = int((values - self.low).max(initial=0)).bit_length()
        self.cut = max(0, span - bits)  # bits left to the exact step
        coarse = (values - self.low) >> self.cut
        self.width = max(1, min(bits, span))
        self.slices = [[_bitmap((coarse[:, d] >> b & 1).astype(bool)) for b in range(self.width)] for d in range(values.shape[1])]
        self.all = _bitmap(np.ones(self.n, bool))
        self.not_slices = [[s ^ self.all for s in row] for row in self.slices]

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best: none is missing."""
        columns: dict[int, list[np.ndarray]] = {}
        for d in np.flatnonzero(query):
            q = int(query[d])
            source = self.slices[d] if q > 0 else self.not_slices[d]
            q = abs(q)
            while q:
                i = (q & -q).bit_length() - 1
                for b in range(self.width):
                    columns.setdefault(i + b, []).append(source[b])
                q &= q - 1
        total = add_up(columns)
        # Every coarse score is short of its exact one by 0 to `error`, in units of 2 ** cut.
        error = int(np.abs(query).sum()) * ((1 << self.cut) - 1)
        error = -(-error >> self.cut) if error else 0
        sure, open_ = np.zeros_like(self.all), self.all.copy()
        kth = 0
        for w in range(len(total) - 1, -1, -1):
            s = total[w]
            if s is None:
                continue
            x = sure | (open_ & s)
            if _count(x) >= k:
                open_ &= s
                kth |= 1 << w
            else:
                sure, open_ = x, open_ & ~s
        least = kth - error - 1
        if least <= 0:
            keep = self.all
        else:  # rows whose sum is at least `least`, compared slice by slice
            above, equal = np.zeros_like(self.all), self.all.copy()
            for w in range(max(len(total), least.bit_length()) - 1, -1, -1):
                s = total[w] if w < len(total) and total[w] is not None else np.zeros_like(self.all)
                if least >> w & 1:
                    equal &= s
                else:
                    above |= equal & s
                    equal &= ~s
            keep = above | equal
        return np.flatnonzero(np.unpackbits(keep.view(np.uint8), bitorder="little")[: self.n])

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        same = int((self.ids == query_id).sum())
        wide = self.values.shape[1]
        query = np.pad(query[:wide], (0, max(0, wide - len(query))))
        fits = self.plain and query.dtype != object and self.most * max((abs(int(x)) for x in query), default=0) * max(1, wide) < 2**62
        rows = self.candidates(query, k + same) if fits and self.n > 4 * (k + same) else np.arange(self.n)
        rows = rows[self.ids[rows] != query_id]
        if fits:
            score = self.values[rows] @ query
            order = np.lexsort((self.ids[rows], -score))[:k]
            return self.ids[rows][order], score[order]
        score = (self.values[rows].astype(object) * query.astype(object)).sum(1).tolist() if len(rows) else []
        best = sorted(zip([-s for s in score], self.ids[rows].tolist(), strict=True))[:k]
        if any(not -(2**63) <= -s < 2**63 for s, _ in best):
            raise OverflowError(f"a score of query {query_id} fits no long")
        return np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)


def usable(vector: str) -> Column:
    v = F.col(vector)
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(ok(x), F.lit(False)))


def search(df: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, bits: int = 6, block_rows: int = 1 << 16, query_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, id and score of each query's k best rows of df. Both tables hold an id and a vector."""
    spark = df.sparkSession
    common.ship(spark)
    form = lambda t: t.where(usable(vector) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows, asked = form(df), form(queries)
    # Queries come to the driver a block at a time; ids cut them into ranges of bounded size.
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("c"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    parts = max(1, -(-int(size.c) * 8 // query_bytes))
    edges = [None, None]
    if parts > 1:
        edges = [None, *asked.select(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0], None]
    found = None
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        block = asked if lo is None else asked.where(F.col("id") > lo)
        block = (block if hi is None else block.where(F.col("id") <= hi)).orderBy("id").toArrow()
        if not block.num_rows:
            continue
        send = spark.sparkContext.broadcast((block.column("id").to_numpy(), quantised(block.column("v").combine_chunks(), scale)))

        def run(batches: Iterator[pa.RecordBatch], send=send) -> Iterator[pa.RecordBatch]:
            query_ids, query_values = send.value
            held: list[pa.RecordBatch] = []

            def answer() -> pa.RecordBatch:
                t = pa.Table.from_batches(held).combine_chunks()
                b = Block(t.column("id").to_numpy(), quantised(t.column("v").combine_chunks(), scale), bits)
                best = [b.best(int(q), v, k) for q, v in zip(query_ids, query_values, strict=True)]
                out = [(np.full(len(ids), q), ids, score) for q, (ids, score) in zip(query_ids, best, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "id", "score"])

            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= block_rows:
                    yield answer()
                    held = []
            if held and sum(b.num_rows for b in held):
                yield answer()

        part = rows.mapInArrow(run, "query_id bigint, id bigint, score bigint")
        found = part if found is None else found.union(part)
    if found is None:
        found = rows.select(F.col("id").alias("query_id"), "id", F.lit(0).cast("long").alias("score")).limit(0)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("id")))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")
