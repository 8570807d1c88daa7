"""Removal of long byte strings that occur more than once in a corpus, by suffix arrays.

Every window of `length` bytes has a key: the least hash among its 48-byte grams. Equal windows have equal keys, so
windows are sharded by key, and runs of consecutive windows with one key travel as one segment. A key that occurs in
one segment alone, with its gram once, can't hold a repeat; segments of equal content repeat wholly. Only contents
that share a key with other contents (or meet their own key's gram twice) are sent, once each, to the shard of their
key, where the suffix array with common-prefix values (suffix.py) tells which windows start elsewhere too. Before a
shard in memory is sorted, contents none of whose windows shares its hash with another of the shard leave it, and the
others lose what lies before their first such window and after their last: equal windows have equal hashes. So the
result is that of one suffix array over the whole corpus, while what is sorted is a small part of it.

A key of more than `hot` bytes of contents (a line in very many surroundings) is split: its gram is set aside for the
whole corpus and its windows take the least hash of their other grams. What is hot after SPLITS such rounds, windows
that are boilerplate almost wholly, has its own digest for a key and is settled by counts. Equal windows have equal
keys in every round. At most (bytes of all segments) / hot grams are set aside in a round. A shard over IN_MEMORY bytes
is sorted on the task's disk, with a bounded number of tuples in memory.

Equal contents are told by a 64-bit digest under an equal 44-bit key; no more than that is compared.

Defined results: a null text is an empty text; texts shorter than `length` lose nothing; repeated rows lose every
window that they share; an empty table gives an empty table; extra columns pass through. A result's name that the
table uses takes an underscore.
"""

from __future__ import annotations

import shutil
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common, scan, suffix

GRAM = 48
PLACE = 20  # bits of a place in a part of a text; longer texts come in parts, which share out the windows
SHARD = 2 << 20  # bytes of contents sieved and sorted at a time, more only for a single key
IN_MEMORY = 4 << 20  # bytes beyond which a shard's text, queues and results go to the task's disk
HOT = 64 << 20  # bytes of contents beyond which a key is split
SPLITS = 3  # rounds of other keys for windows under hot ones
TUPLES = 1 << 18  # tuples that a queue on disk holds in memory


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    back = pow(base, -1, 1 << 64)
    n = (1 << PLACE) + 8
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (base, back))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w consecutive ones."""
    n = len(x)
    rows = -(-n // w)
    p = np.full(rows * w, np.uint64(2**64 - 1))
    p[:n] = x
    p = p.reshape(rows, w)
    ahead = np.minimum.accumulate(p, 1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, off: np.ndarray, length: int, aside: np.ndarray | None = None, only: np.ndarray | None = None, own_key: bool = False) -> list[np.ndarray]:
    """Text, first and last window, key, content digest and whether the key's gram occurs twice, of every segment.

    aside: sorted keys of grams that don't count. only: which windows are wanted, by their place in data. own_key: every
    window's own digest is its key.
    """
    out = []
    step = (1 << PLACE) - length
    for base in range(0, max(1, len(data) - length + 1), step):
        part = data[base : base + (1 << PLACE) - 1]
        n = len(part)
        if n < length:
            break
        up, down = powers()
        m = scan.mix(scan.words8(part)[:n].copy())
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m * up[:n])])
        grams = n - GRAM + 1
        span = GRAM - 7
        g = scan.mix((total[span : span + grams] - total[:grams]) * down[:grams])
        low = np.uint64((1 << PLACE) - 1)
        if aside is not None and len(aside):
            own = g >> np.uint64(PLACE)
            g[aside[np.minimum(np.searchsorted(aside, own), len(aside) - 1)] == own] = ~np.uint64(0)
        at = np.arange(grams, dtype=np.uint64)
        w, count = length - GRAM + 1, min(n - length + 1, step)
        left = _window_min((g & ~low) | at, w)[:count]
        right = _window_min((g & ~low) | (low - at), w)[:count]
        doc = np.searchsorted(off, base + np.arange(count), "right") - 1 if len(off) < 3 else np.repeat(np.arange(len(off) - 1), np.diff(off))[base : base + count]
        valid = base + np.arange(count) + length <= off[doc + 1]
        if only is not None:
            valid &= only[base : base + count]
        key = left >> np.uint64(PLACE)
        bare = key == (~np.uint64(0) >> np.uint64(PLACE)) if not own_key else np.ones(count, bool)  # windows without a gram that counts
        i = np.flatnonzero(bare)
        key[i] = scan.mix((total[i + length - 7] - total[i]) * down[i]) >> np.uint64(PLACE)
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        s = np.flatnonzero(fresh)
        if not len(s):
            continue
        stop = valid & np.append(fresh[1:] | ~valid[1:], True)
        e = np.flatnonzero(stop)
        digest = scan.mix(((total[e + length - 7] - total[s]) * down[s]) ^ scan.mix((e - s).astype(np.uint64) + np.uint64(3)))
        twice = np.where(bare[s] | bare[e], e > s, (left[s] & low) != (low - (right[e] & low)))
        out.append((doc[s], base + s - off[doc[s]], base + e - off[doc[s]], key[s].view(np.int64), digest.view(np.int64), twice))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]


def windows(parts: list[np.ndarray], length: int) -> np.ndarray:
    """A hash of every window of contents shorter than 2**PLACE, one content after another; equal windows have equal ones."""
    up, down = powers()
    out, first = [np.zeros(0, np.uint64)], 0
    ends = np.cumsum([len(p) for p in parts])
    while first < len(parts):
        base = ends[first] - len(parts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + (1 << PLACE), "left")))
        data, size = np.concatenate(parts[first:last]), np.array([len(p) for p in parts[first:last]])
        n = len(data)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scan.mix(scan.words8(data)[:n].copy()) * up[:n])])
        i = scan.ragged(np.cumsum(size) - size, np.maximum(size - length + 1, 0))
        out.append(scan.mix((total[i + length - 7] - total[i]) * down[i]))
        first = last
    return np.concatenate(out)


class Shard:
    """Contents under some keys, in memory or, if they are many, in a file of the task's scratch folder."""

    def __init__(self, length: int, in_memory: int = IN_MEMORY, tuples: int = TUPLES):
        self.length, self.in_memory, self.tuples = length, in_memory, tuples
        self.k, self.d, self.size = array("q"), array("q"), array("q")
        self.whole = bytearray()
        self.parts: list[np.ndarray] = []
        self.held, self.waiting, self.scratch = 0, 0, None

    def add(self, k: int, d: int, whole: bool, content: np.ndarray) -> None:
        self.k.append(k)
        self.d.append(d)
        self.size.append(len(content))
        self.whole.append(whole)
        self.parts.append(content)
        self.held += len(content) + 1
        self.waiting += len(content) + 1
        if self.waiting > self.in_memory:
            self.scratch = self.scratch or common.local_scratch()
            with open(f"{self.scratch}/text", "ab") as f:
                self._text().tofile(f)
            self.parts, self.waiting = [], 0

    def _sieve(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each content in memory the first window, and the end of the last, that may start elsewhere too; both 0 if none may."""
        size = np.array(self.size, np.int64)
        many = np.maximum(size - self.length + 1, 0)
        h = windows(self.parts, self.length)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        hit = np.zeros(len(h), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        i = np.flatnonzero(hit)
        which = np.repeat(np.arange(len(size)), many)[i]
        place = i - (np.cumsum(many) - many)[which]
        a, b = size.copy(), np.zeros(len(size), np.int64)
        np.minimum.at(a, which, place)
        np.maximum.at(b, which, place + self.length)
        whole = np.frombuffer(bytes(self.whole), np.uint8) > 0
        return np.where((b == 0) | whole, 0, a), np.where((b > 0) & whole, size, b)

    def _text(self) -> np.ndarray:
        """The contents in memory, each ended by a symbol below all bytes."""
        size = np.array([len(p) for p in self.parts], np.int64)
        text = np.zeros(int(size.sum()) + len(size), np.uint16)
        if len(size):
            text[scan.ragged(np.cumsum(size + 1) - size - 1, size)] = np.concatenate(self.parts).astype(np.uint16) + 1
        return text

    def repeated(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Content numbers and the byte ranges in them that windows with a second start cover."""
        length, size = self.length, np.array(self.size, np.int64)
        whole = np.frombuffer(bytes(self.whole), np.uint8)
        number, cut = np.arange(len(size)), np.zeros(len(size), np.int64)
        if not self.scratch:
            cut, end = self._sieve()
            # What occurs several times as a whole needs no other content.
            alone = np.flatnonzero((end == 0) & (whole > 0) & (size >= length))
            yield alone, np.zeros(len(alone), np.int64), size[alone]
            number = np.flatnonzero(end)
            if not len(number):
                return
            self.parts = [self.parts[i][cut[i] : end[i]] for i in number.tolist()]
            size, cut, whole = (end - cut)[number], cut[number], whole[number]
        at = np.cumsum(size + 1) - size - 1
        if self.scratch:
            with open(f"{self.scratch}/text", "ab") as f:
                self._text().tofile(f)
            self.parts = []
            text = np.memmap(f"{self.scratch}/text", np.uint16, "r")
        else:
            text = self._text()
        store = suffix.Store(self.scratch)
        order, value = suffix.suffix_array(text, length, self.scratch, self.tuples, False, store)
        again = store.array(len(text), bool)
        for i in range(0, len(text), suffix.STEP):
            hit = np.flatnonzero(np.asarray(value[i : i + suffix.STEP]) >= length) + i  # never the first suffix
            again[order[hit]] = True
            again[order[hit - 1]] = True
        first = 0
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(at, at[first] + suffix.STEP)))
            base, n, own = at[first], int(at[last - 1] + size[last - 1] + 1 - at[first]), slice(first, last)
            change, sure = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
            windows = np.maximum(size[own] - length + 1, 0)
            for mark, by in ((change, 1), (sure, whole[own].astype(np.int32))):
                np.add.at(mark, at[own] - base, by)
                np.add.at(mark, at[own] - base + windows, -by)
            flag = np.concatenate([[False], (np.cumsum(change[:-1]) > 0) & (np.asarray(again[base : base + n]) | (np.cumsum(sure[:-1]) > 0)), [False]])
            edge = np.flatnonzero(flag[1:] != flag[:-1]) + base
            which = np.searchsorted(at, edge[::2], "right") - 1
            yield number[which], edge[::2] - at[which] + cut[which], edge[1::2] - 1 + length - at[which] + cut[which]
            first = last

    def answer(self) -> Iterator[pa.RecordBatch]:
        try:
            for which, a, b in self.repeated():
                yield pa.RecordBatch.from_arrays([pa.array(np.array(self.k)[which]), pa.array(np.array(self.d)[which]), pa.array(a), pa.array(b)], names=["k", "d", "from", "to"])
        finally:
            if self.scratch:
                shutil.rmtree(self.scratch, ignore_errors=True)
            common.release()


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of (k, d, whole, content) sorted by k and d to k, d, from, to."""
    shard, last = Shard(length), None
    for batch in batches:
        data, off = common.utf8(batch.column(3))
        for i, (k, d, whole) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True)):
            if last is not None and k != last[0] and shard.held >= SHARD:
                yield from shard.answer()
                shard = Shard(length)
            if (k, d) != last:  # repeated rows send their contents twice
                shard.add(k, d, whole, data[off[i] : off[i + 1]].copy())
            last = (k, d)
    if last is not None:
        yield from shard.answer()


def _some(narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts joined with what is wanted of them. A broadcast of at most 16 MB of ids keeps other texts out of the shuffle; beyond that all are shuffled."""
    ids = wanted.select("t", "r")
    some = narrow.join(F.broadcast(ids) if wanted.count() <= 1_000_000 else ids, ["t", "r"], "left_semi")
    return some.join(wanted, ["t", "r"])


def _keyed(narrow: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(t, r, body) to all segments (t, r, s, e, k, d, twice), and the keys that may hold a repeat (k, mixed, bytes)."""
    spark = narrow.sparkSession
    aside = np.zeros(0, np.uint64)

    def cut(send: object, limited: bool, own_key: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, off in common.chunks(batches, "body", 1 << 19):
                only = None
                if limited:
                    spans = batch.column(3)
                    doc = np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
                    s, e = (x.to_numpy() for x in spans.flatten().flatten())
                    edge = np.zeros(len(data) + 2, np.int32)
                    np.add.at(edge, off[doc] + s, 1)
                    np.add.at(edge, off[doc] + e + 1, -1)
                    only = np.cumsum(edge) > 0
                doc, *columns = segments(data, off, length, send.value, only, own_key)
                ids = [batch.column(j).take(pa.array(doc)) for j in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c) for c in columns)], names=["t", "r", "s", "e", "k", "d", "twice"])

        return run

    schema = "t bigint, r bigint, s bigint, e bigint, k bigint, d bigint, twice boolean"
    all_ = common.written(narrow.select("t", "r", "body").mapInArrow(cut(spark.sparkContext.broadcast(aside), False), schema), "segments")
    for turn in range(SPLITS + 2):
        keys = all_.groupBy("k").agg(F.count("*").alias("n"), F.min("d").alias("x"), F.max("d").alias("y"), F.max("twice").alias("twice"), F.sum(F.col("e") - F.col("s") + length).alias("bytes")).where("n > 1 or twice")
        shared = common.written(keys.select("k", ((F.col("x") != F.col("y")) | F.col("twice")).alias("mixed"), "bytes"), "keys")
        if turn > SPLITS:
            break
        found = shared.where(F.col("mixed") & (F.col("bytes") > hot)).select("k").toArrow()  # at most all bytes / hot keys
        if not found.num_rows:
            break
        common.forget(shared)
        aside = np.union1d(aside, found.column("k").to_numpy().astype(np.uint64))
        hot_keys = F.broadcast(spark.createDataFrame(found))
        redo = common.written(all_.join(hot_keys, "k", "left_semi").groupBy("t", "r").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "redo")
        again = _some(narrow, redo).select("t", "r", "body", "spans").mapInArrow(cut(spark.sparkContext.broadcast(aside), True, turn == SPLITS), schema)
        before, all_ = all_, common.written(all_.join(hot_keys, "k", "left_anti").unionByName(again), "segments")
        common.forget(before)
        common.forget(redo)
    return all_, shared


def remove(df: DataFrame, text: str = "text", id: str = "doc_id", length: int = 200, hot: int = HOT) -> DataFrame:
    """df without its text, with n_bytes, n_removed, n_spans and kept (the remaining bytes)."""
    spark = df.sparkSession
    common.ship(spark)
    t, r, body, lost = (common.free_name(df, c) for c in ("text_hash", "row_hash", "body", "gone"))
    docs = df.withColumn(body, F.coalesce(F.col(text), F.lit(""))).withColumn(t, F.xxhash64(body)).withColumn(r, F.xxhash64(F.col(id), F.lit(7), F.length(body)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(t).alias("t"), F.col(r).alias("r"), F.col(body).alias("body"))
    all_, shared = _keyed(narrow, length, hot)
    hits = common.written(all_.drop("twice").join(shared.select("k", "mixed"), "k"), "shared")
    common.forget(all_)
    common.forget(shared)
    contents = hits.where("mixed").groupBy("k", "d").agg((F.count("*") > 1).alias("whole"), F.min(F.struct("t", "r", "s", "e")).alias("at"))
    by_doc = contents.groupBy("at.t", "at.r").agg(F.collect_list(F.struct("k", "d", "whole", F.col("at.s").alias("s"), F.col("at.e").alias("e"))).alias("wanted"))
    by_doc = common.written(by_doc, "wanted")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, off in common.chunks(iter([batch]), "body"):
                wanted = piece.column(1)
                doc = np.repeat(np.arange(piece.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
                flat = wanted.flatten()
                k, d, whole, s, e = flat.flatten()
                a = off[doc] + s.to_numpy()
                size = e.to_numpy() - s.to_numpy() + length
                content = bpe.binary_of(data[scan.ragged(a, size)], np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([k, d, whole, content], names=["k", "d", "whole", "content"])

    sent = _some(narrow, by_doc).select("body", "wanted").mapInArrow(send, "k bigint, d bigint, whole boolean, content binary")
    sorted_ = sent.repartition(parts, "k").sortWithinPartitions("k", "d")
    ranges = common.written(sorted_.mapInArrow(lambda batches: _shards(batches, length), "k bigint, d bigint, `from` bigint, `to` bigint"), "ranges")
    common.forget(by_doc)
    plain = hits.where("not mixed").select("t", "r", F.col("s").alias("a"), (F.col("e") + length).alias("b"))
    inner = hits.where("mixed").join(ranges, ["k", "d"]).select("t", "r", (F.col("s") + F.col("from")).alias("a"), (F.col("s") + F.col("to")).alias("b"))
    # Whole rows may repeat, so ranges are kept once.
    gone = common.written(plain.union(inner).groupBy("t", "r").agg(F.collect_set(F.struct("a", "b")).alias("gone")), "gone")
    common.forget(hits)
    common.forget(ranges)
    names = {c: common.free_name(df.drop(text), c) for c in ("n_bytes", "n_removed", "n_spans", "kept")}
    kept_columns = [c for c in df.columns if c != text]
    joined = docs.select(*kept_columns, body, t, r).join(gone.select(F.col("t").alias(t), F.col("r").alias(r), F.col("gone").alias(lost)), [t, r], "left").select(*kept_columns, body, lost)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in common.chunks(batches, body):
            spans = batch.column(batch.num_columns - 1)
            many = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), many)
            a, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.flatten().flatten())
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, off[doc] + a, 1)
            np.add.at(edge, off[doc] + b, -1)
            cover = np.cumsum(edge[:-1]) > 0
            _, _, runs = scan.spans(cover, off)
            removed = scan.reduce_by(cover.astype(np.int64), off)
            size = np.diff(off)
            left = bpe.binary_of(data[~cover], np.concatenate([[0], np.cumsum(size - removed)]))
            base = batch.select(kept_columns)
            yield pa.RecordBatch.from_arrays([*base.columns, pa.array(size), pa.array(removed), pa.array(np.diff(runs)), left], names=[*kept_columns, *names.values()])

    kinds = dict(zip(names.values(), ("bigint", "bigint", "bigint", "binary"), strict=True))
    schema = ", ".join(filter(None, [common.arrow_schema(df.drop(text)), *(f"`{n}` {k}" for n, k in kinds.items())]))
    return joined.mapInArrow(drop, schema)
