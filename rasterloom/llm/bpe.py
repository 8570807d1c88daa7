"""Byte-level BPE over whole corpora.

Texts are split by the public byte-BPE pattern in one vectorised pass over their bytes. Every distinct piece is
merged once: pieces of like length form padded integer matrices, in which every row merges its leftmost
minimum-rank pair each round; pairs are found in an open-addressing hash table, finished rows leave the matrix
and merged columns are compacted away. A bounded table of pieces seen before serves all later texts.

Defined results: a null text is an empty text, an empty text has no ids, special-token strings are ordinary
text, repeated rows are encoded each for itself, and a text is never cut. Extra columns pass through; an input
column with a result's name is kept and the result takes a trailing underscore.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common, scan

NONE = np.int32(2**31 - 1)
PAD = np.int32(1 << 30)
BUCKETS = np.array([1, 5, 9, 13, 17, 25, 33, 49, 65, 97, 129, 257])  # longer pieces are merged by a heap, in n log n
PART = 1 << 19  # bytes of text encoded at a time; a longer text is a part of its own
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
L, N, O, S = 0, 1, 2, 3


@lru_cache(1)
def classes() -> np.ndarray:
    """Letter, number, other or space for every code point."""
    import regex

    text = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    out = np.full(0x110000, O, np.uint8)
    for kind, code in ((r"\p{L}+", L), (r"\p{N}+", N)):
        for m in regex.finditer(kind, text):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = code
    out[WHITE] = S
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Every byte's class; all bytes of a character have the character's."""
    table = classes()
    cls = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        v = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int32)
        b0, b1, b2, b3 = v[lead], v[lead + 1] & 63, v[lead + 2] & 63, v[lead + 3] & 63
        point = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = table[np.minimum(point, 0x10FFFF)]
        cls[lead] = kind
        for i, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            own = b0 >= least
            at = lead[own] + i
            cls[at[at < len(cls)]] = kind[own][at < len(cls)]
    return cls


def pieces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches; each ends where the next begins."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(data)
    doc = np.zeros(n + 1, bool)
    doc[off] = True
    begin = doc[:n].copy()
    begin[1:] |= cls[1:] != cls[:-1]
    rs = np.flatnonzero(begin)
    re_ = np.append(rs[1:], n)
    kind, ends_doc = cls[rs], doc[re_]
    space = (kind == S) & ~ends_doc
    glue = space & (data[re_ - 1] == 0x20)
    last = re_ - 1
    for _ in range(3):
        last = np.where(space & (last > rs) & ((data[last] & 0xC0) == 0x80), last - 1, last)
    keep = np.ones(len(rs), bool)
    keep[1:] &= ~glue[:-1]
    begin[rs[~keep]] = False
    begin[last[space & (last > rs)]] = True
    quote = np.flatnonzero((kind == O) & keep & (re_ - rs == 1) & (data[rs] == 39) & ~ends_doc)
    quote = quote[kind[quote + 1] == L] if len(quote) else quote
    if len(quote):
        at, long = re_[quote], re_[quote + 1] - rs[quote + 1]
        a, b = data[at], data[np.minimum(at + 1, n - 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ~one & (long > 1) & ((((a == 114) | (a == 118)) & (b == 101)) | ((a == 108) & (b == 108)))
        size = one + 2 * two
        begin[at[size > 0]] = False
        rest = (size > 0) & (long > size)
        begin[(at + size)[rest]] = True
    return np.flatnonzero(begin)


class Pairs:
    """(left id, right id) to the merged id, by open addressing; NONE where the pair doesn't merge."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 2).bit_length()))
        size = 1 << int(64 - int(self.shift))
        self.last = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        rest, slot = np.arange(len(keys)), self.slot(keys)
        while len(rest):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.values[slot[won]] = keys[rest[won]], values[rest[won]]
            left = np.ones(len(rest), bool)
            left[won] = False
            rest, slot = rest[left], (slot[left] + 1) & self.last

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * scan.C2) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        shape, keys = keys.shape, keys.ravel()
        slot = self.slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.values[slot], NONE)
        rest = np.flatnonzero((have != keys) & (have >= 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & self.last
            have = self.keys[slot]
            hit = have == keys[rest]
            out[rest[hit]] = self.values[slot[hit]]
            go = ~hit & (have >= 0)
            rest, slot = rest[go], slot[go]
        return out.reshape(shape)


class Bpe:
    """Encoder and decoder for one rank file, with a bounded table of pieces."""

    def __init__(self, path: str, most: int = 1 << 20):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        size = max(self.ranks.values()) + 1
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None:
                    b = get(token[i:])
                    if b is not None:
                        keys.append(a << 32 | b)
                        values.append(rank)
        self.pairs = Pairs(np.array(keys, np.int64), np.array(values, np.int32))
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.token_len = np.array([len(t) for t in by_id], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.bits = (self.most * 2 - 1).bit_length()
        self.slots, self.slot_piece = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.known = 0
        self.hash, self.k0, self.k1 = (np.zeros(self.most, np.uint64) for _ in range(3))
        self.at, self.count = np.zeros(self.most, np.int64), np.zeros(self.most, np.int64)
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0

    def merge_rows(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids: rows of one length. Returns (row numbers, their merged rows) as rows finish."""
        out, rows = [], np.arange(len(ids))
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while True:
            j = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), j] if rank.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                out.append((rows[done], ids[done]))
                go = ~done
                rows, ids, rank, j, best = rows[go], ids[go], rank[go], j[go], best[go]
            if not len(rows):
                return out
            each = np.arange(len(rows))
            ids[each, j] = best
            width = ids.shape[1]
            ids = ids[np.arange(width) != (j + 1)[:, None]].reshape(len(rows), width - 1)
            rank = rank[np.arange(width - 1) != j[:, None]].reshape(len(rows), width - 2)
            if width > 2:
                left = np.flatnonzero(j > 0)
                rank[left, j[left] - 1] = self.pairs.find(ids[left, j[left] - 1], ids[left, j[left]])
                right = np.flatnonzero(j < width - 2)
                rank[right, j[right]] = self.pairs.find(ids[right, j[right]], ids[right, j[right] + 1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges on a linked list with a heap of (rank, place), for pieces too long for a matrix."""
        n = len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get, heap = self.ranks.get, []

        def push(i: int) -> None:
            j = end[i]
            if j < n:
                rank = get(piece[i : end[j]])
                if rank is not None:
                    heap.append((rank, i, end[j])) if not ready else heapq.heappush(heap, (rank, i, end[j]))

        ready = False
        for i in range(n):
            push(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != to or end[i] == to:
                continue
            j = end[i]
            alive[j], end[i] = False, to
            if to < n:
                before[to] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([get(piece[i : end[i]]) for i in range(n) if alive[i]], np.int32)

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the pieces' ids, and the ids one piece after another."""
        counts, found = np.zeros(len(starts), np.int64), []
        order = np.argsort(lengths, kind="stable")
        first = np.searchsorted(lengths[order], BUCKETS, "left")
        for width, lo, hi in zip(BUCKETS[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            width, step = width - 1, max(1, (1 << 18) // width)
            for rows in (order[i : min(i + step, hi)] for i in range(lo, hi, step)):
                column = np.arange(width)
                at = np.minimum(starts[rows][:, None] + column, len(data) - 1)
                ids = np.where(column < lengths[rows][:, None], self.byte_id[data[at]], PAD)
                for which, merged in self.merge_rows(ids):
                    counts[rows[which]] = (merged != PAD).sum(1)
                    found.append((rows[which], merged))
        for r in order[first[-1] :].tolist():
            merged = self.merge_long(data[starts[r] : starts[r] + lengths[r]].tobytes())
            counts[r] = len(merged)
            found.append((np.array([r]), merged[None]))
        at, flat = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int32)
        for rows, merged in found:
            real = merged != PAD
            flat[(at[rows][:, None] + np.arange(merged.shape[1]))[real]] = merged[real]
        return counts, flat

    def lookup(self, h: np.ndarray, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        last, slot = (1 << self.bits) - 1, (h >> np.uint64(64 - self.bits)).astype(np.int64)
        have = self.slots[slot]
        out = np.where(have == h, self.slot_piece[slot], -1)
        rest = np.flatnonzero((have != h) & (have != 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & last
            have = self.slots[slot]
            hit = have == h[rest]
            out[rest[hit]] = self.slot_piece[slot[hit]]
            go = ~hit & (have != 0)
            rest, slot = rest[go], slot[go]
        if self.known:
            out[(self.k0[out] != k0) | (self.k1[out] != k1)] = -1
        return out

    def learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray, k0: np.ndarray, k1: np.ndarray) -> np.ndarray:
        """Adds distinct pieces; returns their numbers."""
        counts, ids = self.encode_pieces(data, starts, lengths)
        new = np.arange(self.known, self.known + len(starts))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(ids) + 1024), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[new], self.count[new] = self.used + np.cumsum(counts) - counts, counts
        self.hash[new], self.k0[new], self.k1[new] = h, k0, k1
        self.known, self.used = self.known + len(new), self.used + len(ids)
        rest, slot, last = np.arange(len(new)), (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(rest):
            free = np.flatnonzero(self.slots[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.slots[slot[won]], self.slot_piece[slot[won]] = h[rest[won]], new[rest[won]]
            left = np.ones(len(rest), bool)
            left[won] = False
            rest, slot = rest[left], (slot[left] + 1) & last
        return new

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and n+1 offsets into them."""
        starts = pieces(data, off)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        lengths = np.diff(np.append(starts, len(data)))
        h, v = scan.hash_spans(data, starts, lengths) | np.uint64(1), scan.words8(data)
        k0, k1 = v[starts] & scan.MASK[np.minimum(lengths, 8)], v[np.minimum(starts + 8, len(data))] & scan.MASK[np.clip(lengths - 8, 0, 8)]
        which = self.lookup(h, k0, k1)
        miss = np.flatnonzero(which < 0)
        if len(miss):
            _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            if self.known + len(first) > self.most:
                self.clear()
                self.most = max(self.most, len(np.unique(h)) + 1)
                self.clear()
                miss = np.arange(len(starts))
                _, first, back = np.unique(h, return_index=True, return_inverse=True)
            one = miss[first]
            which[miss] = self.learn(data, starts[one], lengths[one], h[one], k0[one], k1[one])[back]
        counts = self.count[which]
        ids = self.flat[scan.ragged(self.at[which], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(starts, off)]

    def encode_special(self, data: np.ndarray, off: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """encode() with ids of their own for some strings; what lies between them is encoded by itself."""
        found = []
        if special:
            strings = sorted((s.encode() for s in special), key=len, reverse=True)
            found = [m.span() for m in re.finditer(b"|".join(map(re.escape, strings)), data.tobytes())]
        if not found:
            return self.encode(data, off)
        a, b = np.array(found, np.int64).T
        inside = np.searchsorted(off, a, "right") == np.searchsorted(off, b - 1, "right")  # not across two texts
        a, b = a[inside], b[inside]
        # Texts and strings cut the bytes into parts; the strings' parts are emptied, then take their one id.
        edge = np.concatenate([off, a, b])
        kind = np.concatenate([np.zeros(len(off), np.int64), np.full(len(a), 2), np.ones(len(b), np.int64)])
        order = np.lexsort((kind, edge))
        edge, starts = edge[order], kind[order] == 2
        left = np.ones(len(data), bool)
        left[scan.ragged(a, b - a)] = False
        ids, at = self.encode(data[left], np.concatenate([[0], np.cumsum(left)])[edge])
        before = np.concatenate([[0], np.cumsum(starts)])[:-1]  # strings that start before each edge
        own = np.array([special[data[i:j].tobytes().decode()] for i, j in zip(a.tolist(), b.tolist(), strict=True)], ids.dtype)
        texts = np.flatnonzero(kind[order] == 0)
        return np.insert(ids, at[starts], own), at[texts] + before[texts]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' bytes one text after another, and n+1 offsets."""
        long = self.token_len[ids]
        total = np.concatenate([[0], np.cumsum(long)])
        return self.token_bytes[scan.ragged(self.token_at[ids], long)], total[off]


@lru_cache(2)
def worker(path: str) -> Bpe:
    """One per Python worker; later tasks of that worker find it warm."""
    return Bpe(path)


def special_tokens(path: str) -> dict[str, int]:
    """Strings that a tokenizer's file gives ids of their own."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def list_of(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


def binary_of(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _coded(df: DataFrame, text: str, path: str, names: list[str], both: bool) -> DataFrame:
    common.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path)
        for batch, data, off in common.chunks(batches, text, PART):
            ids, at = bpe.encode(data, off)
            more = [list_of(ids, at)] + ([binary_of(*bpe.decode(ids, at))] if both else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    kinds = ["array<int>", "binary"]
    schema = ", ".join(filter(None, [common.arrow_schema(df), *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=False))]))
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """df with the texts' ids as array<int>."""
    return _coded(df, text, path or common.workers_path("byte_bpe_50k.tiktoken"), [common.free_name(df, ids)], False)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, decoded: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for; a null list gives no bytes."""
    common.ship(df.sparkSession)
    path, name = path or common.workers_path("byte_bpe_50k.tiktoken"), common.free_name(df, decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            off = np.concatenate([[0], np.cumsum([0 if x is None else x for x in column.value_lengths().to_pylist()])]).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, binary_of(*bpe.decode(flat, off))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, f"{common.arrow_schema(df)}, `{name}` binary")


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass of one worker."""
    return _coded(df, text, path or common.workers_path("byte_bpe_50k.tiktoken"), [common.free_name(df, ids), common.free_name(df, decoded)], True)


def digests(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """df without its text, with n_tokens, ids_sha256 (of the decimal ids, joined by spaces) and decoded_sha256 of round_trip()'s ids and bytes, which don't leave the worker."""
    common.ship(df.sparkSession)
    path = path or common.workers_path("byte_bpe_50k.tiktoken")
    rest = df.drop(text)
    kept, names = rest.columns, [common.free_name(rest, c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path)
        for batch, data, off in common.chunks(batches, text, PART):
            ids, at = bpe.encode(data, off)
            joined = pc.binary_join(list_of(ids, at).cast(pa.list_(pa.string())), " ")
            digest = [pa.array([hashlib.sha256(b).hexdigest() for b in c.cast(pa.binary()).to_pylist()], pa.string()) for c in (joined, binary_of(*bpe.decode(ids, at)))]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(np.diff(at)), *digest], names=[*kept, *names])

    kinds = ["bigint", "string", "string"]
    schema = ", ".join(filter(None, [common.arrow_schema(rest), *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))]))
    return df.mapInArrow(run, schema)
