"""Suffix arrays with common-prefix values by external induced sorting.

Suffixes are typed (S or L). The LMS substrings are sorted by induction from their first symbols and named; the string
of names is sorted by the same procedure, recursively, which gives the order of the LMS suffixes and their
common-prefix values in names. From them the L suffixes are induced in one ascending scan, and the S suffixes in one
descending scan.

What is induced waits in a disk-backed priority queue as suffix tuples (place, symbol, place of its source in the
scan). Neighbouring symbols form blocks; the queue keeps a file a block and a bounded number of tuples in memory, and
the scan takes one block at a time. A block of several symbols holds few suffixes; those induced inside it are put in
order by rank doubling over the block alone. A symbol of many suffixes is a block of its own, which is a queue in
order of arrival, taken in pieces. Text, types, scans, names and values are files that are mapped, not loaded, once a
scratch folder is given. So memory holds a bounded number of tuples, whatever the length of the text.

The common-prefix value of two suffixes induced one after the other into a bucket is one more than the least value
between their sources in the scan; a range-minimum index over the scan's values answers that. Values are capped:
beyond the cap only "at least" matters.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

STEP = 1 << 20  # symbols of a file handled at a time
ROUNDS = 1 << 12  # suffixes below which a string is one block

Seeds = Callable[[int], Iterator[tuple[np.ndarray, np.ndarray]]]


class Store:
    """Arrays in memory, or files of a scratch folder that are mapped."""

    def __init__(self, scratch: str | None):
        self.scratch, self.made = scratch and tempfile.mkdtemp(dir=scratch), 0

    def path(self) -> str:
        self.made += 1
        return os.path.join(self.scratch, f"part{self.made}")

    def array(self, n: int, kind: type | np.dtype) -> np.ndarray:
        return np.memmap(self.path(), kind, "w+", shape=(max(1, n),))[:n] if self.scratch else np.zeros(n, kind)


def _ranges(n: int, step: int) -> list[tuple[int, int]]:
    return [(i, min(n, i + step)) for i in range(0, n, step)]


class BlockQueue:
    """A disk-backed priority queue of tuples (place, symbol, source), keyed by symbol block; within one, in order of arrival."""

    def __init__(self, store: Store, memory: int, blocks: int, kind: type):
        self.store, self.memory, self.kind = store, memory, kind
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(blocks)]
        self.files: dict[int, str] = {}
        self.held = 0
        self.narrow = np.uint16 if blocks <= 1 << 16 else np.int64

    def push(self, block: np.ndarray, tuples: np.ndarray) -> None:
        """tuples: 3 rows, in order of arrival."""
        if not len(block):
            return
        tuples = tuples.astype(self.kind, copy=False)
        if block[0] == block[-1] and (block == block[0]).all():
            self.waiting[int(block[0])].append(tuples)
        else:
            order = np.argsort(block.astype(self.narrow), kind="stable")  # 16-bit keys are sorted in linear time
            block, tuples = block[order], tuples[:, order]
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                self.waiting[int(block[i])].append(tuples[:, i:j])
        self.held += len(block)
        if self.held > self.memory and self.store.scratch:
            for b, parts in enumerate(self.waiting):
                if parts:
                    with open(self.files.setdefault(b, self.store.path()), "ab") as f:
                        for p in parts:
                            np.ascontiguousarray(p.T).tofile(f)
                    self.waiting[b] = []
            self.held = 0

    def take(self, block: int) -> Iterator[np.ndarray]:
        """Pieces of what waits in the block now; what arrives meanwhile waits for the next call."""
        path, parts = self.files.pop(block, None), self.waiting[block]
        self.waiting[block] = []
        self.held -= sum(p.shape[1] for p in parts)
        if path:
            with open(path, "rb") as f:
                while len(found := np.fromfile(f, self.kind, 3 * max(1, self.memory // 4))):
                    yield found.reshape(-1, 3).T
            os.remove(path)
        if parts:
            yield parts[0] if len(parts) == 1 else np.concatenate(parts, 1)


class Floors:
    """A growing row of values that tells the least of any range: windows of 1 to 16 values, and a sparse table of runs of 16."""

    RUN, SMALL = 16, 5

    def __init__(self, store: Store, n: int, kind: type):
        self.n = 0
        runs = -(-n // self.RUN) + 1
        self.small = [store.array(n + self.RUN, kind) for _ in range(self.SMALL)]
        self.runs = [store.array(runs, kind) for _ in range(max(1, runs.bit_length()))]

    def append(self, values: np.ndarray) -> None:
        a, b = self.n, self.n + len(values)
        self.small[0][a:b] = values
        for k in range(1, self.SMALL):
            i, j, half = max(0, a - (1 << k) + 1), b - (1 << k) + 1, 1 << (k - 1)
            if j > i:
                self.small[k][i:j] = np.minimum(self.small[k - 1][i:j], self.small[k - 1][i + half : j + half])
        i, j = a // self.RUN, b // self.RUN  # runs that are full by now
        if j > i:
            self.runs[0][i:j] = self.small[-1][i * self.RUN : j * self.RUN : self.RUN]
            for k in range(1, len(self.runs)):
                x, y, half = max(0, i - (1 << k) + 1), j - (1 << k) + 1, 1 << (k - 1)
                if y <= x:
                    break
                self.runs[k][x:y] = np.minimum(self.runs[k - 1][x:y], self.runs[k - 1][x + half : y + half])
        self.n = b

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of the values after a, up to b (a < b)."""
        a = a.astype(np.int64) + 1
        size = b - a + 1
        k = np.minimum(np.frexp(size)[1] - 1, self.SMALL - 1)
        out = np.empty(len(a), np.int64)
        for level in range(self.SMALL):
            at = np.flatnonzero(k == level)
            if len(at):
                out[at] = np.minimum(self.small[level][a[at]], self.small[level][b[at] - (1 << level) + 1])
        far = np.flatnonzero(size > 2 * self.RUN)
        if len(far):
            x, y = -(-a[far] // self.RUN), (b[far] + 1) // self.RUN
            k = np.frexp(y - x)[1] - 1
            for level in np.unique(k).tolist():
                at = np.flatnonzero(k == level)
                own = np.minimum(self.runs[level][x[at]], self.runs[level][y[at] - (1 << level)])
                out[far[at]] = np.minimum(out[far[at]], own)
        return out


def s_types(text: np.ndarray, out: np.ndarray) -> None:
    """True where the suffix is less than the next one; the last suffix is greater than the empty one."""
    n, carry = len(text), False
    for i, j in reversed(_ranges(n, STEP)):
        part = np.asarray(text[i : j + 1])
        step = np.flatnonzero(part[:-1] != part[1:])
        told = int(step[-1]) + 1 if len(step) else 0
        out[i + told : j] = carry if j < n else False
        out[i : i + told] = np.repeat(part[step] < part[step + 1], np.diff(np.concatenate([[0], step + 1])))
        carry = bool(out[i])


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: np.ndarray | int) -> np.ndarray:
    """Common-prefix lengths of pairs of suffixes, each up to its cap: compared symbol by symbol, then 16 at a time."""
    n, cap = len(text), np.broadcast_to(np.asarray(cap, np.int64), len(a))
    if len(a) > 1 << 14:
        return np.concatenate([common_prefix(text, a[i:j], b[i:j], cap[i:j]) for i, j in _ranges(len(a), 1 << 14)])
    a, b = a.astype(np.int64), b.astype(np.int64)
    out, room = np.zeros(len(a), np.int64), np.minimum(cap, n - np.maximum(a, b))
    rest, i, step = np.flatnonzero(room > 0), 0, np.arange(16)
    while len(rest) and i < 6:
        rest = rest[text[a[rest] + i] == text[b[rest] + i]]
        i += 1
        out[rest] = i
        rest = rest[room[rest] > i]
    while len(rest):
        x, y = a[rest, None] + i + step, b[rest, None] + i + step
        same = text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]
        run = np.where(same.all(1), 16, same.argmin(1))
        i += 16
        out[rest] = np.minimum(i - 16 + run, room[rest])
        rest = rest[(run == 16) & (room[rest] > i)]
    return out


class Level:
    """One string of the recursion: its types, its symbol blocks, and the two inducing scans."""

    def __init__(self, text: np.ndarray, cap: int, store: Store, memory: int):
        self.text, self.n, self.cap, self.store, self.memory = text, len(text), cap, store, memory
        self.kind = np.int32 if self.n < 2**31 - 2 else np.int64
        self.value_kind = np.uint8 if cap < 255 else np.int32
        self.s = store.array(self.n, bool)
        s_types(text, self.s)
        self.limit = min(memory, max(self.n // 32, ROUNDS))
        self._blocks()

    def _blocks(self) -> None:
        """Cuts the symbols into blocks of about `limit` suffixes; a symbol of many is a block of its own."""
        symbols = 1 + max(int(self.text[i:j].max()) for i, j in _ranges(self.n, STEP))
        counts = self.store.array(symbols, np.int64)
        for i, j in _ranges(self.n, STEP):
            if symbols <= 1 << 16:
                counts += np.bincount(self.text[i:j], minlength=symbols)
            else:
                which, many = np.unique(self.text[i:j], return_counts=True)
                counts[which] += many
        cuts, before, last, last_heavy = [], 0, -1, False
        for i, j in _ranges(symbols, STEP):
            own = np.asarray(counts[i:j])
            start = before + np.cumsum(own) - own
            group, heavy = start // self.limit, own > self.limit // 4
            fresh = (group != np.concatenate([[last], group[:-1]])) | heavy | np.concatenate([[last_heavy], heavy[:-1]])
            cuts.append(i + np.flatnonzero(fresh))
            before, last, last_heavy = int(start[-1] + own[-1]), int(group[-1]), bool(heavy[-1])
        self.cuts = np.concatenate([*cuts, [symbols]])
        self.blocks = len(self.cuts) - 1
        self.table = np.repeat(np.arange(self.blocks), np.diff(self.cuts)) if symbols <= 1 << 16 else None

    def block_of(self, symbol: np.ndarray) -> np.ndarray:
        return self.table[symbol] if self.table is not None else np.searchsorted(self.cuts, symbol, "right") - 1

    def lms(self) -> np.ndarray:
        """The places of the LMS suffixes, in order of the text."""
        cut = _ranges(self.n - 1, STEP)
        found = lambda i, j: np.flatnonzero(self.s[i + 1 : j + 1] & ~np.asarray(self.s[i:j])) + i + 1
        many = [len(found(i, j)) for i, j in cut]
        out, at = self.store.array(sum(many), self.kind), 0
        for (i, j), m in zip(cut, many, strict=True):
            out[at : at + m] = found(i, j)
            at += m
        return out

    def by_symbol(self, places: np.ndarray) -> Seeds:
        """Seeds in order of their symbol alone."""
        queue = BlockQueue(self.store, self.memory, self.blocks, self.kind)
        for i, j in _ranges(len(places), STEP):
            own = np.asarray(places[i:j])
            symbol = self.text[own].astype(self.kind)
            queue.push(self.block_of(symbol), np.stack([own, symbol, own]))

        def seeds(block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            parts = queue.take(block)
            if self.cuts[block + 1] - self.cuts[block] > 1 and (held := [*parts]):
                parts = [np.concatenate(held, 1)]
            for p in parts:
                yield p[0][np.argsort(p[1], kind="stable")], np.zeros(p.shape[1], np.int64)

        return seeds

    def in_order(self, places: np.ndarray, values: np.ndarray) -> Seeds:
        """Sorted seeds with values, cut at the blocks."""
        many = np.zeros(self.blocks, np.int64)
        for i, j in _ranges(len(places), STEP):
            many += np.bincount(self.block_of(self.text[np.asarray(places[i:j])]), minlength=self.blocks)
        off = np.concatenate([[0], np.cumsum(many)])

        def seeds(block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            step = self.limit if self.cuts[block + 1] - self.cuts[block] == 1 else self.n
            for i, j in _ranges(int(many[block]), max(1, step)):
                own = slice(int(off[block]) + i, int(off[block]) + j)
                yield np.asarray(places[own]), np.asarray(values[own]).astype(np.int64)

        return seeds

    def induce(self, seeds: Seeds, values: bool) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in descending order, and each one's value with the one before it in that order."""
        scan = _Scan(self, seeds, 1, values)
        scan.run()

        def lower(block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """The block's L suffixes in descending order: each value moves to the other one of its pair."""
            a, b = scan.off[block], scan.off[block + 1]
            step = self.limit if self.cuts[block + 1] - self.cuts[block] == 1 else self.n
            for i, j in reversed(_ranges(b - a, max(1, step))):
                value = np.zeros(j - i, np.int64)
                if values:
                    value[1:] = scan.out_value[a + i + 1 : a + j][::-1]
                    if j < b - a:
                        value[0] = scan.out_value[a + j]
                yield np.asarray(scan.out_at[a + i : a + j])[::-1], value

        down = _Scan(self, lower, -1, values)
        down.run()
        return down.out_at, down.out_value


class _Scan:
    """One inducing scan over the blocks: ascending for L suffixes (sign 1), descending for S suffixes (sign -1)."""

    def __init__(self, level: Level, seeds: Seeds, sign: int, values: bool):
        self.level, self.seeds, self.sign, self.values = level, seeds, sign, values
        self.queue = BlockQueue(level.store, level.memory, level.blocks, level.kind)
        self.floors = Floors(level.store, level.n + 1, level.value_kind) if values else None
        self.at = 0  # suffixes scanned
        many = level.n if sign < 0 else level.n - sum(int(np.count_nonzero(level.s[i:j])) for i, j in _ranges(level.n, STEP))
        self.out_at, self.out_value = level.store.array(many, level.kind), level.store.array(many if values else 0, level.value_kind)
        self.kept = 0
        self.off = np.zeros(level.blocks + 1, np.int64)

    def run(self) -> None:
        level = self.level
        if self.sign > 0:  # the empty suffix comes first and induces the last one
            if self.values:
                self.floors.append(np.zeros(1, np.int64))
            self.at = 1
            last = np.array([[level.n - 1], [int(level.text[-1])], [0]], level.kind)
            self.queue.push(level.block_of(last[1]), last)
        for block in range(level.blocks)[:: self.sign]:
            (self._single if level.cuts[block + 1] - level.cuts[block] == 1 else self._several)(block)
            self.off[block + 1] = self.kept

    def _scanned(self, at: np.ndarray, value: np.ndarray | None, seed: bool | np.ndarray) -> None:
        """Notes suffixes in scan order. The ascending scan keeps the induced ones, the descending one all."""
        if self.values:
            self.floors.append(value)
        keep = slice(None) if self.sign < 0 or seed is False else ~seed if isinstance(seed, np.ndarray) else None
        if keep is not None:
            own = at[keep]
            self.out_at[self.kept : self.kept + len(own)] = own
            if self.values:
                self.out_value[self.kept : self.kept + len(own)] = value[keep]
            self.kept += len(own)
        self.at += len(at)

    def _before(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The preceding suffixes that this scan induces: indices into at, places, symbols."""
        i = np.flatnonzero(at > 0)
        i = i[self.level.s[at[i] - 1] == (self.sign < 0)]
        p = at[i] - 1
        return i, p, self.level.text[p].astype(self.level.kind)

    def _push(self, at: np.ndarray, first: int, but: int | None = None) -> None:
        i, p, symbol = self._before(at)
        if but is not None:
            other = symbol != but
            i, p, symbol = i[other], p[other], symbol[other]
        self.queue.push(self.level.block_of(symbol), np.stack([p, symbol, (first + i).astype(self.level.kind)]))

    def _single(self, block: int) -> None:
        """A block of one symbol: a queue in order of arrival; runs of the symbol arrive again and again."""
        level, last, before, rounds = self.level, -1, -1, 0
        while rounds <= level.cap:
            some = False
            for early in self.queue.take(block):
                some, at, source, value = True, early[0], early[2], None
                if self.values:
                    value = np.zeros(len(at), np.int64)
                    a = np.concatenate([[last], source[:-1]])
                    k = int(last < 0)
                    value[k:] = np.minimum(self.floors.least(a[k:], source[k:]) + 1, level.cap)
                last, before, first = int(source[-1]), int(at[-1]), self.at
                self._scanned(at, value, False)
                self._push(at, first)
            if not some:
                break
            rounds += 1
        if rounds > level.cap and (rest := [*self.queue.take(block)]):
            before = self._runs(int(level.cuts[block]), np.concatenate([r[0] for r in rest]).astype(np.int64))
        for at, value in self.seeds(block):
            if self.values and before >= 0:
                value = value.copy()
                value[0] = common_prefix(level.text, np.array([before]), at[:1], level.cap)[0]
            first, before = self.at, int(at[-1])
            self._scanned(at, value, True)
            self._push(at, first)

    def _runs(self, symbol: int, at: np.ndarray) -> int:
        """What is left of runs longer than the cap, depth by depth: all of it agrees in cap symbols."""
        level, starts, carry = self.level, [], -1
        for i, j in _ranges(level.n, STEP):
            edge = np.flatnonzero(np.diff(np.concatenate([[carry >= 0], np.asarray(level.text[i:j]) == symbol]).astype(np.int8)))
            own = i + edge
            if carry >= 0 and len(own):
                starts.append(np.array([carry]))
                own, carry = own[1:], -1
            if len(own) % 2:
                carry, own = int(own[-1]), own[:-1]
            starts.append(own[::2][own[1::2] - own[::2] > level.cap])
        if carry >= 0:
            starts.append(np.array([carry]))
        start = np.concatenate(starts)
        room = at - start[np.searchsorted(start, at, "right") - 1] + 1  # places from the run's start up to here
        depth, before = 0, -1
        while len(at):
            deep = max(1, level.limit // len(at))
            down = np.arange(depth, depth + deep)
            grid = at[None, :] - down[:, None]
            part = grid[room[None, :] > down[:, None]].astype(level.kind)
            first, before = self.at, int(part[-1])
            self._scanned(part, np.full(len(part), level.cap) if self.values else None, False)
            self._push(part, first, symbol)
            depth += deep
            at, room = at[room > depth], room[room > depth]
        return before

    def _several(self, block: int) -> None:
        """A block of several symbols, few suffixes: what is induced inside it is sorted by doubling along the chains."""
        level, lo, hi = self.level, self.level.cuts[block], self.level.cuts[block + 1]
        early = [*self.queue.take(block)]
        early = np.concatenate(early, 1) if early else np.zeros((3, 0), level.kind)
        given = [*self.seeds(block)]
        seed = np.concatenate([g[0] for g in given]) if given else np.zeros(0, level.kind)
        m, base = early.shape[1], early.shape[1] + len(seed)
        if not base:
            return
        at, symbol, link = [np.concatenate([early[0], seed])], [np.concatenate([early[1], level.text[seed].astype(level.kind)])], [np.arange(base)]
        leave, total = [], 0
        while len(at[-1]):
            i, p, s = self._before(at[-1])
            inside = (s >= lo) & (s < hi)
            leave.append((total + i[~inside], p[~inside], s[~inside]))
            at.append(p[inside])
            symbol.append(s[inside])
            link.append(total + i[inside])
            total += len(at[-2])
        at, symbol, link = np.concatenate(at), np.concatenate(symbol), np.concatenate(link)
        n = len(at)
        kind = np.ones(n, np.int64)
        kind[:m], kind[m:base] = 0, 2
        key = self.sign * symbol.astype(np.int64) * 4 + kind
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        if n > base:
            chain, jump = np.arange(base, n), link.copy()
            tied = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
            start = np.maximum.accumulate(np.where(tied, np.arange(n), 0))
            inside = order >= base
            rank[order[inside]] = start[inside]
            while True:
                r, q = rank[chain], rank[jump[chain]]
                o = np.lexsort((q, r))
                r, q, here = r[o], q[o], np.arange(len(o))
                new = np.concatenate([[True], r[1:] != r[:-1]])
                fresh = new | np.concatenate([[True], q[1:] != q[:-1]])
                top = np.maximum.accumulate(np.where(new, here, 0))
                rank[chain[o]] = r + np.maximum.accumulate(np.where(fresh, here, 0)) - top
                if fresh.all():
                    break
                jump[chain] = jump[jump[chain]]
            order[rank] = np.arange(n)
        value = None
        if self.values:
            value = np.zeros(n, np.int64)
            x, y = order[:-1], order[1:]
            same = symbol[x] == symbol[y]
            plain = np.flatnonzero(same & (kind[x] == 0) & (kind[y] == 0))
            if len(plain):
                value[plain + 1] = self.floors.least(early[2][x[plain]], early[2][y[plain]]) + 1
            # Sources in this block against sources outside, or of another symbol: they differ at once.
            told = same & (kind[y] == 1)
            close = told & (kind[x] == 1) & (symbol[link[x]] == symbol[link[y]])
            value[1:][told & ~close] = 1
            if len(seed):
                seeds = np.concatenate([g[1] for g in given])
                both = np.flatnonzero(same & (kind[x] == 2) & (kind[y] == 2))
                value[both + 1] = seeds[y[both] - m]
            direct = np.flatnonzero(close | (same & (kind[x] != 2) & (kind[y] == 2)))
            if len(direct):
                value[direct + 1] = common_prefix(level.text, at[x[direct]], at[y[direct]], level.cap)
            value = np.minimum(value, level.cap)
        first = self.at
        self._scanned(at[order], value, kind[order] == 2)
        i, p, s = (np.concatenate(c) for c in zip(*leave, strict=True))
        o = np.argsort(rank[i], kind="stable")
        self.queue.push(level.block_of(s[o]), np.stack([p[o], s[o], (first + rank[i[o]]).astype(level.kind)]))


def _named(level: Level, lms: np.ndarray, falling: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings by their order, at their places in the text's order, and the number of names."""
    names, last, name = level.store.array(len(lms), np.int64), None, -1
    for i, j in reversed(_ranges(level.n, min(STEP, max(1 << 14, level.memory)))):
        at = np.asarray(falling[i:j])[::-1].astype(np.int64)
        at = at[at > 0]
        at = at[np.asarray(level.s[at]) & ~np.asarray(level.s[at - 1])]
        if not len(at):
            continue
        place = np.searchsorted(lms, at.astype(lms.dtype))
        size = np.where(place + 1 < len(lms), lms[np.minimum(place + 1, len(lms) - 1)] - at + 1, 0)  # the last one runs to the end, like no other
        a, b = np.concatenate([[-1 if last is None else last[0]], at[:-1]]), at
        before = np.concatenate([[0 if last is None else last[1]], size[:-1]])
        same = (size == before) & (size > 0)
        some = np.flatnonzero(same)
        same[some] = common_prefix(level.text, a[some], b[some], size[some]) == size[some]
        own = name + np.cumsum(~same)
        names[place] = own
        name, last = int(own[-1]), (int(at[-1]), int(size[-1]))
    return names, name + 1


def suffix_array(text: np.ndarray, cap: int = 200, scratch: str | None = None, memory: int = 1 << 22, full: bool = True, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of a string of non-negative integers in descending order, and each one's common prefix with the one before it, at most cap.

    Without `full`, suffixes that agree in at least cap symbols may stand in any order among themselves. With a scratch
    folder, memory holds some multiple of `memory` tuples at most (about 150 bytes each), and the results are mapped files.
    """
    store = store or Store(scratch)
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int32)
    level = Level(text, cap, store, memory)
    lms = level.lms()
    values = store.array(len(lms), level.value_kind)
    sorted_ = lms
    if len(lms) > 1:
        falling, _ = level.induce(level.by_symbol(lms), False)
        names, many = _named(level, lms, falling)
        less = -(-cap // 2)  # a name stands for two symbols at least
        if many == len(lms) or (less <= 1 and not full):
            order, known = _by_name(names, many, store), None
        else:
            order, known = suffix_array(names, max(less, 1), None, memory, full, store)
        sorted_ = store.array(len(lms), level.kind)
        # The names' order is descending; seeds are wanted in ascending order.
        m = len(lms)
        for i, j in _ranges(m, min(STEP, max(1 << 14, memory))):
            own = np.asarray(order[m - j : m - i])[::-1].astype(np.int64)
            sorted_[i:j] = lms[own]
            a, b = own[:-1], own[1:]
            if i:
                a, b = np.concatenate([[int(order[m - i])], a]), own
            # Names that agree skip their text; the first different one is compared, or the rest up to the cap.
            if known is None:
                shared = np.zeros(len(a), np.int64) if many == m else (names[a] == names[b]).astype(np.int64)
            else:
                shared = np.asarray(known[m - j + 1 : m - i + (1 if i else 0)])[::-1].astype(np.int64)
            skip = np.minimum(lms[np.minimum(a + shared, m - 1)].astype(np.int64) - lms[a], cap)
            found = skip + common_prefix(text, lms[a] + skip, lms[b] + skip, cap - skip)
            values[j - len(found) : j] = found
    return level.induce(level.in_order(sorted_, values), True)


def _by_name(names: np.ndarray, many: int, store: Store) -> np.ndarray:
    """Places in descending order of their names, by counting; equal names keep no order of their own."""
    counts = store.array(many + 1, np.int64)
    for i, j in _ranges(len(names), STEP):
        which, own = np.unique(names[i:j], return_counts=True)
        counts[which + 1] += own
    total = 0
    for i, j in _ranges(many + 1, STEP):
        counts[i:j] = total + np.cumsum(counts[i:j])
        total = int(counts[j - 1])
    out = store.array(len(names), np.int64)
    for i, j in _ranges(len(names), STEP):
        part = np.asarray(names[i:j])
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        rank = np.arange(len(part)) - np.maximum.accumulate(np.where(first, np.arange(len(part)), 0))
        out[len(names) - 1 - (counts[ranked] + rank)] = i + order
        np.add.at(counts, ranked, 1)
    return out
