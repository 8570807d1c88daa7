"""Near-duplicate documents by MinHash with one permutation.

A document's set holds the 64-bit hashes of its distinct word shingles. One permutation puts each hash into one of
128 bins by its top bits; the least hash of a bin is its value, and empty bins borrow from bins that universal
hashing picks (optimal densification). Four bins make a band, 32 bands give 32 bucket keys. Small sets have prefix
keys instead: in any one order of all shingles, two linked sets must share one of their first n - ceil(t n) + 1. The
order is by rarity among small sets, so a line that very many of them share makes no bucket of all those.

Documents of equal sets form a class first; only its smallest id goes on. Buckets give star-shaped candidate edges:
the smallest member is the hub, each other member is compared with it, so a bucket of m gives m - 1 pairs. That
alone could miss a link between two members that differ from the hub. So where the others of a bucket don't end up in
one component (a bucket of two has only one other), they are joined by prefixes of their whole sets, rarest shingles
first; shingles that only one component has come before all others, since links inside a component are not wanted any
more. Where the first shared shingle leaves too few behind it in either set, the two can't link, so few pairs are
left. All links are confirmed on full sets. Components come from min-label propagation with pointer jumping.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; rows
that share an id count as one document; ties go to the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common, scan

BINS, ROWS, BANDS = 128, 4, 32
SMALL = 40  # sets up to this size have prefix keys
SALT = 2000  # members of a hub in one task's group


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and n+1 offsets."""
    low = scan.LOWER[data]
    starts, lengths, first = scan.words(low, off)
    h = scan.hash_spans(low, starts, lengths)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    size = np.diff(first)
    left = np.repeat(first[1:], size) - np.arange(n)  # words from here to the text's end
    whole = np.repeat(size, size)
    s = scan.mix(h)
    for j in range(1, k):
        more = np.concatenate([h[j:], np.zeros(min(j, n), np.uint64)])[:n]
        s = np.where(left > j, scan.mix((s * scan.C2) ^ more), s)
    keep = (left >= k) | ((whole < k) & (left == whole))
    s = s[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[first]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        s[a:b].sort()
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    fresh[at[:-1][size > 0]] = True
    return s[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def _attempts(rounds: int = 64) -> np.ndarray:
    b, t = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(1, rounds + 1, dtype=np.uint64), indexing="ij")
    return (scan.mix(b * np.uint64(1009) + t * np.uint64(0x51ED2701)) % np.uint64(BINS)).astype(np.int64)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The densified bins of every (not empty) set."""
    n, size = len(at) - 1, np.diff(at)
    place = np.repeat(np.arange(n) * BINS, size) + (sets >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    out, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    out[place[first]], full[place[first]] = sets[first], True
    out, full = out.reshape(n, BINS), full.reshape(n, BINS)
    own, tries = full.copy(), _attempts()
    for t in range(tries.shape[1] + BINS):
        if full.all():
            break
        # After the universal hashes, bins in turn: every set has a full one.
        source = tries[:, t] if t < tries.shape[1] else (np.arange(BINS) + t) % BINS
        take = ~full & own[:, source]
        out = np.where(take, out[:, source], out)
        full |= take
    return out


def bucket_keys(sets: np.ndarray, at: np.ndarray, percent: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of all texts one after another, and n+1 offsets; prefix keys by least hashes for sets up to `small`."""
    size = np.diff(at)
    prefix = np.where((size > 0) & (size <= small), size - -(-percent * size // 100) + 1, 0)
    big = np.flatnonzero(size >= max(1, SMALL * percent // 100))
    counts = prefix.copy()
    counts[big] += BANDS
    off = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(off[-1]), np.uint64)
    where = np.flatnonzero(prefix)
    out[scan.ragged(off[where], prefix[where])] = scan.mix(sets[scan.ragged(at[where], prefix[where])] ^ np.uint64(0xABCDEF))
    if len(big):
        parts = scan.ragged(at[big], size[big])
        sig = signatures(sets[parts], np.concatenate([[0], np.cumsum(size[big])])).reshape(len(big), BANDS, ROWS)
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(big), 1))
        for r in range(ROWS):
            key = scan.mix((key * scan.C2) ^ sig[:, :, r])
        out[(off[big] + prefix[big])[:, None] + np.arange(BANDS)] = key
    return out.view(np.int64), off


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def sketch(df: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, text) to doc_id, n, h1, h2 (a 128-bit digest of the set), keys of bands, and the whole set of a small one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in common.chunks(batches, "text"):
            sets, at = shingles(data, off, k)
            keys, where = bucket_keys(sets, at, percent, small=0)
            size = np.diff(at)
            few = np.where(size <= SMALL, size, 0)
            whole = sets[scan.ragged(at[:-1], few)].view(np.int64), np.concatenate([[0], np.cumsum(few)])
            columns = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(size), pa.array(_sums(scan.mix(sets), at)), pa.array(_sums(scan.mix(sets ^ scan.C3), at)), bpe.list_of(keys, where), bpe.list_of(*whole)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "h1", "h2", "keys", "small"])

    return df.mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, keys array<bigint>, small array<bigint>")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each wanted id. A semi-join by broadcast keeps other texts out of the shuffle; beyond 8 MB of ids they are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def tokens(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Texts of (cid, comp) to a row (cid, n, comp, h) for every shingle of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in common.chunks(batches, "text"):
            sets, at = shingles(data, off, k)
            size = np.diff(at)
            row = np.repeat(np.arange(batch.num_rows), size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(size[row]), batch.column(1).take(row), pa.array(sets.view(np.int64))], names=["cid", "n", "comp", "h"])

    texts = _texts(docs, wanted.select(F.col("cid").alias("doc_id"))).withColumnRenamed("doc_id", "cid")
    return texts.join(wanted, "cid").select("cid", "comp", "text").mapInArrow(run, "cid bigint, n bigint, comp bigint, h bigint")


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(cid, n, comp, h), a row for every shingle, to the first n - ceil(t n) + 1 of each set with their places `at`.

    Shingles of one component alone come first in a set, then the others by rarity. The former are left out, so two
    linked sets of different components share a row of this result, the first of which has their whole intersection
    behind it in both.
    """
    same = Window.partitionBy("h")
    met = rows.select("*", F.count("*").over(same).alias("df"), F.min("comp").over(same).alias("x"), F.max("comp").over(same).alias("y")).where("x != y")
    sets = met.groupBy("cid", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    sets = sets.withColumn("alone", F.col("n") - F.size("hs")).withColumn("first", F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 - alone as int)"))
    return sets.where("first > 0").select("cid", "n", "comp", "alone", F.posexplode(F.slice("hs", F.lit(1), F.col("first"))).alias("i", "x")).select(F.col("x.h").alias("h"), "cid", "n", "comp", (F.col("i") + F.col("alone")).alias("at"))


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components, in prefixes' rows, that may link."""
    t = 100 + percent
    # What lies behind the first shared shingle holds the intersection, so the smaller set has that shingle early.
    # Few rows make many pairs where many sets share a shingle, so their number of tasks is fixed, not merged by bytes.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h")
    x = rows.where((F.col("n") - F.col("at")) * t >= F.col("n") * 2 * percent).select("h", *(F.col(c).alias(f"x{c}") for c in ("cid", "n", "comp", "at")))
    need = (F.col("xn") + F.col("n")) * percent
    may = (F.col("xcomp") != F.col("comp")) & (F.struct("xn", "xcid") < F.struct("n", "cid")) & _fits(F.col("xn"), F.col("n"), percent)
    pairs = x.join(rows, "h").where(may & ((F.col("xn") - F.col("xat")) * t >= need) & ((F.col("n") - F.col("at")) * t >= need))
    return pairs.select(F.least("xcid", "cid").alias("a"), F.greatest("xcid", "cid").alias("b")).distinct()


def confirm(docs: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(a, b) to a, b, inter, both: sizes of intersection and union of the full sets, one row per edge.

    The hub's text meets its members' in groups of bounded size; a hub of many members is met in many groups.
    """
    spark = docs.sparkSession
    groups = edges.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("groups"))
    ids = edges.select(F.col("a").alias("doc_id")).union(edges.select(F.col("b").alias("doc_id"))).distinct()
    wanted = _texts(docs, ids)
    hubs = groups.join(wanted, groups.a == wanted.doc_id).select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(None).cast("bigint").alias("b"), "text")
    members = edges.join(groups, "a").join(wanted, F.col("b") == F.col("doc_id")).select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), "b", "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = hubs.union(members).repartition(parts, "a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch, data, off in common.chunks(batches, "text"):
            sets, at = shingles(data, off, k)
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows: list[tuple[int, int, int, int]] = []
            for i, member in enumerate(b):
                own = sets[at[i] : at[i + 1]]
                if member is None:
                    hub = own.copy()
                elif len(hub) and len(own):
                    where = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                    inter = int((hub[where] == own).sum())
                    rows.append((a[i], member, inter, len(hub) + len(own) - inter))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "inter", "both"])

    return spread.mapInArrow(run, "a bigint, b bigint, inter bigint, both bigint")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (id, comp): the smallest id reachable, for every id that has an edge."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = common.written(both, "edges")
    labels = common.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("jump"))
        step = common.written(step.join(up, "comp", "left").select("id", "old", F.least(F.col("comp"), F.coalesce("jump", "comp")).alias("comp")), "labels")
        moved = step.where("comp != old").limit(1).count()
        common.forget(labels)
        labels = step.select("id", "comp")
        labels._rasterloom_path = step._rasterloom_path
        if not moved:
            return labels


def _fits(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def classes(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of df; linked are sets of Jaccard >= percent / 100."""
    common.ship(df.sparkSession)
    docs = df.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sig = common.written(sketch(docs, k, percent), "sketch")
    sets = common.written(sig.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("cid"), F.first("keys").alias("keys"), F.first("small").alias("small")), "classes")
    # Buckets of two members at least, and their hubs.
    rare = prefixes(sets.select("cid", "n", F.col("cid").alias("comp"), F.explode("small").alias("h")), percent)
    place = sets.select(F.explode("keys").alias("key"), "cid", "n").union(rare.select(F.xxhash64("h").alias("key"), "cid", "n"))
    same = Window.partitionBy("key")
    met = place.select("*", F.min(F.struct("cid", "n")).over(same).alias("hub"), F.count("*").over(same).alias("m")).where("m > 1")
    member = common.written(met.select("key", "cid", "n", F.col("hub.cid").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
    star = member.where("cid != hub").where(_fits(F.col("n"), F.col("hub_n"), percent)).select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct()
    told = common.written(confirm(docs, common.written(star, "star"), k), "told")
    link = F.col("inter") * 100 >= F.col("both") * percent
    comp = components(told.where(link))
    # All were compared with their hub, so only buckets whose others aren't in one component by now hold pairs to compare.
    at = member.where("cid != hub").join(comp, F.col("cid") == F.col("id"), "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"))
    open_ = at.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
    left = common.written(at.join(open_, "key", "left_semi").select("cid", "comp").distinct(), "open")
    pairs = common.written(candidates(common.written(prefixes(tokens(docs, left, k), percent), "prefixes"), percent), "rest")
    if pairs.limit(1).count():
        more = common.written(confirm(docs, pairs, k), "more")
        comp = components(told.where(link).select("a", "b").union(more.where(link).select("a", "b")))
    by_set = sets.select("n", "h1", "h2", "cid").join(comp, F.col("cid") == F.col("id"), "left").select("n", "h1", "h2", F.coalesce("comp", "cid").alias("component_id"))
    out = sig.select("doc_id", "n", "h1", "h2").join(by_set, ["n", "h1", "h2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
