"""Quality scores by Bradley-Terry ranking of documents.

Preference pairs set a good document against a bad one; the logistic loss on the difference of their features gives
weights, whose inner product with a document's features is its score. A quantile of the scores of the labelled
documents, the share of bad ones, is the threshold; scores are moved to 0..1 so that the threshold falls on
`cut`. Features are shape statistics of the whole text, in quantile steps: no words, language or source.

All labelled documents count. Steps are their quantiles, with a rank error of 1e-4 of them. Groups of about `most`
documents of either class fit weights of their own, whose mean is taken; the rarer class's documents are in several
groups. Threshold and slope come from the counts of all their scores on a grid of 65,536 steps. Defined results: null and empty texts have the score of the
features of no words; equal texts have equal scores; without labels of both kinds every score is 1: no document is held
to be bad without evidence. Where the classes' scores don't overlap at all, the threshold is the middle of the gap
between them instead of the quantile at its edge. An empty table gives an empty table. Extra columns pass through; a
result's name that the table uses takes an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common, sample, scan

STEPS = 16
GRID = 1 << 16  # steps of scores that are counted


def _among(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


UPPER, DIGIT = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
DIGIT[48:58] = True
KINDS = {"mark": _among("!?"), "stop": _among(".,;:"), "symbol": _among("#$%&*@^~=+_\\"), "bracket": _among("<>{}[]()/"), "bar": _among("|"), "line": _among("\n")}


def text_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    starts, lengths, first = scan.words(data, off)
    n, count, size = len(off) - 1, np.diff(first).astype(float), np.diff(off).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    h = scan.hash_spans(scan.LOWER[data], starts, lengths)
    some, bytes_ = np.maximum(count, 1), np.maximum(size, 1)
    per = lambda flag: scan.reduce_by(flag.astype(np.int64), first) / some
    of = lambda table: scan.reduce_by(table[data].astype(np.int64), off) / bytes_
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pairs = scan.mix(h + np.roll(h, -1) * scan.C2) if len(h) else h
    fresh = lambda x: scan.reduce_by(_first_seen(x, doc), first) / some
    last = data[starts + lengths - 1] if len(starts) else np.zeros(0, np.uint8)
    head = data[starts] if len(starts) else last
    x = [np.log1p(count), np.log1p(size), per(lengths), per((lengths - scan.reduce_by(lengths, first)[doc] / some[doc]) ** 2), per(same), fresh(h), fresh(pairs)]
    x += [of(UPPER), of(DIGIT), *(of(t) for t in KINDS.values())]
    x += [per(UPPER[head]), *(per(KINDS[k][last]) for k in ("mark", "stop", "symbol")), per(KINDS["bar"][head]), per(lengths == 1), per(lengths > 20)]
    return np.column_stack(x)


def _first_seen(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """1 for one occurrence of each value in a text."""
    out = np.zeros(len(h), np.int64)
    if len(h):
        key = scan.mix(h ^ scan.mix(doc.astype(np.uint64) + np.uint64(7)))
        out[np.unique(key, return_index=True)[1]] = 1
    return out


@dataclass
class Ranking:
    edges: list[np.ndarray]
    weights: np.ndarray
    shift: float
    scale: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum(self.weights[i * STEPS + np.searchsorted(e, c, "left")] for i, (e, c) in enumerate(zip(self.edges, x.T, strict=True)))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.shift) * self.scale + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pair_slope(w: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Slope of the mean log-likelihood that the good document of a pair wins; rows are the places of features that are on."""
    pull = 1 / (1 + np.exp(w[good].sum(1) - w[bad].sum(1)))
    up, down = (np.bincount(p.ravel(), np.repeat(pull, p.shape[1]), len(w)) for p in (good, bad))
    return (up - down) / len(good)


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, y and features x of every labelled document outside the held-out fold."""
    known = sample.told(labels, label, folds, held, id).where(F.col(id).isNotNull()).select(F.col(id).alias("id"), "y")
    rows = docs.where(common.fold(id, folds) != held).select(F.col(id).alias("id"), F.col(text).alias("text"))
    if known.count() <= 1_000_000:  # beyond 8 MB of ids, features of unlabelled documents are dropped after they are made
        rows = rows.join(F.broadcast(known.select("id")), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in common.chunks(batches, "text"):
            x = text_features(data, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), bpe.list_of(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], names=["id", "x"])

    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")
    return common.written(made.join(known, "id").select("id", "y", "x"), "labelled")


def grouped(rows: DataFrame, counts: dict[int, int], group: int) -> DataFrame:
    """rows with the number g of a group: every row is in one at least, and every group has about `group` rows of each class, or all of a smaller class."""
    parts = {y: max(1, -(-n // group)) for y, n in counts.items()}
    own = F.when(F.col("y") == 1, F.lit(parts[1])).otherwise(F.lit(parts[0]))
    return rows.withColumn("g", F.explode(F.sequence(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("group")), own).cast("int"), F.lit(max(parts.values()) - 1), own)))


def _matrix(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy().reshape(len(x), -1)


def _places(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([i * STEPS + np.searchsorted(e, c, "left") for i, (e, c) in enumerate(zip(edges, x.T, strict=True))])


def pair_weights(place: np.ndarray, y: np.ndarray, d: int, pairs: int, rounds: int) -> np.ndarray:
    """Bradley-Terry weights from pairs in which all good documents take turns, and all bad ones."""
    rng = np.random.default_rng(5)
    g, b = (place[np.concatenate([rng.permutation(own) for _ in range(-(-max(pairs, len(y)) // len(own)))])[: max(pairs, len(y))]] for own in (np.flatnonzero(y == 1), np.flatnonzero(y == 0)))
    w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
    for t in range(1, rounds + 1):
        grad = pair_slope(w, g, b) - 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w += 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000, folds: int = 5, held: int = 0, pairs: int = 60_000, rounds: int = 200, cut: float = 0.3) -> Ranking | None:
    """A ranking from all labelled documents outside the held-out fold; a group has about `most` of either label."""
    common.ship(docs.sparkSession)
    rows = labelled(docs, labels, label, folds, held)
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        common.forget(rows)
        return None
    steps = [i / STEPS for i in range(1, STEPS)]
    width = len(rows.first().x)
    edges = [np.unique(c) for c in rows.agg(*(F.percentile_approx(F.col("x")[i], steps, 10_000).alias(f"x{i}") for i in range(width))).first()]
    d = len(edges) * STEPS

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        w = pair_weights(_places(_matrix(table.column("x")), edges), table.column("y").to_numpy(), d, pairs, rounds)
        common.release()
        return pa.table({"w": bpe.list_of(w, np.array([0, d]))})

    parts = grouped(rows, counts, most).groupBy("g").applyInArrow(learn, "w array<double>")
    # The mean by component, so the driver sees one row however many groups there are.
    mean = parts.select(F.posexplode("w").alias("i", "w")).groupBy("i").agg(F.avg("w").alias("w")).collect()
    w = np.zeros(d)
    w[[r.i for r in mean]] = [r.w for r in mean]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w[_places(_matrix(batch.column(1)), edges)].sum(1))], names=["y", "z"])

    scored = common.written(rows.select("y", "x").mapInArrow(score, "y int, z double"), "scored")
    ends = {r.y: r for r in scored.groupBy("y").agg(F.min("z").alias("least"), F.max("z").alias("most")).collect()}
    low, high = min(r.least for r in ends.values()), max(r.most for r in ends.values())
    step = (high - low) / GRID or 1.0
    cells = scored.groupBy("y", F.floor((F.col("z") - low) / step).alias("cell")).count().toArrow()  # at most two rows a step
    common.forget(scored)
    common.forget(rows)
    y, z, many = cells.column("y").to_numpy(), low + (cells.column("cell").to_numpy() + 0.5) * step, cells.column("count").to_numpy().astype(float)
    shift = sample.quantile(z, many, counts[0] / (counts[0] + counts[1]))
    # Overlapping classes leave the quantile inside the overlap; between separate ones the middle of the gap is safest.
    if ends[0].most < ends[1].least:
        shift = float(ends[0].most + ends[1].least) / 2
    fitted = sample.logistic(z[:, None], y.astype(float), many)
    common.release()
    return Ranking(edges, w, shift, float(max(fitted[0], 0.05)), cut)


def rank(df: DataFrame, ranking: Ranking | None, text: str = "text", score: str = "score") -> DataFrame:
    """df with the texts' scores."""
    common.ship(df.sparkSession)
    name = common.free_name(df, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in common.chunks(batches, text):
            s = ranking.score(text_features(data, off)) if ranking else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, f"{common.arrow_schema(df)}, `{name}` double")
