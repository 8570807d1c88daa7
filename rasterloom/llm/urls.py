"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from URLs that carry a label, here the rules' own verdicts, on a bounded sample (`most`, the rows
of least hash). Features are length, depth, digit ratio, entropy, parameter counts and statistics of the suffix.

Defined results: a null url, or one without `://`, has empty host and path and is judged by the trees on the empty
text; equal urls get equal verdicts; without labelled urls of both kinds the method allows everything that no rule
blocks. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, scan

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SUFFIX_BINS = 64


def host_of(url: Column) -> Column:
    after = F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "/", 1)
    found = F.translate(F.regexp_extract(after, r"(?s)^([^?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(url.contains("://"), found).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(url, r"(?s)^.*?://", ""), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(url.contains("://"), found).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits (then the longer host, then text order), as struct<rule, verdict>; null if none."""
    out = F.lit(None).cast("struct<rule string, verdict string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"), r[0])):
        h, p = rule.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(host: pa.Array, path: pa.Array, url: pa.Array, suffix: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of lexical numbers per url, and the hash bin of its host's suffix (the last label)."""
    (ud, uo), (hd, ho), (pd, po) = common.utf8(url), common.utf8(host), common.utf8(path)
    count = lambda data, off, *chars: scan.reduce_by(np.isin(data, np.frombuffer("".join(chars).encode(), np.uint8)).astype(np.int64), off)
    digits = "0123456789"
    length = np.diff(uo)
    some = np.maximum(length, 1)
    entropy = np.zeros(len(length))
    doc = np.repeat(np.arange(len(length)), length)
    seen = np.bincount(doc * 256 + ud, minlength=len(length) * 256).reshape(-1, 256) / some[:, None]
    entropy = -(seen * np.log2(np.where(seen > 0, seen, 1))).sum(1)
    last = pa.array([h.rpartition(".")[2] for h in host.fill_null("").to_pylist()], pa.string())
    ld, lo = common.utf8(last)
    bins = (scan.hash_spans(ld, lo[:-1], np.diff(lo)) % np.uint64(SUFFIX_BINS)).astype(np.int64) if len(lo) > 1 else np.zeros(0, np.int64)
    x = [length, np.diff(ho), np.diff(po), count(pd, po, "/"), count(hd, ho, "."), count(ud, uo, digits) / some, count(hd, ho, digits), entropy, count(ud, uo, "&", "=") + 0.0, count(ud, uo, "?"), count(ud, uo, "#"), count(hd, ho, "-"), count(ud, uo, "%", "_", "~"), np.diff(lo)]
    return np.column_stack([*x, suffix[bins] if suffix is not None else np.zeros(len(length))]).astype(np.float64), bins


class Trees:
    """Gradient-boosted regression trees for logistic loss, on histograms of quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 1.0):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])
        width, d = bins, x.shape[1]
        rate_y = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.rate, self.depth, self.trees = float(np.log(rate_y / (1 - rate_y))), rate, depth, []
        score = np.full(len(y), self.base)
        keys = binned + np.arange(d) * width
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
            split, cut = np.full(2**depth - 1, -1), np.zeros(2**depth - 1, np.int64)
            for level in range(depth):
                first, n = 2**level - 1, 2**level
                flat = (node - first)[:, None] * (d * width) + keys
                gs, hs = (np.bincount(flat.ravel(), np.repeat(v, d), n * d * width).reshape(n, d, width) for v in (g, h))
                gl, hl = gs.cumsum(2), hs.cumsum(2)
                gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + least) + (gt - gl) ** 2 / (ht - hl + least) - gt**2 / (ht + least)
                gain[..., -1] = 0
                best = gain.reshape(n, -1).argmax(1)
                good = gain.reshape(n, -1)[np.arange(n), best] > 1e-6
                split[first : first + n], cut[first : first + n] = np.where(good, best // width, -1), best % width
                f = split[node]
                right = (f >= 0) & (binned[np.arange(len(y)), np.maximum(f, 0)] > cut[node])
                node = 2 * node + 1 + right
            leaf = node - (2**depth - 1)
            value = np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + least)
            score += rate * value[leaf]
            self.trees.append((split, cut, value))

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])
        out, each = np.full(len(x), self.base), np.arange(len(x))
        for split, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = split[node]
                node = 2 * node + 1 + ((f >= 0) & (binned[each, np.maximum(f, 0)] > cut[node]))
            out += self.rate * value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-out))


def fit(labelled: DataFrame, most: int = 20_000) -> tuple[Trees | None, np.ndarray]:
    """Trees from labelled urls (host, path, url, label 1 = block): the `most` rows of least url hash, and the suffixes' block rates."""
    rows = labelled.orderBy(F.xxhash64("url"), "url").limit(most).toArrow()
    y = rows.column("label").to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return None, np.full(SUFFIX_BINS, 0.5)
    columns = [rows.column(c).combine_chunks() for c in ("host", "path", "url")]
    bins = features(*columns, None)[1]
    # Shrunk towards the overall rate: a suffix that was never seen says nothing.
    suffix = (np.bincount(bins, y, SUFFIX_BINS) + 5 * y.mean()) / (np.bincount(bins, minlength=SUFFIX_BINS) + 5)
    return Trees(features(*columns, suffix)[0], y), suffix


def judge(df: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, most: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, verdict and the trees' block_score (null where a rule decides)."""
    common.ship(df.sparkSession)
    names = [common.free_name(df, c) for c in ("host", "path", "rule", "verdict", "block_score")]
    host, path, rule, verdict, score = names
    told = df.withColumn(host, F.coalesce(host_of(F.col(url)), F.lit(""))).withColumn(path, F.coalesce(path_of(F.col(url)), F.lit("")))
    found = common.free_name(told, "found")
    told = told.withColumn(found, rule_of(F.col(host), F.col(path), rules)).withColumn(rule, F.col(f"{found}.rule")).withColumn(verdict, F.col(f"{found}.verdict")).drop(found)
    labelled = told.where(F.col(rule).isNotNull()).select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(url).alias("url"), (F.col(verdict) == "block").cast("int").alias("label"))
    trees, suffix = fit(labelled, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in (host, path, rule, verdict, url)}
            fixed = batch.column(at[rule]).is_valid().to_numpy(zero_copy_only=False)
            free = np.flatnonzero(~fixed)
            scores, verdicts = np.full(batch.num_rows, np.nan), batch.column(at[verdict]).to_pylist()
            if len(free):
                part = batch.take(pa.array(free))
                scores[free] = trees.score(features(*(part.column(at[n]) for n in (host, path, url)), suffix)[0]) if trees else 0.0
                for i in free.tolist():
                    verdicts[i] = "block" if scores[i] >= threshold else "allow"
            columns = list(batch.columns)
            columns[at[verdict]] = pa.array(verdicts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, mask=fixed)], names=[*batch.schema.names, score])

    return told.mapInArrow(run, f"{common.arrow_schema(told)}, `{score}` double")
