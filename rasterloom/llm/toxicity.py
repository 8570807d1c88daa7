"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, digits, apostrophes and non-ASCII bytes, A-Z lower-cased. A token's features are its
hash and the hashes of its first 3 to 8 bytes. Token labels come from document labels: a greedy cover picks the
features that tell toxic documents from the others, and a toxic document's tokens that have one are its toxic
tokens. The field learns emissions and transitions from them by gradient steps on the conditional likelihood.
Forward-backward runs over all tokens of a chunk at once, as a blocked scan of 2x2 matrices that restarts at every
text. Documents are scored by a logistic regression on their marginals; tokens over half are the offending spans.

Fitted on a bounded sample (`most` documents a class), weighted in the regression for all labelled documents.

Defined results: null and empty texts have no tokens and the score of such; equal texts have equal scores; without
labels of both kinds every score is 0: no document is held to be toxic without evidence. An empty table gives an empty
table. Extra columns pass through; a result's name that the table uses takes an underscore. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, sample, scan

TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
PREFIXES = (3, 4, 5, 6, 7, 8)
BITS = 20
BLOCK = 64
FEW = 5


def token_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths, first token of each text (n+1), and the features' buckets; bucket 0 stands for none."""
    low = scan.LOWER[data]
    starts, lengths, first = scan.spans(TOKEN[low], off)
    top = np.uint64(64 - BITS)
    out = np.zeros((len(starts), len(PREFIXES) + 1), np.int32)
    if len(starts):
        out[:, 0] = (scan.hash_spans(low, starts, lengths) >> top).astype(np.int32)
        head = scan.words8(low)[starts]
        for i, k in enumerate(PREFIXES):
            own = (scan.mix((head & scan.MASK[k]) + np.uint64(k * int(scan.C2) & 0xFFFFFFFFFFFFFFFF)) >> top).astype(np.int32)
            out[:, i + 1] = np.where(lengths >= k, own, 0)
    return starts, lengths, first, out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2x2 matrices kept as rows of four, scaled to sum 1."""
    out = np.empty_like(a)
    out[..., 0] = a[..., 0] * b[..., 0] + a[..., 1] * b[..., 2]
    out[..., 1] = a[..., 0] * b[..., 1] + a[..., 1] * b[..., 3]
    out[..., 2] = a[..., 2] * b[..., 0] + a[..., 3] * b[..., 2]
    out[..., 3] = a[..., 2] * b[..., 1] + a[..., 3] * b[..., 3]
    out /= out.sum(-1, keepdims=True)
    return out


def _prefix(m: np.ndarray) -> np.ndarray:
    """Row vectors (1, 1) m[0] m[1] ... m[t] for every t, each scaled to sum 1."""
    n = len(m)
    rows = -(-n // BLOCK)
    padded = np.tile(np.array([1.0, 0, 0, 1]), (rows * BLOCK, 1))
    padded[:n] = m
    padded = padded.reshape(rows, BLOCK, 4)
    for j in range(1, BLOCK):
        padded[:, j] = _product(padded[:, j - 1], padded[:, j])
    into = np.ones((rows, 2))
    if rows > 1:
        into[1:] = _prefix(padded[:-1, -1])
    v = np.stack([into[:, :1] * padded[..., 0] + into[:, 1:] * padded[..., 2], into[:, :1] * padded[..., 1] + into[:, 1:] * padded[..., 3]], -1)
    return (v / v.sum(-1, keepdims=True)).reshape(-1, 2)[:n]


def marginals(emission: np.ndarray, begins: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: every token's probability of being toxic, and the expected transitions into it (n, 4)."""
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 4))
    e = np.exp(np.clip(emission, -30, 30))
    e = np.column_stack([1 / (1 + e), e / (1 + e)])
    base = np.where(begins[:, None], np.tile(start, 2), transition.ravel())
    m = base * np.tile(e, 2)
    alpha = _prefix(m)
    back = m[::-1][:, [0, 2, 1, 3]]
    beta = np.ones((n, 2))
    if n > 1:
        beta[:-1] = _prefix(back[:-1])[::-1]
    both = alpha * beta
    p = both[:, 1] / both.sum(1)
    pair = np.zeros((n, 4))
    pair[1:] = alpha[:-1][:, [0, 0, 1, 1]] * m[1:] * beta[1:][:, [0, 1, 0, 1]]
    pair[begins] = 0
    return p, pair / np.maximum(pair.sum(1, keepdims=True), 1e-300)


@dataclass
class Field:
    weights: np.ndarray  # by feature bucket
    bias: float
    transition: np.ndarray
    start: np.ndarray
    document: np.ndarray  # weights of the document's regression

    def tag(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, lengths, first, features = token_features(data, off)
        emission = self.weights[features].sum(1) + self.bias
        return starts, lengths, first, marginals(emission, _begins(first, len(starts)), self.transition, self.start)[0]

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = document_features(p, first)
        return 1 / (1 + np.exp(-np.clip(x @ self.document[:-1] + self.document[-1], -30, 30)))


def chain_gradient(p: np.ndarray, pair: np.ndarray, truth: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the conditional log-likelihood in the log potentials of transitions (2, 2) and starts: labelled less expected counts."""
    follows = np.flatnonzero(~begins)
    told = np.bincount((truth[follows - 1] * 2 + truth[follows]).astype(np.int64), minlength=4)
    start, t = p[begins], truth[begins]
    return (told - pair[follows].sum(0)).reshape(2, 2), np.array([(start - t).sum(), (t - start).sum()])


def _begins(first: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[first] = True
    return out[:n]


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of every text: the log odds of its two likeliest tokens, and the log of its expected toxic tokens among those over half."""
    n, size = len(first) - 1, np.diff(first)
    doc, full, top, p_left = np.repeat(np.arange(n), size), size > 0, np.full((2, n), 1e-5), p.copy()
    for k in range(2):
        if full.any():
            top[k, full] = np.maximum.reduceat(p_left, first[:-1][full])
        at = np.flatnonzero(p_left == top[k][doc])
        p_left[at[np.unique(doc[at], return_index=True)[1]]] = 0
    top = np.clip(top, 1e-3, 1 - 1e-3)
    return np.column_stack([*np.log(top / (1 - top)), np.log1p(scan.reduce_by(np.where(p > 0.5, p, 0), first))])


def _cover(pairs: np.ndarray, toxic: int, plain: np.ndarray, others: int, least: int = 3, odds: float = 2.5, sure: float = 25.0) -> np.ndarray:
    """Features that tell toxic texts: those far too frequent for chance, and a greedy cover of the texts that are left.

    pairs: distinct text << BITS | feature. The gain of a feature, texts times log odds, is half its likelihood ratio.
    """
    text, feature = pairs >> BITS, pairs & ((1 << BITS) - 1)
    open_, chosen = np.ones(toxic, bool), []
    rest = np.log((plain + 0.5) / (others + 1))
    full = np.bincount(feature, minlength=1 << BITS)
    odd = np.log((full + 0.5) / (toxic + 1)) - rest
    chosen = np.flatnonzero((odd >= odds) & (full * odd >= sure)).tolist()
    open_[text[np.isin(feature, chosen)]] = False
    while True:
        left = open_[text]
        text, feature = text[left], feature[left]
        a = np.bincount(feature, minlength=1 << BITS)
        gain = np.where((a >= least) & (odd >= odds), a * odd, 0)
        best = int(gain.argmax())
        if not gain[best]:
            return np.array(chosen, np.int64)
        chosen.append(best)
        open_[text[feature == best]] = False


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 3000, folds: int = 5, held: int = 0, rounds: int = 6, steps: int = 80) -> Field | None:
    """A field from at most about `most` documents of either label outside the held-out fold."""
    table, y, weight = sample.texts(docs, labels, label, most, folds, held)
    if len(np.unique(y)) < 2:
        return None
    parts, at = [], 0
    for _, data, off in common.chunks(iter(table.combine_chunks().to_batches()), "text"):
        parts.append((data, off, y[at : at + len(off) - 1]))
        at += len(off) - 1
    plain, pairs, toxic = np.zeros(1 << BITS), [], 0
    for data, off, own in parts:
        _, _, first, f = token_features(data, off)
        doc = np.repeat(np.arange(len(own)), np.diff(first))
        distinct = np.unique((doc[:, None].astype(np.int64) << BITS | f).ravel())
        distinct = distinct[(distinct & ((1 << BITS) - 1)) > 0]
        bad = own[distinct >> BITS] == 1
        plain += np.bincount(distinct[~bad] & ((1 << BITS) - 1), minlength=1 << BITS)
        rank = np.cumsum(own == 1) - 1 + toxic
        pairs.append(rank[distinct[bad] >> BITS] << BITS | distinct[bad] & ((1 << BITS) - 1))
        toxic += int((own == 1).sum())
    seed, pairs = np.zeros(1 << BITS, bool), np.concatenate(pairs)
    chosen = _cover(pairs, toxic, plain, int((y == 0).sum()))
    # Features of few documents would take weight from those that inflected forms share.
    usual = plain + np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS) >= FEW
    seed[chosen] = True
    field = Field(np.zeros(1 << BITS), -4.0, np.array([[0.9, 0.1], [0.5, 0.5]]), np.array([0.9, 0.1]), np.zeros(4))
    squares, chain_squares = np.full(1 << BITS, 1e-2), np.full(6, 1.0)
    chain = np.log(np.concatenate([field.transition.ravel(), field.start]))  # potentials of the chain, as logarithms
    del pairs
    seen = []
    for data, off, own in parts:
        seen.append((own, *token_features(data, off)[2:]))
        common.release()
    # A small sample is one part: it takes more rounds to as many steps.
    for r in range(max(rounds, -(-steps // max(1, len(seen))))):
        for own, first, f in seen:
            begins = _begins(first, len(f))
            doc = np.repeat(np.arange(len(own)), np.diff(first))
            truth = (seed[f].any(1) & (own[doc] == 1)).astype(float)
            emission = field.weights[f].sum(1) + field.bias
            p, pair = marginals(emission, begins, field.transition, field.start)
            error = truth - p
            # Balanced steps: toxic tokens are rare.
            g = np.bincount(f.ravel(), np.repeat(error, f.shape[1]), 1 << BITS) - 1e-3 * field.weights
            g[0] = 0
            g *= usual
            squares += g * g
            field.weights += 0.5 * g / np.sqrt(squares)
            own = np.concatenate([c.ravel() for c in chain_gradient(p, pair, truth, begins)]) - 1e-3 * chain
            chain_squares += own * own
            chain += 0.2 * own / np.sqrt(chain_squares)
            del p, pair, error, truth, g, emission, doc, begins  # the driver's memory is small
            field.transition, field.start = np.exp(chain[:4]).reshape(2, 2), np.exp(chain[4:])
    x = []
    for data, off, _ in parts:
        _, _, first, p = field.tag(data, off)
        x.append(document_features(p, first))
    field.document = sample.logistic(np.concatenate(x), y.astype(float), weight)
    del seen, parts, table
    common.release()
    return field


def tag(df: DataFrame, field: Field | None, text: str = "text", score: str = "score", spans: str | None = "spans") -> DataFrame:
    """df with the score and, if wanted, the offending spans as array<struct<start, end, p>> in code points."""
    common.ship(df.sparkSession)
    names = [common.free_name(df, score)] + ([common.free_name(df, spans)] if spans else [])
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
    send = df.sparkSession.sparkContext.broadcast(field)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = send.value
        for batch, data, off in common.chunks(batches, text):
            if field is None:
                more = [pa.array(np.zeros(batch.num_rows))] + ([pa.array([[]] * batch.num_rows, pa.list_(kind))] if spans else [])
            else:
                starts, lengths, first, p = field.tag(data, off)
                more = [pa.array(field.score(p, first))]
                if spans:
                    hit = np.flatnonzero(p > 0.5)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    doc = np.searchsorted(first, hit, "right") - 1
                    base = chars[off[doc]]
                    found = pa.StructArray.from_arrays([pa.array(chars[starts[hit]] - base), pa.array(chars[starts[hit] + lengths[hit]] - base), pa.array(p[hit])], fields=list(kind))
                    more.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, first).astype(np.int32)), found))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    schema = f"{common.arrow_schema(df)}, `{names[0]}` double" + (f", `{names[1]}` array<struct<start: bigint, end: bigint, p: double>>" if spans else "")
    return df.mapInArrow(run, schema)
