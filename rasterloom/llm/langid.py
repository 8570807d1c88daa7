"""Language identification by string kernels.

The kernel of two texts is the blended spectrum of 1- to 3-grams of bytes: the number of n-grams that both have
(presence, not counts), normalised by the texts' own numbers. N-grams are kept as hashed presence bits. Nystroem
landmarks turn the kernel into short vectors, on which ridge regression is trained one language against the rest.
A chunk of texts is scored by two matrix products: presence by landmarks, then kernel rows by weights.

Fitted on a bounded sample of every language: `most` documents each, fewer where TOTAL is shared by many languages,
and `landmarks` in all, but one a language at least. More than LANGUAGES languages are an error. Defined results: `und` with score 0 if
the text is null or has no letter, or nothing could be learned; equal texts get equal results. A-Z count as a-z.
Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sample, scan

SIZE = 1 << 12  # presence bits
LANGUAGES = 512  # the model holds SIZE numbers for each of them at least
TOTAL = 64_000  # documents in the sample


def presence(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 0/1 row of hashed n-grams per text; n-grams don't cross texts."""
    n, low = len(off) - 1, scan.LOWER[data].astype(np.uint32)
    # A run of the same kind of white space says nothing of the language, but a word's border does.
    low[scan.SPACE[data]] = 32
    out = np.zeros(n * SIZE, np.float32)
    row = np.repeat(np.arange(n, dtype=np.int64) * SIZE, np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(data))
    gram = low.copy()
    for size in (1, 2, 3):
        if size > 1:
            gram = gram[:-1] << np.uint32(8) | low[size - 1 :]
        at = (gram * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(20)
        own = left[: len(at)] >= size
        out[row[: len(at)][own] + at[own]] = 1
    return out.reshape(n, SIZE)


def letters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a text has a letter."""
    ascii_ = np.zeros(256, bool)
    ascii_[65:91] = ascii_[97:123] = True
    found = scan.reduce_by(ascii_[data].astype(np.int64), off) > 0
    for i in np.flatnonzero(~found):
        text = data[off[i] : off[i + 1]].tobytes()
        found[i] = bool(text) and any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return found


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # SIZE x m presence, normalised
    weights: np.ndarray  # m x languages, the Nystroem map included
    offset: np.ndarray

    def kernel(self, x: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return (x @ self.landmarks) / own

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its share of the softmax of the machines' outputs."""
        z = np.concatenate([self.kernel(presence(data[off[i] : off[j]], off[i : j + 1] - off[i])) @ self.weights for i, j in _slices(len(off) - 1)]) + self.offset
        e = np.exp(8 * (z - z.max(1, keepdims=True)))
        return z.argmax(1), 1 / e.sum(1)


def _slices(n: int, step: int = 256) -> list[tuple[int, int]]:
    return [(i, min(i + step, n)) for i in range(0, n, step)]


def fit(docs: DataFrame, lang: str = "lang", id: str = "doc_id", text: str = "text", most: int = 1000, landmarks: int = 256, folds: int = 4, held: int = 2, ridge: float = 1e-3) -> Model | None:
    """A model from about `most` documents of each language outside the held-out fold."""
    rows = docs.where(common.fold(id, folds) != held)
    # Sampling sees ids and languages alone; the texts come afterwards.
    chosen = sample.stratified(rows.select(F.col(id).alias("id"), F.col(lang).alias("lang")), "id", "lang", most, LANGUAGES, TOTAL).toArrow()
    if not chosen.num_rows:
        return None
    small = docs.sparkSession.createDataFrame(chosen).distinct().withColumnRenamed("lang", "l")
    at = rows.select(F.col(id).alias("id"), F.col(lang).alias("l"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = at.join(F.broadcast(small), ["id", "l"]).limit(8 * chosen.num_rows).toArrow().sort_by([("id", "ascending"), ("l", "ascending"), ("text", "ascending")])
    names = table.column("l").to_pylist()
    languages = sorted(set(names))
    y = np.array([languages.index(x) for x in names])
    parts = list(common.chunks(iter(table.select(["text"]).combine_chunks().to_batches()), "text"))
    rng = np.random.default_rng(9)
    some = [rng.permutation(np.flatnonzero(y == c))[: max(1, landmarks // len(languages))] for c in range(len(languages))]
    pick = np.zeros(len(y), bool)
    pick[np.concatenate(some)] = True
    held_, base = [], 0
    for _, data, off in parts:
        x = presence(data, off)[pick[base : base + len(off) - 1]]
        held_.append(x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)))
        base += len(off) - 1
    marks = np.concatenate(held_).T.copy()
    model = Model(languages, marks, np.zeros((0, 0)), np.zeros(0))
    k = np.concatenate([model.kernel(presence(data[off[i] : off[j]], off[i : j + 1] - off[i])) for _, data, off in parts for i, j in _slices(len(off) - 1)]).astype(float)
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(float))
    keep = values > 1e-6 * values[-1]
    nystroem = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ nystroem
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.bincount(y)[y]
    weight /= weight.mean()
    mean, goal = (phi * weight[:, None]).mean(0), (target * weight[:, None]).mean(0)
    a = (phi - mean) * weight[:, None]
    w = np.linalg.solve(a.T @ (phi - mean) + ridge * len(y) * np.eye(phi.shape[1]), a.T @ (target - goal))
    del k, a, parts, table
    common.release()
    return Model(languages, marks, (nystroem @ w).astype(np.float32), goal - mean @ w)


def identify(df: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language and its score."""
    common.ship(df.sparkSession)
    names = [common.free_name(df, pred), common.free_name(df, score)]
    send = df.sparkSession.sparkContext.broadcast(model)  # SIZE x landmarks numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = send.value
        for batch, data, off in common.chunks(batches, text):
            ok = letters(data, off) & (model is not None)
            best, s = model.score(data, off) if model else (np.zeros(batch.num_rows, int), np.zeros(batch.num_rows))
            langs = [model.languages[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.where(ok, s, 0.0).astype(float))], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, f"{common.arrow_schema(df)}, `{names[0]}` string, `{names[1]}` double")
