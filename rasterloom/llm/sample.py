"""Bounded training samples of labelled texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def stratified(rows: DataFrame, key: str, label: str, most: int, classes: int = 64, total: int | None = None) -> DataFrame:
    """About `most` rows of each class (all, if a class has fewer): those whose key's hash is least. Rows without label or key don't count.

    With `total`, many classes share out that many rows evenly. What the driver sees is one count per class; more than
    `classes` classes are an error, since none is left out.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = rows.groupBy(label).count().limit(classes + 1).collect()
    if len(counts) > classes:
        raise ValueError(f"{label} has more than {classes} values")
    if total and counts:
        most = min(most, max(1, total // len(counts)))
    share, name = common.free_name(rows, "share"), common.free_name(rows, "class")
    kind = rows.schema[label].dataType.simpleString()
    shares = rows.sparkSession.createDataFrame([(r[0], min(1.0, most / r[1])) for r in counts], f"`{name}` {kind}, `{share}` double")
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(F.broadcast(shares), rows[label] == shares[name]).where(place < F.col(share))
    return some.select(*rows.columns).limit(2 * most * max(1, len(counts)))


def told(labels: DataFrame, label: str, folds: int, held: int, id: str = "doc_id") -> DataFrame:
    """(id, y) of labelled documents outside the held-out fold. A twice-labelled id takes the larger label."""
    return labels.where(common.fold(id, folds) != held).groupBy(id).agg(F.max(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))


def texts(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int, held: int, id: str = "doc_id", text: str = "text") -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Texts, 0/1 labels and weights of a bounded sample of labelled documents outside the held-out fold. A twice-labelled id takes the larger label.

    A weight is the number of labelled documents that one of the sample stands for: its class's count over the sampled ones.
    """
    known = told(labels, label, folds, held, id)
    ids = stratified(known, id, "y", most).select(F.col(id).alias("id"), "y").toArrow()  # at most 4 * most rows
    if not ids.num_rows:
        return pa.table({"text": pa.array([], pa.string())}), np.zeros(0, np.int64), np.zeros(0)
    counts = {r.y: r["count"] for r in known.where(F.col(id).isNotNull()).groupBy("y").count().collect()}
    sampled = np.bincount(ids.column("y").to_numpy(), minlength=2)
    small = docs.sparkSession.createDataFrame(ids)
    found = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(small), "id")
    # Copies of one id would outgrow the bound.
    table = found.limit(8 * most).toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    y = table.column("y").to_numpy()
    common.release()
    return table.select(["text"]), y, np.array([counts.get(c, 0) / max(1, sampled[c]) for c in (0, 1)])[y]


def quantile(values: np.ndarray, weight: np.ndarray, q: float) -> float:
    """The quantile of weighted values, linear between their middles; with equal weights, that of np.quantile."""
    order = np.argsort(values, kind="stable")
    middle = np.cumsum(weight[order]) - weight[order] / 2
    return float(np.interp(middle[0] + q * (middle[-1] - middle[0]), middle, values[order]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression of weighted rows by Newton's method; the last is the intercept."""
    x, weight = np.column_stack([x, np.ones(len(x))]), weight / weight.mean()
    w, keep = np.zeros(x.shape[1]), ridge * len(x) * np.eye(x.shape[1])
    keep[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w
