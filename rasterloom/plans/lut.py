"""A chain of 8-bit point operators as one table of 256 values: exact, since the domain is finite."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import kernel

POINTWISE = {"apply_negative", "bitwise_not", "apply_log", "apply_gamma", "apply_threshold", "apply_threshold_binary_inv", "apply_threshold_trunc", "apply_threshold_tozero", "apply_threshold_tozero_inv", "convert_scale_abs", "apply_lut"}


def fused(chain: list[tuple]) -> np.ndarray:
    """The table of a chain of (name, *params)."""
    values = np.arange(256, dtype=np.uint8)[:, None]
    for name, *params in chain:
        if name not in POINTWISE:
            raise ValueError(f"{name} isn't a point operator of 8-bit values")
        values = np.asarray(kernel(name)(values, *params), np.uint8)
    return values[:, 0]


def apply(px: DataFrame, chain: list[tuple]) -> DataFrame:
    table = F.array(*[F.lit(int(t)) for t in fused(chain)])
    return px.withColumn("v", F.element_at(table, F.col("v") + 1))
