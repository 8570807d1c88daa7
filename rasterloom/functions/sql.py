"""Kernels as SQL functions `cv_<name>(data, height, width, channels)` on image bytes, with their parameters bound at registration."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..registry import kernel


def register(spark: SparkSession, name: str, *params: Any, sql_name: str | None = None) -> str:
    """An 8-bit image in, the kernel's image out as bytes; Arrow batches, no row-at-a-time Python. Returns the SQL name."""
    f, sql_name = kernel(name), sql_name or f"cv_{name}"

    def call(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for d, h, w, c in zip(data, height, width, channels, strict=True):
            a = np.frombuffer(d, np.uint8).reshape(h, w, c)
            r = f(a[..., 0] if c == 1 else a, *params)
            out.append(np.asarray(r[-1] if isinstance(r, tuple) else r).astype(np.uint8).tobytes())
        return pd.Series(out)

    spark.udf.register(sql_name, F.pandas_udf(call, "binary"))
    return sql_name
