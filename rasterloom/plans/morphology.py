"""Rectangular structuring elements as two passes of one row and one column: exact for minima and maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..kernels import dense
from ..operators import images


def _two_passes(a, width: int, height: int, step):
    return step.stack(step.stack(a, dense.get_structuring_element(0, width, 1)), dense.get_structuring_element(0, 1, height))


def _staged(step, width: int, height: int):
    def f(a):
        return _two_passes(a, width, height, step)

    return dense.stacked(f)


def erode(df: DataFrame, width: int, height: int) -> DataFrame:
    return images.run(df, _staged(dense.apply_erosion, width, height))


def dilate(df: DataFrame, width: int, height: int) -> DataFrame:
    return images.run(df, _staged(dense.apply_dilation, width, height))
