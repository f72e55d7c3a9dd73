"""Tolerant casts and grid values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dose grid.
DOSE_GRID = (0.04, 0.12, 0.37, 1.11, 3.33, 10.0)
_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def to_number(value: Column) -> Column:
    """Double of a number text, null for anything else.

    The pattern guards the cast: Spark reads a trailing ``d`` or ``f`` as a Java literal suffix.
    """
    text = value.cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def nearest_grid_value(value: Column, grid: Sequence[float] = DOSE_GRID) -> Column:
    """Grid value with the smallest distance; the smaller one on equal distance."""
    points = [F.struct(F.abs(value - F.lit(float(g))).alias("gap"), F.lit(float(g)).alias("point")) for g in sorted(grid)]
    return F.when(value.isNotNull(), F.array_min(F.array(*points))["point"])
