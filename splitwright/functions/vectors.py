"""Expressions on ARRAY<DOUBLE> rows of bounded width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_sum(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def log_sum_exp(vector: Column) -> Column:
    top = F.array_max(vector)
    return top + F.log(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def softmax(vector: Column) -> Column:
    lse = log_sum_exp(vector)
    return F.transform(vector, lambda x: F.exp(x - lse))


def vector_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def top_positions(scores: Column, k: int) -> Column:
    """Positions (0-based) of the ``k`` largest scores, best first, smaller position on ties."""
    keyed = F.transform(scores, lambda x, i: F.struct((-x).alias("key"), i.alias("pos")))
    return F.transform(F.slice(F.sort_array(keyed), 1, k), lambda s: s["pos"])
