"""One row per key, set operations on keys, samples and first-k reports.

First and last are decided by an explicit order column. Aggregates are used instead of ranking
windows: they combine inside each task first, so a key that holds most of the rows costs nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Column, last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str] | str, order_by: str = "src_row") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return _one_per_key(df, keys, F.col(order_by), last=False)


def keep_last(df: DataFrame, keys: Sequence[str] | str, order_by: str = "src_row") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return _one_per_key(df, keys, F.col(order_by), last=True)


def distinct_keys(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Distinct non-null, non-empty keys."""
    return df.select(key.alias(name)).where(F.col(name).isNotNull() & (F.col(name) != "")).distinct()


def key_set_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both inputs with their membership: ``key, in_a, in_b``.

    Union, intersection and differences are filters on the two flags, out of one shuffle.
    """
    left = a.select(F.col(key), F.lit(True).alias("in_a"), F.lit(False).alias("in_b"))
    right = b.select(F.col(key), F.lit(False).alias("in_a"), F.lit(True).alias("in_b"))
    return left.unionByName(right).groupBy(key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def seeded_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows without replacement: the smallest seeded hashes of the key (a distributed top-k)."""
    mark = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.withColumn("_mark", mark).orderBy("_mark", key).limit(k).drop("_mark")


def first_rows(df: DataFrame, k: int, order_by: str = "src_row") -> DataFrame:
    """The first ``k`` rows in source order (a report, planned as a distributed top-k)."""
    return df.orderBy(order_by).limit(k)
