"""Pass/fail gates as table rows; the caller decides what to do with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Thresholds of the gates.
MIN_NAME_NOVEL = 30
MIN_RESOLUTION_RATE = 0.90
MAX_MISS_RATE = 0.01
PASS_CORRELATION, FLAG_CORRELATION = 0.99, 0.95
RETAINED_RANGE = (5700, 6000)
# Which failing gate decides the status of a profile run.
STATUS_PRECEDENCE = ("lookup_miss", "retained_rows", "profile_correlation")


def _gate(value: DataFrame, name: str, threshold: str, passed) -> DataFrame:
    status = F.when(passed, F.lit("pass")).otherwise(F.lit("fail"))
    return value.select(
        F.lit(name).alias("gate"),
        F.col("value").cast("double").alias("value"),
        F.lit(threshold).alias("threshold"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        status.alias("status"),
    )


def at_least(value: DataFrame, name: str, threshold: float) -> DataFrame:
    """Gate on a one-row table with a ``value`` column."""
    return _gate(value, name, f">= {threshold}", F.col("value") >= threshold)


def at_most(value: DataFrame, name: str, threshold: float) -> DataFrame:
    return _gate(value, name, f"<= {threshold}", F.col("value") <= threshold)


def between(value: DataFrame, name: str, low: float, high: float) -> DataFrame:
    return _gate(value, name, f"[{low}, {high}]", F.col("value").between(low, high))


def name_novel_gate(value: DataFrame) -> DataFrame:
    return at_least(value, "name_novel", MIN_NAME_NOVEL)


def resolution_gate(value: DataFrame) -> DataFrame:
    return at_least(value, "resolution_rate", MIN_RESOLUTION_RATE)


def miss_gate(value: DataFrame) -> DataFrame:
    return at_most(value, "lookup_miss", MAX_MISS_RATE)


def retained_gate(value: DataFrame) -> DataFrame:
    return between(value, "retained_rows", *RETAINED_RANGE)


def correlation_gate(value: DataFrame) -> DataFrame:
    """Three states: pass, flag (continue, but say so) and fail."""
    v = F.col("value")
    good = F.coalesce(v >= PASS_CORRELATION, F.lit(False))
    status = F.when(good, F.lit("pass")).when(F.coalesce(v >= FLAG_CORRELATION, F.lit(False)), F.lit("flag"))
    return _gate(value, "profile_correlation", f">= {PASS_CORRELATION}", good).withColumn(
        "status", value_status(status)
    )


def value_status(status):
    return F.coalesce(status, F.lit("fail"))


def run_status(gates: DataFrame, precedence: tuple[str, ...] = STATUS_PRECEDENCE) -> DataFrame:
    """First failing gate by precedence, ``ok`` when none fails; a flagged gate does not fail."""
    rank = F.array_position(F.array(*[F.lit(g) for g in precedence]), F.col("gate"))
    failing = gates.where((F.col("status") == "fail") & (rank > 0))
    first = failing.agg(F.min_by("gate", rank).alias("gate"))
    return first.select(F.coalesce("gate", F.lit("ok")).alias("status"))
