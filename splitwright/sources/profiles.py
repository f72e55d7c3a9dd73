"""Profile stores: a vector table with its dimension table, and the sinks aligned with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwright.operators.checks import SchemaError, require_columns
from splitwright.operators.profiles import vector_width_check, with_flag_columns
from splitwright.sources.tables import write_parquet


def open_profile_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(store, dimensions)`` below ``path``; both parts must exist and agree in width."""
    store = require_columns(spark.read.parquet(f"{path}/profiles"), ["colid", "data"], "profile store")
    dimensions = require_columns(spark.read.parquet(f"{path}/dimensions"), ["pos", "rowid"], "dimension table")
    check = vector_width_check(store, dimensions).first()
    if not check["ok"]:
        raise SchemaError(f"profile widths {check['min_width']}..{check['max_width']} differ from {check['n_dimensions']} dimensions")
    return store, dimensions


def write_profile_store(store: DataFrame, dimensions: DataFrame, path: str) -> str:
    write_parquet(store.select("colid", F.col("data").cast("array<float>").alias("data")), f"{path}/profiles")
    write_parquet(dimensions, f"{path}/dimensions")
    return path


def write_aligned(profiles: DataFrame, path: str, flag_width: int = 50) -> str:
    """Vectors and boolean masks of the same rows, keyed by ``row_idx``."""
    require_columns(profiles, ["row_idx", "data", "split_flags"], "profiles")
    write_parquet(profiles.select("row_idx", F.col("data").cast("array<float>").alias("data")), f"{path}/vectors")
    write_parquet(with_flag_columns(profiles.select("row_idx", "split_flags"), flag_width), f"{path}/masks")
    return path
