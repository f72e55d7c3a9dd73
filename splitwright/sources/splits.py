"""Split assignments as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitwright.operators.checks import SchemaError


def write_split(assigned: DataFrame, path: str, id_col: str = "id") -> str:
    """Long form: one JSON line ``{"id": ...}`` per item, a folder per split, globally sorted ids."""
    rows = assigned.select("split", F.col(id_col).alias("id"))
    rows.orderBy("split", "id").write.mode("overwrite").partitionBy("split").json(path)
    return path


def read_split(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    return spark.read.schema(f"id {id_type}, split string").json(path).select("id", "split")


def write_split_document(assigned: DataFrame, path: str, id_col: str = "id") -> str:
    """Objects ``{"train": [...], ...}`` with sorted ids, in a folder of ordered parts.

    Each part is one object with the next ids, so no task gathers more than a range of them; a small
    assignment is a single object.
    """
    rows = assigned.select("split", F.col(id_col).alias("id")).repartitionByRange("split", "id")
    names = [r[0] for r in assigned.select("split").distinct().orderBy("split").collect()]
    lists = [F.sort_array(F.collect_list(F.when(F.col("split") == s, F.col("id")))).alias(s) for s in names]
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(*lists)
    parts.repartitionByRange("part").sortWithinPartitions("part").drop("part").write.mode("overwrite").json(path)
    return path


def read_split_document(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``split, id`` of a JSON object of id lists; fields that are not lists of ids are left out."""
    doc = spark.read.option("multiLine", multi_line).json(path)  # parts written here have an object a line
    lists = [f.name for f in doc.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not lists:
        raise SchemaError(f"no id lists in {path}")
    entries = [
        F.struct(F.lit(c).alias("split"), F.col(f"`{c}`").cast("array<string>").alias("ids")) for c in lists
    ]
    return doc.select(F.inline(F.array(*entries))).select("split", F.explode("ids").alias("id"))
