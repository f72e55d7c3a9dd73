"""Delimited and Parquet tables with declared schemas and an explicit source order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitwright.operators.checks import SchemaError


def with_source_order(df: DataFrame) -> DataFrame:
    """Add ``src_row``, a sortable struct that follows file, block and position.

    It needs no global numbering and sorts like the files do.
    """
    return df.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("src_row"),
    )


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str,
    sep: str = ",",
    columns: Sequence[str] | None = None,
    source_order: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Read CSV (or TSV with ``sep='\t'``) with a header; columns are found by name.

    ``schema`` declares the wanted columns, in any order; the files may have more. Header names count
    without outer blanks, a missing one is an error. ``columns`` prunes in the scan. With
    ``multi_line``, quoted line breaks belong to their value, and a file is read by one task.
    """
    plain = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wanted = list(columns) if columns is not None else plain.names
    parts = []
    for one in [path] if isinstance(path, str) else list(path):
        header = check_header(spark, one, wanted, sep)
        place = {name: i for i, name in reversed(list(enumerate(header)))}
        kinds = {i: plain[name].dataType for name, i in place.items() if name in plain.names}
        # the file's own layout; what is not wanted stays text and is never parsed
        layout = T.StructType([T.StructField(f"_{i}", kinds.get(i, T.StringType())) for i in range(len(header))])
        reader = spark.read.schema(layout).options(header=True, sep=sep, quote='"', escape='"', enforceSchema=True, multiLine=multi_line)
        df = reader.csv(one)
        df = with_source_order(df) if source_order else df
        parts.append(df.select(*[F.col(f"_{place[c]}").alias(c) for c in wanted], *(["src_row"] if source_order else [])))
    return reduce(DataFrame.unionByName, parts)


def read_delimited_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a delimited table as they stand in the file, outer blanks removed."""
    names = spark.read.options(header=True, sep=sep, quote='"', escape='"').csv(path).columns
    return [n.strip() for n in names]


def check_header(spark: SparkSession, path: str, expected: Sequence[str], sep: str = ",") -> list[str]:
    """The header, which must hold all expected names."""
    found = read_delimited_header(spark, path, sep)
    missing = [c for c in expected if c not in found]
    if missing:
        raise SchemaError(f"{path} is missing columns {missing}; saw {found}")
    return found


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.mode("overwrite").options(header=True, sep=sep, quote='"', escape='"').csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path
