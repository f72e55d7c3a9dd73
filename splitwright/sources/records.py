"""Nested record source: XML documents with names, aliases and computed properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwright.functions.names import trimmed

# Layout of a source record.
RECORD_TAG = "drug"
RECORD_SCHEMA = (
    "name STRING, "
    "synonyms STRUCT<synonym: ARRAY<STRING>>, "
    "`international-brands` STRUCT<`international-brand`: ARRAY<STRUCT<name: STRING>>>, "
    "`calculated-properties` STRUCT<property: ARRAY<STRUCT<kind: STRING, value: STRING>>>"
)
STRUCTURE_KIND = "SMILES"


def read_records(spark: SparkSession, path: str, row_tag: str = RECORD_TAG) -> DataFrame:
    """``src_row, name, structure, aliases`` of every outermost record.

    Records nested inside others are not rows. The structure is the value of the first property of
    kind :data:`STRUCTURE_KIND`.
    """
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(RECORD_SCHEMA).load(path)
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    properties = F.col("`calculated-properties`.property")
    of_kind = F.filter(properties, lambda p: trimmed(p["kind"]) == STRUCTURE_KIND)
    brands = F.transform(F.col("`international-brands`.`international-brand`"), lambda b: b["name"])
    none = F.array().cast("array<string>")
    aliases = F.concat(F.coalesce(F.col("synonyms.synonym"), none), F.coalesce(brands, none))
    return raw.select(
        order.alias("src_row"),
        trimmed(F.col("name")).alias("name"),
        trimmed(F.get(of_kind, F.lit(0))["value"]).alias("structure"),
        F.filter(F.transform(aliases, trimmed), lambda a: a.isNotNull() & (a != "")).alias("aliases"),
    )
