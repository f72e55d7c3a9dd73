"""The labelled registry: one row per entity out of several lists, in a fixed column order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwright.functions.numbers import to_number
from splitwright.operators.checks import find_column, require_columns, require_order
from splitwright.operators.dedupe import keep_first
from splitwright.operators.resolve import keyed_lookup, probe_names

REGISTRY_COLUMNS = [
    "id", "name", "structure", "canonical", "group_key", "label", "severity", "in_measured", "in_upstream",
]


def is_binary(label: Column) -> Column:
    return F.coalesce(to_number(label).isin(0.0, 1.0), F.lit(False))


def keep_binary_labels(items: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows whose label reads as 0 or 1, with the label as an integer."""
    return items.where(is_binary(F.col(f"`{label_col}`"))).withColumn(
        label_col, to_number(F.col(f"`{label_col}`")).cast("int")
    )


def label_drop_count(items: DataFrame, label_col: str = "label") -> DataFrame:
    ok = is_binary(F.col(f"`{label_col}`"))
    return items.agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_dropped")
    )


def join_resolved(items: DataFrame, resolved: DataFrame, id_col: str = "id") -> DataFrame:
    """Items that were resolved, with their structure columns."""
    return items.join(resolved.select(id_col, "structure", "canonical", "group_key"), id_col, "inner")


def join_drop_count(items: DataFrame, resolved: DataFrame, id_col: str = "id") -> DataFrame:
    """How many items have a resolved structure, as one row."""
    known = resolved.select(id_col, F.lit(True).alias("_r")).distinct()
    joined = items.select(id_col).join(known, id_col, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_in"), F.count("_r").alias("n_joined"), F.count_if(F.col("_r").isNull()).alias("n_dropped")
    )


def build_registry(
    labels: DataFrame,
    severities: DataFrame,
    resolved: DataFrame,
    measured_names: DataFrame,
    upstream_names: DataFrame,
    severity_col: str = "severity",
) -> DataFrame:
    """Registry in :data:`REGISTRY_COLUMNS` order.

    ``labels`` holds ``src_row, id, name, label``; ``severities`` ``src_row, name, severity``;
    ``resolved`` ``id, structure, canonical, group_key``; the member lists a ``name`` column. Rows
    with other labels, unresolved rows and repeated ids are dropped, in that order. Severities and member lists are probed through one table of names.
    """
    require_columns(labels, ["src_row", "id", "name"], "labels")
    require_columns(resolved, ["id", "structure", "canonical", "group_key"], "resolved")
    label_col = find_column(labels, ["label"], "label column")
    labelled = keep_binary_labels(labels.withColumnRenamed(label_col, "label"))
    joined = join_resolved(labelled, resolved)
    lists = {"in_measured": measured_names, "in_upstream": upstream_names}
    flagged = probe_names(joined, keyed_lookup(severities, severity_col, lists), "severity", list(lists))
    unique = keep_first(flagged.select("src_row", *REGISTRY_COLUMNS), "id")
    return require_order(unique.select(*REGISTRY_COLUMNS), REGISTRY_COLUMNS)
