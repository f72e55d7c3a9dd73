"""Leakage filters and novelty slices: remove or mark rows by protected names and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwright.functions.names import name_key, spread_key, with_computed
from splitwright.operators.checks import find_column, require_columns
from splitwright.operators.dedupe import distinct_keys, keep_last
from splitwright.session import lookup_side

# Accepted name columns of a measurement table, in this order.
MEASUREMENT_NAME_COLUMNS = ("pert_iname", "drug_name", "pert_id", "compound_name")


def protected_sets(test_ids: DataFrame, registry: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Distinct non-empty names and group keys of the protected items.

    Ids without a registry row protect nothing; :func:`unresolved_ids` counts them.
    """
    require_columns(registry, [id_col, "name", "group_key"], "registry")
    rows = registry.join(test_ids.select(id_col).distinct(), id_col, "left_semi")
    return distinct_keys(rows, name_key(F.col("name"))), distinct_keys(rows, F.col("group_key"))


def unresolved_ids(test_ids: DataFrame, registry: DataFrame, id_col: str = "id") -> DataFrame:
    missing = test_ids.select(id_col).join(registry.select(id_col), id_col, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("n_unresolved"))


def _mark(rows: DataFrame, key: Column, salt: Column, keys: DataFrame, out_col: str) -> DataFrame:
    """Boolean column: is ``key`` among ``keys``? Null and empty keys never are."""
    probe = spread_key(F.nullif(key, F.lit("")), salt)
    marks = lookup_side(keys.select(F.col("key").alias("_k"), F.lit(True).alias("_m")))
    joined = with_computed(rows, "_k", probe).join(marks, "_k", "left")
    return joined.select(*[F.col(c) for c in rows.columns], F.coalesce("_m", F.lit(False)).alias(out_col))


def mark_upstream_names(
    upstream: DataFrame, protected_names: DataFrame, protected_keys: DataFrame
) -> DataFrame:
    """Distinct upstream names with ``by_name`` and ``by_key`` marks.

    ``upstream`` holds ``src_row, name, group_key``; a repeated name takes its last key. Names are
    compared trimmed and in lower case.
    """
    require_columns(upstream, ["src_row", "name", "group_key"], "upstream")
    named = upstream.where(F.col("name").isNotNull()).select("src_row", "name", "group_key")
    names = keep_last(named, "name").select("name", "group_key")
    marked = _mark(names, name_key(F.col("name")), F.col("name"), protected_names, "by_name")
    return _mark(marked, F.col("group_key"), F.col("name"), protected_keys, "by_key")


def surviving_names(marked: DataFrame) -> DataFrame:
    """Upstream names that no rule excludes."""
    return marked.where(~F.col("by_name") & ~F.col("by_key")).select("name")


def exclusion_counts(marked: DataFrame, protected_keys: DataFrame) -> DataFrame:
    """The eight counts of a name-level filter as one row."""
    keys = protected_keys.select(F.lit(True).alias("is_key"), F.lit(False).alias("by_name"), F.lit(False).alias("by_key"))
    both = marked.select(F.lit(False).alias("is_key"), "by_name", "by_key").unionByName(keys)
    by_key, by_name, upstream = F.col("by_key"), F.col("by_name"), ~F.col("is_key")
    return both.agg(
        F.count_if(upstream).alias("total"),
        F.count_if(by_key).alias("excluded_by_key"),
        F.count_if(by_name).alias("excluded_by_name"),
        F.count_if(by_key & by_name).alias("excluded_intersection"),
        F.count_if(upstream & ~by_key & ~by_name).alias("train_after_exclusion"),
        F.count_if(by_key).alias("key_match_count"),
        F.count_if(by_name).alias("name_match_count"),
        F.count_if(~upstream).alias("protected_key_count"),
    )


def mark_measurements(
    rows: DataFrame,
    index: DataFrame,
    protected_names: DataFrame,
    protected_keys: DataFrame,
    id_col: str,
    name_col: str | None = None,
) -> DataFrame:
    """Row form of the filter: every measurement row with ``by_name, by_key, resolved``.

    Names are compared in lower case *without* trimming. All rules are evaluated once per distinct
    name; ``index`` maps ``name_key`` to ``structure, group_key``. Unresolved names are only excluded
    by name.
    """
    require_columns(index, ["name_key", "structure", "group_key"], "index")
    name_col = name_col or find_column(rows, MEASUREMENT_NAME_COLUMNS, "name column")
    lowered = F.lower(F.col(name_col))
    names = rows.select(lowered.alias("name_key")).where(F.col("name_key").isNotNull()).distinct()
    known = names.join(index.select("name_key", "structure", "group_key"), "name_key", "left")
    marked = _mark(known, F.col("name_key"), F.col("name_key"), protected_names, "by_name")
    marked = _mark(marked, F.col("group_key"), F.col("name_key"), protected_keys, "by_key")
    verdict = marked.select(
        F.col("name_key").alias("_k"), "by_name", "by_key", F.col("structure").isNotNull().alias("resolved")
    )
    joined = rows.withColumn("_k", spread_key(lowered, F.col(id_col))).join(lookup_side(verdict), "_k", "left")
    never = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return joined.select(*[F.col(c) for c in rows.columns], never("by_name"), never("by_key"), never("resolved"))


def filter_measurements(
    rows: DataFrame, index: DataFrame, protected_names: DataFrame, protected_keys: DataFrame, id_col: str
) -> tuple[DataFrame, DataFrame | None]:
    """Safe rows and the breakdown of the filter.

    A table without a known name column passes through unchanged and has no breakdown.
    """
    if not set(MEASUREMENT_NAME_COLUMNS) & {c.strip() for c in rows.columns}:
        return rows, None
    marked = mark_measurements(rows, index, protected_names, protected_keys, id_col)
    return safe_rows(marked), filter_breakdown(marked)


def safe_rows(marked: DataFrame) -> DataFrame:
    return marked.where(~F.col("by_name") & ~F.col("by_key")).drop("by_name", "by_key", "resolved")


def filter_breakdown(marked: DataFrame) -> DataFrame:
    """Rows in and out, and what each rule dropped, as one row."""
    a, b = F.col("by_name"), F.col("by_key")
    return marked.agg(
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(~a & ~b).alias("n_out"),
        F.count_if(a | b).alias("n_dropped_total"),
        F.count_if(a & ~b).alias("n_name_only"),
        F.count_if(b & ~a).alias("n_key_only"),
        F.count_if(a & b).alias("n_both"),
        F.count_if(~F.col("resolved")).alias("n_unresolved"),
    )


def novelty_slices(
    test_items: DataFrame, upstream_names: DataFrame, train_keys: DataFrame, id_col: str = "id"
) -> DataFrame:
    """Test items with ``in_upstream_now, name_novel, name_and_key_novel``.

    Here a missing key is one ordinary value (""): such an item is key-novel only when no training
    item lacks a key. ``upstream_names`` has a ``name`` column, ``train_keys`` a ``group_key`` column.
    """
    require_columns(test_items, [id_col, "name", "group_key"], "test items")
    names = distinct_keys(upstream_names, name_key(F.col("name")))
    marked = _mark(test_items, name_key(F.col("name")), F.col(id_col), names, "in_upstream_now")
    # a visible stand-in for the empty key keeps it an ordinary join value
    ordinary = F.concat(F.lit("="), F.coalesce("group_key", F.lit("")))
    keys = train_keys.select(ordinary.alias("key")).distinct()
    marked = _mark(marked, ordinary, F.col(id_col), keys, "_known_key")
    return marked.select(
        *test_items.columns,
        "in_upstream_now",
        (~F.col("in_upstream_now")).alias("name_novel"),
        (~F.col("in_upstream_now") & ~F.col("_known_key")).alias("name_and_key_novel"),
    )


def slice_counts(slices: DataFrame) -> DataFrame:
    return slices.agg(
        F.count_if("in_upstream_now").alias("test_in_upstream"),
        F.count_if("name_novel").alias("test_name_novel"),
        F.count_if("name_and_key_novel").alias("test_name_and_key_novel"),
    )


def membership_drift(slices: DataFrame, stored_flag: str) -> DataFrame:
    """Rows whose stored membership differs from the recomputed one."""
    return slices.agg(F.count_if(F.col(stored_flag) != F.col("in_upstream_now")).alias("n_drift"))
