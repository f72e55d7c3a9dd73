"""Schema checks, tolerant column lookup and value checks."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitwright.functions.names import trimmed

# Accepted names per field of a profile set; the first present one is taken.
PROFILE_FIELD_ALIASES = {
    "compound_name": ("compound_names", "compound_name", "drug_name", "drug_names"),
    "label": ("dili_binary", "DILI", "dili", "label", "labels", "y"),
    "expressions": ("expressions", "expression", "gene_expression", "X", "features"),
    "split_flags": ("split_flags", "splits", "split"),
    "profile_id": ("inst_ids", "inst_id", "profile_ids", "profile_id", "sig_ids"),
}
# Accepted headers of a severity column, compared without case.
SEVERITY_COLUMN_NAMES = ("dili severity", "dili-severity", "severity", "dili concern", "dili-concern")
# Widths of a profile row and layout of its numbered columns.
EXPRESSION_WIDTH = 978
SPLIT_FLAG_WIDTH = 50
EXPRESSION_COLUMN = r"^(?:expression_|gene_)?(\d+)$"
SPLIT_FLAG_COLUMN = r"^split_(\d+)$"


class SchemaError(ValueError):
    """A required column is missing or a declared property does not hold."""


def require_columns(df: DataFrame, required: Iterable[str], what: str = "input") -> DataFrame:
    """Plan-time check; the message names what is missing and what was seen."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise SchemaError(f"{what} is missing columns {missing}; saw {df.columns}")
    return df


def find_column(df: DataFrame, candidates: Sequence[str], what: str = "column", ignore_case: bool = False) -> str:
    """First candidate among the column names; exact names win over names with outer blanks."""
    fold = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    exact = {fold(c): c for c in reversed(df.columns)}
    blank = {fold(c.strip()): c for c in reversed(df.columns)}
    for names in (exact, blank):
        for candidate in candidates:
            if fold(candidate) in names:
                return names[fold(candidate)]
    raise SchemaError(f"no {what} among {df.columns}; searched {list(candidates)}")


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def resolve_columns(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]],
    optional: Iterable[str] = (),
    ignore_case: bool = False,
) -> DataFrame:
    """Select and rename the columns that stand for the wanted fields, first alias wins."""
    chosen = []
    for field, names in aliases.items():
        try:
            chosen.append(F.col(f"`{find_column(df, names, field, ignore_case)}`").alias(field))
        except SchemaError:
            if field not in set(optional):
                raise
    return df.select(*chosen)


def numbered_columns(columns: Sequence[str], pattern: str, width: int, order: str = "numeric") -> list[str]:
    """Columns that match ``pattern``, in numeric (or textual) order of their number."""
    found = [(int(m.group(1)), c) for c in columns if (m := re.match(pattern, c))]
    if len(found) != width:
        raise SchemaError(f"expected {width} columns matching {pattern}, found {len(found)}")
    return [c for _, c in sorted(found)] if order == "numeric" else sorted(c for _, c in found)


def numbered_array(
    df: DataFrame, pattern: str, width: int, element: str, order: str = "numeric"
) -> Column:
    """One array column out of many numbered columns."""
    cols = numbered_columns(df.columns, pattern, width, order)
    return F.array(*[F.col(f"`{c}`").cast(element) for c in cols])


#: Layouts of a profile set, the preferred first.
PROFILE_LAYOUTS = ("record", "table", "nested")


def _nested_columns(df: DataFrame) -> list[str]:
    """Columns whose values are records or lists of records."""
    inner = {f.name: f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType for f in df.schema.fields}
    return [name for name, kind in inner.items() if isinstance(kind, T.StructType)]


def _unnested(df: DataFrame, column: str) -> DataFrame:
    """The records in a column as rows."""
    name = f"`{column}`"
    is_list = isinstance(df.schema[column].dataType, T.ArrayType)
    records = df.select(F.explode(name).alias("_record")) if is_list else df.select(F.col(name).alias("_record"))
    return records.where(F.col("_record").isNotNull()).select("_record.*")


def _layout_columns(df: DataFrame, layout: str, expression_width: int, flag_width: int) -> tuple[dict[str, Column], list[str]]:
    """Columns by field, and what the layout needs and the schema lacks."""
    names = dict(PROFILE_FIELD_ALIASES)
    arrays = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    if layout == "table":
        names.pop("expressions"), names.pop("split_flags")
    picked, missing = {}, []
    for field, candidates in names.items():
        try:
            found = find_column(df, candidates, field, ignore_case=layout == "table")
        except SchemaError:
            if field == "split_flags" and layout == "nested" or field not in ("profile_id", "split_flags"):
                missing.append(f"{field} (one of {list(candidates)})")
            continue
        if field in ("expressions", "split_flags") and found not in arrays:
            missing.append(f"{field} as an array")
        picked[field] = F.col(f"`{found}`")
    numbered = {"split_flags": (SPLIT_FLAG_COLUMN, flag_width, "boolean", "textual" if layout == "record" else "numeric")}
    if layout == "table":
        numbered["expressions"] = (EXPRESSION_COLUMN, expression_width, "float", "numeric")
    for field, (pattern, width, kind, order) in numbered.items():
        if field not in picked and layout != "nested":
            try:
                picked[field] = numbered_array(df, pattern, width, kind, order)
            except SchemaError as error:
                missing.append(f"{field}: {error}")
    return picked, missing


def ranked_layouts(
    df: DataFrame, expression_width: int = EXPRESSION_WIDTH, flag_width: int = SPLIT_FLAG_WIDTH
) -> list[tuple[str, str | None, list[str]]]:
    """``(layout, column, lacking)`` of every way to read the schema, the one that lacks least first.

    ``column`` is the column that holds the records of a ``nested`` layout. Of equal ones the order of
    ``PROFILE_LAYOUTS``, then that of the columns decides.
    """
    ways = [("record", None), ("table", None), *(("nested", c) for c in _nested_columns(df))]
    ranked = []
    for layout, column in ways:
        rows = df if column is None else _unnested(df, column)
        ranked.append((layout, column, _layout_columns(rows, layout, expression_width, flag_width)[1]))
    return sorted(ranked, key=lambda way: len(way[2]))


def profile_set(
    df: DataFrame,
    layout: str | None = None,
    expression_width: int = EXPRESSION_WIDTH,
    flag_width: int = SPLIT_FLAG_WIDTH,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Bring one of the accepted layouts to ``compound_name, label, expressions, split_flags[, profile_id]``.

    ``record`` layouts hold arrays under case-sensitive field names (or ``split_NN`` columns, taken
    in textual order); ``table`` layouts spread the vectors over numbered columns and are matched
    without case; ``nested`` layouts hold records, or lists of them, in one column. Without ``layout`` the schema decides: the first way to
    read it that lacks nothing (:func:`ranked_layouts`); if there is none, the error names what each lacks.
    ``keep`` names further columns of the rows that stay as they are, such as their place in the source.
    Values are checked lazily; see :func:`profile_violations`.
    """
    if layout is None or layout == "nested":
        ways = [w for w in ranked_layouts(df, expression_width, flag_width) if layout in (None, w[0])]
        if not ways or ways[0][2]:
            lacks = "; ".join(f"{name}{f' in {c}' if c else ''} lacks {', '.join(m)}" for name, c, m in ways)
            raise SchemaError(f"no layout of a profile set fits {df.columns}: {lacks or 'no column holds records'}")
        layout, column, _ = ways[0]
        df = df if column is None else _unnested(df, column)
    picked, missing = _layout_columns(df, layout, expression_width, flag_width)
    if missing:
        raise SchemaError(f"the {layout} layout of a profile set lacks {', '.join(missing)}; saw {df.columns}")
    out = [
        picked["compound_name"].cast("string").alias("compound_name"),
        picked["label"].cast("double").alias("label"),
        picked["expressions"].cast("array<float>").alias("expressions"),
        picked["split_flags"].cast("array<boolean>").alias("split_flags"),
    ]
    if "profile_id" in picked:
        out.append(picked["profile_id"].cast("string").alias("profile_id"))
    return df.select(*out, *(F.col(f"`{c}`") for c in keep))


def profile_violations(
    profiles: DataFrame, expression_width: int = EXPRESSION_WIDTH, flag_width: int = SPLIT_FLAG_WIDTH
) -> DataFrame:
    """One row that counts the rows breaking each declared property.

    Labels must be exactly 0 or 1: a fraction is a violation and is not truncated first.
    """
    bad_label = F.col("label").isNull() | ~F.col("label").isin(0.0, 1.0)
    return profiles.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad_label).alias("bad_label"),
        F.count_if(F.size("expressions") != expression_width).alias("bad_expression_width"),
        F.count_if(F.size("split_flags") != flag_width).alias("bad_flag_width"),
    )


def raise_on_violations(report: DataFrame, what: str = "input") -> None:
    """Raise when a one-row violation report has a positive count in a ``bad_*`` column."""
    row = report.first().asDict()
    bad = {k: v for k, v in row.items() if k.startswith("bad_") and v}
    if bad:
        raise SchemaError(f"{what} violates its contract: {bad}")


def _sortable(value):
    """A key that orders like the session does: nulls first, records field by field."""
    if isinstance(value, dict):
        return tuple(_sortable(v) for v in value.values())
    return (value is not None, value) if value is not None else (False,)


def first_values(df: DataFrame, columns: Sequence[str], order_by: str, k: int) -> DataFrame:
    """``column, v, _o``: candidates for the first ``k`` non-null trimmed values of each column, ``k`` from each task.

    A task keeps the ``k`` smallest by order of each column and nothing else; nothing is sorted as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in columns]
        for batch in batches:
            order = batch["_o"].to_pylist()
            keys = list(map(_sortable, order))
            for c in range(len(columns)):
                values = batch[f"c{c}"]
                rows = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
                bound = kept[c][-1][0] if len(kept[c]) == k else None
                rows = [i for i in rows if bound is None or keys[i] < bound]
                rows = heapq.nsmallest(k, rows, key=lambda i: keys[i])
                kept[c] = heapq.nsmallest(k, [*kept[c], *((keys[i], order[i], values[i].as_py()) for i in rows)], key=lambda x: x[0])
        found = [(c, v, o) for c, rows in enumerate(kept) for _, o, v in rows]
        if found:
            column, v, o = zip(*found)
            yield pa.record_batch([pa.array(column, pa.int32()), pa.array(v, pa.string()), pa.array(o, batch["_o"].type)], ["column", "v", "_o"])

    texts = [trimmed(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.select(F.col(order_by).alias("_o"), *texts)
    schema = T.StructType([T.StructField("column", T.IntegerType()), T.StructField("v", T.StringType()), rows.schema["_o"]])
    return rows.mapInArrow(run, schema)


def sniff_column(df: DataFrame, pattern: str, sample: int = 20, order_by: str | None = None) -> str:
    """First string column whose first ``sample`` non-null trimmed values all match ``pattern``.

    "First" follows ``order_by``, by default the ``src_row`` column if there is one. All columns are
    looked at in one pass, of which every task keeps ``sample`` values a column.
    """
    order_by = order_by or ("src_row" if "src_row" in df.columns else None)
    if order_by is None:
        df, order_by = df.withColumn("_place", F.monotonically_increasing_id()), "_place"
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != order_by]
    if names:
        place = F.row_number().over(Window.partitionBy("column").orderBy("_o"))  # over sample rows of each task
        first = first_values(df, names, order_by, sample).withColumn("place", place).where(F.col("place") <= sample)
        counts = first.groupBy("column").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("v").rlike(pattern)).alias("matched"))
        found = sorted(r["column"] for r in counts.collect() if r["seen"] == r["matched"])
        if found:
            return names[found[0]]
    raise SchemaError(f"no column of {df.columns} matches {pattern}")


def load_profile_ids(df: DataFrame, pattern: str, expected_rows: int | None = 6000) -> DataFrame:
    """Trimmed ids of the sniffed column; a wrong row count is an error."""
    column = sniff_column(df, pattern)
    ids = df.select(*[c for c in df.columns if c == "src_row"], trimmed(F.col(f"`{column}`")).alias("profile_id"))
    if expected_rows is not None and (found := ids.count()) != expected_rows:
        raise SchemaError(f"expected {expected_rows} ids in column {column}, found {found}")
    return ids


def invariant_report(
    df: DataFrame,
    key: str,
    not_null: Sequence[str] = (),
    binary: Sequence[str] = (),
    expected_rows: int | None = None,
) -> DataFrame:
    """Row count, duplicate keys, nulls and non-binary values as one row.

    Rows are pre-aggregated per key, so the only shuffle carries one row per distinct key and task.
    """
    null_counts = [F.count_if(F.col(c).isNull()).alias(f"bad_null_{c}") for c in not_null]
    value_counts = [
        F.count_if(F.col(c).isNull() | ~F.col(c).isin(0, 1)).alias(f"bad_binary_{c}") for c in binary
    ]
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *null_counts, *value_counts)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per_key.columns if c.startswith("bad_")]
    rows = F.coalesce(F.sum("n"), F.lit(0))
    report = per_key.agg(
        rows.alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("bad_duplicate_keys"), *sums
    )
    if expected_rows is not None:
        report = report.withColumn("bad_row_count", F.abs(F.col("n_rows") - expected_rows))
    return report


def require_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns must be exactly these, in this order."""
    if df.columns != list(columns):
        raise SchemaError(f"expected columns {list(columns)}, saw {df.columns}")
    return df


def column_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``column, present, n_values`` of the required columns: the check of :func:`require_columns` as a table.

    ``n_values`` counts the values of a present column that are not null, over the whole table in one aggregate.
    """
    count = lambda c: F.count(F.col(f"`{c}`")) if c in df.columns else F.lit(0).cast("long")
    counts = df.agg(*[count(c).alias(f"n{k}") for k, c in enumerate(required)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), F.col(f"n{k}").alias("n_values")) for k, c in enumerate(required)]
    return counts.select(F.inline(F.array(*rows)))


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``bad_<column>``: how many values are null (or an empty text)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    empty = lambda c: (F.col(c) == "") if isinstance(kinds[c], T.StringType) else F.lit(False)
    return df.agg(*[F.count_if(F.col(c).isNull() | empty(c)).alias(f"bad_{c}") for c in columns])


def reject_nulls(df: DataFrame, columns: Sequence[str], what: str = "input") -> DataFrame:
    """Raise when one of the columns holds a null (or an empty text)."""
    raise_on_violations(null_report(df, columns), what)
    return df
