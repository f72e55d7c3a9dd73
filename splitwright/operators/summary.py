"""Counts and distributions for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwright.session import stored


# Expected size, tolerance and ratio band of a profile table.
EXPECTED_ROWS, SIZE_TOLERANCE = 6000, 0.05
RATIO_BAND = (1.25, 1.69)


def registry_summary(registry: DataFrame, total: int) -> DataFrame:
    """Size, class balance, resolution rate and coverage as one row; 0.0 for empty denominators."""
    n = F.count(F.lit(1))
    share = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))
    positive, severe = F.count_if(F.col("label") == 1), F.count("severity")
    measured, upstream = F.count_if("in_measured"), F.count_if("in_upstream")
    rate = F.coalesce(F.try_divide(n, F.lit(total)), F.lit(0.0))
    return registry.agg(
        n.alias("n_registry"),
        F.lit(total).cast("long").alias("n_listed"),
        positive.alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
        share(positive).alias("pos_frac"),
        rate.alias("resolution_rate"),
        severe.alias("severity_count"),
        share(severe).alias("severity_frac"),
        measured.alias("measured_count"),
        share(measured).alias("measured_frac"),
        upstream.alias("upstream_count"),
        share(upstream).alias("upstream_frac"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n, pct`` by descending count, then value.

    The counts are written once; their total and the result read them from there, so the source is
    scanned a single time.
    """
    counts = stored(df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = F.lit(100.0) * F.col("n") / F.lit(float(max(total, 1)))
    return counts.select("value", "n", share.alias("pct")).orderBy(F.desc("n"), "value")


def group_with_first(df: DataFrame, key: str, value: str, order_by: str = "src_row") -> DataFrame:
    """Per key the first non-null value in source order and the size, by descending size."""
    first = F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order_by)))
    return df.groupBy(key).agg(first.alias(value), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def class_drift(
    rows: DataFrame, expected: int = EXPECTED_ROWS, tolerance: float = SIZE_TOLERANCE, band: tuple[float, float] = RATIO_BAND
) -> DataFrame:
    """Positive/negative ratio, and whether size and ratio stay within their bands."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
    ).withColumn("pn_ratio", F.col("n_pos") / F.greatest("n_neg", F.lit(1)))
    near = F.abs(F.col("n") - expected) / F.lit(float(expected)) < tolerance
    return counts.withColumn("within", near & F.col("pn_ratio").between(*band))


def tidy_metrics(one_row: DataFrame, section: str) -> DataFrame:
    """Turn a one-row table into ``section, metric, value`` rows."""
    kinds = {f.name: f.dataType.simpleString() for f in one_row.schema.fields}
    usable = [c for c in one_row.columns if kinds[c] != "string"]
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in usable]
    return one_row.select(F.lit(section).alias("section"), F.inline(F.array(*pairs)))


def tidy_table(rows: DataFrame, section: str, label_col: str) -> DataFrame:
    """Turn a small table into ``section, metric, value`` rows named ``<column>_<label>``."""
    numbers = [f.name for f in rows.schema.fields if f.name != label_col and f.dataType.simpleString() != "string"]
    label = F.col(label_col).cast("string")
    pairs = [
        F.struct(F.concat(F.lit(f"{c}_"), label).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers
    ]
    return rows.select(F.lit(section).alias("section"), F.inline(F.array(*pairs)))


def diagnostics(sections: dict[str, DataFrame]) -> DataFrame:
    """All counts of a run as one tidy table."""
    parts = [tidy_metrics(df, name) for name, df in sections.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
