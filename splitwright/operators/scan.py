"""Running sums and ranks over ordered groups of any size.

A ranking window sends a whole group to one task, which one list with a third of the table would fill.
So rows are range-partitioned by group and order, and only sums of whole ranges cross range borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitwright.session import checkpointed


def running_sums(
    df: DataFrame, by: Sequence[str], order_by: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Add inclusive running sums per group in the given order, which must be total.

    Rows are range-partitioned by group and order, summed inside each range, and shifted by the sums of
    the earlier ranges of the same group, so no task holds more than one range.
    """
    by = list(by)
    terms = df.select("*", *[e.alias(f"_t_{k}") for k, e in sums.items()])
    ranges = terms.repartitionByRange(*[F.col(c) for c in by], *order_by)
    ranges = checkpointed(ranges.withColumn("_range", F.spark_partition_id()))
    totals = ranges.groupBy(*by, "_range").agg(*[F.sum(f"_t_{k}").alias(f"_s_{k}") for k in sums])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range", *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums]
    )
    inside = (
        Window.partitionBy(*by, "_range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = ranges.select(*df.columns, "_range", *[F.sum(f"_t_{k}").over(inside).alias(f"_l_{k}") for k in sums])
    joined = local.join(offsets, [*by, "_range"])
    return joined.select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums])


def dense_row_number(df: DataFrame, order_by: Sequence[str], out_col: str = "row_idx") -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order without gathering them in one task.

    Rows are range-partitioned by the order; each range counts its rows, and the start of a range is
    the sum of the earlier counts (one number per range).
    """
    order = [F.col(c) for c in order_by]
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = checkpointed(ranges.withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order)
    numbered = ranges.withColumn("_local", F.row_number().over(inside))
    return numbered.join(starts, "_range").select(
        *df.columns, (F.col("_start") + F.col("_local") - 1).alias(out_col)
    )
