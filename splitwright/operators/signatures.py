"""Operations on signature vectors (one vector per item and cell)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwright.functions.vectors import top_positions, vector_difference
from splitwright.operators.gates import at_least
from splitwright.operators.profiles import dimension_correlation, position_values
from splitwright.session import lookup_side


def differential(treated: DataFrame, baseline: DataFrame, by: str = "cell") -> DataFrame:
    """Treated minus baseline vector; ``baseline`` has one ``vector`` per cell."""
    base = lookup_side(baseline.select(by, F.col("vector").alias("_base")))
    return treated.join(base, by).select(
        *[c for c in treated.columns if c != "vector"], vector_difference(F.col("vector"), F.col("_base")).alias("vector")
    )


def top_dimensions(signatures: DataFrame, k: int, vector_col: str = "vector") -> DataFrame:
    """Positions of the ``k`` largest absolute values of every vector, largest first."""
    size = F.transform(vector_col, lambda x: F.abs(x))
    return signatures.select(*[c for c in signatures.columns if c != vector_col], top_positions(size, k).alias("top"))


def replicate_mean(profiles: DataFrame, by: Sequence[str], vector_col: str = "vector") -> DataFrame:
    """Mean vector over the replicates of a key; positions are averaged before the shuffle."""
    long = profiles.select(*by, position_values(F.col(vector_col)))
    means = long.groupBy(*by, "pos").agg(F.avg(F.col("value").cast("double")).alias("m"))
    packed = means.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_v"))
    return packed.select(*by, F.transform("_v", lambda s: s["m"]).alias(vector_col))


def measured_grid(wanted: DataFrame, means: DataFrame, by: Sequence[str]) -> DataFrame:
    """All wanted keys with their mean vector, null where nothing was measured."""
    return wanted.join(means, list(by), "left")


def agreement_per_cell(pairs: DataFrame, by: str = "cell") -> DataFrame:
    """Mean per-dimension correlation of two aligned vectors ``a, b`` per cell."""
    r = dimension_correlation(pairs, by=(by,)).where(~F.isnan("r"))
    return r.groupBy(by).agg(F.avg("r").alias("mean_r"), F.count(F.lit(1)).alias("n_dims"))


def agreement_gate(per_cell: DataFrame, threshold: float = 0.3) -> DataFrame:
    value = per_cell.agg(F.avg("mean_r").alias("value"))
    return at_least(value, "signature_agreement", threshold)


def confounded_dimensions(vectors: DataFrame, outcome_col: str, share: float = 0.10) -> DataFrame:
    """The ``share`` of positions whose values correlate most (absolutely) with an outcome."""
    pairs = vectors.select("vector", F.transform("vector", lambda _: F.col(outcome_col).cast("double")).alias("outcome"))
    r = dimension_correlation(pairs, "vector", "outcome").where(~F.isnan("r"))
    ranked = r.select("pos", "r", F.abs("r").alias("strength"))
    k = int(ranked.count() * share)  # one row per vector position
    return ranked.orderBy(F.desc("strength"), "pos").limit(k)


def mask_dimensions(vectors: DataFrame, masked: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Vectors with the masked positions set to 0.0, and ``masked_mean`` over the masked positions.

    The mask is bounded by the vector width and becomes a constant of the plan.
    """
    positions = F.array(*[F.lit(int(r["pos"])) for r in masked.select("pos").collect()]).cast("array<int>")
    hidden = lambda i: F.array_contains(positions, i)
    kept = F.transform(vector_col, lambda x, i: F.when(hidden(i), F.lit(0.0)).otherwise(x.cast("double")))
    inside = F.filter(vector_col, lambda _, i: hidden(i))
    total = F.aggregate(inside, F.lit(0.0), lambda acc, x: acc + x)
    return vectors.select(
        *[c for c in vectors.columns if c != vector_col],
        kept.alias(vector_col),
        F.try_divide(total, F.size(inside)).alias("masked_mean"),
    )


def top_attributions(attributions: DataFrame, k: int = 200, vector_col: str = "vector") -> DataFrame:
    """Positions by mean absolute attribution, the ``k`` strongest."""
    long = attributions.select(position_values(F.col(vector_col)))
    means = long.groupBy("pos").agg(F.avg(F.abs(F.col("value").cast("double"))).alias("mean_abs"))
    return means.orderBy(F.desc("mean_abs"), "pos").limit(k)
