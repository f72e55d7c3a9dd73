"""Classifier metrics per slice, seed aggregation, bootstrap intervals and severity trends."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splitwright.operators.scan import running_sums
from splitwright.session import lookup_side, spread_small

_POISSON_TERMS = 16
_DRAWS_PER_HASH = 4  # one MD5 holds four 32-bit draws
#: Resamples whose sums travel in one row, and the schema of these rows.
_CHUNK = 500
_PARTIAL = "chunk long, s array<double>, n array<long>"


def ranked_scores(
    rows: DataFrame, by: Sequence[str], score_col: str = "score", label_col: str = "label"
) -> DataFrame:
    """Distinct scores per slice with their class counts and running class counts from below."""
    counts = rows.groupBy(*by, F.col(score_col).alias("score")).agg(
        F.count_if(F.col(label_col) == 1).alias("pos"), F.count_if(F.col(label_col) == 0).alias("neg")
    )
    return running_sums(counts, by, [F.asc("score")], {"pos_to": F.col("pos"), "neg_to": F.col("neg")})


def classifier_metrics(
    rows: DataFrame,
    by: Sequence[str] = ("slice",),
    score_col: str = "score",
    label_col: str = "label",
    threshold: float = 0.5,
) -> DataFrame:
    """AUROC (ties count half), AUPRC (average precision), MCC and balanced accuracy per slice.

    Slices with a single class have no AUROC (null); an undefined MCC reads as 0.
    """
    by = list(by)
    ranked = ranked_scores(rows, by, score_col, label_col)
    totals = ranked.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    wide = ranked.join(lookup_side(totals), by)
    tp = F.col("P") - F.col("pos_to") + F.col("pos")
    fp = F.col("N") - F.col("neg_to") + F.col("neg")
    wins = F.col("pos") * (F.col("neg_to") - F.col("neg") + F.col("neg") / 2.0)
    hit = F.col("score") >= threshold
    per_slice = wide.groupBy(*by).agg(
        F.first("P").alias("P"),
        F.first("N").alias("N"),
        F.sum(wins).alias("wins"),
        F.sum(F.col("pos") * F.try_divide(tp, tp + fp)).alias("precision_sum"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).cast("double").alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).cast("double").alias("fp"),
    )
    fn, tn = F.col("P") - F.col("tp"), F.col("N") - F.col("fp")
    tp_, fp_ = F.col("tp"), F.col("fp")
    scale = F.sqrt((tp_ + fp_) * (tp_ + fn) * (tn + fp_) * (tn + fn))
    return per_slice.select(
        *by,
        (F.col("P") + F.col("N")).alias("n"),
        F.col("P").alias("n_pos"),
        F.try_divide("wins", F.col("P").cast("double") * F.col("N")).alias("auroc"),
        F.try_divide("precision_sum", F.col("P").cast("double")).alias("auprc"),
        F.coalesce(F.try_divide(tp_ * tn - fp_ * fn, scale), F.lit(0.0)).alias("mcc"),
        ((F.try_divide(tp_, F.col("P")) + F.try_divide(tn, F.col("N"))) / 2.0).alias("balanced_accuracy"),
    )


def seed_summary(runs: DataFrame, by: Sequence[str], value_col: str = "value", min_seeds: int = 3) -> DataFrame:
    """Mean and sample deviation over seeds, and whether there are enough of them."""
    return runs.groupBy(*by).agg(
        F.avg(value_col).alias("mean"),
        F.stddev_samp(value_col).alias("std"),
        F.count(F.lit(1)).alias("n_seeds"),
        (F.count(F.lit(1)) >= min_seeds).alias("enough"),
    )


def _poisson_weights(draws: np.ndarray) -> np.ndarray:
    """Poisson(1) draws by inversion of 32-bit numbers."""
    terms = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(_POISSON_TERMS)])
    return np.searchsorted(terms * 2.0**32, draws.astype(np.float64), "right")


def _resampled(rows: DataFrame, resamples: int, seed: int) -> DataFrame:
    """``chunk, s, n``: weighted sums and weights of all resamples over the rows of a task, in chunks of positions.

    A task keeps one sum and one weight per resample, whatever its number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [b"%d:%d" % (k, seed) for k in range(-(-resamples // _DRAWS_PER_HASH))]
        sums, weights, any_rows = np.zeros(resamples), np.zeros(resamples, np.int64), False
        for batch in batches:
            for name, value in zip(batch["id"].to_pylist(), batch["v"].to_pylist()):
                start = hashlib.md5(name.encode() + b":")
                digests = []
                for end in ends:
                    mark = start.copy()
                    mark.update(end)
                    digests.append(mark.digest())
                drawn = _poisson_weights(np.frombuffer(b"".join(digests), ">u4")[:resamples])
                weights += drawn
                if value is not None:
                    sums += drawn * value
                any_rows = True
        if any_rows:
            yield _chunks(range(-(-resamples // _CHUNK)), sums, weights)

    return rows.mapInArrow(run, _PARTIAL)


def _chunks(chunks: Iterable[int], sums: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    cut = lambda x: [x[k * _CHUNK : (k + 1) * _CHUNK] for k in chunks]
    return pa.record_batch([pa.array(list(chunks), pa.int64()), pa.array(cut(sums)), pa.array(cut(weights))], ["chunk", "s", "n"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the partial sums of each chunk as they come."""
    totals: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for chunk, s, n in zip(batch["chunk"].to_pylist(), batch["s"], batch["n"]):
            parts = [s.values.to_numpy(), n.values.to_numpy()]
            totals[chunk] = [a + b for a, b in zip(totals[chunk], parts)] if chunk in totals else parts
    if totals:
        columns = [pa.array(list(x)) for x in zip(*totals.values())]
        yield pa.record_batch([pa.array(list(totals), pa.int64()), *columns], ["chunk", "s", "n"])


def bootstrap_means(
    rows: DataFrame, id_col: str, value_col: str, resamples: int = 10_000, seed: int = 42
) -> DataFrame:
    """Mean of a paired difference in every bootstrap resample: ``resample, mean``.

    Each row draws its own Poisson(1) multiplicity per resample from a hash of its id, which
    approximates drawing with replacement and needs no shared state: a task adds all its rows to one array of
    sums, and the arrays of all tasks are added by position. Rows without an id are left out; a null value
    counts as zero. Resamples that draw no row are missing.
    """
    named = rows.select(F.col(id_col).cast("string").alias("id"), F.col(value_col).cast("double").alias("v"))
    partial = _resampled(spread_small(named.where(F.col("id").isNotNull())), resamples, seed)
    totals = partial.repartition("chunk").mapInArrow(_merged, _PARTIAL)
    sums = totals.select("chunk", F.posexplode(F.arrays_zip("s", "n")).alias("at", "sum"))
    resample = F.col("chunk") * _CHUNK + F.col("at")
    mean = F.col("sum.s") / F.when(F.col("sum.n") > 0, F.col("sum.n"))
    return sums.select(resample.alias("resample"), mean.alias("mean")).where(F.col("mean").isNotNull())


def bootstrap_interval(means: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Percentile interval over the resamples (their number is a parameter, not the data size)."""
    tail = (1.0 - confidence) / 2.0
    return means.agg(
        F.avg("mean").alias("mean"),
        F.percentile("mean", F.lit(tail)).alias("low"),
        F.percentile("mean", F.lit(1.0 - tail)).alias("high"),
    )


def severity_trend(rows: DataFrame, order: Sequence[str], severity_col: str = "severity", score_col: str = "score") -> DataFrame:
    """Mean score per severity in the given order; ``rising`` compares with the bucket before."""
    level = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(severity_col))
    means = rows.where(level > 0).groupBy(level.cast("long").alias("level"), F.col(severity_col).alias("severity")).agg(
        F.avg(score_col).alias("mean_score"), F.count(F.lit(1)).alias("n")
    )
    before = F.lag("mean_score").over(Window.partitionBy(F.lit(1)).orderBy("level"))  # a handful of rows
    return means.withColumn("rising", F.coalesce(F.col("mean_score") > before, F.lit(True)))


def is_monotone(trend: DataFrame) -> DataFrame:
    return trend.agg(F.coalesce(F.every("rising"), F.lit(True)).alias("monotone"))
