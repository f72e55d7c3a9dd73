"""Ranking and regression metrics over score tables.

Input is long: ``list_id, pos, label, pred`` with ``pos`` counting 0, 1, 2, ... inside a list. Metrics
that are sums stay plain aggregates; sorted ones use :mod:`splitwright.operators.scan`; metrics over
pairs cut every list into blocks of :data:`PAIR_BLOCK` items, so that a long list becomes many small
independent pieces of work and no single pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwright.functions.vectors import log_sum_exp, softmax, top_positions
from splitwright.operators.scan import running_sums
from splitwright.session import lookup_side, stored

PAIR_BLOCK = 256
# Steepness of the approximate rank, weights of the homophily penalty, and small terms.
RANK_STEEPNESS = 50.0
NORM_WEIGHT, HOMOPHILY_WEIGHT = 0.1, 0.5
COSINE_FLOOR, BALANCE_FLOOR = 1e-8, 1e-6


def _nan() -> Column:
    return F.lit(float("nan"))


def _ratio(a: Column, b: Column) -> Column:
    """Floating division in which 0/0 and x/0 read as NaN."""
    return F.coalesce(F.try_divide(a, b), _nan())


def mean_squared_error(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col("pred") - F.col("label"), 2)).alias("value"))


def cross_entropy(rows: DataFrame, logits_col: str = "logits", class_col: str = "label") -> DataFrame:
    """Mean of -log softmax at the true class; classes count from 0."""
    loss = log_sum_exp(F.col(logits_col)) - F.element_at(logits_col, F.col(class_col).cast("int") + 1)
    return rows.agg(F.avg(loss).alias("value"))


def _with_tops(rows: DataFrame, *columns: str) -> DataFrame:
    """Join the per-list maximum of each column, for stable exponentials."""
    tops = rows.groupBy("list_id").agg(*[F.max(c).alias(f"top_{c}") for c in columns])
    return rows.join(lookup_side(tops), "list_id")


def listnet_per_list(rows: DataFrame) -> DataFrame:
    """-sum softmax(label) * log softmax(pred) = logsumexp(pred) - softmax(label)-weighted mean pred."""
    wide = _with_tops(rows, "label", "pred")
    weight = F.exp(F.col("label") - F.col("top_label"))
    sums = wide.groupBy("list_id").agg(
        F.first("top_pred").alias("top"),
        F.sum(F.exp(F.col("pred") - F.col("top_pred"))).alias("z"),
        F.sum(weight).alias("w"),
        F.sum(weight * F.col("pred")).alias("wp"),
    )
    return sums.select("list_id", (F.col("top") + F.log("z") - F.col("wp") / F.col("w")).alias("loss"))


def listmle_per_list(rows: DataFrame) -> DataFrame:
    """Sum over the label-descending list of (log of the tail sum of exp(pred)) - pred."""
    wide = _with_tops(rows, "pred")
    # a tail sum in descending order is a running sum in the reversed order
    tails = running_sums(
        wide,
        ["list_id"],
        [F.asc("label"), F.desc("pos")],
        {"tail": F.exp(F.col("pred") - F.col("top_pred"))},
    )
    term = F.log("tail") + F.col("top_pred") - F.col("pred")
    return tails.groupBy("list_id").agg(F.sum(term).alias("loss"))


def rank_cosine_per_list(rows: DataFrame) -> DataFrame:
    dot = F.sum(F.col("label") * F.col("pred"))
    norms = F.sqrt(F.sum(F.col("label") * F.col("label"))) * F.sqrt(F.sum(F.col("pred") * F.col("pred")))
    cosine = dot / F.greatest(norms, F.lit(COSINE_FLOOR))
    return rows.groupBy("list_id").agg(((1.0 - cosine) / 0.5).alias("loss"))


def pearson_per_list(rows: DataFrame) -> DataFrame:
    cov = F.covar_pop("label", "pred")
    scale = F.stddev_pop("label") * F.stddev_pop("pred")
    constant = (F.min("label") == F.max("label")) | (F.min("pred") == F.max("pred"))
    r = F.when(constant, _nan()).otherwise(_ratio(cov, scale))
    return rows.groupBy("list_id").agg(r.alias("r"))


def _item_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``list_id, block, pos, label, pred``: arrays of at most ``block`` positions in order, written once."""
    kept = rows.select("list_id", "pos", F.col("label").cast("double").alias("label"), F.col("pred").cast("double").alias("pred"))
    items = F.sort_array(F.collect_list(F.struct("pos", "label", "pred")))
    cut = kept.groupBy("list_id", F.floor(F.col("pos") / block).cast("long").alias("block")).agg(items.alias("items"))
    return stored(cut.select("list_id", "block", *[F.col(f"items.{c}").alias(c) for c in ("pos", "label", "pred")]), "blocks")


def _long_lists(blocks: DataFrame) -> DataFrame:
    """``list_id, last_block`` of the lists with several blocks."""
    return lookup_side(blocks.where(F.col("block") > 0).groupBy("list_id").agg(F.max("block").alias("last_block")))


def _block_pairs(blocks: DataFrame, long: DataFrame, both_ways: bool) -> DataFrame:
    """Block pairs of the lists with several blocks; the second, ``other_*``, follows the first or differs."""
    wanted = blocks.join(long, "list_id")
    start = F.lit(0).cast("long") if both_ways else F.least(F.col("block") + 1, F.col("last_block"))
    left = wanted.withColumn("_b", F.explode(F.sequence(start, F.col("last_block")))).where(F.col("_b") != F.col("block"))
    right = wanted.select("list_id", F.col("block").alias("_b"), F.col("label").alias("other_label"), F.col("pred").alias("other_pred"))
    return left.join(right, ["list_id", "_b"]).drop("_b", "last_block")


def _tiles(df: DataFrame, kernel: Callable[..., tuple], names: Sequence[str], schema: str) -> DataFrame:
    """One row of ``list_id`` and the kernel's results for each row; ``names`` are the arrays that it takes.

    A row is a tile of at most ``block`` times ``block`` pairs.
    """
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch[n] for n in names]
            offsets = [x.offsets.to_numpy() for x in lists]
            values = [x.values.to_numpy(zero_copy_only=False) for x in lists]
            rows = []
            with np.errstate(over="ignore"):
                for k in range(batch.num_rows):
                    rows.append(kernel(*(v[o[k] : o[k + 1]] for v, o in zip(values, offsets))))
            if rows:
                yield pa.record_batch([batch["list_id"], *map(pa.array, zip(*rows))], fields)

    return df.select("list_id", *names).mapInArrow(run, schema)


def _kept_type(rows: DataFrame) -> str:
    return f"list_id {rows.schema['list_id'].dataType.simpleString()}"


def ranknet_per_list(rows: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Sum over i < j of (1 - sgn(label_i - label_j)) * d / 2 + log(1 + exp(-d)), d = pred_i - pred_j."""

    def terms(la, a, lb, b):
        d = a[:, None] - b
        return (1.0 - np.sign(la[:, None] - lb)) * d * 0.5 + np.logaddexp(0.0, -d)

    blocks = _item_blocks(rows, block)
    schema = f"{_kept_type(rows)}, part double"
    parts = _tiles(blocks, lambda label, pred: (np.triu(terms(label, pred, label, pred), 1).sum(),), ("label", "pred"), schema)
    long = _long_lists(blocks)
    if not long.isEmpty():
        pairs = _block_pairs(blocks, long, both_ways=False)
        names = ("label", "pred", "other_label", "other_pred")
        parts = parts.unionByName(_tiles(pairs, lambda *x: (terms(*x).sum(),), names, schema))
    return parts.groupBy("list_id").agg(F.sum("part").alias("loss"))


def approximate_ndcg_per_list(
    rows: DataFrame, steepness: float = RANK_STEEPNESS, block: int = PAIR_BLOCK
) -> DataFrame:
    """nDCG with smooth ranks 0.5 + sum over other scores of 1 / (1 + exp(steepness * (s_i - s_j))).

    A list of one block is one tile. Longer lists add up the tiles of each item, and their
    best order comes from running sums.
    """

    def beaten(a, b):
        d = a[:, None] - b
        return np.where(d == 0, 0.0, 1.0 / (1.0 + np.exp(steepness * d))).sum(axis=1)

    def whole(label, pred):
        gain = np.exp2(label) - 1.0
        dcg = (gain / np.log2(beaten(pred, pred) + 1.5)).sum()
        return dcg, (np.sort(gain)[::-1] / np.log2(np.arange(len(gain)) + 2.0)).sum()

    blocks = _item_blocks(rows, block)
    long = _long_lists(blocks)
    schema = _kept_type(rows)
    sums = _tiles(blocks.join(long, "list_id", "left_anti"), whole, ("label", "pred"), f"{schema}, dcg double, ideal double")
    if not long.isEmpty():
        own = blocks.join(long, "list_id").drop("last_block")
        tiles = own.withColumn("other_pred", F.col("pred")).unionByName(_block_pairs(blocks, long, both_ways=True).drop("other_label"))
        kernel = lambda pos, label, a, b: (pos, label, beaten(a, b))
        items = f"{schema}, pos array<{rows.schema['pos'].dataType.simpleString()}>, label array<double>, part array<double>"
        parts = _tiles(tiles, kernel, ("pos", "label", "pred", "other_pred"), items)
        parts = parts.select("list_id", F.inline(F.arrays_zip("pos", "label", "part")))
        ranks = parts.groupBy("list_id", "pos", "label").agg((F.sum("part") + 0.5).alias("rank"))
        gain = F.pow(F.lit(2.0), F.col("label")) - 1.0
        dcg = ranks.groupBy("list_id").agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"))
        numbered = own.select("list_id", F.inline(F.arrays_zip("pos", "label")))
        placed = running_sums(numbered, ["list_id"], [F.desc("label"), F.asc("pos")], {"place": F.lit(1)})
        ideal = placed.groupBy("list_id").agg(F.sum(gain / F.log2(F.col("place") + 1.0)).alias("ideal"))
        sums = sums.unionByName(dcg.join(ideal, "list_id"))
    return sums.select("list_id", _ratio(F.col("dcg"), F.col("ideal")).alias("ndcg"))


def listnet(rows: DataFrame) -> DataFrame:
    return listnet_per_list(rows).agg(F.avg("loss").alias("value"))


def listmle(rows: DataFrame) -> DataFrame:
    return listmle_per_list(rows).agg(F.avg("loss").alias("value"))


def rank_cosine(rows: DataFrame) -> DataFrame:
    return rank_cosine_per_list(rows).agg(F.sum("loss").alias("value"))


def ranknet(rows: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    return ranknet_per_list(rows, block).agg(F.sum("loss").alias("value"))


def approximate_ndcg(rows: DataFrame, steepness: float = RANK_STEEPNESS, block: int = PAIR_BLOCK) -> DataFrame:
    return approximate_ndcg_per_list(rows, steepness, block).agg((-F.avg("ndcg")).alias("value"))


def negative_pearson(rows: DataFrame, skip_undefined: bool = False) -> DataFrame:
    """Minus the sum over lists; a constant list makes it NaN unless undefined lists are skipped."""
    per_list = pearson_per_list(rows)
    per_list = per_list.where(~F.isnan("r")) if skip_undefined else per_list
    return per_list.agg((-F.sum("r")).alias("value"))


def squared_error_and_cosine(rows: DataFrame) -> DataFrame:
    """Mean squared error plus rank cosine, from one pass over the rows."""
    error = F.pow(F.col("pred") - F.col("label"), 2)
    norms = F.sqrt(F.sum(F.col("label") * F.col("label"))) * F.sqrt(F.sum(F.col("pred") * F.col("pred")))
    cosine = F.sum(F.col("label") * F.col("pred")) / F.greatest(norms, F.lit(COSINE_FLOOR))
    per_list = rows.groupBy("list_id").agg(
        F.sum(error).alias("se"), F.count(F.lit(1)).alias("n"), ((1.0 - cosine) / 0.5).alias("loss")
    )
    return per_list.agg((F.sum("se") / F.sum("n") + F.sum("loss")).alias("value"))


def homophily(vectors: DataFrame, vector_col: str = "vector", class_col: str = "label") -> DataFrame:
    """Label homophily penalty tr(X'(D + A)X) + 0.1 * |X|, with A the off-class adjacency.

    The pairwise form collapses to sums per class and dimension, so no pairs are formed:
    sum_i (N - n_c(i)) |x_i|^2 + |sum x|^2 - sum_c |sum over c of x|^2.
    """
    long = vectors.select(F.col(class_col).alias("c"), F.posexplode(vector_col).alias("pos", "v"))
    long = long.withColumn("v", F.col("v").cast("double"))
    per_class_dim = long.groupBy("c", "pos").agg(
        F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n")
    )
    per_dim = per_class_dim.groupBy("pos").agg(
        F.pow(F.sum("s"), 2).alias("s_all"), F.sum(F.pow("s", 2)).alias("s_class"), F.sum("q").alias("q")
    )
    across = per_dim.agg(
        F.sum("s_all").alias("s_all"), F.sum("s_class").alias("s_class"), F.sum("q").alias("q")
    )
    per_class = per_class_dim.groupBy("c").agg(F.sum("q").alias("q"), F.max("n").alias("n"))
    own = per_class.agg(F.sum("n").alias("n_all"), F.sum(F.col("n") * F.col("q")).alias("nq"))
    both = across.unionByName(own, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("s_all", "s_class", "q", "n_all", "nq")]
    )
    trace = F.col("n_all") * F.col("q") - F.col("nq") + F.col("s_all") - F.col("s_class")
    return both.select((trace + NORM_WEIGHT * F.sqrt("q")).alias("value"))


def squared_error_and_homophily(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    parts = mean_squared_error(rows).unionByName(
        homophily(vectors).select((F.lit(HOMOPHILY_WEIGHT) * F.col("value")).alias("value"))
    )
    return parts.agg(F.sum("value").alias("value"))


def gate_routing(rows: DataFrame, k: int, logits_col: str = "logits") -> DataFrame:
    """Per expert: summed softmax weight (importance) and number of top-``k`` choices (load)."""
    chosen = top_positions(F.col(logits_col), k)
    marked = F.transform(
        softmax(F.col(logits_col)),
        lambda p, i: F.struct(i.alias("expert"), p.alias("p"), F.array_contains(F.col("_top"), i).alias("hit")),
    )
    long = rows.withColumn("_top", chosen).select(F.inline(marked))
    return long.groupBy("expert").agg(
        F.sum("p").alias("importance"), F.count_if("hit").alias("load")
    ).withColumn("expert", F.col("expert").cast("long"))


def top_gate_weights(rows: DataFrame, k: int, logits_col: str = "logits") -> DataFrame:
    """Softmax over the ``k`` largest logits of each row, with their experts."""
    top = top_positions(F.col(logits_col), k)
    best = F.transform(top, lambda i: F.element_at(logits_col, i + 1))
    return rows.select(*[c for c in rows.columns if c != logits_col], top.alias("experts"), softmax(best).alias("weights"))


def routing_balance(routing: DataFrame) -> DataFrame:
    """Sum of the coefficients of variation of importance and load (sample deviation)."""
    spread = lambda c: F.stddev_samp(c) / (F.avg(c) + BALANCE_FLOOR)
    return routing.agg((spread("importance") + spread("load")).alias("value"))
