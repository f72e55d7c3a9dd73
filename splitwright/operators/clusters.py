"""Single-linkage clusters: connected components of the similarity graph, and the cluster split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitwright.operators.checks import reject_nulls, require_columns
from splitwright.operators.similarity import (
    Block,
    check_threshold,
    collapse_copies,
    content_digests,
    first_of_digest,
    prefixed,
    representatives,
    set_tiles,
    shared_sets,
    tile_pairs,
)
from splitwright.operators.splits import DEFAULT_FRACTIONS, cluster_assignment
from splitwright.session import checkpointed, lookup_side, stored


#: Links that a task reduces to a forest at a time.
FOREST_LINKS = 500_000


def _lowest_neighbours(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges that are not the smallest of their component, and that smallest node."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        open_ = (root[a] != low) | (root[b] != low)
        if not open_.any():
            break
        a, b, low = a[open_], b[open_], low[open_]
        # roots take the smallest root they are linked to, then all nodes follow to the end of their paths
        for end in (a, b):
            np.minimum.at(root, root[end], low)
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def local_forests(links: DataFrame) -> DataFrame:
    """``v, u`` with the same components as the links ``v, u``: a star for each component of each block of rows.

    A block of ``FOREST_LINKS`` rows leaves at most one row for each of its nodes, whatever its number of links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            stars = _lowest_neighbours(*(table[c].to_numpy() for c in ("v", "u")))
            return pa.record_batch([pa.array(x, t.type) for x, t in zip(stars, table.schema)], ["v", "u"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FOREST_LINKS:
                yield forest()
                held, n = [], 0
        if n:
            yield forest()

    return links.mapInArrow(run, links.schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id) of every node with an edge ``id_a, id_b``.

    Every block of edges is first reduced to a forest. Then alternating star contraction: each node hands its larger neighbours, then its smaller ones, to
    the smallest neighbour, until every component is one star: until no node has a smaller neighbour and
    besides it another one. The number of edges never grows and
    the rounds grow with the logarithm of the diameter. Every round is checkpointed, and a hub only
    ever takes part through a combinable minimum and a splittable join.
    """
    links = edges.select(F.greatest("id_a", "id_b").alias("v"), F.least("id_a", "id_b").alias("u"))
    links = checkpointed(local_forests(links.where(F.col("u") != F.col("v"))).distinct())
    while True:
        both = links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        smaller = F.sum((F.col("u") < F.col("v")).cast("int")).alias("smaller")
        nodes = both.groupBy("v").agg(F.min("u").alias("m"), smaller, F.count(F.lit(1)).alias("all"))
        nodes = lookup_side(nodes.select("v", F.least("m", "v").alias("m"), "smaller", "all"))
        if nodes.where((F.col("smaller") > 0) & (F.col("all") > 1)).isEmpty():
            return nodes.select(F.col("v").alias("id"), F.col("m").alias("component"))
        large = both.join(nodes.select("v", "m"), "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = stored(large.where(F.col("u") != F.col("v")).distinct(), "links")
        lowest = lookup_side(large.groupBy("v").agg(F.min("u").alias("m")))
        moved = large.join(lowest, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = moved.unionByName(lowest.select("v", F.col("m").alias("u")))
        links = checkpointed(small.where(F.col("u") != F.col("v")).distinct())


def _labels(reps: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges).withColumnRenamed("id", "_id")
    return reps.select("id").join(found, F.col("id") == F.col("_id"), "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _tile_links(left: Block, right: Block, threshold: float, same: bool) -> Iterator[pa.RecordBatch]:
    """Links ``v, u`` that connect the similar sets of a tile: a star for each component.

    Pairs that the portions before have connected are not compared.
    """
    root = np.arange(len(left.n) + (0 if same else len(right.n)))
    first = len(root) - len(right.n)
    for a, b, _ in tile_pairs(left, right, threshold, same, (root[: len(left.n)], root[first:])):
        nodes, lowest = _lowest_neighbours(root[a], root[b + first])
        low = np.arange(len(root))
        low[nodes] = lowest
        root[:] = low[root]
    below = np.flatnonzero(root != np.arange(len(root)))
    ids = left.ids.combine_chunks() if same else pa.concat_arrays([left.ids.combine_chunks(), right.ids.combine_chunks()])
    yield pa.record_batch([ids.take(pa.array(below)), ids.take(pa.array(root[below]))], ["v", "u"])


def _linked(sets: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    members = stored(members, "members")
    ranked = prefixed(shared_sets(representatives(sets, members), threshold), threshold)
    kind = ranked.schema["id"].dataType
    schema = T.StructType([T.StructField("v", kind), T.StructField("u", kind)])
    links = set_tiles(ranked, lambda left, right, same: _tile_links(left, right, threshold, same), schema)
    final = _labels(ranked, links.select(F.col("v").alias("id_a"), F.col("u").alias("id_b"))).withColumnRenamed("id", "rep")
    # sets without a possible partner are not among the ranked ones
    return members.join(final, "rep", "left").select("id", F.coalesce("component", "rep").alias("cluster_id"))


def link_clusters(sets: DataFrame, threshold: float = 0.4) -> DataFrame:
    """``id, cluster_id`` (smallest member id) under single linkage at ``threshold``.

    Clusters need connectivity, not all pairs. The sets are compared in tiles of two blocks (see
    :func:`~splitwright.operators.similarity.set_tiles`). What leaves a tile is at most one link for each of its
    sets, whatever the number of its similar pairs.
    """
    require_columns(sets, ["id", "fp"], "sets")
    check_threshold(threshold)
    return _linked(sets, collapse_copies(sets), threshold)


def item_clusters(sets: DataFrame, threshold: float = 0.4) -> DataFrame:
    """:func:`link_clusters` of ``id, fp``, where a missing or empty ``fp`` is an error."""
    require_columns(sets, ["id", "fp"], "sets")
    check_threshold(threshold)
    digests = content_digests(sets)
    reject_nulls(digests.select(F.when(F.col("n") > 0, F.lit(True)).alias("fingerprint")), ["fingerprint"], "items")
    return _linked(sets, first_of_digest(digests), threshold)


def cluster_split(
    items: DataFrame,
    id_col: str = "id",
    fp_col: str = "fp",
    label_col: str | None = "label",
    threshold: float = 0.4,
    fractions: tuple[float, float, float] = DEFAULT_FRACTIONS,
) -> DataFrame:
    """All items with ``cluster_id`` and ``split``; similar items never part.

    Items without a fingerprint or with an empty one are an error. The label is optional.
    """
    require_columns(items, [id_col, fp_col] + ([label_col] if label_col else []), "items")
    sets = items.select(F.col(id_col).alias("id"), F.col(fp_col).alias("fp"))
    clusters = item_clusters(sets, threshold).withColumnRenamed("id", id_col)
    clustered = items.join(clusters, id_col)
    return cluster_assignment(clustered, id_col, label_col, fractions)
