"""Near-duplicate groups with HyperMinHash signatures.

A document is the set of its five-word shingles. Each of ``REGISTERS`` hash functions keeps its minimum as a
16-bit register: the count of leading zeros and ten mantissa bits. Bands of ``ROWS`` registers propose
candidates; a Jaccard estimate, corrected for the registers that agree by chance, drops hopeless ones; the
rest is decided on the full sets.

Equal sets are one node from the start. Groups need connectivity, not all pairs: first every node meets one
pivot of its buckets, chosen as the likely origin of the others, which settles groups of copies with one
comparison a node; afterwards the strays, nodes outside the largest settled group of a bucket, meet that
group and each other in blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwright.llm.recipes import keep_rows
from splitwright.llm.text import WordHashes, arrow_map, documents, mixed, row_key, space_words, text_slices, texts_of
from splitwright.operators.clusters import connected_components
from splitwright.session import stored

WORDS = 5
#: Similarity as a fraction of whole numbers: linked when ``LINK[1] * common >= LINK[0] * union``.
LINK = (75, 100)
#: A pair of exactly that similarity shares no band with probability 5e-6.
ROWS, BANDS = 4, 32
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Bytes of text in one block of a family.
BLOCK_BYTES = 1_000_000
#: Estimates below are dropped: five standard deviations under the threshold.
LEAST_ESTIMATE = 0.75 - 5 * (0.75 * 0.25 / REGISTERS) ** 0.5

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_PLACES = _RANDOM.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)
_BAND = _RANDOM.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the five-word sequences; fewer words are one sequence, none is none."""
    n = min(WORDS, len(words))
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, np.uint64) * _PLACES[WORDS]
        for i in range(n):
            total += words[i : len(words) - n + 1 + i] * _PLACES[i]
    return np.unique(mixed(total))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of sets that are not empty, a row each."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.concatenate(sets)
    work = np.empty_like(values)
    lowest = np.empty((len(sets), REGISTERS), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(REGISTERS):
            np.multiply(values, _FACTORS[j], out=work)
            np.add(work, _OFFSETS[j], out=work)
            lowest[:, j] = np.minimum.reduceat(work, starts)
    return compressed(lowest)


def compressed(lowest: np.ndarray) -> np.ndarray:
    """Leading zeros above the mantissa bits that follow the first one."""
    left = lowest.copy()
    zeros = np.zeros(lowest.shape, np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        short = left < np.uint64(1 << (64 - step))
        zeros += np.where(short, np.uint64(step), np.uint64(0))
        left = np.where(short, left << np.uint64(step), left)
    tail = (left << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | tail).astype(np.uint16)


@lru_cache(maxsize=4096)
def _chance(log_a: int, log_b: int) -> float:
    """Probability that registers of unrelated sets agree, sizes given as twice their binary logarithm."""
    edges = np.concatenate([2.0 ** -(z + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for z in range(52)])
    tops = edges + np.repeat(2.0 ** -(np.arange(52) + 1.0) / (1 << MANTISSA), 1 << MANTISSA)
    a, b = 2.0 ** (log_a / 2), 2.0 ** (log_b / 2)
    inside = [np.exp(n * np.log1p(-edges)) - np.exp(n * np.log1p(-np.minimum(tops, 1 - 1e-16))) for n in (a, b)]
    return float((inside[0] * inside[1]).sum())


def estimate(agree: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance agreement."""
    logs = [np.rint(2 * np.log2(np.maximum(n, 1))).astype(int) for n in (n_a, n_b)]
    chance = np.array([_chance(min(a, b), max(a, b)) for a, b in zip(*logs)])
    return np.maximum(0.0, (agree - chance) / (1 - chance))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, _key1, _key2, _row, n, fp, regs``: set size, 128-bit hash of the set, registers.

    Documents without words have null ``fp`` and ``regs``.
    """

    def work():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch):
            sizes, prints, regs = [], [], []
            for texts in text_slices(batch["text"]):
                sets = [shingles(hashes.of(space_words(t))) for t in texts]
                full = [s for s in sets if len(s)]
                rows = iter(registers(full)) if full else iter(())
                for s in sets:
                    sizes.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    regs.append(next(rows).tobytes() if len(s) else None)
            yield pa.record_batch(
                [batch["doc_id"], batch["_key1"], batch["_key2"], pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())],
                ["doc_id", "_key1", "_key2", "n", "fp", "regs"],
            )

        return step

    rows = documents(docs)
    keyed = rows.select("doc_id", "text", *row_key(rows))
    found = arrow_map(keyed, work, "doc_id long, _key1 long, _key2 long, n long, fp binary, regs binary")
    return stored(found.withColumn("_row", F.monotonically_increasing_id()), "signatures")


def band_rows(nodes: DataFrame) -> DataFrame:
    """``band, id, n``: a row for each band of each node."""

    def work():
        def step(batch: pa.RecordBatch):
            regs = np.stack([np.frombuffer(r, np.uint16) for r in batch["regs"].to_pylist()]).astype(np.uint64)
            with np.errstate(over="ignore"):
                parts = (regs.reshape(len(regs), BANDS, ROWS) + np.uint64(1)) * _BAND
                keys = mixed(parts.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACES[0]).view(np.int64)
            yield pa.record_batch(
                [
                    pa.array(keys.reshape(-1)),
                    pa.array(np.repeat(batch["id"].to_numpy(), BANDS)),
                    pa.array(np.repeat(batch["n"].to_numpy(), BANDS).astype(np.int32)),
                ],
                ["band", "id", "n"],
            )

        return step

    return arrow_map(nodes.select("id", "n", "regs"), work, "band long, id long, n int")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs ``id_a, id_b`` whose estimate does not rule them out."""

    def work():
        def step(batch: pa.RecordBatch):
            a, b = (np.stack([np.frombuffer(r, np.uint16) for r in batch[c].to_pylist()]) for c in ("regs_a", "regs_b"))
            close = estimate((a == b).mean(axis=1), batch["n_a"].to_numpy(), batch["n_b"].to_numpy()) >= LEAST_ESTIMATE
            yield batch.select(["id_a", "id_b"]).filter(pa.array(close))

        return step

    sides = [nodes.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}")) for x in "ab"]
    return arrow_map(pairs.join(sides[0], "id_a").join(sides[1], "id_b"), work, "id_a long, id_b long")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. Texts travel, they are smaller than sets."""

    def work():
        hashes = WordHashes()
        last: list = [None, None]

        def step(batch: pa.RecordBatch):
            good = []
            for a, left, right in zip(batch["id_a"].to_pylist(), texts_of(batch["text_a"]), texts_of(batch["text_b"])):
                if last[0] != a:
                    last[:] = a, shingles(hashes.of(space_words(left)))
                other = shingles(hashes.of(space_words(right)))
                common = len(np.intersect1d(last[1], other, assume_unique=True))
                good.append(LINK[1] * common >= LINK[0] * (len(last[1]) + len(other) - common))
            yield batch.select(["id_a", "id_b"]).filter(pa.array(good, pa.bool_()))

        return step

    sides = [texts.select(F.col("id").alias(f"id_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab"]
    return arrow_map(pairs.join(sides[1], "id_b").join(sides[0], "id_a"), work, "id_a long, id_b long")


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges).withColumnRenamed("id", "_id")
    joined = nodes.select("id").join(found, F.col("id") == F.col("_id"), "left")
    return stored(joined.select("id", F.coalesce("component", "id").alias("label")), "labels")


def _close_sizes(a, b):
    return (F.lit(LINK[1]) * F.least(a, b)) >= (F.lit(LINK[0]) * F.greatest(a, b))


def shared_bands(nodes: DataFrame) -> DataFrame:
    """``band, id, n, weight`` of bands that several nodes share. The weight of a node is the sum of its
    buckets' sizes: the text that others are copies of has its own registers in the largest buckets."""
    bands = stored(band_rows(nodes), "bands")
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    shared = stored(bands.join(stored(sizes, "band-sizes"), "band"), "shared-bands")
    weights = stored(shared.groupBy("id").agg(F.sum("k").alias("weight")), "weights")
    return shared.drop("k").join(weights, "id")


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that hold several labels, with the label that most members have."""
    known = buckets.join(labels, "id")
    parts = known.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"))
    major = parts.groupBy("band").agg(F.max(F.struct("k", "label")).alias("m"), F.count(F.lit(1)).alias("parts"))
    major = stored(major.where(F.col("parts") > 1).select("band", F.col("m.label").alias("major")), "open-bands")
    return stored(known.join(major, "band"), "open-buckets")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """Each node with one other: of the heaviest nodes of its buckets the one that most bands point to."""
    pivots = buckets.groupBy("band").agg(F.max(F.struct("weight", (-F.col("id")).alias("p"), "n")).alias("top"))
    pivots = pivots.select("band", (-F.col("top.p")).alias("pivot"), F.col("top.n").alias("m"))
    met = buckets.join(stored(pivots, "pivots"), "band").where((F.col("id") != F.col("pivot")) & _close_sizes(F.col("n"), F.col("m")))
    votes = met.groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("k"))
    best = votes.groupBy("id").agg((-F.max(F.struct("k", (-F.col("pivot")).alias("p")))["p"]).alias("pivot"))
    return best.select(F.least("id", "pivot").alias("id_a"), F.greatest("id", "pivot").alias("id_b")).distinct()


def family_links(buckets: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``id_a, id_b`` that the first comparison has left open.

    A bucket that holds several labels belongs to the family of its most common one; its other members
    are strays of that family. Strays are compared with all members and all strays of the family, which
    covers every pair of the bucket. Both sides come in blocks of texts of bounded size, so pairs are
    never rows, and a pair of blocks returns a spanning forest of its links.
    """
    still = open_buckets(buckets, labels)
    strays = stored(still.where(F.col("label") != F.col("major")).select(F.col("major").alias("family"), "id").distinct(), "strays")
    families = stored(strays.select("family").distinct(), "families")
    members = labels.join(families, F.col("label") == F.col("family")).select("family", "id", F.lit(True).alias("member"))
    every = members.unionByName(strays.withColumn("member", F.lit(False)))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        found = stored(rows.join(texts, "id"), "family-texts")
        sizes = found.groupBy("family").agg(F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES).alias("parts"))
        dealt = found.join(stored(sizes, "family-sizes"), "family").withColumn("part", F.pmod(F.xxhash64("id"), F.greatest("parts", F.lit(1))))
        return dealt.groupBy("family", "part").agg(F.collect_list(F.struct("id", "member", "text")).alias(name)).drop("part")

    def work():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch):
            for i in range(batch.num_rows):
                edges = sorted(block_links(batch["left"][i].as_py(), batch["right"][i].as_py(), hashes))
                yield pa.record_batch([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["id_a", "id_b"])

        return step

    met = blocks(strays.withColumn("member", F.lit(False)), "left").join(blocks(every, "right"), "family")
    return arrow_map(met.select("left", "right"), work, "id_a long, id_b long").where(F.col("id_a") != F.col("id_b"))


def block_links(left: list[dict], right: list[dict], hashes: WordHashes) -> set[tuple[int, int]]:
    """A spanning forest of the links between two blocks; members of the family count as linked.

    Shared shingles are counted through an inverted list of the right block.
    """
    sets = [shingles(hashes.of(space_words(r["text"].encode()))) for r in right]
    sizes = np.array([len(s) for s in sets])
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    family = [r["id"] for r in right if r["member"]]
    for other in family[1:]:
        parent[root(other)] = root(family[0])
    forest = set()
    for row in left:
        own = shingles(hashes.of(space_words(row["text"].encode())))
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        counts = high - low
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        common = np.bincount(owners[at], minlength=len(sets))
        for j in np.flatnonzero(LINK[1] * common >= LINK[0] * (len(own) + sizes - common)):
            a, b = row["id"], right[j]["id"]
            if a != b and root(a) != root(b):
                parent[root(a)] = root(b)
                forest.add((min(a, b), max(a, b)))
    return forest


def near_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, _key1, _key2`` of every document.

    A document without words (null and empty texts) is its own group. Of a group the smallest ``doc_id``
    stays; a null id stays only where no row has one, and of rows that repeat an id one stays. Other
    columns are not read.
    """
    rows = signatures(docs)
    full = rows.where(F.col("fp").isNotNull())
    first = F.min(F.struct("_row", "_key1", "_key2")).alias("_first")
    nodes = full.groupBy("fp").agg(first, F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = stored(nodes.select("fp", F.col("_first._row").alias("id"), "_first._key1", "_first._key2", "n", "regs"), "nodes")

    buckets = stored(shared_bands(nodes), "buckets")
    keyed = documents(docs)
    keyed = keyed.select("text", *row_key(keyed))
    wanted = buckets.select("id").distinct().join(nodes.select("id", "_key1", "_key2"), "id")
    # one plan at every size: the texts move once, to where their keys are
    found = keyed.join(stored(wanted, "wanted").hint("merge"), ["_key1", "_key2"])
    texts = stored(found.dropDuplicates(["id"]).select("id", "text"), "texts")

    stars = stored(likely(star_pairs(buckets), nodes), "likely")
    labels = _labels(nodes, stored(linked(stars, texts), "links"))
    rest = stored(family_links(buckets, labels, texts), "links")
    # settled groups take part as stars
    settled = labels.where(F.col("id") != F.col("label")).select(F.col("label").alias("id_a"), F.col("id").alias("id_b"))
    labels = _labels(nodes, settled.unionByName(rest))

    classes = stored(nodes.select("fp", "id").join(labels, "id").select("fp", "label"), "classes")
    placed = rows.select("doc_id", "_row", "_key1", "_key2", "n", "fp").join(classes, "fp", "left")
    placed = stored(placed.select("doc_id", "_row", "_key1", "_key2", "n", F.coalesce("label", "_row").alias("label")), "placed")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    heads = placed.groupBy("label").agg(smallest.alias("_head"))
    return placed.join(stored(heads, "heads"), "label").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("_head.id").alias("component_id"),
        (F.col("_row") == F.col("_head.row")).alias("kept"),
        "_key1",
        "_key2",
    )


def near_groups(docs: DataFrame) -> DataFrame:
    """:func:`near_rows` without the row keys."""
    return near_rows(docs).drop("_key1", "_key2")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns."""
    return keep_rows(docs, near_rows(docs).where("kept").select("_key1", "_key2"))
