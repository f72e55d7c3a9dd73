"""Group-aware stratified splits: whole groups go to train, validation or test.

The assignment is greedy over the groups in a fixed order, with six running counts as its only
state. Everything per row (building the groups, mapping the result back) is an ordinary aggregate or
join. The greedy pass itself runs over range-partitioned groups: all ranges are folded at the same
time from predicted start states, a range is accepted when its prediction was right, and only the
six counts of each range travel through the driver. Long stretches in which every group goes to the
same split, which is nearly all of a large input, are predicted exactly, and ranges of equal groups are
stepped over in closed form, also where their picks alternate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitwright.functions.ids import own_group_key
from splitwright.operators.checks import SchemaError, reject_nulls, require_columns
from splitwright.session import checkpointed, stored

SPLITS = ("train", "val", "test")
# Default fractions and the sum tolerance.
DEFAULT_FRACTIONS = (0.80, 0.10, 0.10)
FRACTION_TOLERANCE = 1e-6


def check_fractions(fractions: tuple[float, float, float]) -> None:
    if abs(sum(fractions) - 1.0) > FRACTION_TOLERANCE:
        raise SchemaError(f"train, val and test fractions must sum to 1.0, got {fractions}")


def split_targets(total: int, fractions: tuple[float, float, float]) -> tuple[int, int, int]:
    """Half-even rounded train and validation targets; test takes the remainder."""
    train, val = round(total * fractions[0]), round(total * fractions[1])
    return train, val, total - train - val


@dataclass(frozen=True)
class Fill:
    """State between two groups: rows and positives per split."""

    rows: tuple[int, int, int] = (0, 0, 0)
    positives: tuple[int, int, int] = (0, 0, 0)

    def add(self, split: int, rows: int, positives: int) -> "Fill":
        bump = lambda t, v: tuple(x + (v if k == split else 0) for k, x in enumerate(t))
        return Fill(bump(self.rows, rows), bump(self.positives, positives))


@dataclass(frozen=True)
class Targets:
    """What the greedy pass aims at.

    The penalty of an overfull split exceeds every other cost term by construction, so costs are
    compared as the pair (overshoot, squared gaps) in exact integers.
    """

    rows: tuple[int, int, int]
    positives: tuple[int, int, int]


# order in which equal costs are listed: alphabetical by split name
_BY_NAME = sorted(range(3), key=lambda k: SPLITS[k])
_BURST, _LONGEST_RUN = 64, 1 << 18
_EXACT_SQUARES = 1 << 30


def drawn(seed: int, key, tied: list[int]) -> int:
    """The tied split whose name has the smallest MD5 together with the seed and the group's key."""
    return min(tied, key=lambda k: hashlib.md5(f"{seed}:{key}:{SPLITS[k]}".encode()).hexdigest())


def _step(state: Fill, targets: Targets, size: int, plus: int, draw: Callable[[list[int]], int] | None) -> int:
    costs = []
    for k in range(3):
        after = targets.rows[k] - state.rows[k] - size
        gap = state.positives[k] + plus - targets.positives[k]
        costs.append((max(0, -after), max(0, after) ** 2 + gap * gap))
    best = min(costs)
    tied = [k for k in _BY_NAME if costs[k] == best]
    return draw(tied) if draw is not None and len(tied) > 1 else tied[0]


def _run_length(state: Fill, targets: Targets, pick: int, size: np.ndarray, plus: np.ndarray) -> int:
    """How many of the next groups go to ``pick`` with a strictly lowest cost.

    Squared gaps of very large inputs exceed 64 bits; they are then compared in floating point, and a
    difference within its error ends the run, which leaves that group to the exact single step.
    """
    wide = sum(targets.rows) > _EXACT_SQUARES

    def cost(k: int, rows, positives):
        after = targets.rows[k] - rows - size
        gap = positives + plus - targets.positives[k]
        kind = np.float64 if wide else np.int64
        return np.maximum(0, -after), np.maximum(0, after).astype(kind) ** 2 + gap.astype(kind) ** 2

    before_rows = state.rows[pick] + np.concatenate(([0], np.cumsum(size)[:-1]))
    before_plus = state.positives[pick] + np.concatenate(([0], np.cumsum(plus)[:-1]))
    over, gaps = cost(pick, before_rows, before_plus)
    good = np.ones(len(size), dtype=bool)
    for k in range(3):
        if k != pick:
            other_over, other_gaps = cost(k, state.rows[k], state.positives[k])
            margin = 1e-12 * (gaps + other_gaps) if wide else 0
            good &= (over < other_over) | ((over == other_over) & (gaps + margin < other_gaps))
    wrong = np.flatnonzero(~good)
    return int(wrong[0]) if len(wrong) else len(size)


def greedy_fill(
    size: np.ndarray, plus: np.ndarray, state: Fill, targets: Targets, keys=None, seed: int | None = None
) -> tuple[np.ndarray, Fill]:
    """Split number per group, in order, and the state after the last one.

    Short bursts of single steps alternate with whole runs that go to one split. With a seed, equal
    costs are decided by :func:`drawn` from the group's key, so a tie does not depend on earlier ones.
    """
    size, plus = size.astype(np.int64), plus.astype(np.int64)
    picks = np.empty(len(size), dtype=np.int8)
    at = 0
    while at < len(size):
        start, stop = at, min(len(size), at + _BURST)
        while at < stop:
            draw = None if seed is None else (lambda tied, key=keys[at]: drawn(seed, key, tied))
            pick = _step(state, targets, int(size[at]), int(plus[at]), draw)
            state = state.add(pick, int(size[at]), int(plus[at]))
            picks[at] = pick
            at += 1
        if (picks[start:at] == picks[at - 1]).all():
            pick, width = int(picks[at - 1]), 4 * _BURST
            while at < len(size):
                stop = min(len(size), at + width)
                run = _run_length(state, targets, pick, size[at:stop], plus[at:stop])
                picks[at : at + run] = pick
                state = state.add(pick, int(size[at : at + run].sum()), int(plus[at : at + run].sum()))
                at += run
                if at < stop:
                    break
                width = min(2 * width, _LONGEST_RUN)
    return picks, state


#: Longest repeating pattern of picks that :func:`equal_groups` looks for, and how many changes of pattern it follows.
_PATTERN, _PATTERN_CHANGES = 64, 1000


def _first_failure(a: int, b: int, c: int, last: int) -> int:
    """Smallest t in 0..last with ``a t^2 + b t + c <= 0``, or ``last + 1``; exact."""
    fails = lambda t: a * t * t + b * t + c <= 0
    if fails(0):
        return 0
    if a > 0:  # falls up to the vertex only
        vertex = min(last, max(0, -b // (2 * a)))
        last_fall = next((t for t in (vertex, min(last, vertex + 1)) if fails(t)), None)
        if last_fall is None:
            return last + 1
        last = last_fall
    elif not fails(last):  # concave and positive at both ends
        return last + 1
    low, high = 0, last
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if fails(middle) else (middle, high)
    return high


def _whole_periods(state: Fill, targets: Targets, size: int, plus: int, pattern: list[int], most: int) -> int:
    """How many times in a row the picks of ``pattern`` certainly repeat from ``state``, at most ``most``.

    From period to period the rows and positives of each split grow by a constant, so the difference of two costs
    is a polynomial of the period's number as long as no split runs full, and its first root ends the pattern.
    """
    rows = [size * pattern.count(k) for k in range(3)]
    positives = [plus * pattern.count(k) for k in range(3)]
    at = state
    for pick in pattern:
        after = [targets.rows[k] - at.rows[k] - size for k in range(3)]
        gap = [at.positives[k] + plus - targets.positives[k] for k in range(3)]
        for k in range(3):
            if after[k] >= 0 and rows[k]:
                most = min(most, after[k] // rows[k] + 1)  # in later periods this split is full
        last = most - 1
        if last < 0:
            return 0

        def square(k: int) -> tuple[int, int, int]:
            a, b, c = positives[k] ** 2, 2 * gap[k] * positives[k], gap[k] ** 2
            return (a + rows[k] ** 2, b - 2 * after[k] * rows[k], c + after[k] ** 2) if after[k] >= 0 else (a, b, c)

        for k in range(3):
            if k == pick:
                continue
            if after[pick] >= 0 > after[k]:
                continue
            if after[pick] < 0:
                if after[k] >= 0:
                    return 0
                difference = (0, rows[k] - rows[pick], after[pick] - after[k])
            else:
                difference = tuple(x - y for x, y in zip(square(k), square(pick)))
            most = min(most, _first_failure(*difference, last))
            last = most - 1
            if last < 0:
                return 0
        at = at.add(pick, size, plus)
    return most


def equal_groups(state: Fill, targets: Targets, size: int, plus: int, count: int, seed: int | None) -> Fill | None:
    """State after ``count`` groups of the same size and positives, without a step for each.

    Picks of equal groups repeat in short patterns; each pattern is taken as often as it holds at once. None if a tie has to
    be drawn from the keys, or if there are too many different patterns.
    """
    for _ in range(_PATTERN_CHANGES):
        picks, at, tied = [], state, False

        def draw(_: list[int]) -> int:
            nonlocal tied
            tied = True
            return 0

        while len(picks) < min(count, 2 * _PATTERN):
            pick = _step(at, targets, size, plus, draw if seed is not None else None)
            if tied:
                return None
            picks.append(pick)
            at = at.add(pick, size, plus)
        if len(picks) == count:
            return at
        repeats = 0
        for period in range(1, _PATTERN + 1):
            if picks[period:] == picks[:-period]:
                pattern = picks[:period]
                repeats = _whole_periods(state, targets, size, plus, pattern, count // period)
                break
        if repeats * max(1, period) <= len(picks):
            state, count = at, count - len(picks)
            continue
        for k in range(3):
            n = repeats * pattern.count(k)
            state = state.add(k, n * size, n * plus)
        count -= repeats * period
        if not count:
            return state
    return None


def _fold_batches(batches: Iterator[pd.DataFrame], starts: dict[int, Fill], targets: Targets, key: str, seed: int | None):
    """Fold every range from its start state: ``range, rows, picks, state`` a piece.

    The range is a column of the rows. Task numbers would not do: a later ``coalesce`` or ``union``
    runs several ranges in one task, under another number.
    """
    at, state = None, None
    for batch in batches:
        for r, rows in batch.groupby("_range", sort=False):
            if r != at:
                at, state = r, starts[int(r)]
            picks, state = greedy_fill(
                rows["size"].to_numpy(), rows["positives"].to_numpy(), state, targets, rows[key].to_numpy(), seed
            )
            yield at, rows, picks, state


def _range_start_states(groups: DataFrame, key: str, targets: Targets, seed: int | None) -> tuple[dict[int, Fill], int]:
    """State at the start of every range of ordered groups, and the number of rounds of jobs it took.

    Ranges of equal groups are stepped over exactly, without a job. Others are found by predict and verify.
    """
    edges = [f(c) for c in ("size", "positives") for f in (F.sum, F.min, F.max)]
    sums, equal = {}, {}
    for r, n, *ends, count in groups.groupBy("_range").agg(*edges, F.count(F.lit(1))).collect():  # one row per range
        low, high, p, fewest, most_ = map(int, ends)
        sums[r] = (int(n), p)
        if low == high and fewest == most_:
            equal[r] = (low, fewest, int(count))
    order = sorted(sums)  # ranges without rows change nothing

    starts, at, state, likely, width, rounds = {}, 0, Fill(), None, 1, 0
    while at < len(order):
        stepped = equal_groups(state, targets, *equal[order[at]], seed) if order[at] in equal else None
        if stepped is not None:
            starts[order[at]], state = state, stepped
            at += 1
            continue
        rounds += 1
        guess = {order[at]: state}
        if likely is not None:
            for before, r in zip(order[at : at + width - 1], order[at + 1 : at + width]):
                guess[r] = guess[before].add(likely, *sums[before])

        def fold(batches, guess=guess):
            ends = {}
            for r, _, picks, end in _fold_batches(batches, guess, targets, key, seed):
                ends[r] = (int(picks[-1]), *end.rows, *end.positives)
            if ends:
                yield pd.DataFrame([(r, e[0], list(e[1:])) for r, e in ends.items()], columns=["r", "last", "state"])

        ahead = groups.where(F.col("_range").between(order[at], max(guess)))
        folded = ahead.mapInPandas(fold, "r int, last int, state array<long>").collect()  # one row per range
        ends = {row["r"]: (row["last"], Fill(tuple(row["state"][:3]), tuple(row["state"][3:]))) for row in folded}
        begun = at
        while at < len(order) and guess.get(order[at]) == state:
            starts[order[at]] = state
            likely, state = ends[order[at]]
            at += 1
        # look further ahead after a full hit, as far as it was right after a miss
        width = 8 * len(guess) if at - begun == len(guess) else max(1, at - begun)
    return starts, rounds


def assign_groups(
    groups: DataFrame,
    key: str,
    fractions: tuple[float, float, float] = DEFAULT_FRACTIONS,
    seed: int | None = 42,
) -> DataFrame:
    """``key, split`` for groups ``key, size, positives``, taken by descending size, then key.

    With a seed, equal costs are decided by a hash of seed and key among the tied splits; without one,
    the alphabetically first is taken. The assignment is written once, so all that is derived from it
    agrees.
    """
    check_fractions(fractions)
    require_columns(groups, [key, "size", "positives"], "groups")
    order = [F.desc("size"), F.asc(key)]
    ordered = groups.select(key, F.col("size").cast("long"), F.col("positives").cast("long"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = checkpointed(ordered.withColumn("_range", F.spark_partition_id()))
    n, p = ordered.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("positives"), F.lit(0))).first()
    targets = Targets(split_targets(int(n), fractions), split_targets(int(p), fractions))
    starts, _ = _range_start_states(ordered, key, targets, seed)
    names = np.array(SPLITS, dtype=object)

    def replay(batches):
        for _, rows, picks, _ in _fold_batches(batches, starts, targets, key, seed):
            yield pd.DataFrame({key: rows[key], "split": names[picks]})

    key_type = groups.schema[key].dataType.simpleString()
    return stored(ordered.mapInPandas(replay, f"`{key}` {key_type}, split string"), "assignment")


def group_table(items: DataFrame, id_col: str, group_col: str, label_col: str | None) -> DataFrame:
    """``group_key, size, positives`` with a group of its own for every item without a key."""
    positives = F.sum(F.col(label_col).cast("long")) if label_col else F.lit(0).cast("long")
    keyed = items.withColumn("_g", own_group_key(F.col(group_col), F.col(id_col)))
    return keyed.groupBy(F.col("_g").alias("group_key")).agg(
        F.count(F.lit(1)).alias("size"), positives.alias("positives")
    )


def group_split(
    items: DataFrame,
    id_col: str = "id",
    group_col: str = "group_key",
    label_col: str = "label",
    fractions: tuple[float, float, float] = DEFAULT_FRACTIONS,
    seed: int | None = 42,
) -> DataFrame:
    """All items with their ``split``; items of one group never part."""
    require_columns(items, [id_col, group_col, label_col], "items")
    check_fractions(fractions)
    reject_nulls(items, [label_col], "items")
    assigned = assign_groups(group_table(items, id_col, group_col, label_col), "group_key", fractions, seed)
    assigned = assigned.withColumnRenamed("group_key", "_g")
    keyed = items.withColumn("_g", own_group_key(F.col(group_col), F.col(id_col)))
    return keyed.join(assigned, "_g").select(*items.columns, "split")


def cluster_assignment(
    clustered: DataFrame,
    id_col: str = "id",
    label_col: str | None = "label",
    fractions: tuple[float, float, float] = DEFAULT_FRACTIONS,
) -> DataFrame:
    """Split clusters (``cluster_id`` = smallest member id) greedily; ties go to the first name."""
    positives = F.sum(F.col(label_col).cast("long")) if label_col else F.lit(0).cast("long")
    clusters = clustered.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), positives.alias("positives")
    )
    assigned = assign_groups(clusters, "cluster_id", fractions, seed=None)
    return clustered.join(assigned, "cluster_id").select(*clustered.columns, "split")


def external_split(rows: DataFrame, id_col: str, split_col: str = "split") -> DataFrame:
    """Adopt a split made elsewhere: ids as text, ``valid`` becomes ``val``."""
    name = F.when(F.col(split_col) == "valid", F.lit("val")).otherwise(F.col(split_col))
    return rows.select(F.col(id_col).cast("string").alias("id"), name.alias("split"))


def class_balance(assigned: DataFrame, label_col: str = "label") -> DataFrame:
    """``split, rate, n_pos, n_total`` for the three splits; zeros for an empty one."""
    counts = assigned.groupBy("split").agg(
        F.sum(F.col(label_col).cast("long")).alias("n_pos"), F.count(F.lit(1)).alias("n_total")
    )
    names = assigned.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return names.join(counts, "split", "left").select(
        "split",
        F.coalesce(F.col("n_pos") / F.col("n_total"), F.lit(0.0)).alias("rate"),
        zero("n_pos").alias("n_pos"),
        zero("n_total").alias("n_total"),
    )


def overlapping_ids(assigned: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that occur in more than one split; empty for a valid split."""
    pairs = assigned.groupBy(id_col).agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return pairs.where(F.col("a") != F.col("b")).select(id_col, F.col("a").alias("first_split"), F.col("b").alias("last_split"))


def check_disjoint(assigned: DataFrame, id_col: str = "id") -> DataFrame:
    bad = overlapping_ids(assigned, id_col).limit(5).collect()
    if bad:
        raise SchemaError(f"ids in several splits, for example {[r[0] for r in bad]}")
    return assigned


def split_keys(assigned: DataFrame, group_col: str = "group_key", split: str = "test") -> DataFrame:
    """Distinct non-empty group keys of one split."""
    return (
        assigned.where((F.col("split") == split) & F.col(group_col).isNotNull() & (F.col(group_col) != ""))
        .select(group_col)
        .distinct()
    )


def held_out(assigned: DataFrame, flag_col: str, split: str = "test") -> DataFrame:
    """Rows of one split whose membership flag is false."""
    return assigned.where((F.col("split") == split) & ~F.col(flag_col))


def rate_spread(balance: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Is the spread of the positive rates within the tolerance?"""
    spread = F.max("rate") - F.min("rate")
    return balance.agg(spread.alias("spread"), (spread <= tolerance).alias("stratified"))


def oversize_cluster(clustered: DataFrame, share: float = 0.10) -> DataFrame:
    """Largest cluster against the whole part of ``share`` of all rows."""
    sizes = clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    limit = F.floor(F.lit(share) * F.col("n_total"))
    return sizes.agg(F.max("size").alias("largest"), F.sum("size").alias("n_total")).select(
        "largest", "n_total", (F.col("largest") > limit).alias("oversize")
    )


def flag_rows(profiles: DataFrame, k: int, flags_col: str = "split_flags") -> DataFrame:
    """Rows with the side that the ``k``-th replicated split flag selects."""
    side = F.when(F.col(flags_col)[k], F.lit("train")).otherwise(F.lit("test"))
    return profiles.withColumn("side", side)


def flag_balance(profiles: DataFrame, flags_col: str = "split_flags", label_col: str = "label") -> DataFrame:
    """Class balance of every replicated split: ``split_no, in_train, n_pos, n_total, rate``."""
    long = profiles.select(F.posexplode(flags_col).alias("split_no", "in_train"), F.col(label_col).cast("long").alias("y"))
    return long.groupBy("split_no", "in_train").agg(
        F.sum("y").alias("n_pos"), F.count(F.lit(1)).alias("n_total"), F.avg("y").alias("rate")
    )
