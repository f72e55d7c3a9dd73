import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitwright.operators import splits
from splitwright.operators.checks import SchemaError
from splitwright.operators.splits import Fill, Targets, greedy_fill, split_targets


def plain_greedy(groups, fractions=(0.8, 0.1, 0.1), seed=None, keys=None):
    """Straightforward form of the greedy rule on (size, positives) pairs in order."""
    n, p = sum(g for g, _ in groups), sum(q for _, q in groups)
    goal, pgoal = dict(zip(splits.SPLITS, split_targets(n, fractions))), dict(zip(splits.SPLITS, split_targets(p, fractions)))
    fill, pos = dict.fromkeys(splits.SPLITS, 0), dict.fromkeys(splits.SPLITS, 0)
    out = []
    for i, (g, q) in enumerate(groups):
        cost = {}
        for s in splits.SPLITS:
            over = max(0, fill[s] + g - goal[s])
            cost[s] = max(0, goal[s] - fill[s] - g) ** 2 + 10 * n * n * over + (pos[s] + q - pgoal[s]) ** 2
        tied = sorted(s for s in splits.SPLITS if cost[s] == min(cost.values()))
        mark = lambda s: hashlib.md5(f"{seed}:{keys[i]}:{s}".encode()).hexdigest()  # noqa: B023, E731
        pick = tied[0] if seed is None else min(tied, key=mark)
        fill[pick] += g
        pos[pick] += q
        out.append(pick)
    return out


def random_groups(rng, n, largest):
    size = np.sort(rng.integers(1, largest + 1, n))[::-1]
    return [(int(s), int(rng.integers(0, s + 1))) for s in size]


@pytest.mark.parametrize("seed", [None, 42])
@pytest.mark.parametrize("largest", [1, 3, 40])
def test_runs_equal_single_steps(seed, largest):
    rng = np.random.default_rng(largest)
    for n in (1, 5, 300, 3000):
        groups = random_groups(rng, n, largest)
        size, plus = np.array([g[0] for g in groups]), np.array([g[1] for g in groups])
        targets = Targets(split_targets(int(size.sum()), (0.8, 0.1, 0.1)), split_targets(int(plus.sum()), (0.8, 0.1, 0.1)))
        keys = [f"k{i}" for i in range(n)]
        picks, _ = greedy_fill(size, plus, Fill(), targets, keys, seed)
        assert [splits.SPLITS[k] for k in picks] == plain_greedy(groups, seed=seed, keys=keys)


def test_very_large_counts_stay_exact():
    rng = np.random.default_rng(3)
    groups = [(int(s) * 10**9, int(s) * 10**8 * 3) for s in np.sort(rng.integers(1, 90, 2000))[::-1]]
    size, plus = np.array([g[0] for g in groups]), np.array([g[1] for g in groups])
    targets = Targets(split_targets(int(size.sum()), (0.8, 0.1, 0.1)), split_targets(int(plus.sum()), (0.8, 0.1, 0.1)))
    picks, _ = greedy_fill(size, plus, Fill(), targets)
    assert [splits.SPLITS[k] for k in picks] == plain_greedy(groups)


@pytest.mark.parametrize("seed", [None, 42])
@pytest.mark.parametrize("largest", [1, 12])
def test_many_ranges_equal_one(spark, monkeypatch, seed, largest):
    """The assignment does not depend on how many tasks hold the ordered groups."""
    rng = np.random.default_rng(11)
    groups = random_groups(rng, 5000, largest)
    rows = [(f"g{rng.integers(10**9):010d}-{i}", s, p) for i, (s, p) in enumerate(groups)]
    rows.sort(key=lambda r: (-r[1], r[0]))
    df = spark.createDataFrame(rows, "group_key string, size long, positives long").repartition(8)
    want = dict(zip([r[0] for r in rows], plain_greedy([(r[1], r[2]) for r in rows], seed=seed, keys=[r[0] for r in rows])))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(splits, "stored", lambda df, label: df)  # without the written copy
    try:
        got = splits.assign_groups(df, "group_key", seed=seed)
        assert got.rdd.getNumPartitions() > 4
        as_dict = lambda d: {r[0]: r[1] for r in d.collect()}
        assert as_dict(got) == want
        # other task numbers and several ranges in one task change nothing
        assert as_dict(got.coalesce(1)) == want and as_dict(got.coalesce(3)) == want
        other = spark.createDataFrame([("x", "train")], "group_key string, split string").repartition(5)
        assert as_dict(other.union(got)) == want | {"x": "train"} == as_dict(got.union(other))
        some = spark.createDataFrame([(k,) for k in list(want)[::7]], "group_key string")
        assert as_dict(got.join(F.broadcast(some), "group_key").coalesce(1)) == {k: want[k] for k in list(want)[::7]}
        assert all(want[r[0]] == r[1] for r in got.limit(40).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_seeds_draw_differently(spark):
    rows = [(f"g{i:03d}", 1, 0) for i in range(300)]
    df = spark.createDataFrame(rows, "group_key string, size long, positives long")
    drawn = {tuple(sorted(map(tuple, splits.assign_groups(df, "group_key", seed=s).collect()))) for s in range(5)}
    assert len(drawn) > 1


# group -> (positive, negative) rows of the fixture; the last one has no key
FIXTURE = {"Sa": (4, 4), "Sb": (3, 3), "Sc": (3, 2), "Sd": (2, 2), "Se": (2, 2), "Sf": (2, 1), "Sg": (1, 2), "Sh": (2, 1),
           "Si": (1, 2), "Sj": (2, 1), "Sk": (1, 1), "": (2, 4)}


@pytest.fixture(scope="module")
def items(spark):
    rows, i = [], 0
    for key, (pos, neg) in FIXTURE.items():
        for label in [1] * pos + [0] * neg:
            i += 1
            rows.append((i, key, label))
    return spark.createDataFrame(rows, "id long, group_key string, label int")


def test_group_split_properties(spark, items):
    first = splits.group_split(items).select("id", "group_key", "label", "split").cache()
    again = splits.group_split(items.repartition(5))
    assert {r["id"]: r["split"] for r in first.collect()} == {r["id"]: r["split"] for r in again.collect()}
    assert first.count() == 50 and first.select("id").distinct().count() == 50
    per_group = first.where("group_key <> ''").groupBy("group_key").agg(F.countDistinct("split").alias("n"))
    assert per_group.agg(F.max("n")).first()[0] == 1
    balance = {r["split"]: r for r in splits.class_balance(first).collect()}
    assert abs(balance["train"]["rate"] - 0.5) <= 0.05
    assert sum(r["n_total"] for r in balance.values()) == 50
    assert splits.overlapping_ids(first).count() == 0
    splits.check_disjoint(first)
    with pytest.raises(SchemaError, match="several splits"):
        splits.check_disjoint(first.select("id", "split").unionByName(first.select("id", F.lit("val").alias("split"))))


def test_matches_plain_rule(spark, items):
    groups = splits.group_table(items, "id", "group_key", "label").collect()
    groups.sort(key=lambda r: (-r["size"], r["group_key"]))
    want = dict(zip([r["group_key"] for r in groups], plain_greedy([(r["size"], r["positives"]) for r in groups], seed=42, keys=[r["group_key"] for r in groups])))
    got = {r["group_key"] or f"_acyclic_{r['id']}": r["split"] for r in splits.group_split(items).collect()}
    assert got == want


def test_input_checks(spark, items):
    with pytest.raises(SchemaError, match="sum to 1.0"):
        splits.group_split(items, fractions=(0.5, 0.1, 0.1))
    with pytest.raises(SchemaError, match="label"):
        splits.group_split(items.drop("label"))
    with pytest.raises(SchemaError, match="label"):
        splits.group_split(items.withColumn("label", F.when(F.col("id") > 1, F.col("label"))))
    empty = splits.group_split(items.limit(0))
    assert empty.count() == 0


def test_balance_of_empty_split(spark):
    df = spark.createDataFrame([(1, "train", 1), (2, "train", 0)], "id long, split string, label int")
    got = {r["split"]: tuple(r)[1:] for r in splits.class_balance(df).collect()}
    assert got == {"train": (0.5, 1, 2), "val": (0.0, 0, 0), "test": (0.0, 0, 0)}


def test_external_and_flags(spark):
    df = spark.createDataFrame([(1, "valid"), (2, "train")], "Drug_ID int, split string")
    assert sorted(tuple(r) for r in splits.external_split(df, "Drug_ID").collect()) == [("1", "val"), ("2", "train")]
    prof = spark.createDataFrame([(1, [True, False]), (0, [False, False])], "label int, split_flags array<boolean>")
    assert [r["side"] for r in splits.flag_rows(prof, 0).collect()] == ["train", "test"]
    got = {(r["split_no"], r["in_train"]): (r["n_pos"], r["n_total"]) for r in splits.flag_balance(prof).collect()}
    assert got == {(0, True): (1, 1), (0, False): (0, 1), (1, False): (1, 2)}


def test_held_out_and_keys(spark):
    df = spark.createDataFrame(
        [(1, "test", "k", True), (2, "test", "", False), (3, "train", "j", False), (4, "test", None, False)],
        "id long, split string, group_key string, in_measured boolean",
    )
    assert sorted(r["id"] for r in splits.held_out(df, "in_measured").collect()) == [2, 4]
    assert [r[0] for r in splits.split_keys(df).collect()] == ["k"]


def walked(state, targets, size, plus, count, seed=None):
    """State and picks of single steps."""
    picks, end = greedy_fill(np.full(count, size), np.full(count, plus), state, targets, [""] * count, seed)
    return picks, end


def some_states(rng):
    """Start states in which the row and the label gaps of the splits pull in different directions."""
    rows = tuple(int(x) for x in rng.integers(0, 4000, 3))
    positives = tuple(int(x) for x in rng.integers(0, 3000, 3))
    targets = Targets(tuple(int(x) for x in rng.integers(1000, 6000, 3)), tuple(int(x) for x in rng.integers(0, 2000, 3)))
    return Fill(rows, positives), targets


def test_equal_groups_equal_single_steps():
    rng, alternating = np.random.default_rng(12), 0
    for _ in range(250):
        state, targets = some_states(rng)
        size, count = int(rng.integers(1, 9)), int(rng.integers(1, 3000))
        plus = int(rng.integers(0, size + 1))
        picks, end = walked(state, targets, size, plus, count)
        alternating += (np.diff(picks) != 0).mean() > 0.3
        assert splits.equal_groups(state, targets, size, plus, count, None) == end
        drawn = splits.equal_groups(state, targets, size, plus, count, 42)
        assert drawn is None or drawn == end
    assert alternating > 20


def test_first_failure_of_polynomials():
    for a in range(-3, 4):
        for b in range(-9, 10):
            for c in (-1, 0, 1, 5, 30):
                for last in (0, 1, 7):
                    want = next((t for t in range(last + 1) if a * t * t + b * t + c <= 0), last + 1)
                    assert splits._first_failure(a, b, c, last) == want


def alternating_case():
    """Equal groups after a few large ones, such that the equal ones alternate between splits."""
    large = [(2492, 2492), (2483, 2483), (2019, 0), (1946, 0), (1264, 1264), (884, 0), (73, 73)]
    groups, fractions = large + [(2, 2)] * 600, (0.5, 0.25, 0.25)
    size, plus = np.array([g[0] for g in groups]), np.array([g[1] for g in groups])
    targets = Targets(split_targets(int(size.sum()), fractions), split_targets(int(plus.sum()), fractions))
    picks, _ = greedy_fill(size, plus, Fill(), targets)
    assert (np.diff(picks[-600:]) != 0).mean() > 0.8
    return groups, fractions, targets, picks


def test_rounds_do_not_grow_with_ranges_of_equal_groups(spark):
    groups, fractions, targets, picks = alternating_case()
    rounds = []
    for ranges in (10, 50):
        rows = [(f"g{i:05d}", s, p, 0 if i < 7 else 1 + (i - 7) * (ranges - 1) // 600) for i, (s, p) in enumerate(groups)]
        df = spark.createDataFrame(rows, "key string, size long, positives long, _range int")
        starts, n = splits._range_start_states(df.coalesce(1).sortWithinPartitions("key"), "key", targets, None)
        assert len(starts) == ranges
        rounds.append(n)
    assert rounds[0] == rounds[1] == 1
    df = spark.createDataFrame([r[:3] for r in rows], "key string, size long, positives long")
    got = {r["key"]: r["split"] for r in splits.assign_groups(df, "key", fractions, None).collect()}
    assert got == {r[0]: splits.SPLITS[k] for r, k in zip(rows, picks)}
