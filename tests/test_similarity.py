import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from splitwright.operators import clusters, similarity, splits
from splitwright.operators.checks import SchemaError


def jaccard(a, b):
    return len(a & b) / len(a | b)


def make_sets(seed, n=150, vocabulary=300, copies=40, near=40, hot=True):
    """Random sets with exact copies, a family of near copies and a token that most sets share."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(set(rng.sample(range(10, vocabulary), rng.randint(1, 25))))
    for _ in range(copies):
        out.append(set(out[3]))
    base = set(rng.sample(range(10, vocabulary), 20))
    for k in range(near):
        out.append((base - {rng.choice(sorted(base))}) | {1000 + k})
    if hot:
        for s in out[::2]:
            s.add(7)
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return dict(zip(ids, out))


def frame(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, fp array<long>")


def brute_components(sets, threshold):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if jaccard(sets[a], sets[b]) >= threshold:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("block", [20_000, 9])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(similarity, "POSTING_BLOCK", block)
    sets = make_sets(1)
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    reps = {i: set(s) for s, i in first.items()}
    want = {}
    for a, b in itertools.combinations(sorted(reps), 2):
        if (s := jaccard(reps[a], reps[b])) >= threshold:
            want[(a, b)] = s
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in similarity.similar_pairs(frame(spark, sets), threshold).collect()}
    assert got == want


@pytest.mark.parametrize("threshold", [0.3, 0.6])
@pytest.mark.parametrize("block", [20_000, 9])
def test_clusters_equal_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(similarity, "POSTING_BLOCK", block)
    for seed in (2, 3):
        sets = make_sets(seed)
        got = {r["id"]: r["cluster_id"] for r in clusters.link_clusters(frame(spark, sets), threshold).collect()}
        assert got == brute_components(sets, threshold)


@pytest.mark.parametrize(("heavy", "block"), [(None, 20_000), (10_000, 9), (20, 20_000), (0, 9)])
def test_max_similarity_equals_brute_force(spark, monkeypatch, heavy, block):
    monkeypatch.setattr(similarity, "POSTING_BLOCK", block)
    if heavy is not None:
        monkeypatch.setattr(similarity, "heavy_df", lambda sets: heavy)
    sets = make_sets(5)
    sets[9999], sets[9998] = {123456}, {7}
    test = {i: s for i, s in sets.items() if i % 3 == 0}
    train = {i: s for i, s in sets.items() if i % 3}
    got = {r["id"]: r["max_similarity"] for r in similarity.max_similarity(frame(spark, test), frame(spark, train)).collect()}
    assert got == {i: max(jaccard(s, t) for t in train.values()) for i, s in test.items()}
    none = similarity.max_similarity(frame(spark, test), frame(spark, train).limit(0))
    assert none.agg(F.max("max_similarity"), F.count("*")).first() == (0.0, len(test))


@pytest.mark.parametrize("shape", ["chain", "star", "ring", "random"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {
        "chain": [(i, i + 1) for i in range(60)] + [(100, 101)],
        "star": [(500, i) for i in range(200)] + [(1000, 1001), (1001, 1000)],
        "ring": [(i, (i + 1) % 31) for i in range(31)] + [(40, 40)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
    }[shape]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    links = {n: {n} for n in nodes}
    for a, b in edges:
        if a != b:
            joined = links[a] | links[b]
            for n in joined:
                links[n] = joined
    want = {n: min(links[n]) for n in nodes}
    got = clusters.connected_components(spark.createDataFrame(edges, "id_a long, id_b long")).collect()
    assert len(got) == len(want) and {r["id"]: r["component"] for r in got} == want


def test_cluster_split_keeps_similar_items_together(spark):
    sets = make_sets(6, hot=False)
    items = frame(spark, sets).withColumn("label", (F.col("id") % 2).cast("int"))
    out = clusters.cluster_split(items, threshold=0.4).cache()
    assert out.count() == len(sets)
    by_split = {s: [sets[r["id"]] for r in out.collect() if r["split"] == s] for s in splits.SPLITS}
    for a, b in itertools.combinations(splits.SPLITS, 2):
        assert all(jaccard(x, y) < 0.4 for x in by_split[a] for y in by_split[b])
    largest = splits.oversize_cluster(out).first()
    assert largest["largest"] >= 40 and largest["oversize"]
    unlabelled = clusters.cluster_split(items.drop("label"), label_col=None)
    assert unlabelled.count() == len(sets)


def test_cluster_split_rejects_empty(spark):
    bad = spark.createDataFrame([(1, [1], 0), (2, [], 1)], "id long, fp array<long>, label int")
    with pytest.raises(SchemaError, match="fingerprint"):
        clusters.cluster_split(bad)
    with pytest.raises(SchemaError, match="threshold"):
        clusters.cluster_split(bad.where("id = 1"), threshold=1.5)


def test_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.1, 0.95, 1.0, 0.999)], "max_similarity double")
    got = [(r["low"], r["high"], r["n"]) for r in similarity.similarity_histogram(df).orderBy("low").collect()]
    assert [g[2] for g in got] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 3]
    assert got[3][:2] == (0.3, 0.4) and math.isclose(got[9][1], 1.0)


def test_grid_sends_one_copy_to_each_pair_of_blocks(spark, monkeypatch):
    """A token in a third of the sets: no task sees more than a block of either side."""
    monkeypatch.setattr(similarity, "POSTING_BLOCK", 50)
    rows = [(i, 5 + i % 20, 1 if i % 3 == 0 else 100 + i // 2) for i in range(1200)]
    df = spark.createDataFrame([(t, 400, i, n) for i, n, t in rows], "token long, df long, id long, n int")
    grid = similarity._grid(df, df, 0.4)
    assert [r["token"] for r in grid.collect()] == [1]
    sides = {s: similarity._cells(df, grid, s, 0.4).where("token = 1").collect() for s in "lr"}
    for side, own in (("l", "c"), ("r", "d")):
        cells = {}
        for r in sides[side]:
            cells.setdefault(tuple(r["cell"]), []).append(r["id"])
        assert max(map(len, cells.values())) < 100 and all(len(set(x)) == len(x) for x in cells.values())
        copies = [sum(r["id"] == i for r in sides[side]) for i in range(0, 1200, 3)]
        assert max(copies) <= 12
    met = similarity._blocked_join(df, df, F.col("l.id") < F.col("r.id"), 0.4).select("l.id", "r.id", "l.n", "r.n", "l.token").collect()
    got = sorted((a, b) for a, b, n, m, _ in met if min(n, m) >= 0.4 * max(n, m))
    want = [(i, j) for i, n, t in rows for j, m, u in rows if i < j and t == u and min(n, m) >= 0.4 * max(n, m)]
    assert got == sorted(want)


@pytest.mark.parametrize("threshold", [0.3, 0.7])
def test_join_report_counts_shrink_to_the_pairs(spark, threshold):
    sets = make_sets(12, n=300, vocabulary=120, copies=5)
    got = {r["step"]: r["pairs"] for r in similarity.join_report(frame(spark, sets), threshold).collect()}
    distinct = {frozenset(s) for s in sets.values()}
    pairs = sum(jaccard(a, b) >= threshold for a, b in itertools.combinations(distinct, 2))
    assert got["prefix"] > got["sketch"] >= got["count"] >= got["similar"] == pairs


@pytest.mark.parametrize("size", [3, 500_000])
def test_local_forests_keep_components(spark, monkeypatch, size):
    monkeypatch.setattr(clusters, "FOREST_LINKS", size)
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] * 3
    links = spark.createDataFrame([(max(e), min(e)) for e in edges if e[0] != e[1]], "v long, u long").repartition(2)
    forest = [tuple(r) for r in clusters.local_forests(links).collect()]
    assert all(v > u for v, u in forest) and (size == 3 or len(forest) < 90)
    want = clusters.connected_components(links.selectExpr("v as id_a", "u as id_b")).collect()
    got = clusters.connected_components(spark.createDataFrame(forest, "id_a long, id_b long")).collect()
    assert sorted(got) == sorted(want)
    text = links.selectExpr("concat('n', v) as id_a", "concat('n', u) as id_b")
    assert clusters.connected_components(text).count() == len(want)
