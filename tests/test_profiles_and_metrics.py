import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from splitwright.operators import evaluation, profiles, ranking, scan, signatures
from splitwright.operators.checks import SchemaError


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame([(f"id_{i:04d}", [float(i), float(-i), 1.0]) for i in range(100)], "colid string, data array<float>")


def test_lookup(spark, store):
    queries = spark.createDataFrame([(0, "id_0042"), (1, "nope"), (2, "id_0007"), (3, "id_0042")], "src_row long, profile_id string")
    out = profiles.lookup_profiles(queries, store).orderBy("src_row").collect()
    assert [r["data"][0] if r["found"] else None for r in out] == [42.0, None, 7.0, 42.0]
    assert [r[1] for r in profiles.missing_ids(queries, store).collect()] == ["nope"]
    row = profiles.miss_rate(profiles.lookup_profiles(queries, store)).first()
    assert (row["n_input"], row["n_missing"], row["miss_rate"]) == (4, 1, 0.25)
    assert profiles.miss_rate(profiles.lookup_profiles(queries.limit(0), store)).first()["miss_rate"] == 0.0


def test_store_shape(spark, store):
    dims = spark.createDataFrame([(i, f"g{i}") for i in range(3)], "pos long, rowid string")
    assert profiles.vector_width_check(store, dims).first()["ok"]
    assert not profiles.vector_width_check(store, dims.limit(2)).first()["ok"]


def test_correlation(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(20, 5))
    b = np.column_stack([a[:, 0], -a[:, 1], a[:, 2] + rng.normal(size=20), np.full(20, 0.1), a[:, 4] * 3 + 1])
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<double>, b array<double>").repartition(4)
    got = {r["pos"]: r["r"] for r in profiles.dimension_correlation(df).collect()}
    for k in (0, 1, 2, 4):
        assert got[k] == pytest.approx(np.corrcoef(a[:, k], b[:, k])[0, 1], abs=1e-12)
    assert math.isnan(got[3])
    row = profiles.correlation_summary(profiles.dimension_correlation(df)).first()
    assert row["n_finite"] == 4 and row["n_low"] == 2


def test_align(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row_idx long, x string")
    right = spark.createDataFrame([(0, "u"), (1, "v")], "row_idx long, y string")
    assert sorted(tuple(r) for r in profiles.align_by_row(left, right).collect()) == [(0, "u", "a"), (1, "v", "b")]
    with pytest.raises(SchemaError, match="align"):
        profiles.align_by_row(right, left)


def test_profile_table(spark):
    rows = [("CGS001_MCF7_24H:BRD-K12345678:10", "x", "CC", None, 1, True), ("CPC020_HEPG2_6H:BRD-K01234567:high", "y", "CN", "Most", 0, True),
            ("bad", "z", None, None, 0, False)]
    df = spark.createDataFrame(rows, "profile_id string, name string, canonical string, severity string, label int, matched boolean")
    out = profiles.profile_table(df)
    assert out.columns == profiles.PROFILE_TABLE_COLUMNS
    first, second = out.orderBy("profile_id").collect()
    assert (first["brd_id"], first["cell_id"], first["time_h"], first["dose_um"], first["severity"]) == ("BRD-K12345678", "MCF7", 24, 10.0, "")
    assert math.isnan(second["dose_um"]) and len(second["tuple_key"]) == 16
    with pytest.raises(Exception, match="cannot parse profile id"):
        profiles.profile_table(df.withColumn("matched", F.lit(True)).withColumn("canonical", F.lit("c"))).collect()


def test_disagreements(spark):
    rows = spark.createDataFrame([(i, n, l) for i, (n, l) in enumerate([("A ", 1), ("b", 0), ("a", 1), ("c", 1)])], "src_row long, name string, label int")
    registry = spark.createDataFrame([(0, "a", 1), (1, "A", 0), (2, "b", 0)], "src_row long, name string, label int")
    report = profiles.disagreement_report(profiles.label_disagreements(rows, registry))
    assert [r["name"] for r in report.collect()] == ["A ", "a"]


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(["hot"] * 8 + ["a", "b"], 400), "o": rng.permutation(400), "v": rng.integers(1, 9, 400)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scan.running_sums(spark.createDataFrame(pdf), ["g"], [F.asc("o")], {"total": F.col("v"), "n": F.lit(1)}).toPandas()
        all_ = scan.running_sums(spark.createDataFrame(pdf), [], [F.desc("o")], {"total": F.col("v")}).toPandas()
        numbered = scan.dense_row_number(spark.createDataFrame(pdf), ["o"]).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = pdf.sort_values("o").assign(total=lambda d: d.groupby("g").v.cumsum(), n=lambda d: d.groupby("g").cumcount() + 1)
    key = lambda d: d.sort_values("o")[["o", "total", "n"]].values.tolist()
    assert key(out) == key(want)
    assert all_.sort_values("o").total.tolist() == pdf.sort_values("o", ascending=False).v.cumsum().tolist()[::-1]
    assert (numbered.o == numbered.row_idx).all() and len(numbered) == 400


def score_lists(seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for k, n in enumerate((1, 2, 5, 17, 40)):
        label = rng.integers(0, 5, n).astype(float)
        out.append((k, label, np.round(rng.normal(size=n), 1)))
    return out


@pytest.fixture(scope="module")
def lists(spark):
    rows = [(k, i, float(l), float(p)) for k, label, pred in score_lists() for i, (l, p) in enumerate(zip(label, pred))]
    return spark.createDataFrame(rows, "list_id long, pos long, label double, pred double").repartition(4).cache()


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def plain_metrics():
    ranknet = listnet = listmle = cosine = ndcg = 0.0
    data = score_lists()
    for _, l, p in data:
        for i in range(len(l)):
            for j in range(i + 1, len(l)):
                d = p[i] - p[j]
                ranknet += (1 - np.sign(l[i] - l[j])) * d / 2 + np.log(1 + np.exp(-d))
        listnet += -(softmax(l) * np.log(softmax(p))).sum() / len(data)
        q = p[np.argsort(-l, kind="stable")]
        listmle += sum(np.log(np.exp(q[i:]).sum()) - q[i] for i in range(len(q))) / len(data)
        cosine += (1 - (l @ p) / max(np.linalg.norm(l) * np.linalg.norm(p), 1e-8)) / 0.5
        d = p[:, None] - p[None, :]
        rank = 0.5 + np.where(d == 0, 0, 1 / (1 + np.exp(50 * d))).sum(1)
        dcg = ((2**l - 1) / np.log2(rank + 1)).sum()
        ideal = ((2 ** np.sort(l)[::-1] - 1) / np.log2(np.arange(len(l)) + 2)).sum()
        ndcg += (dcg / ideal if ideal else math.nan) / len(data)
    return ranknet, listnet, listmle, cosine, -ndcg


def scalar(df):
    return df.first()["value"]


@pytest.mark.parametrize("block", [256, 4])
def test_list_metrics(spark, lists, block):
    ranknet, listnet, listmle, cosine, ndcg = plain_metrics()
    assert scalar(ranking.ranknet(lists, block)) == pytest.approx(ranknet, rel=1e-12)
    assert scalar(ranking.listnet(lists)) == pytest.approx(listnet, rel=1e-12)
    assert scalar(ranking.listmle(lists)) == pytest.approx(listmle, rel=1e-12)
    assert scalar(ranking.rank_cosine(lists)) == pytest.approx(cosine, rel=1e-12)
    per_list = ranking.approximate_ndcg_per_list(lists, block=block)
    assert scalar(per_list.agg((-F.avg("ndcg")).alias("value"))) == pytest.approx(ndcg, rel=1e-12, nan_ok=True)


def test_simple_metrics(spark, lists):
    l = np.concatenate([x[1] for x in score_lists()])
    p = np.concatenate([x[2] for x in score_lists()])
    mse = ((l - p) ** 2).mean()
    assert scalar(ranking.mean_squared_error(lists)) == pytest.approx(mse)
    assert scalar(ranking.squared_error_and_cosine(lists)) == pytest.approx(mse + scalar(ranking.rank_cosine(lists)))
    r = sum(np.corrcoef(a, b)[0, 1] for _, a, b in score_lists() if a.std() and b.std())
    assert scalar(ranking.negative_pearson(lists, skip_undefined=True)) == pytest.approx(-r)
    assert math.isnan(scalar(ranking.negative_pearson(lists)))


def test_cross_entropy_and_homophily(spark, lists):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(30, 4)), rng.integers(0, 3, 30)
    df = spark.createDataFrame([(v.tolist(), v.tolist(), int(c)) for v, c in zip(x, y)], "logits array<double>, vector array<double>, label int")
    want = np.mean([-np.log(softmax(v)[c]) for v, c in zip(x, y)])
    assert scalar(ranking.cross_entropy(df)) == pytest.approx(want)
    off = (y[:, None] != y[None, :]).astype(float)
    penalty = np.trace(x.T @ (np.diag(off.sum(1)) + off) @ x) + 0.1 * np.linalg.norm(x)
    assert scalar(ranking.homophily(df)) == pytest.approx(penalty)
    both = scalar(ranking.squared_error_and_homophily(lists, df))
    assert both == pytest.approx(scalar(ranking.mean_squared_error(lists)) + 0.5 * penalty)


def test_gate_routing(spark):
    x = np.random.default_rng(6).normal(size=(50, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, logits array<double>")
    probs = np.array([softmax(v) for v in x])
    load = np.zeros(4)
    for v in x:
        load[np.argsort(-v)[:2]] += 1
    got = ranking.gate_routing(df, 2).orderBy("expert").toPandas()
    assert np.allclose(got.importance, probs.sum(0)) and (got.load == load).all()
    cv = lambda a: a.std(ddof=1) / (a.mean() + 1e-6)
    assert scalar(ranking.routing_balance(ranking.gate_routing(df, 2))) == pytest.approx(cv(probs.sum(0)) + cv(load))
    top = ranking.top_gate_weights(df, 2).orderBy("id").first()
    assert sum(top["weights"]) == pytest.approx(1.0) and top["experts"] == np.argsort(-x[0])[:2].tolist()


def test_classifier_metrics(spark):
    rng = np.random.default_rng(8)
    rows = [(s, int(y), float(v)) for s in ("all", "novel") for y, v in zip(rng.integers(0, 2, 60), rng.integers(0, 11, 60) / 10)]
    rows += [("single", 1, 0.7), ("single", 1, 0.2)]
    out = {r["slice"]: r for r in evaluation.classifier_metrics(spark.createDataFrame(rows, "slice string, label int, score double")).collect()}
    for s in ("all", "novel"):
        y, v = (np.array(c) for c in zip(*[(r[1], r[2]) for r in rows if r[0] == s]))
        pos, neg = v[y == 1], v[y == 0]
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
        ap, last = 0.0, 0.0
        for t in sorted(set(v), reverse=True):
            recall, precision = (pos >= t).mean(), y[v >= t].mean()
            ap, last = ap + (recall - last) * precision, recall
        tp, fp, fn, tn = (pos >= 0.5).sum(), (neg >= 0.5).sum(), (pos < 0.5).sum(), (neg < 0.5).sum()
        mcc = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        assert out[s]["auroc"] == pytest.approx(auc) and out[s]["auprc"] == pytest.approx(ap)
        assert out[s]["mcc"] == pytest.approx(mcc)
        assert out[s]["balanced_accuracy"] == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
    assert out["single"]["auroc"] is None and out["single"]["mcc"] == 0.0


def test_seeds_and_bootstrap(spark):
    runs = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("A", 3.0), ("B", 1.0)], "condition string, value double")
    got = {r["condition"]: (r["mean"], r["std"], r["enough"]) for r in evaluation.seed_summary(runs, ["condition"]).collect()}
    assert got == {"A": (2.0, 1.0, True), "B": (1.0, None, False)}
    rng = np.random.default_rng(9)
    gain = rng.normal(0.3, 1.0, 200)
    df = spark.createDataFrame([(i, float(g)) for i, g in enumerate(gain)], "id long, gain double")
    means = evaluation.bootstrap_means(df, "id", "gain", resamples=2001)
    row = evaluation.bootstrap_interval(means).first()
    assert means.count() == 2001
    error = gain.std() / math.sqrt(200)
    assert row["mean"] == pytest.approx(gain.mean(), abs=0.2 * error)
    assert row["low"] == pytest.approx(gain.mean() - 1.96 * error, abs=0.35 * error)
    assert row["high"] == pytest.approx(gain.mean() + 1.96 * error, abs=0.35 * error)


def test_severity(spark):
    df = spark.createDataFrame([("No", 0.1), ("Less", 0.5), ("Most", 0.4), ("?", 9.0)], "severity string, score double")
    trend = evaluation.severity_trend(df, ("No", "Less", "Most"))
    assert [(r["level"], r["rising"]) for r in trend.orderBy("level").collect()] == [(1, True), (2, True), (3, False)]
    assert not evaluation.is_monotone(trend).first()[0]


def test_signatures(spark):
    df = spark.createDataFrame([(1, "c1", [1.0, 3.0]), (1, "c1", [3.0, 5.0]), (2, "c1", [0.0, 1.0]), (2, "c2", [2.0, 2.0])], "id long, cell string, vector array<double>")
    means = signatures.replicate_mean(df, ["id", "cell"])
    assert {(r["id"], r["cell"]): r["vector"] for r in means.collect()} == {(1, "c1"): [2.0, 4.0], (2, "c1"): [0.0, 1.0], (2, "c2"): [2.0, 2.0]}
    wanted = spark.createDataFrame([(1, "c1"), (1, "c2")], "id long, cell string")
    grid = {(r["id"], r["cell"]): r["vector"] for r in signatures.measured_grid(wanted, means, ["id", "cell"]).collect()}
    assert grid == {(1, "c1"): [2.0, 4.0], (1, "c2"): None}
    base = spark.createDataFrame([("c1", [1.0, 1.0]), ("c2", [0.0, 5.0])], "cell string, vector array<double>")
    diff = {(r["id"], r["cell"]): r["vector"] for r in signatures.differential(means, base).collect()}
    assert diff[(1, "c1")] == [1.0, 3.0] and diff[(2, "c2")] == [2.0, -3.0]
    top = signatures.top_dimensions(spark.createDataFrame([(1, [0.1, -5.0, 2.0, 5.0])], "id long, vector array<double>"), 2)
    assert top.first()["top"] == [1, 3]
    vectors = spark.createDataFrame([(i, [float(i), float(i % 2), 1.0, float(-i)], i) for i in range(10)], "id long, vector array<double>, viability int")
    masked = signatures.confounded_dimensions(vectors, "viability", share=0.7)
    assert sorted(r["pos"] for r in masked.collect()) == [0, 3]
    out = signatures.mask_dimensions(vectors, masked).where("id = 4").first()
    assert out["vector"] == [0.0, 0.0, 1.0, 0.0] and out["masked_mean"] == 0.0
    ranked = signatures.top_attributions(vectors, 2).collect()
    assert [r["pos"] for r in ranked] == [0, 3]
    pairs = vectors.select(F.lit("c").alias("cell"), F.col("vector").alias("a"), F.col("vector").alias("b"))
    assert signatures.agreement_gate(signatures.agreement_per_cell(pairs)).first()["passed"]


def test_resamples_follow_the_hash_rule(spark):
    """The multiplicities are a pure function of id, resample and seed, whatever the partitions."""
    rows = [(f"r{i}", float(i % 7) - 2.0) for i in range(37)]
    want = []
    for resample in range(1003):
        s = n = 0.0
        for name, value in rows:
            digest = hashlib.md5(f"{name}:{resample // 4}:5".encode()).hexdigest()
            uniform = int(digest[8 * (resample % 4) : 8 * (resample % 4) + 8], 16) / 2**32
            weight, total = 0, math.exp(-1)
            while uniform >= total and weight < 16:
                weight += 1
                total += math.exp(-1) / math.factorial(weight)
            s, n = s + weight * value, n + weight
        want.append((resample, s / n))
    df = spark.createDataFrame([*rows, (None, 5.0)], "id string, gain double")
    for parts in (1, 6):
        got = evaluation.bootstrap_means(df.repartition(parts), "id", "gain", resamples=1003, seed=5).orderBy("resample").collect()
        assert [r["resample"] for r in got] == list(range(1003))
        assert [r["mean"] for r in got] == pytest.approx([m for _, m in want], rel=1e-12)
    assert evaluation.bootstrap_means(df.limit(0), "id", "gain", resamples=10).count() == 0


def test_long_and_short_lists_together(spark):
    """Lists of one block, of several, and of exactly a block agree with the plain sums at every block size."""
    rng = np.random.default_rng(4)
    rows = [(k, p, float(rng.integers(0, 4)), float(rng.normal())) for k, n in enumerate((1, 2, 7, 8, 9, 40)) for p in range(n)]
    df = spark.createDataFrame(rows, "list_id long, pos long, label double, pred double").repartition(3)
    for metric, name in ((ranking.ranknet_per_list, "loss"), (ranking.approximate_ndcg_per_list, "ndcg")):
        results = [{r["list_id"]: r[name] for r in metric(df, block=b).collect()} for b in (1000, 8, 3)]
        assert len(results[0]) == 6
        for other in results[1:]:
            assert other == pytest.approx(results[0], rel=1e-10, nan_ok=True)
        named = metric(df.withColumn("list_id", F.concat(F.lit("l"), "list_id")), block=8)
        assert named.count() == 6


def test_only_probed_rows_of_the_store_travel(spark, store):
    queries = spark.createDataFrame([("id_0003",), ("id_0003",), ("id_0050",), (None,), ("other",)], "profile_id string")
    probed = profiles.probed_rows(store, "colid", queries, "profile_id")
    assert {"id_0003", "id_0050"} <= {r["colid"] for r in probed.collect()} and probed.count() <= 3
    every = spark.range(3000).select(F.format_string("id_%04d", "id").alias("profile_id"))
    assert profiles.probed_rows(store, "colid", every, "profile_id").count() == 100
    nulls = spark.range(500).select(F.lit(None).cast("string").alias("profile_id"), "id")
    looked = profiles.lookup_profiles(nulls.unionByName(nulls.limit(1).withColumn("profile_id", F.lit("id_0001"))), store)
    assert looked.count() == 501 and looked.where("found").count() == 1
    assert profiles.missing_ids(nulls, store).count() == 500
    repeated = store.withColumn("src_row", F.lit(1)).unionByName(store.withColumn("data", F.array(F.lit(7.0))).withColumn("src_row", F.lit(2)))
    assert {tuple(r["data"]) for r in profiles.lookup_profiles(queries, repeated).where("found").collect()} == {(7.0,)}
