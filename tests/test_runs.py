import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitwright import runs
from splitwright.functions.sets import hashed_shingles
from splitwright.operators.checks import SchemaError
from splitwright.session import checkpointed, run_scratch, scratch_root, settled, stored
from splitwright.sources.splits import read_split


def test_names_to_registry(spark, tmp_path):
    labels = spark.createDataFrame(
        [(0, 1, "Aspirin", "1"), (1, 2, "Caffeine citrate", "0"), (2, 3, "Unknown", "1"), (3, 4, "Broken", "1"), (4, 5, "Third", "2")],
        "src_row long, id long, name string, label string",
    )
    index = spark.createDataFrame([("aspirin", "CC"), ("caffeine", "CN"), ("broken", "?"), ("third", "OO")], "name_key string, structure string")
    out = runs.resolve_run(labels, index, str(tmp_path), valid=lambda c: c != "?")
    assert sorted(tuple(r)[::2] for r in out["rejected"].collect()) == [(3, "name_not_in_index"), (4, "structure_parse_failure")]
    assert out["gates"].first()["status"] == "fail"
    assert spark.read.option("header", True).csv(str(tmp_path / "resolved")).count() == 3
    resolved = out["resolved"].withColumn("group_key", F.lit("k"))
    severities = spark.createDataFrame([(0, "aspirin sodium", "Most")], "src_row long, name string, severity string")
    member = spark.createDataFrame([("ASPIRIN",)], "name string")
    built = runs.registry_run(labels, severities, resolved, member, member, str(tmp_path))
    row = built["summary"].first()
    assert (row["n_registry"], row["n_listed"], row["n_pos"], row["severity_count"], row["upstream_count"]) == (2, 5, 1, 1, 1)


def test_split_run(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words, 20))
        rows.append((i, f"Item {i}", f"g{i % 40}" if i % 5 else "", int(i % 2), i % 3 == 0, i % 4 == 0, text))
        if i % 10 == 0:
            rows.append((1000 + i, f"Copy {i}", f"c{i}", int(i % 2), False, False, text + " tail"))
    items = spark.createDataFrame(rows, "id long, name string, group_key string, label int, in_measured boolean, in_upstream boolean, text string")
    items = items.select("id", "name", "group_key", "label", "in_measured", "in_upstream", hashed_shingles(F.col("text")).alias("fp"))
    upstream = items.where("in_upstream").select(F.col("id").alias("src_row"), F.upper("name").alias("name"), "group_key")
    external = spark.createDataFrame([(1, "train"), (2, "valid"), (3, "test")], "id long, split string")
    with run_scratch(spark) as scratch:
        out = runs.split_run(items, upstream, str(tmp_path), external=external)
        assert os.listdir(scratch.removeprefix("file:"))
        out = {name: spark.createDataFrame(df.collect(), df.schema) for name, df in out.items()}
    assert not os.path.exists(scratch.removeprefix("file:"))  # nothing is left of the run
    value = {(r["section"], r["metric"]): r["value"] for r in out["diagnostics"].collect()}
    assert sum(value[("group_split", f"n_total_{s}")] for s in ("train", "val", "test")) == 132
    n_test = value[("cluster_split", "n_total_test")]
    bins = {m: v for (s, m), v in value.items() if s == "cluster_split_similarity" and m.startswith("n_")}
    assert sum(bins.values()) == n_test and sum(v for m, v in bins.items() if float(m[2:]) >= 0.4) == 0
    assert value[("novelty_slices", "n_drift")] == 0
    assert value[("external_split", "size_val")] == 1
    f = {m: v for (s, m), v in value.items() if s == "upstream_filter"}
    assert f["total"] - (f["excluded_by_key"] + f["excluded_by_name"] - f["excluded_intersection"]) == f["train_after_exclusion"]
    written = {r["split"]: r["count"] for r in read_split(spark, str(tmp_path / "group_split")).groupBy("split").count().collect()}
    assert written["train"] + written["val"] + written["test"] == 132
    assert written["test_in_upstream"] + written["test_name_novel"] == written["test"]
    assert written["train_upstream"] == f["train_after_exclusion"]
    assert out["gates"].first()["threshold"] == ">= 30"
    # the written split is enough to filter measurements by
    index = items.select(F.lower("name").alias("name_key"), F.lit("S").alias("structure"), "group_key")
    rows = items.select(F.col("id").alias("row_id"), F.col("name").alias("drug_name"))
    reports = runs.leakage_run({"m": rows}, index, items, str(tmp_path), split_path=str(tmp_path / "group_split"))
    test = {r["id"] for r in read_split(spark, str(tmp_path / "group_split")).where("split = 'test'").collect()}
    keys = {r["group_key"] for r in items.collect() if str(r["id"]) in test} - {""}
    left = [r for r in items.collect() if str(r["id"]) not in test and r["group_key"] not in keys]
    assert reports["m"].first()["n_out"] == len(left) > 0


def test_leakage_run(spark, tmp_path):
    protected = spark.createDataFrame([(1, "Alpha", "k1")], "id long, name string, group_key string")
    index = spark.createDataFrame([("beta", "B", "k1"), ("gamma", "G", "")], "name_key string, structure string, group_key string")
    rows = spark.createDataFrame([(1, "alpha"), (2, "Beta"), (3, "gamma")], "row_id long, drug_name string")
    other = spark.createDataFrame([(1, 2.0)], "row_id long, z double")
    reports = runs.leakage_run({"first": rows, "second": other}, index, protected, str(tmp_path))
    assert list(reports) == ["first"] and reports["first"].first()["n_out"] == 1
    assert [r["drug_name"] for r in spark.read.parquet(str(tmp_path / "first")).collect()] == ["gamma"]
    assert spark.read.parquet(str(tmp_path / "second")).count() == 1


def test_profile_run(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(30, 4))
    ids = [f"CGS{i:03d}_{'MCF7' if i % 2 else 'HEPG2'}_24H:BRD-K{i:08d}:{i % 3}" for i in range(30)]
    store = spark.createDataFrame([(c, v.tolist()) for c, v in zip(ids[:28], data)], "colid string, data array<double>")
    rows = [(i, c, f"Drug{i % 5} sodium", i % 2, v.tolist(), [True, False]) for i, (c, v) in enumerate(zip(ids, data))]
    profile_rows = spark.createDataFrame(
        rows, "row_idx long, profile_id string, name string, label int, expressions array<double>, split_flags array<boolean>"
    )
    known = spark.createDataFrame([(k, f"drug{k}", f"C{k}", "Most", 1) for k in range(4)], "src_row long, name string, canonical string, severity string, label int")
    known = known.withColumn("name", F.concat("name", F.lit(" sodium")))
    out = runs.profile_run(profile_rows, store, known, str(tmp_path), flag_width=2)
    assert out["miss_rate"].first()["n_missing"] == 2
    assert out["correlation"].first()["mean_r"] == pytest.approx(1.0)
    assert out["profiles"].count() == 23 and out["dropped"].count() == 5
    assert out["status"].first()[0] == "lookup_miss"
    assert out["conflict_names"].count() == 10
    assert sum(r["n"] for r in out["cells"].collect()) == 23 == sum(r["n"] for r in out["doses"].collect())
    assert spark.read.parquet(str(tmp_path / "masks")).columns == ["row_idx", "split_00", "split_01"]


def test_profile_source_run(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(20, 4))
    ids = [f"CGS{i:03d}_MCF7_24H:BRD-K{i:08d}:{i % 3}" for i in range(20)]
    store = spark.createDataFrame([(c, v.tolist()) for c, v in zip(ids, data)], "colid string, data array<double>")
    # the places have gaps, and the set is longer than the list of ids
    rows = [(3 * i, f"Drug{i % 2}", float(i % 2), v.tolist(), [True, False]) for i, v in enumerate([*data, data[0]])]
    source = spark.createDataFrame(rows[::-1], "src_row long, drug_name string, y double, X array<double>, splits array<boolean>")
    listed = spark.createDataFrame([(5 * i, "x", f" {c} ") for i, c in enumerate(ids)][::-1], "src_row long, comment string, other string")
    known = spark.createDataFrame([(0, "Drug0", "C0", "Most", 0), (1, "Drug1", "C1", "No", 1)], "src_row long, name string, canonical string, severity string, label int")
    (tmp_path / "raw.bin").write_bytes(b"abc")
    widths = {"expression_width": 4, "flag_width": 2}
    out = runs.profile_source_run(source, listed, store, known, str(tmp_path / "out"), [str(tmp_path / "raw.bin")], expected_ids=20, **widths)
    assert out["manifest"].first()["n_bytes"] == 3
    assert out["miss_rate"].first()["n_found"] == 20 == out["profiles"].count()
    assert out["correlation"].first()["mean_r"] == pytest.approx(1.0)  # every id met its own profile
    assert out["conflict_names"].count() == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "manifest")).count() == 1
    with pytest.raises(SchemaError, match="expected 6000"):
        runs.profile_source_run(source, listed, store, known, str(tmp_path), **widths)
    with pytest.raises(SchemaError, match="bad_label"):
        runs.profile_source_run(source.withColumn("y", F.lit(0.5)), listed, store, known, str(tmp_path), expected_ids=20, **widths)
    with pytest.raises(SchemaError, match="cannot align"):
        runs.profile_source_run(source.limit(5), listed, store, known, str(tmp_path), expected_ids=20, **widths)


def test_settled_results_own_their_tables(spark):
    """Tables and checkpoints of a step go with it, its result stays until released, also inside another run."""
    with run_scratch(spark) as scratch:
        folder = scratch.removeprefix("file:")
        kept = stored(spark.range(5), "outer")
        step = lambda: checkpointed(stored(kept.withColumn("x", F.col("id") * 2), "inner")).groupBy().agg(F.sum("x").alias("s"))
        result = settled(spark, step, "result")
        left = [name.split("-")[0] for name in sorted(os.listdir(folder))]
        assert left.count("outer") == left.count("result") == 1 and not {"inner", "run"} & set(left)
        assert result.table.first()["s"] == 20 and kept.count() == 5
        result.release()
        assert not os.path.exists(result.path.removeprefix("file:"))
    roots = {scratch_root(spark)}
    settled(spark, lambda: spark.range(1), "result").release()
    assert roots == {scratch_root(spark)}


def test_a_failing_step_leaves_nothing(spark):
    with run_scratch(spark) as scratch:
        def fails():
            stored(spark.range(3), "inner")
            raise ValueError("no")

        with pytest.raises(ValueError):
            settled(spark, fails, "result")
        assert not [name for name in os.listdir(scratch.removeprefix("file:")) if name.startswith(("run-", "result"))]
