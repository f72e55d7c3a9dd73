import pytest
from pyspark.sql import functions as F

from splitwright.operators import gates, leakage
from splitwright.operators.checks import SchemaError


@pytest.fixture(scope="module")
def registry(spark):
    rows = [(1, "one", "pyridine"), (2, "two", "furan"), (3, "three", ""), (4, "four", None), (5, "five", "thiophene"), (6, "six", "indole"),
            (7, "seven", "pyrrole"), (8, "eight", "benzene"), (9, "nine", "naphthalene"), (10, " Beta", "")]
    return spark.createDataFrame(rows, "id long, name string, group_key string")


@pytest.fixture(scope="module")
def upstream(spark):
    rows = [(0, "alpha", "benzene"), (1, "beta", "pyridine"), (2, "gamma", "naphthalene"), (3, "delta", ""), (4, "aspirin", "benzene")]
    return spark.createDataFrame(rows, "src_row long, name string, group_key string")


@pytest.fixture(scope="module")
def test_ids(spark):
    return spark.createDataFrame([(8,), (9,), (10,), (77,)], "id long")


def test_name_level_filter(spark, registry, upstream, test_ids):
    names, keys = leakage.protected_sets(test_ids, registry)
    assert sorted(r[0] for r in names.collect()) == ["beta", "eight", "nine"]
    assert sorted(r[0] for r in keys.collect()) == ["benzene", "naphthalene"]
    marked = leakage.mark_upstream_names(upstream, names, keys)
    assert [r[0] for r in leakage.surviving_names(marked).collect()] == ["delta"]
    counts = leakage.exclusion_counts(marked, keys).first().asDict()
    assert counts == {
        "total": 5, "excluded_by_key": 3, "excluded_by_name": 1, "excluded_intersection": 0, "train_after_exclusion": 1,
        "key_match_count": 3, "name_match_count": 1, "protected_key_count": 2,
    }
    total = counts["excluded_by_key"] + counts["excluded_by_name"] - counts["excluded_intersection"]
    assert counts["total"] - total == counts["train_after_exclusion"]
    assert leakage.unresolved_ids(test_ids, registry).first()[0] == 1


def test_last_key_of_a_repeated_name(spark, registry, test_ids):
    rows = [(0, "x", "benzene"), (1, "x", "other"), (2, "Beta ", "q"), (3, None, "benzene")]
    names, keys = leakage.protected_sets(test_ids, registry)
    marked = leakage.mark_upstream_names(spark.createDataFrame(rows, "src_row long, name string, group_key string"), names, keys)
    assert {r["name"]: (r["by_name"], r["by_key"]) for r in marked.collect()} == {"x": (False, False), "Beta ": (True, False)}


def test_row_level_filter(spark):
    rows = spark.createDataFrame(
        [(1, "Alpha", 1.0), (2, "alpha", 2.0), (3, " beta", 3.0), (4, "beta", 4.0), (5, "unknown", 5.0), (6, None, 6.0), (7, "gamma", 7.0), (8, "both", 8.0)],
        "row_id long, pert_id string, ehill double",
    )
    index = spark.createDataFrame(
        [("alpha", "A", "k1"), ("beta", "B", ""), ("gamma", "G", "k9"), ("both", "C", "k1")], "name_key string, structure string, group_key string"
    )
    names = spark.createDataFrame([("beta",), ("both",)], "key string")
    keys = spark.createDataFrame([("k1",)], "key string")
    marked = leakage.mark_measurements(rows, index, names, keys, "row_id")
    assert sorted(r["row_id"] for r in leakage.safe_rows(marked).collect()) == [3, 5, 6, 7]  # " beta" keeps its blank
    assert leakage.filter_breakdown(marked).first().asDict() == {
        "n_in": 8, "n_out": 4, "n_dropped_total": 4, "n_name_only": 1, "n_key_only": 2, "n_both": 1, "n_unresolved": 3,
    }
    assert leakage.safe_rows(marked).columns == rows.columns
    with pytest.raises(SchemaError, match="name column"):
        leakage.mark_measurements(rows.drop("pert_id"), index, names, keys, "row_id")


NOVEL = [(11, "a", "k1", True), (12, "b ", "k2", True), (13, "n13", "k1", False), (14, "n14", "z1", False), (15, "n15", "z2", True),
         (17, "n17", "", False), (18, "n18", None, False), (19, "C", "z3", True)]


@pytest.mark.parametrize("train_has_empty", [True, False])
def test_novelty_slices(spark, train_has_empty):
    test = spark.createDataFrame(NOVEL, "id long, name string, group_key string, in_upstream boolean")
    upstream = spark.createDataFrame([("A",), ("B",), ("c",)], "name string")
    keys = [("k1",), ("k2",)] + ([("",)] if train_has_empty else [])
    out = leakage.novelty_slices(test, upstream, spark.createDataFrame(keys, "group_key string")).cache()
    ids = lambda c: sorted(r["id"] for r in out.where(c).collect())
    assert ids("in_upstream_now") == [11, 12, 19]
    assert ids("name_novel") == [13, 14, 15, 17, 18]
    assert ids("name_and_key_novel") == ([14, 15] if train_has_empty else [14, 15, 17, 18])
    assert out.where("name_and_key_novel and not name_novel").count() == 0
    assert leakage.membership_drift(out, "in_upstream").first()[0] == 1
    counts = leakage.slice_counts(out)
    gate = gates.name_novel_gate(counts.select(F.col("test_name_novel").alias("value"))).first()
    assert (gate["value"], gate["passed"], gate["status"]) == (5.0, False, "fail")


def value(spark, x):
    return spark.createDataFrame([(x,)], "value double")


def test_gates(spark):
    assert gates.resolution_gate(value(spark, 0.87412)).first()["status"] == "fail"
    assert gates.resolution_gate(value(spark, 0.9)).first()["status"] == "pass"
    assert gates.miss_gate(value(spark, 0.01)).first()["passed"]
    assert [gates.correlation_gate(value(spark, v)).first()["status"] for v in (0.995, 0.96, 0.9, None)] == ["pass", "flag", "fail", "fail"]
    assert gates.retained_gate(value(spark, 5699.0)).first()["status"] == "fail"
    table = gates.miss_gate(value(spark, 0.5)).unionByName(gates.correlation_gate(value(spark, 0.2)))
    assert gates.run_status(table.unionByName(gates.retained_gate(value(spark, 1.0)))).first()[0] == "lookup_miss"
    fine = gates.correlation_gate(value(spark, 0.96)).unionByName(gates.miss_gate(value(spark, 0.0)))
    assert gates.run_status(fine).first()[0] == "ok"
