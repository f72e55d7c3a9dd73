import pytest
from pyspark.sql import functions as F

from splitwright.operators import dedupe, resolve
from splitwright.operators.checks import SchemaError


def routed(spark, items, index):
    items = spark.createDataFrame(items, "id long, name string")
    index = spark.createDataFrame(index, "src_row long, name_key string, structure string")
    return {r["id"]: r for r in resolve.resolve_names(items, index).collect()}


def test_direct_retry_and_reject(spark):
    index = [(0, "aspirin", "CC"), (1, "levocetirizine", "CN"), (2, "aspirin", "XX"), (3, "blank", " "), (4, "empty", ""), (5, "none", None)]
    got = routed(
        spark,
        [(1, " Aspirin "), (2, "Levocetirizine dihydrochloride"), (3, "unknown"), (4, "blank"), (5, "empty"), (6, None),
         (7, "none"), (8, "none sodium"), (9, "sodium")],
        index,
    )
    assert got[1]["structure"] == "CC" and got[1]["reason"] is None and got[1]["source"] == "alias_index"
    assert got[2]["structure"] == "CN"
    assert got[3]["reason"] == "name_not_in_index"
    assert got[4]["reason"] == "structure_parse_failure"
    # an empty or missing structure triggers the retry, which finds no suffix here
    assert got[5]["reason"] == got[7]["reason"] == "name_not_in_index"
    assert got[6]["reason"] == "name_not_in_index"
    # in the retry the key alone decides, its value is then invalid
    assert got[8]["reason"] == "structure_parse_failure"
    assert got[9]["reason"] == "name_not_in_index"
    assert len(got) == 9


def test_user_validity(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    index = spark.createDataFrame([("a", "CC"), ("b", "bad")], "name_key string, structure string")
    out = resolve.resolve_names(items, index, valid=lambda c: c != "bad", canonical=F.lower)
    assert [r["canonical"] for r in resolve.resolved_rows(out).collect()] == ["cc"]
    assert [tuple(r) for r in resolve.rejected_rows(out).collect()] == [(2, "b", "structure_parse_failure")]


def test_missing_columns(spark):
    items = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(SchemaError, match="name"):
        resolve.resolve_names(items, items)


def lookup(spark, names, reference):
    items = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    ref = spark.createDataFrame(reference, "src_row long, name string, severity string")
    out = resolve.priority_lookup(items, ref, "severity").orderBy("id").collect()
    return [(r["severity"], r["lookup_step"]) for r in out]


def test_priority_steps(spark):
    reference = [(0, "Aspirin", "Most"), (1, "abacavir sulfate", "Less"), (2, "lonidamine", "No"), (3, "nullish", None),
                 (4, "nullish sodium", "Most"), (5, "ASPIRIN ", "No"), (6, "x sodium glycinate", "Less")]
    got = lookup(spark, ["aspirin", "abacavir", "Lonidamine Sodium", "nullish", "other", None, "x", "x hydrate"], reference)
    assert got[:3] == [("Most", 1), ("Less", 3), ("No", 2)]
    assert got[3] == (None, 1)  # an exact hit with a null value ends the search
    assert got[4] == (None, 0) and got[5] == (None, 0)
    assert got[6] == ("Less", 3)
    assert got[7] == (None, 0)  # stripped on both sides is never tried


def test_suffix_free(spark):
    queries = spark.createDataFrame(
        [(0, "Drug Sodium"), (1, "miss"), (2, "drug"), (3, None), (4, "salted"), (5, "nosev"), (6, "")], "src_row long, name string"
    )
    registry = spark.createDataFrame(
        [(0, "drug hydrochloride", "C1", "Most"), (1, "Drug", "C2", "Less"), (2, "salted sodium glycinate", "C3", "No"),
         (3, "nosev", "C4", ""), (4, None, "C5", "No"), (5, "", "C6", "No")],
        "src_row long, name string, canonical string, severity string",
    )
    out = resolve.resolve_suffix_free(queries, registry)
    got = {r["src_row"]: (r["canonical"], r["severity"], r["matched"]) for r in out.collect()}
    assert got == {
        0: ("C1", "Most", True), 1: (None, None, False), 2: ("C1", "Most", True), 3: (None, None, False),
        4: ("C3", "No", True), 5: ("C4", None, True), 6: (None, None, False),
    }
    drops = resolve.dropped_rows(out).orderBy("src_row").collect()
    assert [tuple(r) for r in drops] == [(1, "miss"), (3, ""), (6, "")]


def test_member_flag(spark):
    items = spark.createDataFrame([(1, "Aspirin "), (2, "other"), (3, None)], "id long, name string")
    members = spark.createDataFrame([(" ASPIRIN",), ("aspirin",), ("",), (None,)], "name string")
    got = resolve.member_flag(items, members, "flag").orderBy("id").collect()
    assert [r["flag"] for r in got] == [True, False, False]


def test_alias_index(spark):
    records = spark.createDataFrame(
        [(0, "Acetylsalicylic acid", "CC", ["Aspirin", " ASA", ""]), (1, "Other", "NN", ["aspirin", "Third"]), (2, "No structure", None, ["x"]),
         (3, None, "CC", ["y"]), (4, "Plain", "OO", None)],
        "src_row long, name string, structure string, aliases array<string>",
    )
    got = {r["name_key"]: (r["name"], r["structure"]) for r in resolve.build_alias_index(records).collect()}
    assert got == {
        "acetylsalicylic acid": ("Acetylsalicylic acid", "CC"), "aspirin": ("Acetylsalicylic acid", "CC"), "asa": ("Acetylsalicylic acid", "CC"),
        "other": ("Other", "NN"), "third": ("Other", "NN"), "plain": ("Plain", "OO"),
    }


def test_first_last_sample(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", None, 1), ("b", 5, 9), ("a", 7, 3)], "k string, v int, src_row long")
    assert {r["k"]: r["v"] for r in dedupe.keep_first(df, "k").collect()} == {"a": None, "b": 5}
    assert {r["k"]: r["v"] for r in dedupe.keep_last(df, "k").collect()} == {"a": 7, "b": 5}
    nums = spark.range(1000)
    one = [r[0] for r in dedupe.seeded_sample(nums, "id", 20, 1).collect()]
    two = [r[0] for r in dedupe.seeded_sample(nums.repartition(7), "id", 20, 1).collect()]
    assert sorted(one) == sorted(two) and len(set(one)) == 20
    other = [r[0] for r in dedupe.seeded_sample(nums, "id", 20, 2).collect()]
    assert sorted(other) != sorted(one)


def test_once_per_key(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b"), (4, None)], "id long, name string")
    derive = lambda keys: keys.select("key", F.upper("key").alias("up"))
    got = resolve.derive_once_per_key(rows, F.lower("name"), derive, "id").orderBy("id").collect()
    assert [r["up"] for r in got] == ["A", "A", "B", None]


def test_one_table_of_names_serves_all_probes(spark):
    """Null and empty names, repeated keys, a null value that is a hit, and a member that no reference knows."""
    ref = spark.createDataFrame(
        [(3, "Beta", "late"), (1, "beta", None), (None, "gamma", "no place"), (2, "Alpha sodium", "A"), (4, None, "x"), (5, "", "blank")],
        "src_row long, name string, severity string",
    )
    members = {"left": spark.createDataFrame([("ALPHA",), (None,), ("",), ("alpha",)], "name string"), "right": spark.createDataFrame([], "name string")}
    table = resolve.keyed_lookup(ref, "severity", members)
    assert table.count() == table.select("_k").distinct().count()
    items = spark.createDataFrame([(1, "Beta"), (2, "alpha"), (3, "gamma hydrochloride"), (4, None), (5, "none"), (6, "")], "id long, name string")
    got = resolve.probe_names(items, table, "severity", ["left", "right"]).orderBy("id").collect()
    assert [tuple(r)[2:] for r in got] == [
        (None, 1, False, False), ("A", 3, True, False), ("no place", 2, False, False),
        (None, 0, False, False), (None, 0, False, False), ("blank", 1, False, False),
    ]
    assert resolve.probe_names(items.limit(0), table, "severity", ["left"]).count() == 0


def test_registry_writes_one_table_of_names(spark, monkeypatch):
    from splitwright.operators import registry

    written = []
    monkeypatch.setattr(resolve, "lookup_side", lambda df: written.append(df.columns) or df)
    labels = spark.createDataFrame([(0, 1, "Aspirin", "1")], "src_row long, id long, name string, label string")
    known = spark.createDataFrame([(1, "CC", "C", "g")], "id long, structure string, canonical string, group_key string")
    severities = spark.createDataFrame([(0, "aspirin", "Most")], "src_row long, name string, severity string")
    names = spark.createDataFrame([("ASPIRIN",)], "name string")
    row = registry.build_registry(labels, severities, known, names, names.limit(0)).first()
    assert (row["severity"], row["in_measured"], row["in_upstream"]) == ("Most", True, False) and len(written) == 1
