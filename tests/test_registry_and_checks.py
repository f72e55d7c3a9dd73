import pytest
from pyspark.sql import functions as F

from splitwright.functions.ids import PROFILE_ID_SNIFF_PATTERN
from splitwright.operators import checks, registry, summary
from splitwright.operators.checks import SchemaError


@pytest.fixture(scope="module")
def built(spark):
    labels = spark.createDataFrame(
        [(0, 1, "Acetaminophen", "1"), (1, 2, "Aspirin", "0"), (2, 3, "Caffeine", "1.0"), (3, 4, "Lonidamine sodium", "0"), (4, 5, "Other", "2"),
         (5, 2, "Aspirin again", "1"), (6, 6, "Broken", None)],
        "src_row long, id long, name string, `label ` string",
    )
    severities = spark.createDataFrame(
        [(0, "ACETAMINOPHEN", "Most"), (1, "aspirin hydrochloride", "Less"), (2, "lonidamine", None)], "src_row long, name string, severity string"
    )
    resolved = spark.createDataFrame(
        [(1, "s1", "c1", "k"), (2, "s2", "c2", ""), (3, "s3", "c3", "k"), (4, "s4", "c4", "m"), (5, "s5", "c5", "m")],
        "id long, structure string, canonical string, group_key string",
    )
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    return registry.build_registry(labels, severities, resolved, names("acetaminophen", "CAFFEINE ", "lonidamine"), names("aspirin", "caffeine")).cache()


def test_registry(built):
    assert built.columns == registry.REGISTRY_COLUMNS
    got = {r["id"]: r for r in built.collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[2]["name"] == "Aspirin" and got[2]["label"] == 0  # the first row of a repeated id stays
    assert [got[i]["severity"] for i in (1, 2, 3, 4)] == ["Most", "Less", None, None]
    assert [(got[i]["in_measured"], got[i]["in_upstream"]) for i in (1, 2, 3, 4)] == [(True, False), (False, True), (True, True), (False, False)]


def test_summary(built):
    row = summary.registry_summary(built, 8).first().asDict()
    assert (row["n_registry"], row["n_pos"], row["n_neg"], row["severity_count"], row["measured_count"], row["upstream_count"]) == (4, 2, 2, 2, 2, 2)
    assert (row["pos_frac"], row["resolution_rate"]) == (0.5, 0.5)
    empty = summary.registry_summary(built.limit(0), 0).first().asDict()
    assert empty["pos_frac"] == empty["resolution_rate"] == empty["upstream_frac"] == 0.0


def test_invariants(spark, built):
    report = checks.invariant_report(built, "id", ["canonical"], ["label"], expected_rows=4)
    checks.raise_on_violations(report)
    broken = spark.createDataFrame([(1, None, 3), (1, "x", 1)], "id long, canonical string, label int")
    row = checks.invariant_report(broken, "id", ["canonical"], ["label"], expected_rows=3).first().asDict()
    assert row == {"n_rows": 2, "bad_duplicate_keys": 1, "bad_null_canonical": 1, "bad_binary_label": 1, "bad_row_count": 1}
    with pytest.raises(SchemaError, match="bad_duplicate_keys"):
        checks.raise_on_violations(checks.invariant_report(broken, "id"))
    with pytest.raises(SchemaError):
        checks.require_order(built.select("name", "id"), ["id", "name"])
    with pytest.raises(SchemaError, match="canonical"):
        checks.reject_nulls(broken, ["canonical"])


def test_label_filter(spark):
    df = spark.createDataFrame([("1",), ("0.0",), ("2",), ("x",), (None,), ("1d",)], "label string")
    assert registry.label_drop_count(df).first().asDict() == {"n_in": 6, "n_kept": 2, "n_dropped": 4}
    assert sorted(r[0] for r in registry.keep_binary_labels(df).collect()) == [0, 1]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["List Classification ", "compound_name"])
    assert checks.find_column(df, ["List Classification"]) == "List Classification "
    assert checks.find_column(df, ["CompoundName", "Compound Name", "compound_name"]) == "compound_name"
    assert checks.trim_headers(df).columns == ["List Classification", "compound_name"]
    with pytest.raises(SchemaError, match="saw"):
        checks.require_columns(df, ["absent"])
    with pytest.raises(SchemaError, match="searched"):
        checks.find_column(df, ["absent"])
    severity = spark.createDataFrame([(1,)], ["DILI Concern"])
    assert checks.find_column(severity, checks.SEVERITY_COLUMN_NAMES, ignore_case=True) == "DILI Concern"


def wide(spark, n=10, width=978, flags=50, prefix="expression_"):
    cols = {"Compound_Name": "string", "dili": "int"}
    schema = ", ".join([f"{k} {v}" for k, v in cols.items()] + [f"`{prefix}{i}` float" for i in range(width)] + [f"split_{k:02d} boolean" for k in range(flags)])
    rows = [(f"c{r}", r % 2, *[float(r * 1000 + i) for i in range(width)], *[(r + k) % 2 == 0 for k in range(flags)]) for r in range(n)]
    return spark.createDataFrame(rows, schema)


def test_profile_table_layout(spark):
    got = checks.profile_set(wide(spark), "table")
    assert got.columns == ["compound_name", "label", "expressions", "split_flags"]
    row = got.where("compound_name = 'c3'").first()
    assert row["expressions"][977] == 3977.0 and row["split_flags"][:2] == [False, True]
    checks.raise_on_violations(checks.profile_violations(got))
    with pytest.raises(SchemaError, match="expected 978"):
        checks.profile_set(wide(spark, n=1, width=977), "table")


def test_profile_record_layout(spark):
    rows = [("a", 1, [0.5] * 4, [True, False]), ("b", 0, [0.1] * 4, [False, False])]
    record = spark.createDataFrame(rows, "drug_names string, DILI int, X array<double>, splits array<boolean>")
    got = checks.profile_set(record, "record", 4, 2)
    checks.raise_on_violations(checks.profile_violations(got, 4, 2))
    with pytest.raises(SchemaError, match="compound_name"):
        checks.profile_set(record.withColumnRenamed("drug_names", "DRUG_NAMES"), "record", 4, 2)
    with pytest.raises(SchemaError, match="expressions"):
        checks.profile_set(record.drop("X"), "record", 4, 2)
    fraction = got.withColumn("label", F.lit(0.7))
    assert checks.profile_violations(fraction, 4, 2).first()["bad_label"] == 2
    assert checks.profile_violations(got, 5, 2).first()["bad_expression_width"] == 2


def test_numbered_order():
    cols = ["split_10", "split_2", "split_1"]
    assert checks.numbered_columns(cols, checks.SPLIT_FLAG_COLUMN, 3) == ["split_1", "split_2", "split_10"]
    assert checks.numbered_columns(cols, checks.SPLIT_FLAG_COLUMN, 3, "textual") == ["split_1", "split_10", "split_2"]


def test_sniffed_ids(spark):
    rows = [("x", f"  CGS{i:03d}_MCF7_24H:BRD-K{i:08d}:10 ") for i in range(30)]
    df = spark.createDataFrame(rows, "a string, b string")
    ids = checks.load_profile_ids(df, PROFILE_ID_SNIFF_PATTERN, expected_rows=30)
    assert ids.where(F.col("profile_id").rlike("^ | $")).count() == 0
    with pytest.raises(SchemaError, match="expected 6000"):
        checks.load_profile_ids(df, PROFILE_ID_SNIFF_PATTERN)
    with pytest.raises(SchemaError, match="no column"):
        checks.sniff_column(df.select("a"), PROFILE_ID_SNIFF_PATTERN)


def test_distributions(spark):
    df = spark.createDataFrame([("a", None, 0), ("a", 2.0, 1), ("b", 1.0, 2), ("a", 3.0, 3)], "k string, v double, src_row long")
    assert [tuple(r) for r in summary.value_counts(df, "k").collect()] == [("a", 3, 75.0), ("b", 1, 25.0)]
    assert [tuple(r) for r in summary.group_with_first(df, "k", "v").collect()] == [("a", 2.0, 3), ("b", 1.0, 1)]
    labels = spark.createDataFrame([(1,)] * 3 + [(0,)] * 2, "label int")
    row = summary.class_drift(labels, expected=5).first()
    assert (row["pn_ratio"], row["within"]) == (1.5, True)
    assert not summary.class_drift(labels).first()["within"]
    tidy = summary.diagnostics({"a": labels.agg(F.count("*").alias("n")), "b": labels.agg(F.max("label").alias("m"))})
    assert sorted(tuple(r) for r in tidy.collect()) == [("a", "n", 5.0), ("b", "m", 1.0)]


def test_layouts_are_found_from_the_schema(spark):
    record = spark.createDataFrame([("a", 1, [0.5] * 4, [True, False])], "drug_names string, DILI int, X array<double>, splits array<boolean>")
    spread = record.selectExpr("drug_names as Drug_Name", "DILI as dili", *[f"X[{k}] as gene_{k}" for k in range(4)], *[f"splits[{k}] as split_{k}" for k in range(2)])
    nested = record.selectExpr("1 as other", "array(struct(*), null, struct(*)) as items")
    single = record.selectExpr("struct(*) as item")
    assert [checks.ranked_layouts(x, 4, 2)[0][:2] for x in (record, spread, nested, single)] == [
        ("record", None), ("table", None), ("nested", "items"), ("nested", "item"),
    ]
    want = [tuple(r) for r in checks.profile_set(record, "record", 4, 2).collect()]
    for x, n in ((record, 1), (spread, 1), (nested, 2), (single, 1)):
        assert [tuple(r) for r in checks.profile_set(x, None, 4, 2).collect()] == want * n
    with pytest.raises(SchemaError, match=r"nested in items lacks label.*; record lacks .*; table lacks .*expected 4 columns"):
        checks.profile_set(nested.selectExpr("transform(items, i -> named_struct('drug_name', i.drug_names, 'X', i.X, 'splits', i.splits)) as items"), None, 4, 2)
    with pytest.raises(SchemaError, match="expressions as an array"):
        checks.profile_set(record.withColumn("X", F.lit(1.0)), None, 4, 2)
    with pytest.raises(SchemaError, match="no column holds records"):
        checks.profile_set(record, "nested", 4, 2)


@pytest.mark.parametrize("parts", [1, 6])
def test_first_values_are_kept_per_task(spark, parts):
    """The first values by order decide, wherever they lie; nulls do not count."""
    rows = [(i, None if i % 3 else f" id{i}\t", "no" if i == 70 else f"id{i}", "id" if i > 40 else "x") for i in range(200)]
    df = spark.createDataFrame(rows, "src_row long, a string, b string, c string").repartition(parts)
    kept = checks.first_values(df, ["a", "b", "c"], "src_row", 5)
    assert kept.count() <= 3 * 5 * parts
    first = sorted((r["_o"], r["v"]) for r in kept.where("column = 0").collect())[:5]
    assert first == [(i, f"id{i}") for i in (0, 3, 6, 9, 12)]
    assert checks.sniff_column(df, r"^id\d+$") == "a" and checks.sniff_column(df.drop("a"), r"^id\d+$") == "b"
    with pytest.raises(SchemaError):
        checks.sniff_column(df.select("src_row", "b"), r"^id\d+$", sample=80)
    by = df.withColumn("place", F.struct((-F.col("src_row")).alias("x"), F.lit("s").alias("y"))).drop("src_row")
    assert checks.sniff_column(by.select("place", "c"), r"^id$", order_by="place") == "c"


def test_column_report_counts_values(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "id int, name string")
    got = {r["column"]: (r["present"], r["n_values"]) for r in checks.column_report(df, ["id", "name", "label"]).collect()}
    assert got == {"id": (True, 2), "name": (True, 2), "label": (False, 0)}
