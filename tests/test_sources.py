import hashlib
import json

import pytest
from pyspark.sql import functions as F

from splitwright.operators import resolve, scan
from splitwright.operators.checks import SchemaError
from splitwright.sources import files, profiles, records, splits, tables

XML = """<?xml version="1.0" encoding="UTF-8"?>
<root xmlns="http://www.example.org">
  <drug type="small">
    <name> Acetylsalicylic acid </name>
    <synonyms><synonym>Aspirin</synonym><synonym> ASA </synonym></synonyms>
    <international-brands><international-brand><name>Aspro</name><company>x</company></international-brand></international-brands>
    <drug-interactions><drug-interaction><drug><name>Nested</name></drug></drug-interaction></drug-interactions>
    <calculated-properties>
      <property><kind>logP</kind><value>1.2</value></property>
      <property><kind>SMILES</kind><value>CC(=O)O</value></property>
      <property><kind>SMILES</kind><value>second</value></property>
    </calculated-properties>
  </drug>
  <drug><name>Biologic</name><synonyms/></drug>
  <drug><name>Second</name><synonyms><synonym>aspirin</synonym></synonyms>
    <calculated-properties><property><kind>SMILES</kind><value>N</value></property></calculated-properties></drug>
</root>
"""


def test_records(spark, tmp_path):
    path = tmp_path / "full.xml"
    path.write_text(XML)
    found = records.read_records(spark, str(path)).orderBy("src_row").collect()
    assert [r["name"] for r in found] == ["Acetylsalicylic acid", "Biologic", "Second"]
    assert [r["structure"] for r in found] == ["CC(=O)O", None, "N"]
    assert sorted(found[0]["aliases"]) == ["ASA", "Aspirin", "Aspro"]
    index = {r["name_key"]: r["structure"] for r in resolve.build_alias_index(records.read_records(spark, str(path))).collect()}
    assert index == {"acetylsalicylic acid": "CC(=O)O", "aspirin": "CC(=O)O", "asa": "CC(=O)O", "aspro": "CC(=O)O", "second": "N"}


def test_delimited(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("id\tname \tvalue\n1\ta, b\t2.5\n2\t\tx\n")
    assert tables.read_delimited_header(spark, str(path), "\t") == ["id", "name", "value"]
    tables.check_header(spark, str(path), ["name"], "\t")
    with pytest.raises(SchemaError, match="absent"):
        tables.check_header(spark, str(path), ["absent"], "\t")
    df = tables.read_delimited(spark, str(path), "id BIGINT, name STRING, value DOUBLE", "\t")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a, b", 2.5), (2, None, None)]
    one = tables.read_delimited(spark, str(path), "id BIGINT, name STRING, value DOUBLE", "\t", columns=["name"])
    assert one.columns == ["name"]


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('name , id,other\n"x\ny",1,z\n"a,b",2,\n')
    for schema in ("id BIGINT, name STRING", "name STRING, id BIGINT"):
        df = tables.read_delimited(spark, str(path), schema, multi_line=True)
        assert sorted((r["id"], r["name"]) for r in df.collect()) == [(1, "x\ny"), (2, "a,b")]
    assert sorted(r["id"] for r in tables.read_delimited(spark, str(path), "id BIGINT", multi_line=True).collect()) == [1, 2]
    with pytest.raises(SchemaError, match="absent"):
        tables.read_delimited(spark, str(path), "id BIGINT, absent STRING")
    more = tmp_path / "u.csv"
    more.write_text("id,name\n3,c\n")
    both = tables.read_delimited(spark, [str(path), str(more)], "name STRING, id BIGINT", multi_line=True)
    assert sorted(r["id"] for r in both.collect()) == [1, 2, 3]


def test_manifest_of_a_large_file(spark, tmp_path):
    import hashlib

    path = tmp_path / "sparse.bin"
    with path.open("wb") as f:
        f.truncate(2_200_000_000)
    digest = hashlib.sha256()
    for _ in range(2200):
        digest.update(bytes(1_000_000))
    row = files.file_manifest(spark, str(path)).first()
    assert (row["sha256"], row["n_bytes"]) == (digest.hexdigest(), 2_200_000_000)


def test_source_order_over_files(spark, tmp_path):
    out = tmp_path / "many"
    df = spark.range(0, 5000).select("id", F.concat(F.lit('q"'), F.col("id").cast("string")).alias("t"))
    tables.write_csv(df.repartitionByRange(5, "id").sortWithinPartitions("id"), str(out))
    back = tables.read_delimited(spark, str(out), "id BIGINT, t STRING", source_order=True)
    assert back.where(F.col("t") != F.concat(F.lit('q"'), F.col("id").cast("string"))).count() == 0
    numbered = scan.dense_row_number(back, ["src_row"])
    assert numbered.where("id <> row_idx").count() == 0 and numbered.count() == 5000


def test_split_files(spark, tmp_path):
    df = spark.createDataFrame([("ID_0002", "train"), ("ID_0001", "train"), ("ID_0003", "test")], "id string, split string")
    splits.write_split(df, str(tmp_path / "lines"))
    assert sorted(tuple(r) for r in splits.read_split(spark, str(tmp_path / "lines")).collect()) == [("ID_0001", "train"), ("ID_0002", "train"), ("ID_0003", "test")]
    splits.write_split_document(df, str(tmp_path / "doc"))
    part = next((tmp_path / "doc").glob("part-*.json"))
    assert json.loads(part.read_text()) == {"train": ["ID_0001", "ID_0002"], "test": ["ID_0003"]}
    many = spark.range(3000).select(F.format_string("ID_%05d", "id").alias("id"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    splits.write_split_document(many, str(tmp_path / "doc2"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    lines = [x for p in sorted((tmp_path / "doc2").glob("part-*.json")) for x in p.read_text().splitlines()]
    assert len(lines) > 2
    back = splits.read_split_document(spark, str(tmp_path / "doc2"), multi_line=False)
    assert sorted(map(tuple, back.select("id", "split").collect())) == sorted(map(tuple, many.collect()))
    given = tmp_path / "given.json"
    given.write_text(json.dumps({"train": [1, 2], "val": [], "test": [3], "version": "0.4", "size": 3}, indent=2))
    got = sorted(tuple(r) for r in splits.read_split_document(spark, str(given)).collect())
    assert got == [("test", "3"), ("train", "1"), ("train", "2")]


def test_profile_store(spark, tmp_path):
    store = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "colid string, data array<double>")
    dims = spark.createDataFrame([(0, "g0"), (1, "g1")], "pos long, rowid string")
    path = profiles.write_profile_store(store, dims, str(tmp_path / "store"))
    back, _ = profiles.open_profile_store(spark, path)
    assert back.count() == 2 and back.schema["data"].dataType.simpleString() == "array<float>"
    profiles.write_profile_store(store, dims.limit(1), str(tmp_path / "bad"))
    with pytest.raises(SchemaError, match="differ"):
        profiles.open_profile_store(spark, str(tmp_path / "bad"))
    rows = spark.createDataFrame([(0, [1.0], [True, False]), (1, [2.0], [False, False])], "row_idx long, data array<double>, split_flags array<boolean>")
    out = profiles.write_aligned(rows, str(tmp_path / "aligned"), flag_width=2)
    assert spark.read.parquet(f"{out}/masks").columns == ["row_idx", "split_00", "split_01"]


def test_manifest_and_cache(spark, tmp_path):
    for name in ("a.csv", "b.csv", "c.txt"):
        (tmp_path / name).write_bytes(name.encode() * 100)
    got = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["n_bytes"]) for r in files.file_manifest(spark, str(tmp_path), "*.csv").collect()}
    assert got == {n: (hashlib.sha256(n.encode() * 100).hexdigest(), 500) for n in ("a.csv", "b.csv")}
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "cache")
    assert files.cached_table(spark, path, build).count() == 1
    assert files.cached_table(spark, path, build).count() == 1
    assert files.cached_table(spark, path, build, rebuild=True).count() == 2
    assert len(calls) == 2
