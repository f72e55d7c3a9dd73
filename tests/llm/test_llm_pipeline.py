"""The pipeline's stages on the smallest tables, and the registered queries."""

import glob
import os

import pytest

import corpus_pipeline
from splitwright.llm import decontaminate, near, recipes, toxicity
from splitwright.llm.plans import QUERIES, SQL
from splitwright.session import stored

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def test_stages_take_effect(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    docs, tables = read("documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, FOLDER), "stage")
        tables[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())

    before, after = tables["toxicity"]
    scores = toxicity.toxicity_scores(before, read("labels"))
    assert ids(after) == ids(scores.where("predicted = 0"))
    before, after = tables["exact dedup"]
    assert ids(after) == ids(recipes.exact_groups(before).where("kept"))
    before, after = tables["near dedup"]
    assert ids(after) == ids(near.near_groups(before).where("kept"))
    before, after = tables["decontamination"]
    found = decontaminate.contamination(before, read("benchmark")).collect()
    clean = {r["doc_id"] for r in found if not r["contaminated"]}
    assert clean <= set(ids(after))
    assert not [r for r in decontaminate.contamination(after, read("benchmark")).collect() if r["contaminated"]]
    before, after = tables["mixing"]
    assert ids(after) == ids(before)
    assert abs(sum(r["taken"] for r in after.collect()) / (1.5 * sum(r["size"] for r in after.collect())) - 1) < 0.05


def test_run_gives_the_rows_of_the_last_stage(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"] and got.count() > 100


@pytest.fixture(scope="module")
def views():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, views, name):
    from tools.compare import compare

    assert compare(QUERIES[name](spark, FOLDER).toPandas(), views.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"pipeline"}))
def test_a_row_for_each_document(spark, name):
    assert QUERIES[name](spark, FOLDER).select("doc_id").distinct().count() == 200
