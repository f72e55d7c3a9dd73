"""Every query against its SQL check on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry_points
from tools.compare import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


@pytest.fixture(scope="module")
def views():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        db.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, views, name):
    got = entry_points.queries()[name](spark, FOLDER).toPandas()
    sql = entry_points.oracle_sql().get(name)
    if sql is not None:
        assert compare(got, views.execute(sql).df()) is None


def test_entry(spark):
    got = {r["split"]: r["n_total"] for r in entry_points.entry(spark).collect()}
    assert sorted(got) == ["test", "train", "val"] and sum(got.values()) == 200
