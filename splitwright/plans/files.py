"""Source and sink queries: tables written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitwright.operators import leakage, resolve, scan, splits, summary
from splitwright.plans import inputs as I
from splitwright.plans.inputs import derived, rounded, table
from splitwright.plans.leakage import SQL as LEAKAGE_SQL
from splitwright.plans.leakage import filter_breakdown, novelty_counts
from splitwright.plans.names import sql_first
from splitwright.plans.splits import SQL as SPLIT_SQL
from splitwright.session import scratch_path
from splitwright.sources import files, profiles, records, tables
from splitwright.sources import splits as split_files

_CSV = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_size INT, p_retailprice DOUBLE"


def csv_table(spark, sf_dir):
    path = scratch_path(spark, "csv")
    columns = [c.split()[0] for c in _CSV.split(", ")]
    tables.write_csv(table(spark, sf_dir, "part").select("p_type", *reversed(columns)), path)
    return tables.read_delimited(spark, path, _CSV)


def tsv_column(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    tables.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, sep="\t")
    names = tables.read_delimited(spark, path, "c_mktsegment STRING", "\t")
    return names.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def csv_source_order(spark, sf_dir):
    """Rows written in key order come back in that order by ``src_row``."""
    path = scratch_path(spark, "ordered")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey")
    tables.write_csv(part, path)
    rows = tables.read_delimited(spark, path, "p_partkey BIGINT, p_name STRING", source_order=True)
    numbered = scan.dense_row_number(rows, ["src_row"])
    return numbered.select("p_partkey", F.col("row_idx").cast("long").alias("row_idx"))


def parquet_table(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    tables.write_parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ["o_orderstatus"])
    back = spark.read.parquet(path)
    return rounded(back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low")))


def xml_records(spark, sf_dir):
    """Parts as nested XML records with aliases and properties, read into an alias index."""
    part = table(spark, sf_dir, "part")
    prop = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    shaped = part.select(
        F.concat("p_name", F.lit(" "), F.format_string("%09d", "p_partkey")).alias("name"),
        F.struct(F.array("p_brand", F.concat("p_type", F.lit(" "), "p_name")).alias("synonym")).alias("synonyms"),
        F.struct(F.array(F.struct(F.concat("p_name", F.lit(" "), "p_brand").alias("name"))).alias("international-brand")).alias(
            "international-brands"
        ),
        F.struct(
            F.array(
                prop("logP", F.col("p_size").cast("string")),
                prop("SMILES", F.when(F.col("p_size") % 6 != 0, F.concat("p_type", F.lit(":"), "p_brand"))),
            ).alias("property")
        ).alias("calculated-properties"),
        "p_partkey",
    ).orderBy("p_partkey")
    path = scratch_path(spark, "xml")
    shaped.drop("p_partkey").write.format("xml").options(rowTag="drug", rootTag="records").save(path)
    return resolve.build_alias_index(records.read_records(spark, path))


def split_lines(spark, sf_dir):
    path = scratch_path(spark, "split")
    split_files.write_split(splits.group_split(derived(spark, sf_dir, I.GROUPED_ORDERS), seed=None), path)
    return split_files.read_split(spark, path, "bigint")


def split_document(spark, sf_dir):
    path = scratch_path(spark, "document")
    assigned = splits.group_split(derived(spark, sf_dir, I.GROUPED_DOCUMENTS), seed=None)
    split_files.write_split_document(assigned, path)
    return split_files.read_split_document(spark, path, multi_line=False)


def profile_store(spark, sf_dir):
    path = scratch_path(spark, "store")
    emb = table(spark, sf_dir, "embeddings")
    store = emb.select(F.concat(F.lit("id_"), F.col("vec_id").cast("string")).alias("colid"), F.col("embedding").alias("data"))
    dims = spark.range(64).select(F.col("id").alias("pos"), F.concat(F.lit("dim_"), F.col("id").cast("string")).alias("rowid"))
    profiles.write_profile_store(store, dims, path)
    back, dimensions = profiles.open_profile_store(spark, path)
    long = back.select(F.posexplode("data").alias("pos", "value"))
    means = long.groupBy("pos").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    return rounded(means.join(dimensions, "pos").select("rowid", "mean"))


def aligned_sinks(spark, sf_dir):
    path = scratch_path(spark, "aligned")
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_idx"), F.col("embedding").alias("data"), F.transform(F.slice("embedding", 1, 50), lambda x: x > 0).alias("split_flags")
    )
    profiles.write_aligned(emb, path)
    vectors, masks = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/masks")
    joined = vectors.join(masks, "row_idx")
    return rounded(joined.select("row_idx", "split_00", "split_49", F.col("data")[63].alias("last_value")))


def file_manifest(spark, sf_dir):
    """Hashes of CSV files written from a table, one file per market segment."""
    path = scratch_path(spark, "manifest")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    customers.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").write.partitionBy("c_mktsegment").csv(path)
    found = files.file_manifest(spark, f"{path}/*/*.csv")
    segment = F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1)
    return found.select(segment.alias("segment"), "sha256", "n_bytes")


def cached_table(spark, sf_dir):
    """Built once, then read: the second build is never called."""
    path = scratch_path(spark, "cache")
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    files.cached_table(spark, path, lambda: counts)

    def never():
        raise RuntimeError("the cached table was rebuilt")

    return files.cached_table(spark, path, never)


def diagnostics(spark, sf_dir):
    balance = splits.class_balance(splits.group_split(derived(spark, sf_dir, I.GROUPED_ORDERS), seed=None))
    spread = splits.rate_spread(balance)
    metrics = summary.diagnostics(
        {
            "group_split": spread,
            "transfer_slices": novelty_counts(spark, sf_dir),
            "row_filter": filter_breakdown(spark, sf_dir),
        }
    )
    path = scratch_path(spark, "diagnostics")
    files.write_diagnostics(metrics, path)
    return rounded(spark.read.schema("section string, metric string, value double").json(path))


def filtered_measurements(spark, sf_dir):
    """The filtered measurement table as a Parquet sink."""
    registry = derived(spark, sf_dir, I.PROTECTED_PARTS)
    names, keys = leakage.protected_sets(registry.select("id"), registry)
    marked = leakage.mark_measurements(derived(spark, sf_dir, I.MEASUREMENTS), derived(spark, sf_dir, I.PART_INDEX), names, keys, "row_id")
    path = tables.write_parquet(leakage.safe_rows(marked), scratch_path(spark, "safe"))
    return spark.read.parquet(path).groupBy("drug_name").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "csv_table": csv_table,
    "tsv_column": tsv_column,
    "csv_source_order": csv_source_order,
    "parquet_table": parquet_table,
    "xml_records": xml_records,
    "split_lines": split_lines,
    "split_document": split_document,
    "profile_store": profile_store,
    "aligned_sinks": aligned_sinks,
    "file_manifest": file_manifest,
    "cached_table": cached_table,
    "diagnostics": diagnostics,
    "filtered_measurements": filtered_measurements,
}

_COUNTS = ("n_in", "n_out", "n_dropped_total", "n_name_only", "n_key_only", "n_both", "n_unresolved")
_SLICE_COUNTS = ("test_in_upstream", "test_name_novel", "test_name_and_key_novel")


def _tidy(section: str, query: str, metrics: tuple[str, ...]) -> str:
    return " union all ".join(
        f"select '{section}' as section, '{m}' as metric, round(cast(({query.replace('@', m)}) as double), 6) as value" for m in metrics
    )


SQL = {
    "csv_table": "select p_partkey, p_name, p_brand, p_size, p_retailprice from part",
    "tsv_column": "select c_mktsegment, count(*) as n from customer group by 1",
    "csv_source_order": "select p_partkey, row_number() over (order by p_partkey) - 1 as row_idx from part",
    "parquet_table": "select o_orderstatus, count(*) as n, round(min(o_totalprice), 6) as low from orders group by 1",
    "xml_records": f"""
with rec as (select p_partkey as src_row, p_name || ' ' || lpad(cast(p_partkey as varchar), 9, '0') as name, p_type || ':' || p_brand as structure,
  [p_name || ' ' || lpad(cast(p_partkey as varchar), 9, '0'), p_brand, p_type || ' ' || p_name, p_name || ' ' || p_brand] as names from part where p_size % 6 <> 0),
rows_ as (select src_row, name, structure, lower(unnest(names)) as name_key from rec)
select * from {sql_first('rows_', 'name_key', 'name_key, name, structure')}""",
    "split_lines": SPLIT_SQL["group_split_orders"],
    "split_document": SPLIT_SQL["group_split"].replace("select id, group_key, split from assigned", "select cast(id as varchar) as id, split from assigned"),
    "profile_store": """
select 'dim_' || cast(pos as varchar) as rowid, round(avg(x), 6) as mean from (select unnest(list_transform(embedding, lambda x: cast(x as double))) as x,
  unnest(range(0, 64)) as pos from embeddings) group by 1""",
    "aligned_sinks": "select vec_id as row_idx, embedding[1] > 0 as split_00, embedding[50] > 0 as split_49, round(cast(embedding[64] as double), 6) as last_value from embeddings",
    "file_manifest": r"""
with f as (select c_mktsegment as segment, string_agg(cast(c_custkey as varchar) || chr(10), '' order by c_custkey) as body from customer group by 1)
select segment, sha256(body) as sha256, cast(strlen(body) as bigint) as n_bytes from f""",
    "cached_table": "select l_returnflag, count(*) as n from lineitem group by 1",
    "diagnostics": _tidy("group_split", "select cast(@ as double) from (" + SPLIT_SQL["balance_spread"] + ")", ("spread", "stratified"))
    + " union all "
    + _tidy("transfer_slices", "select @ from (" + LEAKAGE_SQL["novelty_counts"] + ")", _SLICE_COUNTS)
    + " union all "
    + _tidy("row_filter", "select @ from (" + LEAKAGE_SQL["filter_breakdown"] + ")", _COUNTS),
    "filtered_measurements": "select drug_name, count(*) as n from (" + LEAKAGE_SQL["safe_measurements"] + ") group by 1",
}
