"""Inputs of the queries.

The texts below derive entity lists, indexes and score tables from the given tables. They use only
SQL that Spark and other engines read alike, so a query and its SQL check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# a name with a brand token, and the same with another numbering that meets it only in part
_BASE = "p_name || ' ' || lower(replace(p_brand, '#', ''))"
_OTHER = "p_name || ' brand' || cast(p_size % 30 + 1 as string)"

LABEL_LIST = f"""
select p_partkey as src_row, p_partkey as id,
  case p_partkey % 5
    when 0 then {_BASE} when 1 then {_BASE} || ' sodium' when 2 then {_BASE} || ' Sodium  Hydrate'
    when 3 then '  ' || upper({_BASE}) || ' ' else {_BASE} || ' phosphate complex' end as name,
  case p_partkey % 7
    when 6 then '2' when 5 then 'n/a' when 4 then '1.0' when 3 then '10d'
    else cast(p_size % 2 as string) end as label
from {{part}}"""

ALIAS_TABLE = f"""
select p_partkey as src_row,
  lower(case p_partkey % 3 when 0 then {_BASE} || ' sodium' else {_OTHER} end) as name_key,
  case when p_size % 13 = 0 then '' when p_size % 17 = 0 then null when p_size % 19 = 0 then ' ' || chr(9) || ' '
    else p_type || ':' || p_name end as structure
from {{part}}"""

SEVERITY_LIST = f"""
select p_partkey as src_row,
  case p_partkey % 4
    when 0 then {_OTHER} when 1 then {_OTHER} || ' hydrochloride'
    when 2 then {_OTHER} || ' sodium glycinate' else upper({_BASE}) end as name,
  case p_size % 4 when 0 then 'Most' when 1 then 'Less' when 2 then 'No' end as severity
from {{part}}"""

RESOLVED_LIST = """
select p_partkey + case when p_size % 10 = 9 then 1000000000 else 0 end as id, p_name as structure,
  upper(p_name) as canonical, case when p_size % 8 = 0 then '' else p_brand || '|' || p_type end as group_key
from {part}"""

MEASURED_NAMES = f"select ' ' || upper({_OTHER}) as name from {{part}}"
UPSTREAM_NAMES = f"select {_OTHER} || case when p_size % 2 = 0 then ' sodium' else '' end as name from {{part}}"

PROTECTED_REGISTRY = f"""
select p_partkey as id, {_BASE} as name,
  case when p_size % 10 = 0 then '' when p_size % 10 = 1 then null else p_name || '|' || p_brand end as group_key,
  p_size > 30 as flag, p_size > 44 as in_test
from {{part}}"""

TEST_IDS = """
select p_partkey + case when p_size = 50 then 1000000000 else 0 end as id from {part} where p_size > 44"""

UPSTREAM_LIST = f"""
select p_partkey as src_row, case when p_size % 3 = 0 then upper({_OTHER}) || ' ' else {_OTHER} end as name,
  case when p_size % 7 = 0 then '' else p_name || '|Brand#' || cast(p_partkey % 40 as string) end as group_key
from {{part}}"""

MEASUREMENTS = """
select l_orderkey * 10 + l_linenumber as row_id,
  case when l_linenumber = 7 then 'Unknown ' || cast(l_suppkey as string) when l_quantity > 48 then null
    else 'Part ' || cast(l_partkey as string) end as drug_name,
  l_extendedprice as value
from {lineitem}"""

PART_INDEX = """
select 'part ' || cast(p_partkey as string) as name_key, p_name as structure,
  case when p_size % 9 = 0 then '' else p_name || '|' || p_brand end as group_key
from {part}"""

PROTECTED_PARTS = """
select p_partkey as id, 'PART ' || cast(p_partkey as string) as name,
  case when p_size % 9 = 0 then '' else p_name || '|' || p_brand end as group_key
from {part} where p_size > 48"""

PROFILE_IDS = """
select l_orderkey * 10 + l_linenumber as src_row,
  'PL' || cast(l_suppkey % 50 as string) || '_' || l_returnflag || l_linestatus || '_' ||
  case when l_linenumber % 2 = 0 then '6' else '24' end || 'H' ||
  case when l_linenumber = 7 then '-' else ':' end || 'BRD-K' || cast(l_partkey as string) || ':' ||
  case when l_linenumber = 5 then 'high' else cast(cast(l_quantity as bigint) as string) || '.5' end as profile_id,
  l_partkey, cast(l_quantity as bigint) % 2 as label
from {lineitem}"""

GROUPED_DOCUMENTS = """
select d.doc_id as id, case when d.n_chars % 11 = 0 then '' else d.source || '|' || d.lang end as group_key,
  coalesce(cast(l.quality as bigint), 0) as label, l.doc_id is not null as labelled
from {documents} d left join {labels} l on d.doc_id = l.doc_id"""

GROUPED_ORDERS = """
select o_orderkey as id, case when o_totalprice > 450000 then '' else 'c' || cast(o_custkey as string) end as group_key,
  cast(case when o_orderstatus = 'F' then 1 else 0 end as bigint) as label,
  o_orderpriority = '1-URGENT' as measured
from {orders}"""

SCORE_LISTS = """
select o_custkey as list_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos,
  o_totalprice / 100000.0 as label, (o_orderkey % 17) * 0.25 + o_totalprice / 400000.0 as pred
from {orders}"""

CLASSIFIER_SCORES = """
select l_linestatus as slice, case when l_returnflag = 'R' then 1 else 0 end as label,
  l_discount * 5.0 + l_tax * 6.25 as score
from {lineitem}"""

_TABLES = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run an input text on the tables of a folder."""
    used = {name: table(spark, sf_dir, name) for name in set(_TABLES.findall(text))}
    return spark.sql(text, **used)


def sql_input(text: str) -> str:
    """The same input as a parenthesised SQL subquery on views named like the tables."""
    return "(" + _TABLES.sub(r"\1", text).strip() + ")"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns, as the SQL checks do."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
