"""Keys, identifiers, lookups and one-row-per-key queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitwright.functions.ids import content_key, format_id, own_group_key, parse_id
from splitwright.functions.names import (
    ONE_TOKEN_SUFFIXES,
    REPEATED_SUFFIXES,
    TWO_TOKEN_SUFFIXES,
    name_key,
    strip_all_suffixes,
    strip_one_suffix,
    strip_two_suffixes,
)
from splitwright.functions.numbers import nearest_grid_value, to_number
from splitwright.functions.sets import folded_set, word_shingles
from splitwright.operators import dedupe, resolve
from splitwright.plans import inputs as I
from splitwright.plans.inputs import derived, sql_input, table


# ---- SQL fragments ----


def sql_key(name: str) -> str:
    return rf"lower(regexp_replace({name}, '^\s+|\s+$', '', 'g'))"


def sql_spaced(key: str) -> str:
    return rf"regexp_replace({key}, '\s+', ' ', 'g')"


def sql_one_suffix(key: str) -> str:
    pattern = f"' (?:{'|'.join(ONE_TOKEN_SUFFIXES)})$'"
    spaced = sql_spaced(key)
    return f"case when regexp_matches({spaced}, {pattern}) then regexp_replace({spaced}, {pattern}, '') end"


def sql_two_suffixes(key: str) -> str:
    suffix = f"(?:{'|'.join(TWO_TOKEN_SUFFIXES)})"
    pattern = f"'(?:(?: {suffix}){{1,2}}| {suffix} complex)$'"
    spaced = sql_spaced(key)
    return f"case when regexp_matches({spaced}, {pattern}) then regexp_replace({spaced}, {pattern}, '') else {key} end"


def sql_all_suffixes(name: str) -> str:
    pattern = f"'(?: (?:{'|'.join(REPEATED_SUFFIXES)}))+$'"
    return f"regexp_replace({sql_spaced(sql_key(name))}, {pattern}, '')"


SQL_NUMBER = r"'^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$'"


def sql_number(text: str) -> str:
    return f"case when regexp_matches({text}, {SQL_NUMBER}) then cast({text} as double) end"


def sql_first(source: str, key: str, columns: str) -> str:
    """First row per key in source order."""
    return f"(select {columns} from (select *, row_number() over (partition by {key} order by src_row) as rn_ from {source}) where rn_ = 1)"


# ---- queries ----


def name_keys(spark, sf_dir):
    key = F.col("k")
    return derived(spark, sf_dir, I.LABEL_LIST).withColumn("k", name_key(F.col("name"))).select(
        "id",
        key.alias("name_key"),
        strip_one_suffix(key).alias("one"),
        strip_two_suffixes(key).alias("two"),
        strip_all_suffixes(F.col("name")).alias("every"),
    )


def tolerant_numbers(spark, sf_dir):
    return derived(spark, sf_dir, I.LABEL_LIST).select("id", to_number(F.col("label")).alias("number"))


def grid_values(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", nearest_grid_value(F.col("l_quantity") / 5.0).alias("grid_value")
    )


def formatted_ids(spark, sf_dir):
    text = format_id(F.col("o_orderkey"), "ORD")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.alias("text_id"), parse_id(text, "ORD").alias("number")
    )


def content_keys(spark, sf_dir):
    key = content_key(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy(key.alias("content_key")).agg(F.count(F.lit(1)).alias("n"))


def group_keys(spark, sf_dir):
    items = derived(spark, sf_dir, I.GROUPED_DOCUMENTS)
    return items.select("id", own_group_key(F.col("group_key"), F.col("id")).alias("group_key"))


def folded_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bits = docs.select("doc_id", F.explode(folded_set(word_shingles(F.col("text")), 2048)).alias("bit"))
    return bits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_bits"), F.sum("bit").alias("bit_sum"))


SQL_WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
SQL_SHINGLES = f"""
select doc_id, list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, greatest(len(w) - 2, 1) + 1)]) as grams
from (select doc_id, {SQL_WORDS} as w from documents)"""


def _alias_index(spark, sf_dir):
    return derived(spark, sf_dir, I.ALIAS_TABLE)


def _routed(spark, sf_dir):
    return resolve.resolve_names(derived(spark, sf_dir, I.LABEL_LIST), _alias_index(spark, sf_dir))


def resolved_names(spark, sf_dir):
    return resolve.resolved_rows(_routed(spark, sf_dir)).select("id", "name", "name_key", "structure", "canonical", "source")


def rejected_names(spark, sf_dir):
    return resolve.rejected_rows(_routed(spark, sf_dir))


SQL_ROUTED = f"""
with items as (select *, {sql_key('name')} as k from {sql_input(I.LABEL_LIST)}),
idx as (select * from {sql_first(sql_input(I.ALIAS_TABLE), 'name_key', 'name_key, structure')}),
once as (select i.*, a.structure as direct from items i left join idx a on i.k = a.name_key),
again as (select *, case when coalesce(direct, '') = '' then {sql_one_suffix('k')} end as retry from once),
twice as (select g.*, b.structure as second, b.name_key is not null as hit from again g left join idx b on g.retry = b.name_key),
routed as (select id, name, k as name_key, case when coalesce(direct, '') <> '' then direct when hit then second end as structure,
  coalesce(direct, '') <> '' or hit as found from twice),
final as (select *, case when not found then 'name_not_in_index'
  when coalesce(trim(structure, ' ' || chr(9)), '') = '' then 'structure_parse_failure' end as reason from routed)
"""


def severity_lookup(spark, sf_dir):
    items = derived(spark, sf_dir, I.LABEL_LIST)
    reference = derived(spark, sf_dir, I.SEVERITY_LIST)
    return resolve.priority_lookup(items, reference, "severity").select(
        "id", "severity", F.col("lookup_step").cast("long").alias("lookup_step")
    )


SQL_SEVERITY = f"""
sev as (select src_row, {sql_key('name')} as k, severity from {sql_input(I.SEVERITY_LIST)}),
sev2 as (select *, {sql_two_suffixes('k')} as bare from sev),
exact as (select * from {sql_first('sev2', 'k', 'k, severity')}),
bare as (select * from {sql_first('sev2', 'bare', 'bare, severity')})"""


def suffix_free_lookup(spark, sf_dir):
    registry = derived(spark, sf_dir, I.SEVERITY_LIST).withColumn("canonical", F.upper("name"))
    queries = derived(spark, sf_dir, I.LABEL_LIST).select("src_row", "name")
    return resolve.resolve_suffix_free(queries, registry)


def suffix_free_misses(spark, sf_dir):
    return resolve.dropped_rows(suffix_free_lookup(spark, sf_dir))


SQL_SUFFIX_FREE = f"""
with reg as (select src_row, {sql_all_suffixes('name')} as k, upper(name) as canonical, nullif(severity, '') as severity
  from {sql_input(I.SEVERITY_LIST)}),
one as (select * from {sql_first('reg', 'k', 'k, canonical, severity')}),
res as (select q.src_row, q.name, o.canonical, o.severity, o.k is not null as matched
  from {sql_input(I.LABEL_LIST)} q left join one o on {sql_all_suffixes('q.name')} = o.k)
"""


def membership_flags(spark, sf_dir):
    items = derived(spark, sf_dir, I.LABEL_LIST).select("id", "name")
    flagged = resolve.member_flag(items, derived(spark, sf_dir, I.MEASURED_NAMES), "in_measured")
    return resolve.member_flag(flagged, derived(spark, sf_dir, I.UPSTREAM_NAMES), "in_upstream")


def once_per_key(spark, sf_dir):
    rows = derived(spark, sf_dir, I.MEASUREMENTS)
    index = derived(spark, sf_dir, I.PART_INDEX)
    attach = lambda keys: keys.join(index.withColumnRenamed("name_key", "key"), "key", "left")
    mapped = resolve.derive_once_per_key(rows, F.lower("drug_name"), attach, "row_id")
    return mapped.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.count("structure").alias("n_known"))


def first_per_key(spark, sf_dir):
    return dedupe.keep_first(_alias_index(spark, sf_dir), "name_key")


def last_per_key(spark, sf_dir):
    return dedupe.keep_last(_alias_index(spark, sf_dir), "name_key")


def alias_index(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    records = part.select(
        F.col("p_partkey").alias("src_row"),
        F.concat("p_name", F.lit(" "), "p_brand").alias("name"),
        F.when(F.col("p_size") % 6 != 0, F.concat("p_type", F.lit(":"), F.col("p_size").cast("string"))).alias("structure"),
        F.array("p_name", F.concat("p_type", F.lit(" "), "p_brand"), F.lit(" ")).alias("aliases"),
    )
    return resolve.build_alias_index(records)


def key_sets(spark, sf_dir):
    a = derived(spark, sf_dir, I.MEASURED_NAMES).select(name_key(F.col("name")).alias("key"))
    b = derived(spark, sf_dir, I.UPSTREAM_NAMES).select(name_key(F.col("name")).alias("key"))
    return dedupe.key_set_comparison(a, b, "key")


def sampled_rows(spark, sf_dir):
    return dedupe.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


def first_names(spark, sf_dir):
    misses = suffix_free_misses(spark, sf_dir)
    return dedupe.first_rows(misses, 10)


QUERIES = {
    "name_keys": name_keys,
    "tolerant_numbers": tolerant_numbers,
    "grid_values": grid_values,
    "formatted_ids": formatted_ids,
    "content_keys": content_keys,
    "group_keys": group_keys,
    "folded_fingerprints": folded_fingerprints,
    "resolved_names": resolved_names,
    "rejected_names": rejected_names,
    "severity_lookup": severity_lookup,
    "suffix_free_lookup": suffix_free_lookup,
    "suffix_free_misses": suffix_free_misses,
    "membership_flags": membership_flags,
    "once_per_key": once_per_key,
    "first_per_key": first_per_key,
    "last_per_key": last_per_key,
    "alias_index": alias_index,
    "key_sets": key_sets,
    "sampled_rows": sampled_rows,
    "first_names": first_names,
}

_GRID = "(values (0.04), (0.12), (0.37), (1.11), (3.33), (10.0)) g(p)"
SQL = {
    "name_keys": f"""
with keyed as (select id, name, {sql_key('name')} as k from {sql_input(I.LABEL_LIST)})
select id, k as name_key, {sql_one_suffix('k')} as one, {sql_two_suffixes('k')} as two, {sql_all_suffixes('name')} as every
from keyed""",
    "tolerant_numbers": f"select id, {sql_number('label')} as number from {sql_input(I.LABEL_LIST)}",
    "grid_values": f"""
select l_orderkey, l_linenumber, l_quantity,
  (select arg_min(cast(p as double), row(abs(l_quantity / 5.0 - cast(p as double)), cast(p as double))) from {_GRID}) as grid_value from lineitem""",
    "formatted_ids": """
select o_orderkey, 'ORD_' || case when o_orderkey < 10000 then lpad(cast(o_orderkey as varchar), 4, '0')
  else cast(o_orderkey as varchar) end as text_id, o_orderkey as number from orders""",
    "content_keys": """
select substr(sha256(l_returnflag || '|' || l_linestatus || '|' || cast(l_linenumber as varchar)), 1, 16) as content_key,
  count(*) as n from lineitem group by 1""",
    "group_keys": f"""
select id, case when coalesce(group_key, '') = '' then '_acyclic_' || cast(id as varchar) else group_key end as group_key
from {sql_input(I.GROUPED_DOCUMENTS)}""",
    "folded_fingerprints": f"""
with bits as (select distinct doc_id, cast('0x' || substr(md5(g), 1, 8) as bigint) % 2048 as bit
  from (select doc_id, unnest(grams) as g from ({SQL_SHINGLES})))
select doc_id, count(*) as n_bits, cast(sum(bit) as bigint) as bit_sum from bits group by 1""",
    "resolved_names": SQL_ROUTED
    + "select id, name, name_key, structure, structure as canonical, 'alias_index' as source from final where reason is null",
    "rejected_names": SQL_ROUTED + "select id, name, reason from final where reason is not null",
    "severity_lookup": f"""
with items as (select id, {sql_key('name')} as k from {sql_input(I.LABEL_LIST)}), {SQL_SEVERITY},
items2 as (select *, {sql_two_suffixes('k')} as s from items)
select id, case when a.k is not null then a.severity when b.k is not null then b.severity when c.bare is not null then c.severity end as severity,
  cast(case when a.k is not null then 1 when b.k is not null then 2 when c.bare is not null then 3 else 0 end as bigint) as lookup_step
from items2 i left join exact a on i.k = a.k left join exact b on i.s = b.k and i.s <> i.k left join bare c on i.k = c.bare""",
    "suffix_free_lookup": SQL_SUFFIX_FREE + "select * from res",
    "suffix_free_misses": SQL_SUFFIX_FREE + "select src_row, name from res where not matched",
    "membership_flags": f"""
select id, name, {sql_key('name')} in (select {sql_key('name')} from {sql_input(I.MEASURED_NAMES)}) as in_measured,
  {sql_key('name')} in (select {sql_key('name')} from {sql_input(I.UPSTREAM_NAMES)}) as in_upstream
from {sql_input(I.LABEL_LIST)}""",
    "once_per_key": f"""
select group_key, count(*) as n, count(structure) as n_known from {sql_input(I.MEASUREMENTS)} m
left join {sql_input(I.PART_INDEX)} p on lower(m.drug_name) = p.name_key group by 1""",
    "first_per_key": f"select * from {sql_first(sql_input(I.ALIAS_TABLE), 'name_key', 'src_row, name_key, structure')}",
    "last_per_key": f"""
select src_row, name_key, structure from (select *, row_number() over (partition by name_key order by src_row desc) as rn_
from {sql_input(I.ALIAS_TABLE)}) where rn_ = 1""",
    "alias_index": f"""
with rec as (select p_partkey as src_row, p_name || ' ' || p_brand as name, p_type || ':' || cast(p_size as varchar) as structure,
  [p_name || ' ' || p_brand, p_name, p_type || ' ' || p_brand, ' '] as names from part where p_size % 6 <> 0),
rows_ as (select src_row, name, structure, lower(trim(unnest(names))) as name_key from rec)
select * from {sql_first("(select * from rows_ where name_key <> '')", 'name_key', 'name_key, name, structure')}""",
    "key_sets": f"""
select key, bool_or(a) as in_a, bool_or(b) as in_b from (
  select {sql_key('name')} as key, true as a, false as b from {sql_input(I.MEASURED_NAMES)}
  union all select {sql_key('name')}, false, true from {sql_input(I.UPSTREAM_NAMES)}) group by 1""",
    "sampled_rows": """
select o_orderkey, o_totalprice from orders order by md5(cast(o_orderkey as varchar) || ':42'), o_orderkey limit 100""",
    "first_names": SQL_SUFFIX_FREE + "select src_row, name from res where not matched order by src_row limit 10",
}
