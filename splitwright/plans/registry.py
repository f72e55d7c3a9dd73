"""Registry queries: build, check and summarise."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitwright.operators import checks, profiles, registry, summary
from splitwright.plans import inputs as I
from splitwright.plans.inputs import derived, rounded, sql_input, table
from splitwright.plans.names import SQL_SEVERITY, sql_key, sql_number, sql_two_suffixes


def registry_rows(spark, sf_dir):
    return registry.build_registry(
        derived(spark, sf_dir, I.LABEL_LIST),
        derived(spark, sf_dir, I.SEVERITY_LIST),
        derived(spark, sf_dir, I.RESOLVED_LIST),
        derived(spark, sf_dir, I.MEASURED_NAMES),
        derived(spark, sf_dir, I.UPSTREAM_NAMES),
    )


def label_drops(spark, sf_dir):
    return registry.label_drop_count(derived(spark, sf_dir, I.LABEL_LIST))


def join_drops(spark, sf_dir):
    labelled = registry.keep_binary_labels(derived(spark, sf_dir, I.LABEL_LIST))
    return registry.join_drop_count(labelled, derived(spark, sf_dir, I.RESOLVED_LIST))


def registry_summary(spark, sf_dir):
    total = derived(spark, sf_dir, I.LABEL_LIST).count()
    return rounded(summary.registry_summary(registry_rows(spark, sf_dir), total))


def registry_invariants(spark, sf_dir):
    return checks.invariant_report(registry_rows(spark, sf_dir), "id", ["canonical", "severity"], ["label"])


def severity_counts(spark, sf_dir):
    return rounded(summary.value_counts(registry_rows(spark, sf_dir), "severity"))


def label_conflicts(spark, sf_dir):
    rows = registry.keep_binary_labels(derived(spark, sf_dir, I.LABEL_LIST))
    known = derived(spark, sf_dir, I.SEVERITY_LIST).select(
        "src_row", "name", (F.col("src_row") % 2).cast("int").alias("label")
    )
    return profiles.label_disagreements(rows, known).select("src_row", "id", "name", "label", "registry_label")


def label_conflict_names(spark, sf_dir):
    return profiles.disagreement_report(label_conflicts(spark, sf_dir))


def document_registry(spark, sf_dir):
    """Documents as registry: labelled documents with their source as group, checked and counted."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.select("doc_id", "source", "lang").join(labels, "doc_id")
    counted = joined.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("quality") == 1).alias("n_pos"),
        F.count_if(F.col("toxic") == 1).alias("n_toxic"),
    )
    return counted


def required_columns(spark, sf_dir):
    """Which columns of a split input the orders offer, and how many values they have."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return checks.column_report(orders, ["id", "group_key", "label", "o_orderstatus"])


def padded_columns(spark, sf_dir):
    """A severity column is found under a padded name in other case."""
    rows = derived(spark, sf_dir, I.SEVERITY_LIST).withColumnRenamed("severity", " Severity ")
    column = checks.find_column(rows, checks.SEVERITY_COLUMN_NAMES, "severity", ignore_case=True)
    return rows.groupBy(F.col(f"`{column}`").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def null_counts(spark, sf_dir):
    return checks.null_report(derived(spark, sf_dir, I.ALIAS_TABLE), ["name_key", "structure"])


QUERIES = {
    "required_columns": required_columns,
    "padded_columns": padded_columns,
    "null_counts": null_counts,
    "label_drops": label_drops,
    "join_drops": join_drops,
    "registry_rows": registry_rows,
    "registry_summary": registry_summary,
    "registry_invariants": registry_invariants,
    "severity_counts": severity_counts,
    "label_conflicts": label_conflicts,
    "label_conflict_names": label_conflict_names,
    "document_registry": document_registry,
}

_NUM = sql_number("label")
SQL_REGISTRY = f"""
with labelled as (select src_row, id, name, cast({_NUM} as integer) as label, {sql_key('name')} as k
  from {sql_input(I.LABEL_LIST)} where {_NUM} in (0, 1)), {SQL_SEVERITY},
joined as (select l.*, r.structure, r.canonical, r.group_key, {sql_two_suffixes('l.k')} as s
  from labelled l join {sql_input(I.RESOLVED_LIST)} r on l.id = r.id),
rows_ as (select j.id, j.name, j.structure, j.canonical, j.group_key, j.label,
  case when a.k is not null then a.severity when b.k is not null then b.severity when c.bare is not null then c.severity end as severity,
  j.k in (select {sql_key('name')} from {sql_input(I.MEASURED_NAMES)}) as in_measured,
  j.k in (select {sql_key('name')} from {sql_input(I.UPSTREAM_NAMES)}) as in_upstream
  from joined j left join exact a on j.k = a.k left join exact b on j.s = b.k and j.s <> j.k left join bare c on j.k = c.bare)
"""
_CONFLICTS = f"""
with rows_ as (select src_row, id, name, cast({_NUM} as integer) as label, {sql_key('name')} as k
  from {sql_input(I.LABEL_LIST)} where {_NUM} in (0, 1)),
known as (select {sql_key('name')} as k, cast(src_row % 2 as integer) as registry_label, src_row from {sql_input(I.SEVERITY_LIST)}),
last_ as (select k, arg_max(registry_label, src_row) as registry_label from known group by 1),
conflict as (select src_row, id, name, label, registry_label from rows_ join last_ using (k) where label <> registry_label)
"""
SQL = {
    "required_columns": """
select 'id' as "column", true as present, count(o_orderkey) as n_values from orders
union all select 'o_orderstatus', true, count(o_orderstatus) from orders
union all select c, c in (select column_name from (describe orders)), 0 from (values ('group_key'), ('label')) v(c)""",
    "padded_columns": f"select severity, count(*) as n from {sql_input(I.SEVERITY_LIST)} group by 1",
    "null_counts": f"""
select count(*) filter (where coalesce(name_key, '') = '') as bad_name_key, count(*) filter (where coalesce(structure, '') = '') as bad_structure
from {sql_input(I.ALIAS_TABLE)}""",
    "label_drops": f"""
select count(*) as n_in, count(*) filter (where ok) as n_kept, count(*) filter (where not ok) as n_dropped
from (select coalesce({_NUM} in (0, 1), false) as ok from {sql_input(I.LABEL_LIST)})""",
    "join_drops": f"""
select count(*) as n_in, count(r.id) as n_joined, count(*) - count(r.id) as n_dropped
from (select id from {sql_input(I.LABEL_LIST)} where {_NUM} in (0, 1)) l left join {sql_input(I.RESOLVED_LIST)} r on l.id = r.id""",
    "registry_rows": SQL_REGISTRY + "select * from rows_",
    "registry_summary": SQL_REGISTRY
    + """select count(*) as n_registry, (select count(*) from part) as n_listed, count(*) filter (where label = 1) as n_pos,
  count(*) filter (where label = 0) as n_neg, round(count(*) filter (where label = 1) / count(*), 6) as pos_frac,
  round(count(*) / (select count(*) from part), 6) as resolution_rate, count(severity) as severity_count,
  round(count(severity) / count(*), 6) as severity_frac, count(*) filter (where in_measured) as measured_count,
  round(count(*) filter (where in_measured) / count(*), 6) as measured_frac, count(*) filter (where in_upstream) as upstream_count,
  round(count(*) filter (where in_upstream) / count(*), 6) as upstream_frac from rows_""",
    "registry_invariants": SQL_REGISTRY
    + """select count(*) as n_rows, count(*) - count(distinct id) as bad_duplicate_keys,
  count(*) filter (where canonical is null) as bad_null_canonical, count(*) filter (where severity is null) as bad_null_severity,
  count(*) filter (where label not in (0, 1)) as bad_binary_label from rows_""",
    "severity_counts": SQL_REGISTRY
    + """select severity as value, count(*) as n, round(100.0 * count(*) / (select count(*) from rows_), 6) as pct
  from rows_ group by 1""",
    "label_conflicts": _CONFLICTS + "select * from conflict",
    "label_conflict_names": _CONFLICTS + "select src_row, name from conflict order by src_row limit 10",
    "document_registry": """
select source, lang, count(*) as n, count(*) filter (where quality = 1) as n_pos, count(*) filter (where toxic = 1) as n_toxic
from documents join labels using (doc_id) group by 1, 2""",
}
