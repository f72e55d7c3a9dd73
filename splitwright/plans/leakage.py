"""Leakage filter and novelty queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitwright.operators import gates, leakage
from splitwright.plans import inputs as I
from splitwright.plans.inputs import derived, sql_input
from splitwright.plans.names import sql_key


def _protected(spark, sf_dir):
    return leakage.protected_sets(derived(spark, sf_dir, I.TEST_IDS), derived(spark, sf_dir, I.PROTECTED_REGISTRY))


def _marked_names(spark, sf_dir):
    names, keys = _protected(spark, sf_dir)
    return leakage.mark_upstream_names(derived(spark, sf_dir, I.UPSTREAM_LIST), names, keys)


def unresolved_ids(spark, sf_dir):
    return leakage.unresolved_ids(derived(spark, sf_dir, I.TEST_IDS), derived(spark, sf_dir, I.PROTECTED_REGISTRY))


def marked_names(spark, sf_dir):
    return _marked_names(spark, sf_dir).select("name", "by_name", "by_key")


def surviving_names(spark, sf_dir):
    return leakage.surviving_names(_marked_names(spark, sf_dir))


def exclusion_counts(spark, sf_dir):
    _, keys = _protected(spark, sf_dir)
    return leakage.exclusion_counts(_marked_names(spark, sf_dir), keys)


def _measurements(spark, sf_dir):
    registry = derived(spark, sf_dir, I.PROTECTED_PARTS)
    names, keys = leakage.protected_sets(registry.select("id"), registry)
    return leakage.mark_measurements(
        derived(spark, sf_dir, I.MEASUREMENTS), derived(spark, sf_dir, I.PART_INDEX), names, keys, "row_id"
    )


def safe_measurements(spark, sf_dir):
    return leakage.safe_rows(_measurements(spark, sf_dir)).select("row_id", "drug_name")


def filter_breakdown(spark, sf_dir):
    return leakage.filter_breakdown(_measurements(spark, sf_dir))


def _slices(spark, sf_dir):
    registry = derived(spark, sf_dir, I.PROTECTED_REGISTRY)
    train_keys = registry.where("not in_test").select("group_key")
    return leakage.novelty_slices(registry.where("in_test"), derived(spark, sf_dir, I.UPSTREAM_NAMES), train_keys)


def novelty_slices(spark, sf_dir):
    return _slices(spark, sf_dir).select("id", "in_upstream_now", "name_novel", "name_and_key_novel")


def novelty_counts(spark, sf_dir):
    return leakage.slice_counts(_slices(spark, sf_dir))


def membership_drift(spark, sf_dir):
    return leakage.membership_drift(_slices(spark, sf_dir), "flag")


def name_novel_gate(spark, sf_dir):
    return gates.name_novel_gate(novelty_counts(spark, sf_dir).select(F.col("test_name_novel").alias("value")))


QUERIES = {
    "unresolved_ids": unresolved_ids,
    "marked_names": marked_names,
    "surviving_names": surviving_names,
    "exclusion_counts": exclusion_counts,
    "safe_measurements": safe_measurements,
    "filter_breakdown": filter_breakdown,
    "novelty_slices": novelty_slices,
    "novelty_counts": novelty_counts,
    "membership_drift": membership_drift,
    "name_novel_gate": name_novel_gate,
}

_REG, _IDS = sql_input(I.PROTECTED_REGISTRY), sql_input(I.TEST_IDS)
_NAMES = f"""
with prot as (select * from {_REG} where id in (select id from {_IDS})),
pkeys as (select distinct group_key from prot where coalesce(group_key, '') <> ''),
up as (select name, arg_max(group_key, src_row) as group_key from {sql_input(I.UPSTREAM_LIST)} group by 1),
marked as (select name, {sql_key('name')} in (select {sql_key('name')} from prot) as by_name,
  coalesce(group_key, '') in (select group_key from pkeys) as by_key from up)
"""
_ROWS = f"""
with prot as (select * from {sql_input(I.PROTECTED_PARTS)}),
marked as (select m.row_id, m.drug_name, coalesce(lower(m.drug_name) in (select {sql_key('name')} from prot), false) as by_name,
  coalesce(i.group_key in (select group_key from prot where group_key <> ''), false) as by_key, i.structure is not null as resolved
  from {sql_input(I.MEASUREMENTS)} m left join {sql_input(I.PART_INDEX)} i on lower(m.drug_name) = i.name_key)
"""
_SLICES = f"""
with tk as (select distinct coalesce(group_key, '') as k from {_REG} where not in_test),
s as (select id, flag, {sql_key('name')} in (select {sql_key('name')} from {sql_input(I.UPSTREAM_NAMES)}) as known,
  coalesce(group_key, '') in (select k from tk) as key_known from {_REG} where in_test)
"""
SQL = {
    "unresolved_ids": f"select count(*) as n_unresolved from {_IDS} where id not in (select id from {_REG})",
    "marked_names": _NAMES + "select * from marked",
    "surviving_names": _NAMES + "select name from marked where not by_name and not by_key",
    "exclusion_counts": _NAMES
    + """select count(*) as total, count(*) filter (where by_key) as excluded_by_key, count(*) filter (where by_name) as excluded_by_name,
  count(*) filter (where by_key and by_name) as excluded_intersection, count(*) filter (where not by_key and not by_name) as train_after_exclusion,
  count(*) filter (where by_key) as key_match_count, count(*) filter (where by_name) as name_match_count,
  (select count(*) from pkeys) as protected_key_count from marked""",
    "safe_measurements": _ROWS + "select row_id, drug_name from marked where not by_name and not by_key",
    "filter_breakdown": _ROWS
    + """select count(*) as n_in, count(*) filter (where not by_name and not by_key) as n_out,
  count(*) filter (where by_name or by_key) as n_dropped_total, count(*) filter (where by_name and not by_key) as n_name_only,
  count(*) filter (where by_key and not by_name) as n_key_only, count(*) filter (where by_name and by_key) as n_both,
  count(*) filter (where not resolved) as n_unresolved from marked""",
    "novelty_slices": _SLICES + "select id, known as in_upstream_now, not known as name_novel, not known and not key_known as name_and_key_novel from s",
    "novelty_counts": _SLICES
    + """select count(*) filter (where known) as test_in_upstream, count(*) filter (where not known) as test_name_novel,
  count(*) filter (where not known and not key_known) as test_name_and_key_novel from s""",
    "membership_drift": _SLICES + "select count(*) filter (where flag <> known) as n_drift from s",
    "name_novel_gate": _SLICES
    + """select 'name_novel' as gate, cast(count(*) filter (where not known) as double) as value, '>= 30' as threshold,
  count(*) filter (where not known) >= 30 as passed, case when count(*) filter (where not known) >= 30 then 'pass' else 'fail' end as status from s""",
}
