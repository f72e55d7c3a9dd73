"""Profile queries: store lookup, alignment, validation and the profile table."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitwright.functions.ids import PROFILE_ID_SNIFF_PATTERN
from splitwright.functions.vectors import vector_sum
from splitwright.operators import checks, dedupe, gates, profiles, resolve, scan, summary
from splitwright.plans import inputs as I
from splitwright.plans.inputs import derived, rounded, sql_input, table
from splitwright.plans.names import SQL_NUMBER, sql_all_suffixes
from splitwright.session import spread_small


def _store(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.concat(F.lit("id_"), F.col("vec_id").cast("string")).alias("colid"), F.col("embedding").alias("data"))


def _lookup(spark, sf_dir):
    queries = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("id_"), (F.col("l_partkey") % 700).cast("string")).alias("profile_id"), "l_orderkey", "l_linenumber"
    )
    return profiles.lookup_profiles(queries, _store(spark, sf_dir))


def profile_lookup(spark, sf_dir):
    total = vector_sum(F.transform("data", lambda x: x.cast("double")))
    return rounded(_lookup(spark, sf_dir).select("l_orderkey", "l_linenumber", "profile_id", "found", total.alias("total")))


def lookup_miss_rate(spark, sf_dir):
    return rounded(profiles.miss_rate(_lookup(spark, sf_dir)))


def missing_profiles(spark, sf_dir):
    queries = table(spark, sf_dir, "part").select(F.concat(F.lit("id_"), F.col("p_partkey").cast("string")).alias("profile_id"))
    return profiles.missing_ids(queries, _store(spark, sf_dir))


def aligned_rows(spark, sf_dir):
    """Parts and the first equally many line items, both in key order, joined by position."""
    left = scan.dense_row_number(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    right = scan.dense_row_number(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"])
    return profiles.align_by_row(left, right).select("row_idx", "o_orderkey", "p_partkey", "p_size")


def row_numbers(spark, sf_dir):
    return scan.dense_row_number(
        table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"]
    ).withColumn("row_idx", F.col("row_idx").cast("long"))


def _pairs(spark, sf_dir):
    """Stored vectors against a shifted and scaled copy with an item-specific disturbance."""
    noise = (F.col("vec_id") % 7).cast("double") / 100.0
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("label").alias("cell"),
        F.transform("embedding", lambda x: x.cast("double")).alias("a"),
        F.transform("embedding", lambda x, i: x.cast("double") * 0.9 + noise * (i % 3)).alias("b"),
    )


def dimension_correlation(spark, sf_dir):
    return rounded(profiles.dimension_correlation(_pairs(spark, sf_dir)))


def sampled_correlation(spark, sf_dir):
    sample = dedupe.seeded_sample(_pairs(spark, sf_dir), "vec_id", 100)
    return rounded(profiles.dimension_correlation(sample))


def correlation_summary(spark, sf_dir):
    return rounded(profiles.correlation_summary(profiles.dimension_correlation(_pairs(spark, sf_dir))))


def correlation_gate(spark, sf_dir):
    value = correlation_summary(spark, sf_dir).select(F.col("mean_r").alias("value"))
    return gates.correlation_gate(value)


def _profile_ids(spark, sf_dir):
    """Every row costs several text patterns, so a scan of one small file is spread over the cores."""
    return spread_small(derived(spark, sf_dir, I.PROFILE_IDS))


def parsed_ids(spark, sf_dir):
    return profiles.parse_profile_ids(_profile_ids(spark, sf_dir).select("src_row", "profile_id")).withColumn(
        "time_h", F.coalesce(F.col("time_h").cast("long"), F.lit(0).cast("long"))
    )


def _resolved_profiles(spark, sf_dir):
    rows = _profile_ids(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat("p_name", F.lit(" "), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit(" sodium")).alias("name")
    )
    registry = derived(spark, sf_dir, I.SEVERITY_LIST).withColumn("canonical", F.upper("name"))
    return resolve.resolve_suffix_free(rows.join(part, "l_partkey"), registry)


def rejected_profiles(spark, sf_dir):
    return profiles.rejected_profiles(_resolved_profiles(spark, sf_dir))


def profile_rows(spark, sf_dir):
    rows = profiles.profile_table(_resolved_profiles(spark, sf_dir), strict=False)
    known = F.when(F.isnan("dose_um"), F.lit(-1.0)).otherwise(F.col("dose_um"))
    return rows.withColumn("dose_um", known).withColumn("time_h", F.col("time_h").cast("long"))


def dose_distribution(spark, sf_dir):
    rows = profile_rows(spark, sf_dir).withColumn("src_row", F.col("profile_id"))
    return rounded(summary.group_with_first(rows, "dose_str", "dose_um"))


def cell_distribution(spark, sf_dir):
    return rounded(summary.value_counts(profile_rows(spark, sf_dir), "cell_id"))


def class_drift(spark, sf_dir):
    return rounded(summary.class_drift(profile_rows(spark, sf_dir)))


def profile_gates(spark, sf_dir):
    """All gates of a profile run, in one table."""
    rows, lookup = profile_rows(spark, sf_dir), lookup_miss_rate(spark, sf_dir)
    resolved = _resolved_profiles(spark, sf_dir).agg(F.avg(F.col("matched").cast("double")).alias("value"))
    retained = rows.agg(F.count(F.lit(1)).alias("value"))
    table_ = gates.miss_gate(lookup.select(F.col("miss_rate").alias("value"))).unionByName(gates.retained_gate(retained))
    table_ = table_.unionByName(correlation_gate(spark, sf_dir)).unionByName(gates.resolution_gate(resolved))
    return rounded(table_)


def profile_status(spark, sf_dir):
    return gates.run_status(profile_gates(spark, sf_dir))


def _wide(spark, sf_dir):
    """Embeddings spread over numbered columns."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("Compound_Name"),
        (F.col("label") % 2).alias("Label"),
        *[F.col("embedding")[k].alias(f"expression_{k}") for k in range(64)],
        *[(F.col("embedding")[k] > 0).alias(f"split_{k:02d}") for k in range(50)],
    )


def _record(spark, sf_dir):
    """Embeddings as records with arrays."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("drug_name"),
        (F.col("label") % 3).alias("y"),
        F.col("embedding").alias("X"),
        F.transform(F.slice("embedding", 1, 50), lambda x: x > 0).alias("splits"),
    )


def _profile_totals(found):
    total = vector_sum(F.transform("expressions", lambda x: x.cast("double")))
    flags = F.size(F.filter("split_flags", lambda f: f)).cast("long")
    return rounded(found.select("compound_name", "label", total.alias("total"), flags.alias("n_flags")))


def wide_profiles(spark, sf_dir):
    """Embeddings spread over numbered columns, read back as a profile set."""
    return _profile_totals(checks.profile_set(_wide(spark, sf_dir), "table", 64, 50))


def record_profiles(spark, sf_dir):
    return checks.profile_violations(checks.profile_set(_record(spark, sf_dir), "record"), 64, 50)


def detected_table_profiles(spark, sf_dir):
    """The layout of the spread embeddings is found from the schema."""
    return _profile_totals(checks.profile_set(_wide(spark, sf_dir), None, 64, 50))


def detected_record_profiles(spark, sf_dir):
    return _profile_totals(checks.profile_set(_record(spark, sf_dir), None, 64, 50))


def detected_nested_profiles(spark, sf_dir):
    """Records in lists: one list for each row, beside a column that is no part of the profiles."""
    record = _record(spark, sf_dir)
    nested = record.select(F.lit("x").alias("note"), F.array(F.struct(*record.columns)).alias("rows"))
    return _profile_totals(checks.profile_set(nested, None, 64, 50))


def sniffed_ids(spark, sf_dir):
    """Rows of another layout come later in the table; the first rows decide about the column."""
    rows = derived(spark, sf_dir, I.PROFILE_IDS)
    order = F.struct(F.when(F.col("profile_id").contains("H:"), 0).otherwise(1), F.col("src_row")).alias("src_row")
    padded = rows.select(order, F.lit("note").alias("comment"), F.concat(F.lit(" \t"), "profile_id", F.lit("\n ")).alias("column_7"))
    return checks.load_profile_ids(padded, PROFILE_ID_SNIFF_PATTERN, expected_rows=None).select("profile_id")


def identified_profiles(spark, sf_dir):
    """Ids from a sniffed column meet the profiles of a detected layout by position."""
    emb = table(spark, sf_dir, "embeddings")
    rows = emb.select(
        F.col("vec_id").alias("src_row"),
        F.col("vec_id").cast("string").alias("drug_name"),
        (F.col("label") % 2).alias("y"),
        F.col("embedding").alias("X"),
        F.transform(F.slice("embedding", 1, 50), lambda x: x > 0).alias("splits"),
    )
    # listed in the opposite order of the profiles
    profile_id = F.concat(F.lit(" P"), "vec_id", F.lit("_MCF7_24H:BRD-K"), "vec_id", F.lit(":"), "label")
    listed = emb.select((-F.col("vec_id")).alias("src_row"), F.lit("note").alias("comment"), profile_id.alias("column_2"))
    found = checks.profile_set(rows, None, 64, 50, keep=["src_row"])
    ids = checks.load_profile_ids(listed, PROFILE_ID_SNIFF_PATTERN, expected_rows=None)
    aligned = profiles.identified_profiles(found, ids)
    total = vector_sum(F.transform("expressions", lambda x: x.cast("double")))
    flags = F.size(F.filter("split_flags", lambda f: f)).cast("long")
    return rounded(aligned.select("row_idx", "profile_id", "name", F.col("label").cast("long").alias("label"), total.alias("total"), flags.alias("n_flags")))


def store_check(spark, sf_dir):
    dims = spark.range(64).select(F.col("id").alias("pos"), F.concat(F.lit("dim_"), F.col("id").cast("string")).alias("rowid"))
    check = profiles.vector_width_check(_store(spark, sf_dir), dims)
    return check.withColumn("min_width", F.col("min_width").cast("long")).withColumn("max_width", F.col("max_width").cast("long"))


def flag_columns(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform(F.slice("embedding", 1, 50), lambda x: x > 0).alias("split_flags")
    )
    return profiles.with_flag_columns(emb)


QUERIES = {
    "profile_lookup": profile_lookup,
    "lookup_miss_rate": lookup_miss_rate,
    "missing_profiles": missing_profiles,
    "aligned_rows": aligned_rows,
    "row_numbers": row_numbers,
    "dimension_correlation": dimension_correlation,
    "sampled_correlation": sampled_correlation,
    "correlation_summary": correlation_summary,
    "correlation_gate": correlation_gate,
    "parsed_ids": parsed_ids,
    "profile_rows": profile_rows,
    "rejected_profiles": rejected_profiles,
    "dose_distribution": dose_distribution,
    "cell_distribution": cell_distribution,
    "class_drift": class_drift,
    "profile_gates": profile_gates,
    "profile_status": profile_status,
    "wide_profiles": wide_profiles,
    "record_profiles": record_profiles,
    "detected_table_profiles": detected_table_profiles,
    "detected_record_profiles": detected_record_profiles,
    "detected_nested_profiles": detected_nested_profiles,
    "sniffed_ids": sniffed_ids,
    "identified_profiles": identified_profiles,
    "store_check": store_check,
    "flag_columns": flag_columns,
}

_LOOKUP = """
with q as (select l_orderkey, l_linenumber, 'id_' || cast(l_partkey % 700 as varchar) as profile_id from lineitem),
s as (select 'id_' || cast(vec_id as varchar) as colid, list_sum(list_transform(embedding, lambda x: cast(x as double))) as total from embeddings),
looked as (select q.*, s.colid is not null as found, round(s.total, 6) as total from q left join s on q.profile_id = s.colid)
"""


def _corr(source: str = "embeddings") -> str:
    return f"""
with long as (select cast(x as double) as a, cast(x as double) * 0.9 + (vec_id % 7) / 100.0 * (i % 3) as b, i as pos
  from (select vec_id, unnest(embedding) as x, unnest(range(0, 64)) as i from {source})),
r as (select pos, case when min(a) = max(a) or min(b) = max(b) then 'nan'::double else corr(a, b) end as r, count(*) as n from long group by 1)
"""


_PATTERN = r"'^([A-Z0-9]+)_([A-Z0-9]+)_([0-9]+)H:([A-Z0-9\-]+):(\S+)$'"
_PARSED = f"""
parsed as (select *, regexp_matches(profile_id, {_PATTERN}) as ok, regexp_extract(profile_id, {_PATTERN}, 1) as plate,
  regexp_extract(profile_id, {_PATTERN}, 2) as cell_id, regexp_extract(profile_id, {_PATTERN}, 3) as time_h,
  regexp_extract(profile_id, {_PATTERN}, 4) as brd_id, regexp_extract(profile_id, {_PATTERN}, 5) as dose_str from {sql_input(I.PROFILE_IDS)})"""
_TABLE = f"""
with {_PARSED},
named as (select p.*, lower(t.p_name || ' ' || replace(t.p_brand, '#', '')) || ' sodium' as nm_l,
   t.p_name || ' ' || lower(replace(t.p_brand, '#', '')) || ' sodium' as name from parsed p join part t on p.l_partkey = t.p_partkey),
reg as (select {sql_all_suffixes('name')} as k, arg_min(upper(name), src_row) as canonical, arg_min(row(severity), src_row) as sev
  from {sql_input(I.SEVERITY_LIST)} group by 1),
resolved as (select n.*, r.canonical, (r.sev)[1] as severity, r.k is not null as matched from named n left join reg r on {sql_all_suffixes('n.name')} = r.k),
rows_ as (select profile_id, name as compound_name, brd_id, cell_id, cast(time_h as bigint) as time_h, dose_str,
  case when regexp_matches(dose_str, {SQL_NUMBER}) then cast(dose_str as double) else -1.0 end as dose_um,
  canonical as structure, label, coalesce(severity, '') as severity,
  substr(sha256(canonical || '|' || cell_id || '|' || dose_str), 1, 16) as tuple_key from resolved where matched and ok)
"""
_DRIFT = """select count(*) as n, count(*) filter (where label = 1) as n_pos, count(*) filter (where label = 0) as n_neg,
  round(count(*) filter (where label = 1) / greatest(count(*) filter (where label = 0), 1), 6) as pn_ratio,
  abs(count(*) - 6000) / 6000.0 < 0.05 and count(*) filter (where label = 1) / greatest(count(*) filter (where label = 0), 1) between 1.25 and 1.69 as within from rows_"""
_MEAN_R = "round((select avg(r) from r where not isnan(r)), 6)"
_GATES = (
    _TABLE.rstrip()
    + ","
    + _LOOKUP.strip().removeprefix("with")
    + ","
    + _corr().strip().removeprefix("with")
    + f""", vals as (
  select 'lookup_miss' as gate, round((select avg(case when found then 0.0 else 1.0 end) from looked), 6) as value, '<= 0.01' as threshold
  union all select 'retained_rows', (select count(*) from rows_), '[5700, 6000]'
  union all select 'profile_correlation', {_MEAN_R}, '>= 0.99'
  union all select 'resolution_rate', round((select avg(case when matched then 1.0 else 0.0 end) from resolved), 6), '>= 0.9'),
gates as (select gate, cast(value as double) as value, threshold, case gate when 'lookup_miss' then value <= 0.01 when 'retained_rows' then value between 5700 and 6000
   when 'profile_correlation' then value >= 0.99 else value >= 0.9 end as passed from vals),
final as (select *, case when passed then 'pass' when gate = 'profile_correlation' and value >= 0.95 then 'flag' else 'fail' end as status from gates)
"""
)
_TOTALS = """
select cast(vec_id as varchar) as compound_name, cast(label % {classes} as double) as label,
  round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 6) as total,
  len(list_filter(embedding[1:50], lambda x: x > 0)) as n_flags from embeddings"""
SQL = {
    "detected_table_profiles": _TOTALS.format(classes=2),
    "detected_record_profiles": _TOTALS.format(classes=3),
    "detected_nested_profiles": _TOTALS.format(classes=3),
    "profile_lookup": _LOOKUP + "select l_orderkey, l_linenumber, profile_id, found, total from looked",
    "lookup_miss_rate": _LOOKUP
    + """select count(*) as n_input, count(*) filter (where found) as n_found, count(*) filter (where not found) as n_missing,
  round(avg(case when found then 0.0 else 1.0 end), 6) as miss_rate from looked""",
    "missing_profiles": """
select 'id_' || cast(p_partkey as varchar) as profile_id from part where p_partkey not in (select vec_id from embeddings)""",
    "aligned_rows": """
with a as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as row_idx from orders),
b as (select p_partkey, p_size, row_number() over (order by p_partkey) - 1 as row_idx from part)
select row_idx, o_orderkey, p_partkey, p_size from a join b using (row_idx)""",
    "row_numbers": "select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_orderkey) - 1 as row_idx from orders",
    "dimension_correlation": _corr() + "select pos, round(r, 6) as r, n from r",
    "sampled_correlation": _corr("(select * from embeddings order by md5(cast(vec_id as varchar) || ':42'), vec_id limit 100)")
    + "select pos, round(r, 6) as r, n from r",
    "correlation_summary": _corr()
    + "select round(avg(r), 6) as mean_r, round(median(r), 6) as median_r, count(*) filter (where r < 0.99) as n_low, count(*) as n_finite from r where not isnan(r)",
    "correlation_gate": _corr()
    + f"""select 'profile_correlation' as gate, {_MEAN_R} as value, '>= 0.99' as threshold, {_MEAN_R} >= 0.99 as passed,
  case when {_MEAN_R} >= 0.99 then 'pass' when {_MEAN_R} >= 0.95 then 'flag' else 'fail' end as status""",
    "parsed_ids": f"""
with {_PARSED}
select src_row, profile_id, case when ok then plate end as plate, case when ok then cell_id end as cell_id,
  case when ok then cast(time_h as bigint) else 0 end as time_h, case when ok then brd_id end as brd_id,
  case when ok then dose_str end as dose_str, ok as id_ok from parsed""",
    "profile_rows": _TABLE + "select * from rows_",
    "rejected_profiles": _TABLE + "select profile_id, name from resolved where matched and not ok",
    "dose_distribution": _TABLE + "select dose_str, min(dose_um) as dose_um, count(*) as n from rows_ group by 1",
    "cell_distribution": _TABLE
    + "select cell_id as value, count(*) as n, round(100.0 * count(*) / (select count(*) from rows_), 6) as pct from rows_ group by 1",
    "class_drift": _TABLE + _DRIFT,
    "profile_gates": _GATES + "select gate, value, threshold, passed, status from final",
    "profile_status": _GATES
    + """select coalesce(min_by(gate, case gate when 'lookup_miss' then 1 when 'retained_rows' then 2 else 3 end), 'ok') as status
  from final where status = 'fail' and gate <> 'resolution_rate'""",
    "wide_profiles": _TOTALS.format(classes=2),
    "record_profiles": """
select count(*) as n_rows, count(*) filter (where label % 3 = 2) as bad_label, count(*) filter (where len(embedding) <> 64) as bad_expression_width,
  cast(0 as bigint) as bad_flag_width from embeddings""",
    "sniffed_ids": f"select profile_id from {sql_input(I.PROFILE_IDS)}",
    "identified_profiles": """
with p as (select row_number() over (order by vec_id) - 1 as row_idx, cast(vec_id as varchar) as name, cast(label % 2 as bigint) as label,
    round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 6) as total,
    cast(len(list_filter(embedding[1:50], lambda x: x > 0)) as bigint) as n_flags from embeddings),
i as (select row_number() over (order by vec_id desc) - 1 as row_idx,
    'P' || vec_id || '_MCF7_24H:BRD-K' || vec_id || ':' || label as profile_id from embeddings)
select row_idx, profile_id, name, label, total, n_flags from p join i using (row_idx)""",
    "store_check": "select min(len(embedding)) as min_width, max(len(embedding)) as max_width, cast(64 as bigint) as n_dimensions, min(len(embedding)) = 64 and max(len(embedding)) = 64 as ok from embeddings",
    "flag_columns": "select vec_id, " + ", ".join(f"embedding[{k + 1}] > 0 as split_{k:02d}" for k in range(50)) + " from embeddings",
}
