"""Entity resolution: alias indexes, staged name lookups and reject routing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwright.functions.names import (
    name_key,
    spread_key,
    strip_all_suffixes,
    strip_one_suffix,
    strip_two_suffixes,
    with_computed,
    trimmed,
)
from splitwright.operators.checks import require_columns
from splitwright.operators.dedupe import distinct_keys, keep_first
from splitwright.session import lookup_side

# Reject reasons and the source mark of a resolved row.
REASON_NOT_IN_INDEX = "name_not_in_index"
REASON_INVALID = "structure_parse_failure"
INDEX_SOURCE = "alias_index"


def not_blank(structure: Column) -> Column:
    """Default validity of a structure text: neither null nor blank."""
    return F.coalesce(trimmed(structure) != "", F.lit(False))


def resolve_names(
    items: DataFrame,
    index: DataFrame,
    id_col: str = "id",
    name_col: str = "name",
    valid: Callable[[Column], Column] = not_blank,
    canonical: Callable[[Column], Column] = lambda c: c,
) -> DataFrame:
    """Look names up in an alias index, then once more without a suffix token.

    ``index`` holds ``name_key, structure`` (and ``src_row`` when a key may repeat; the first row
    wins). A missing *or empty* structure triggers the second lookup; there, presence of the key
    decides. Every input row comes out once, with ``structure, canonical, source, reason``:
    ``reason`` is null for resolved rows. ``valid`` and ``canonical`` are user expressions on the
    structure.
    """
    require_columns(items, [id_col, name_col], "items")
    require_columns(index, ["name_key", "structure"], "index")
    if "src_row" in index.columns:
        index = keep_first(index.select("name_key", "structure", "src_row"), "name_key").drop("src_row")
        index = lookup_side(index)
    # an index without src_row must already be unique per key, which build_alias_index guarantees
    index = index.where(F.col("name_key").isNotNull()).select("name_key", "structure")

    keyed = with_computed(items, "_key", name_key(F.col(name_col))).withColumn(
        "_probe", spread_key(F.col("_key"), F.col(id_col))
    )
    direct = index.select(F.col("name_key").alias("_probe"), F.col("structure").alias("_direct"))
    missed = F.coalesce(F.col("_direct") == "", F.lit(True))
    once = with_computed(keyed.join(direct, "_probe", "left"), "_retry", F.when(missed, strip_one_suffix(F.col("_key"))))
    second = index.select(
        F.col("name_key").alias("_again"), F.col("structure").alias("_second"), F.lit(True).alias("_hit")
    )
    twice = once.withColumn("_again", spread_key(F.col("_retry"), F.col(id_col))).join(second, "_again", "left")

    found_direct = F.coalesce(F.col("_direct") != "", F.lit(False))
    found_second = F.coalesce(F.col("_hit"), F.lit(False))
    structure = F.when(found_direct, F.col("_direct")).when(found_second, F.col("_second"))
    reason = F.when(~found_direct & ~found_second, F.lit(REASON_NOT_IN_INDEX)).when(
        ~valid(F.col("structure")), F.lit(REASON_INVALID)
    )
    return (
        twice.withColumn("structure", structure)
        .withColumn("reason", reason)
        .select(
            *[F.col(c) for c in items.columns],
            F.col("_key").alias("name_key"),
            "structure",
            F.when(F.col("reason").isNull(), canonical(F.col("structure"))).alias("canonical"),
            F.when(F.col("reason").isNull(), F.lit(INDEX_SOURCE)).alias("source"),
            "reason",
        )
    )


def resolved_rows(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("reason").isNull()).drop("reason")


def rejected_rows(routed: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    return routed.where(F.col("reason").isNotNull()).select(id_col, name_col, "reason")


def keyed_lookup(
    reference: DataFrame, value_col: str, members: Mapping[str, DataFrame] | None = None, name_col: str = "name"
) -> DataFrame:
    """One row a name key with everything that is known of it, written once for all probes.

    ``_exact`` is the value of the first reference row of that name, ``_bare`` that of the first whose name is the key once its
    suffix tokens are gone; both are structs, as a hit may hold a null value. Each list of ``members`` adds a boolean
    column of its name. Null keys are left out, and so are empty names of member lists. Reference rows without a position come last.
    """
    require_columns(reference, [name_col, value_col, "src_row"], "reference")
    members = dict(members or {})
    keyed = reference.select(name_key(F.col(name_col)).alias("_k"), F.col(value_col).alias("value"), "src_row")
    keyed = keyed.where(F.col("_k").isNotNull())
    hit = F.struct("value", F.isnull("src_row").alias("late"), "src_row")
    rows = keyed.select("_k", hit.alias("_exact"))
    rows = rows.unionByName(keyed.select(strip_two_suffixes(F.col("_k")).alias("_k"), hit.alias("_bare")), allowMissingColumns=True)
    for flag, listed in members.items():
        names = listed.select(name_key(F.col("name")).alias("_k"), F.lit(True).alias(flag))
        rows = rows.unionByName(names.where(F.col("_k") != ""), allowMissingColumns=True)

    def first(column: str) -> Column:
        order = F.when(F.col(column).isNotNull(), F.struct(f"{column}.late", f"{column}.src_row"))
        return F.min_by(F.when(F.col(column).isNotNull(), F.struct(f"{column}.value")), order).alias(column)

    flags = [F.coalesce(F.max(flag), F.lit(False)).alias(flag) for flag in members]
    return lookup_side(rows.groupBy("_k").agg(first("_exact"), first("_bare"), *flags))


def probe_names(
    items: DataFrame, lookup: DataFrame, out_col: str, flags: Sequence[str] = (), id_col: str = "id", name_col: str = "name"
) -> DataFrame:
    """Items with ``out_col, lookup_step`` and the membership ``flags``, from a :func:`keyed_lookup`.

    Names probe it as they are, which decides steps 1 and 3 and all flags at once; those without an exact hit
    probe it again without suffix tokens.
    """
    work = with_computed(items, "_name", name_key(F.col(name_col)))
    known = lookup.select("_k", "_exact", "_bare", *[F.col(flag).alias(f"_in_{flag}") for flag in flags])
    work = work.withColumn("_k", spread_key(F.col("_name"), F.col(id_col))).join(known, "_k", "left").drop("_k")
    work = with_computed(work, "_short", F.when(F.col("_exact").isNull(), strip_two_suffixes(F.col("_name"))))
    retry = F.when(F.col("_short") != F.col("_name"), F.col("_short"))
    by_short = lookup.where(F.col("_exact").isNotNull()).select("_k", F.col("_exact").alias("_again"))
    work = work.withColumn("_k", spread_key(retry, F.col(id_col))).join(by_short, "_k", "left").drop("_k")
    hit = {column: F.col(column).isNotNull() for column in ("_exact", "_again", "_bare")}
    value = F.coalesce(*[F.when(found, F.struct(F.col(f"{column}.value"))) for column, found in hit.items()])["value"]
    step = F.when(hit["_exact"], F.lit(1)).when(hit["_again"], F.lit(2)).when(hit["_bare"], F.lit(3))
    found = [F.coalesce(f"_in_{flag}", F.lit(False)).alias(flag) for flag in flags]
    own = [F.col(c) for c in items.columns]
    return work.select(*own, value.alias(out_col), step.otherwise(F.lit(0)).alias("lookup_step"), *found)


def priority_lookup(
    items: DataFrame,
    reference: DataFrame,
    value_col: str,
    id_col: str = "id",
    name_col: str = "name",
    out_col: str | None = None,
) -> DataFrame:
    """Value of a reference list by name, in three steps.

    1. the name as it is; 2. the name without suffix tokens, when that differs; 3. the name among
    the suffix-free reference names. A hit counts even when its value is null, so the steps are
    decided by hit marks; ``lookup_step`` says which one hit (0: none). ``reference`` holds ``name, <value_col>, src_row``; the first row per key
    wins. All steps probe one table, so the items shuffle twice at most.
    """
    return probe_names(items, keyed_lookup(reference, value_col, name_col=name_col), out_col or value_col, (), id_col, name_col)


def resolve_suffix_free(
    queries: DataFrame, registry: DataFrame, id_col: str = "src_row", name_col: str = "name"
) -> DataFrame:
    """Lookup with all suffix tokens stripped on both sides; the first registry row per key wins.

    ``registry`` holds ``name, canonical, severity, src_row``. Every query row comes out once with
    ``canonical, severity, matched``; an empty severity reads as null. Rows with ``matched`` false
    are the misses, in source order by ``id_col``.
    """
    require_columns(registry, ["name", "canonical", "severity", "src_row"], "registry")
    keyed = registry.select(
        strip_all_suffixes(F.col("name")).alias("_k"),
        "canonical",
        F.nullif(F.col("severity"), F.lit("")).alias("severity"),
        "src_row",
    ).where(F.col("_k") != "")
    lookup = lookup_side(keep_first(keyed, "_k").select("_k", "canonical", "severity", F.lit(True).alias("_hit")))
    probe = spread_key(strip_all_suffixes(F.col(name_col)), F.col(id_col))
    joined = with_computed(queries, "_k", probe).join(lookup, "_k", "left")
    return joined.select(
        *[F.col(c) for c in queries.columns],
        "canonical",
        "severity",
        F.coalesce(F.col("_hit"), F.lit(False)).alias("matched"),
    )


def dropped_rows(resolved: DataFrame, id_col: str = "src_row", name_col: str = "name") -> DataFrame:
    """Position and original name of the rows without a match (null names read as empty)."""
    return resolved.where(~F.col("matched")).select(
        F.col(id_col), F.coalesce(F.col(name_col), F.lit("")).alias(name_col)
    )


def member_flag(
    items: DataFrame, members: DataFrame, out_col: str, id_col: str = "id", name_col: str = "name"
) -> DataFrame:
    """Boolean column: is the normalised name in the member list?"""
    keys = lookup_side(distinct_keys(members, name_key(F.col("name")), "_k").withColumn("_in", F.lit(True)))
    probe = spread_key(name_key(F.col(name_col)), F.col(id_col))
    joined = with_computed(items, "_k", probe).join(keys, "_k", "left")
    return joined.select(*[F.col(c) for c in items.columns], F.coalesce("_in", F.lit(False)).alias(out_col))


def derive_once_per_key(rows: DataFrame, key: Column, derive: Callable[[DataFrame], DataFrame], id_col: str) -> DataFrame:
    """Compute something costly once per distinct key and map it back to all rows.

    ``derive`` turns the one-column table ``key`` into ``key`` plus new columns, one row per key.
    """
    keyed = rows.withColumn("key", key)
    derived = derive(keyed.select("key").where(F.col("key").isNotNull()).distinct())
    new = [c for c in derived.columns if c != "key"]
    probe = lookup_side(derived.select(F.col("key").alias("_k"), *new))
    return (
        keyed.withColumn("_k", spread_key(F.col("key"), F.col(id_col)))
        .join(probe, "_k", "left")
        .select(*rows.columns, *new)
    )


def build_alias_index(records: DataFrame) -> DataFrame:
    """Alias index ``name_key, name, structure`` of nested records.

    ``records`` holds ``src_row, name, structure, aliases ARRAY<STRING>``. Primary name and aliases
    all lead to the structure; an alias claimed twice belongs to the record that comes first;
    records without a name or a structure are skipped.
    """
    require_columns(records, ["src_row", "name", "structure", "aliases"], "records")
    usable = records.where(not_blank(F.col("name")) & not_blank(F.col("structure")))
    names = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = usable.select(
        "src_row", trimmed(F.col("name")).alias("name"), trimmed(F.col("structure")).alias("structure"), F.explode(names).alias("alias")
    ).select(name_key(F.col("alias")).alias("name_key"), "name", "structure", "src_row")
    rows = rows.where(F.col("name_key").isNotNull() & (F.col("name_key") != ""))
    return keep_first(rows, "name_key").select("name_key", "name", "structure")
