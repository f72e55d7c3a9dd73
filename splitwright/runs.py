"""Whole runs: the operators combined the way a dataset is prepared from start to end.

Each run writes its results below a folder and returns them as tables. Gates are rows, written after
all results; what to do about a failing gate is up to the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwright.functions.ids import PROFILE_ID_SNIFF_PATTERN
from splitwright.operators import checks, gates, leakage, profiles, registry, resolve, similarity, splits, summary
from splitwright.operators.checks import invariant_report, raise_on_violations, require_columns
from splitwright.operators.clusters import cluster_split
from splitwright.operators.dedupe import seeded_sample
from splitwright.session import settled, stored
from splitwright.sources.files import file_manifest, write_diagnostics
from splitwright.sources.profiles import write_aligned
from splitwright.sources.splits import read_split, write_split
from splitwright.sources.tables import write_csv, write_parquet

#: Name under which a written split lists the group keys of its test items.
TEST_KEYS = "test_group_keys"


def _kept(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """The stored result of a step; its scratch tables are gone."""
    return settled(spark, build, label).table


def _share(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.coalesce(F.avg(condition.cast("double")), F.lit(0.0)).alias("value"))


def resolve_run(
    labels: DataFrame,
    index: DataFrame,
    out: str,
    valid: Callable[[Column], Column] = resolve.not_blank,
    canonical: Callable[[Column], Column] = lambda c: c,
) -> dict[str, DataFrame]:
    """Resolve the names of a label list; writes ``resolved`` and ``rejected`` as CSV."""
    routed = _kept(labels.sparkSession, lambda: resolve.resolve_names(labels, index, valid=valid, canonical=canonical), "routed")
    resolved, rejected = resolve.resolved_rows(routed), resolve.rejected_rows(routed)
    write_csv(resolved, f"{out}/resolved")
    write_csv(rejected, f"{out}/rejected")
    gate = gates.resolution_gate(_share(routed, F.col("reason").isNull()))
    return {"resolved": resolved, "rejected": rejected, "reasons": summary.value_counts(rejected, "reason"), "gates": gate}


def registry_run(
    labels: DataFrame, severities: DataFrame, resolved: DataFrame, measured: DataFrame, upstream: DataFrame, out: str
) -> dict[str, DataFrame]:
    """Build, check, write and summarise the registry."""
    build = lambda: registry.build_registry(labels, severities, resolved, measured, upstream)
    built = _kept(labels.sparkSession, build, "registry")
    raise_on_violations(invariant_report(built, "id", ["canonical"], ["label"]), "registry")
    write_csv(built, f"{out}/registry")
    return {"registry": built, "summary": summary.registry_summary(built, labels.count())}


def split_run(
    items: DataFrame,
    upstream: DataFrame,
    out: str,
    seed: int | None = 42,
    threshold: float = 0.4,
    external: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Group split, cluster split, upstream filter, novelty slices, histograms and diagnostics.

    ``items`` is a registry with a fingerprint column ``fp``; ``upstream`` holds ``src_row, name,
    group_key``; ``external`` is a split made elsewhere (``id, split``).
    """
    require_columns(items, ["id", "name", "group_key", "label", "in_measured", "in_upstream", "fp"], "items")
    spark = items.sparkSession
    grouped = _kept(spark, lambda: splits.group_split(items, seed=seed), "grouped")
    clustered = _kept(spark, lambda: cluster_split(items, threshold=threshold), "clustered")
    for assigned in (grouped, clustered):
        splits.check_disjoint(assigned)

    test, train = grouped.where("split = 'test'"), grouped.where("split = 'train'")
    names, keys = leakage.protected_sets(test.select("id"), items)
    marked = _kept(spark, lambda: leakage.mark_upstream_names(upstream, names, keys), "marked")
    slices = _kept(spark, lambda: leakage.novelty_slices(test, upstream, train.select("group_key")), "slices")
    named = lambda df, name: df.select(F.lit(name).alias("split"), F.col("id").cast("string").alias("id"))
    lists = [grouped.select("split", F.col("id").cast("string").alias("id"))]
    lists += [named(splits.held_out(grouped, "in_measured"), "test_held_out")]
    for flag, name in (("in_upstream_now", "test_in_upstream"), ("name_novel", "test_name_novel"), ("name_and_key_novel", "test_name_and_key_novel")):
        lists.append(named(slices.where(flag), name))
    lists.append(named(splits.split_keys(grouped).withColumnRenamed("group_key", "id"), TEST_KEYS))
    lists.append(named(leakage.surviving_names(marked).withColumnRenamed("name", "id"), "train_upstream"))
    everything = lists[0]
    for more in lists[1:]:
        everything = everything.unionByName(more)
    write_split(everything, f"{out}/group_split")
    held_clusters = named(splits.held_out(clustered, "in_measured"), "test_held_out")
    write_split(clustered.select("split", F.col("id").cast("string").alias("id")).unionByName(held_clusters), f"{out}/cluster_split")

    sections = []
    for name, assigned in (("group_split", grouped), ("cluster_split", clustered)):
        sides = [assigned.where(F.col("split") == s).select("id", "fp") for s in ("test", "train")]
        histogram = _kept(spark, lambda: similarity.similarity_histogram(similarity.max_similarity(*sides)), "histogram")  # noqa: B023
        balance = splits.class_balance(assigned)
        sections += [
            summary.tidy_table(balance, name, "split"),
            summary.tidy_metrics(splits.rate_spread(balance), name),
            summary.tidy_table(histogram.select("low", "n"), f"{name}_similarity", "low"),
        ]
    sections.append(summary.tidy_metrics(splits.oversize_cluster(clustered), "cluster_split"))
    if external is not None:
        adopted = splits.external_split(external, "id")
        write_split(adopted, f"{out}/external_split")
        sections.append(summary.tidy_table(adopted.groupBy("split").agg(F.count(F.lit(1)).alias("size")), "external_split", "split"))
    counts = leakage.slice_counts(slices)
    gate = gates.name_novel_gate(counts.select(F.col("test_name_novel").alias("value")))
    sections += [
        summary.tidy_metrics(counts, "novelty_slices"),
        summary.tidy_metrics(leakage.membership_drift(slices, "in_upstream"), "novelty_slices"),
        summary.tidy_metrics(leakage.exclusion_counts(marked, keys), "upstream_filter"),
        summary.tidy_metrics(gate.select("value", "passed"), "name_novel_gate"),
    ]
    metrics = sections[0]
    for section in sections[1:]:
        metrics = metrics.unionByName(section)
    metrics = stored(metrics, "diagnostics")
    write_diagnostics(metrics, f"{out}/diagnostics")
    return {"group_split": grouped, "cluster_split": clustered, "slices": slices, "diagnostics": metrics, "gates": gate}


def leakage_run(
    tables: dict[str, DataFrame],
    index: DataFrame,
    protected: DataFrame,
    out: str,
    id_col: str = "row_id",
    split_path: str | None = None,
) -> dict[str, DataFrame]:
    """Filter measurement tables by the protected registry rows; writes one Parquet table each.

    With ``split_path``, the folder of a written split, ``protected`` is the registry: its rows in the test
    split are protected by name, and the keys are those that the split lists.
    """
    if split_path is None:
        names, keys = leakage.protected_sets(protected.select("id"), protected)
    else:
        written = read_split(protected.sparkSession, split_path)
        test = written.where(F.col("split") == "test").select("id")
        names, _ = leakage.protected_sets(test, protected.withColumn("id", F.col("id").cast("string")))
        keys = written.where(F.col("split") == TEST_KEYS).select(F.col("id").alias("key")).distinct()
    names, keys = stored(names, "names"), stored(keys, "keys")
    reports = {}
    for name, rows in tables.items():
        safe, breakdown = leakage.filter_measurements(rows, index, names, keys, id_col)
        write_parquet(safe, f"{out}/{name}")
        if breakdown is not None:
            reports[name] = breakdown
    return reports


def profile_run(
    profile_rows: DataFrame, store: DataFrame, known: DataFrame, out: str, flag_width: int = 50, sample: int | None = None, seed: int = 42
) -> dict[str, DataFrame]:
    """Look profiles up, validate them against the store, resolve their names and write the tables.

    ``profile_rows`` holds ``row_idx, profile_id, name, label, expressions, split_flags``; ``known`` is
    the registry with ``src_row, name, canonical, severity, label``. The correlation with the store is one
    linear pass over all found rows, or over a seeded ``sample`` of them.
    """
    spark = profile_rows.sparkSession
    looked = _kept(spark, lambda: profiles.lookup_profiles(profile_rows, store), "looked")
    miss = profiles.miss_rate(looked)
    found = looked.where("found")
    checked = found if sample is None else seeded_sample(found, "profile_id", sample, seed)
    pairs = checked.select(F.col("data").alias("a"), F.col("expressions").alias("b"))
    correlation = stored(profiles.correlation_summary(profiles.dimension_correlation(pairs)), "correlation")

    resolved = _kept(spark, lambda: resolve.resolve_suffix_free(found, known, id_col="row_idx"), "resolved")
    retained = resolved.where(F.col("matched") & F.col("canonical").isNotNull())
    rows = stored(profiles.profile_table(resolved), "profiles")
    write_csv(rows, f"{out}/profiles")
    write_aligned(retained, out, flag_width)
    conflicts = profiles.label_disagreements(retained.withColumn("src_row", F.col("row_idx")), known)
    table = gates.miss_gate(miss.select(F.col("miss_rate").alias("value")))
    table = table.unionByName(gates.retained_gate(rows.agg(F.count(F.lit(1)).alias("value"))))
    table = table.unionByName(gates.correlation_gate(correlation.select(F.col("mean_r").alias("value"))))
    table = stored(table, "gates")
    return {
        "profiles": rows,
        "dropped": resolve.dropped_rows(resolved, "row_idx"),
        "miss_rate": miss,
        "correlation": correlation,
        "conflict_names": profiles.disagreement_report(conflicts),
        "drift": summary.class_drift(rows),
        "cells": summary.value_counts(rows, "cell_id"),
        "doses": summary.group_with_first(rows.withColumn("src_row", F.col("profile_id")), "dose_str", "dose_um"),
        "gates": table,
        "status": gates.run_status(table),
    }


def profile_source_run(
    profile_source: DataFrame,
    id_source: DataFrame,
    store: DataFrame,
    known: DataFrame,
    out: str,
    files: Sequence[str] = (),
    expected_ids: int | None = 6000,
    pattern: str = PROFILE_ID_SNIFF_PATTERN,
    layout: str | None = None,
    expression_width: int = checks.EXPRESSION_WIDTH,
    flag_width: int = checks.SPLIT_FLAG_WIDTH,
    sample: int | None = None,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """:func:`profile_run` from its raw sources: a profile set in any layout and a table with a column of ids.

    The input ``files`` are listed with their hashes, the column of ids is found by ``pattern``, values of
    the set are checked before anything is looked up, and ids meet profiles by position. Both sources hold
    their order in ``src_row``.
    """
    results = {}
    if files:
        results["manifest"] = stored(file_manifest(store.sparkSession, list(files)), "manifest")
        write_csv(results["manifest"], f"{out}/manifest")
    ids = checks.load_profile_ids(id_source, pattern, expected_ids)
    rows = stored(checks.profile_set(profile_source, layout, expression_width, flag_width, keep=["src_row"]), "profile-set")
    raise_on_violations(checks.profile_violations(rows, expression_width, flag_width), "profile set")
    identified = stored(profiles.identified_profiles(rows, ids), "identified")
    return results | profile_run(identified, store, known, out, flag_width, sample, seed)
