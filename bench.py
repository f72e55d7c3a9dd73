"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from splitwright.plans.catalog import QUERIES  # noqa: E402
from splitwright.session import local_session  # noqa: E402

HEADLINE = (
    "name_keys", "resolved_names", "severity_lookup", "registry_rows", "group_split_orders", "overlapping_ids",
    "similar_pairs", "linked_clusters", "cluster_split", "max_similarity", "safe_measurements", "filter_breakdown",
    "novelty_slices", "profile_lookup", "dimension_correlation", "profile_rows", "ranknet", "approximate_ndcg",
    "listmle", "homophily", "classifier_metrics", "bootstrap_interval", "xml_records", "split_lines",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start the executors
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "total wall-clock of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
