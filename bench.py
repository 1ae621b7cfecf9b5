"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "document_fingerprints", "near_dup_pairs", "near_dup_list", "pairs_independent", "pairs_same_row", "pairs_additive",
    "train_val_leak_by_class", "internal_leak_by_source", "cross_source_matrix", "annotated_documents",
    "line_leak_by_class", "full_audit", "benchmark_contamination_by_source", "exact_match_list", "trivial_cascade", "dedup_split_counts",
    "stratified_documents", "matched_documents", "label_shuffle", "vector_hashes", "nearest_original",
    "wide_nearest", "wide_pairs", "ncc_band_summary", "multiclass_scores", "class_auc", "source_balanced_scores", "team_rank_shift",
    "cluster_bootstrap_rate", "random_null_trials", "rank_bootstrap", "user_coverage", "value_summary",
)


def main() -> None:
    from leaksift import build_session
    from leaksift.queries.base import document_digests, document_prints
    from leaksift.queries.catalog import all_queries

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    times, shared = {}, {}
    # What every query of texts needs is made once and timed apart; the queries then read it.
    for name, build in (("fingerprints", document_prints), ("digests", document_digests)) if not sys.argv[1:] else ():
        started = time.perf_counter()
        build(spark, sf).count()
        shared[name] = round(time.perf_counter() - started, 3)
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    total = sum(times.values()) + sum(shared.values())
    print(json.dumps({"metric": "headline_total", "value": round(total, 3), "unit": "sec", "queries": times,
                      "shared_text_tables": shared, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
