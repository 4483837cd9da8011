"""Times the headline queries on $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from glossloom.plans import catalog
from glossloom.session import get_session

HEADLINE = (
    "word_coverage", "source_rollup", "label_normalize", "gloss_normalize", "identity_key", "match_targets", "unfinished_jobs",
    "asof_session", "gap_sessions", "exact_dups", "load_stores", "near_dup_pairs", "near_dup_greedy", "store_fingerprint", "deal_largest_first",
    "stratified_split", "fixed_test", "pool_round_robin", "scarce_split", "fewshot_draws",
    "prototype_scores", "run_metrics", "macro_f1_union", "per_class_scores", "paired_tests", "bootstrap_intervals", "run_pivot",
    "result_summary", "discordant_large", "kinematics", "gap_fill", "resample_30", "sliding_fft", "kalman_smooth", "cwt_bands",
    "hankel_dmd", "augment_warp", "model_input", "stream_sessions", "index_append",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
