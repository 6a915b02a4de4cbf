"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the driver tables; BENCH_CPUS: local threads; BENCH_QUERIES: names, or
`all`. Every query runs to the end of all its columns into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from loopstats.plans.registry import QUERIES
from loopstats.session import build_session

HEADLINE = """
    cost_rollup cost_by_stage cost_join_content cost_period_report structured_stats trace_summary trace_replay
    attempt_number budget_guard model_health price_lookup dashboard_kpis quality_buckets judge_rounds_mean
    weighted_score effective_weights_asof label_pairs calibrate agreement_report cohen_kappa sample_sync fewshot_topk
    chunk_text index_documents knn_topk rag_context render_prompts redact_text redact_json secret_scan canonical_json
    active_duplicates validate_payload profile_resolution model_ref_integrity config_change_log task_progress
    notifications outbox_health transition_audit
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    names = list(QUERIES) if chosen == ["all"] else chosen
    spark = build_session(
        f"local[{cpus}]",
        "loopstats-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in ("cost_totals", "chunk_counts"):  # start the JVM's compilers and the Python workers
        run(name)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    result = {"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}
    sys.stdout.write(json.dumps(result) + "\n")


if __name__ == "__main__":
    main()
