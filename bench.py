"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables. BENCH_CPUS: local threads.
BENCH_QUERIES: optional comma list instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from hindcast.catalog.queries import REGISTRY
from hindcast.session import configure

HEADLINE = (
    "label_rate_by_ticker",
    "join_feature_session",
    "join_event_features",
    "volatility_20d",
    "dedup_first",
    "ingest_funnel",
    "stratified_sample",
    "build_training_events",
    "build_training_events_full",
    "topk_hits",
    "vector_topk_join",
    "overfetch_topk",
    "context_prompt",
    "decode_payload",
    "parse_proposal",
    "gate_policy",
    "run_decisions",
    "time_split",
    "time_folds",
    "threshold_f1",
    "log_loss",
    "sentiment_resume",
    "stream_ingest",
    "feed_summary",
    "expectation_suite",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM paths and the Python workers before timing.
    spark.range(1000).mapInPandas(lambda frames: frames, "id long").write.format("noop").mode("overwrite").save()
    took, jobs = {}, {}
    tracker = spark.sparkContext.statusTracker()
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        jobs[name] = len(tracker.getJobIdsForGroup(name))
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "jobs": jobs,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
