"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR: input folder (default sf0.1); BENCH_CPUS: local cores (default 8).
Shared derived tables (the profile view, the split payloads, the statistics)
are built by their own entries, which are timed as well.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from emberframe.plans import registry  # noqa: E402
from emberframe.sources.view import profile_view  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

HEADLINE = (
    "frames_by_language", "language_fractions", "symbol_fractions", "host_ids", "payload_tree_counts",
    "payload_string_bytes", "message_bytes", "payload_stats", "check_duplicate_keys", "check_sample_shapes",
    "check_orphans", "check_all", "canonical_sample_attrs", "listing_samples", "scale_samples", "split_by_process",
    "resource_attr_dict", "encoding_summary", "encoding_gzip", "derived_metrics", "summary_upscaled_mib",
    "percentile_table", "recommended_limit", "correlation_ranking", "histogram_uncompressed_mib", "src_decode",
    "context_findings", "current_context", "buffer_windows",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * CPUS))
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads

    times: dict[str, float] = {}

    def timed(name, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)

    timed("profile_view_build", lambda: profile_view(spark, SF_DIR))
    for name in HEADLINE:
        timed(name, lambda: registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
