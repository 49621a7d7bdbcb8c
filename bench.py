"""Headline timings: one JSON line with the seconds of each query, plan and run together."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import corpus  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from checks.session import local_session  # noqa: E402

HEADLINE = (
    "scan_project", "scan_general", "scan_javascript", "scan_secrets", "scan_auth", "scaling_traps",
    "service_usage", "lang_table", "stack_row", "dep_rollup", "untested_critical", "test_ratio",
    "test_antipatterns", "dangerous_files", "scan_documents", "copy_paste", "findings_diff",
    "rate_limit_windows", "severity_rollup",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        run(QUERIES[name](spark, sf_dir))  # warm-up: class loading and compilation
        for _ in range(repeats):
            start = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    size = corpus.files(spark, sf_dir).selectExpr("count(*)", "sum(octet_length(content))").first()
    scan = seconds["scan_project"]
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "files": size[0],
        "scan_files_per_sec": round(size[0] / scan, 1), "scan_mb_per_sec": round(size[1] / 1e6 / scan, 2),
    }))


if __name__ == "__main__":
    main()
