"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma-separated names, default the headline list below, "all" for every one).
Each query is written to the noop sink, so every output column is computed; the time given is
the better of two runs after a first one.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import datetime

from pyspark.sql import SparkSession

from altcredit.checks import views
from altcredit.checks.queries import QUERIES
from altcredit.plans import load
from altcredit.sources.store import TableStore

HEADLINE = (
    "gst_ratios",
    "upi_ratios",
    "aa_ratios",
    "epfo_ratios",
    "cross_validation",
    "scorecard",
    "scorecard_history",
    "report_facts",
    "prompt_text",
    "fallback_narrative",
    "revenue_trend",
    "customer_financials",
    "normalize_bank_statements",
    "validation_errors",
    "load_lineage",
    "upsert_merge",
    "report_listing",
    "recent_reports_topk",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("altcredit-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Capturing the Python call site of every Column takes longer than planning a query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def load_files(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Loading the bank feed from JSON lines into an empty store, and again on top of itself."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    views.raw_bank_statements(spark, sf_dir).write.json(f"{folder}/bank_statements.jsonl")
    views.raw_customers(spark, sf_dir).write.json(f"{folder}/customers.jsonl")
    store = TableStore(spark, f"{folder}/store")
    store.create_tables()
    now = datetime(2025, 1, 1, 6)
    times = {}
    for table, name in (("customers", "file_load_customers"), ("bank_statements", "file_load"), ("bank_statements", "file_merge")):
        start = time.perf_counter()
        load.load_feed(store, f"{folder}/{table}.jsonl", table, views.AS_OF, now, name, "jsonl")
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]:.2f}s", file=sys.stderr)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = session(cpus)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        cold = run(spark, name, sf_dir)
        times[name] = round(min(run(spark, name, sf_dir) for _ in range(2)), 3)
        print(f"{name}: first {cold:.2f}s, then {times[name]:.2f}s", file=sys.stderr)
    if not chosen:
        times |= load_files(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
