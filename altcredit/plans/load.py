"""Loading feed files into the stored tables, with error rows and lineage."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altcredit.functions import wording as wd
from altcredit.functions.times import instant
from altcredit.operators import upsert as up
from altcredit.operators import validate as vd
from altcredit.operators.registry import FEEDS, FeedSpec, waves
from altcredit.sources import feeds, paths, sums
from altcredit.sources.store import TableStore

logger = logging.getLogger(__name__)

def _spec(table: str) -> FeedSpec:
    if table not in FEEDS:
        raise ValueError(f"Unknown table_name: {table}")
    return FEEDS[table]


def _check(raw: DataFrame, table: str, as_of: date, customers: DataFrame | None) -> DataFrame:
    checked = vd.check_feed(raw, table, as_of, passthrough=(*feeds.POSITION, "corrupt"))
    checked = vd.block_damaged(checked)
    return checked if customers is None else vd.block_orphans(checked, customers)


def load_records(
    store: TableStore,
    raw: DataFrame,
    table: str,
    as_of: date,
    run_ts: datetime,
    run_id: str,
    files: DataFrame | None = None,
    source: str = "",
    whole_files: bool = True,
) -> DataFrame:
    """Checks raw records, merges the accepted ones and logs errors and lineage.

    The checked records are written out once; the merge, the error log and the counts all read
    that copy, so files are parsed a single time and a lost executor repeats no finished step.
    The copy is removed at the end. Log rows belong to the run, the table and the ``source``:
    a repeated load replaces its own, another load under the same run id keeps them.
    Returns attempted, loaded and skipped records per file, read from a small table of its own.
    """
    spec = _spec(table)
    customers = store.read("customers") if spec.is_child else None
    staged_path = store.fresh_path(f"{table}_checked")
    _check(raw, table, as_of, customers).write.parquet(staged_path)
    staged = store.spark.read.parquet(staged_path)
    if whole_files:
        staged = vd.whole_files(staged)

    accepted = vd.accepted(staged).select(*spec.columns, *feeds.ORDER)
    if store.sums:
        sums.note(store, table, accepted)
    store.upsert(up.last_per_key(accepted, spec.keys, feeds.ORDER), table, run_ts)
    if store.sums:
        sums.refresh(store, table)

    results_path = store.fresh_path(f"{table}_results")
    by = ("source_path", "source_file")
    vd.file_results(staged, by, whole_files, files).coalesce(1).write.parquet(results_path)
    results = store.spark.read.parquet(results_path)

    unreadable = results.filter(F.col("status") == vd.UNREADABLE).select("source_path")
    readable = staged.join(unreadable, "source_path", "left_anti")
    errors = vd.error_rows(readable, table).withColumn("logged_at", instant(run_ts))
    store.append(errors, "validation_errors", run_id, f"{table}-{source}")

    failed = F.col("status") == vd.UNREADABLE
    lineage = results.select(
        F.when(failed, F.col("source_path")).otherwise(F.col("source_file")).alias("source_file"),
        F.lit(table).alias("table_name"),
        F.col("loaded").alias("record_count"),
        instant(run_ts).alias("load_timestamp"),
        F.when(failed, F.lit(wd.FAILED)).otherwise(F.col("status")).alias("status"),
        "error_message",
    )
    store.append(lineage, "data_lineage", run_id, f"{table}-{source}")
    paths.discard(store.spark, staged_path)
    return results.select(
        F.lit(table).alias("table_name"), "source_path", "attempted", "loaded", "skipped"
    )


def load_feed(
    store: TableStore,
    path: str,
    table: str,
    as_of: date,
    run_ts: datetime,
    run_id: str,
    fmt: str = "json",
) -> DataFrame:
    """Loads one feed file, or a directory of them, into its table."""
    spark, spec = store.spark, _spec(table)
    if not paths.exists(spark, path):
        missing = spark.createDataFrame(
            [(path, table, 0, wd.FAILED, f"No such file or directory: '{path}'")],
            "source_file string, table_name string, record_count bigint, status string, "
            "error_message string",
        ).withColumn("load_timestamp", instant(run_ts))
        store.append(missing, "data_lineage", run_id, f"{table}-{path}")
        return spark.createDataFrame(
            [(table, path, 0, 0, 0)],
            "table_name string, source_path string, attempted bigint, loaded bigint, "
            "skipped bigint",
        )
    raw = feeds.read_feed(spark, path, spec, fmt)
    files = feeds.feed_files(spark, path)
    return load_records(
        store, raw, table, as_of, run_ts, run_id, files, source=path, whole_files=fmt == "json"
    )


def run_etl(
    store: TableStore,
    data_dir: str,
    as_of: date,
    run_ts: datetime,
    run_id: str,
    fmt: str = "json",
) -> list[DataFrame]:
    """Loads every registered feed found in ``data_dir``; those that refer to no other one first.

    Feeds that don't refer to each other are loaded at the same time. If one fails, the others of its wave are
    loaded to the end, later waves are not begun, and the error is raised.
    """
    store.create_tables()
    found = {}
    for table in FEEDS:
        path = f"{data_dir}/{table}.{fmt}"
        if paths.exists(store.spark, path):
            found[table] = path
        else:
            logger.warning("Skipping %s: %s not found", table, path)
    results: dict[str, DataFrame] = {}
    for wave in waves({t: FEEDS[t] for t in found}):
        with ThreadPoolExecutor(len(wave)) as pool:
            loads = {t: pool.submit(load_feed, store, found[t], t, as_of, run_ts, run_id, fmt) for t in wave}
        results |= {t: load.result() for t, load in loads.items()}
    return [results[t] for t in found]


def validate_data(spark: SparkSession, data_dir: str, as_of: date, fmt: str = "json") -> DataFrame:
    """Dry run over every registered feed: (table_name, issue) rows, nothing written."""
    parts = []
    for table, spec in FEEDS.items():
        path = f"{data_dir}/{table}.{fmt}"
        if not paths.exists(spark, path):
            note = f"{paths.name_of(path)} not found"
            parts.append(spark.createDataFrame([(table, note)], "table_name string, issue string"))
            continue
        raw = feeds.read_feed(spark, path, spec, fmt)
        checked = vd.block_damaged(vd.check_feed(raw, table, as_of, ("source_path", "source_file", "corrupt")))
        lines = vd.issue_lines()
        if fmt == "json":
            # One line a file, however many of its records are damaged.
            checked = vd.whole_files(checked)
            checked = checked.filter(~F.col("corrupt")).unionByName(checked.filter("corrupt").dropDuplicates(["source_path"]))
            unreadable = F.format_string("%s: failed to read/parse: " + vd.NOT_JSON, F.col("source_file"))
            lines = F.when(F.col("corrupt"), F.array(unreadable)).otherwise(lines)
        parts.append(
            checked.select(F.lit(table).alias("table_name"), F.explode(lines).alias("issue"))
        )
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    return issues
