"""The batch load driven by a file stream.

Each micro-batch goes through the same checks, merge and logs as a batch load, under a run id
made of table, directory and batch number: a repeated micro-batch merges the same rows
again and replaces its own log rows, so a restart leaves the tables as they would have been.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from altcredit.operators.registry import FEEDS
from altcredit.plans.load import load_records
from altcredit.sources import feeds, paths
from altcredit.sources.store import TableStore


def stream_feed(
    store: TableStore,
    directory: str,
    table: str,
    as_of: date,
    run_ts: datetime,
    max_files: int = 1000,
    fmt: str = "json",
    progress: str | None = None,
) -> StreamingQuery:
    """Loads the files of a directory that have not been loaded yet, then stops.

    ``fmt`` is "json" (array files) or "jsonl". What has been loaded is kept at ``progress``, by default beside
    the tables: it must live as long as they do.
    """
    spec = FEEDS[table]
    name = f"stream-{table}-{paths.as_name(directory)}"
    reader = store.spark.readStream.option("maxFilesPerTrigger", max_files)
    if fmt == "json":
        arriving = reader.schema(feeds.json_schema(spec)).options(**feeds.ARRAY_OPTIONS).json(directory)
        positioned = feeds.positioned_json
    elif fmt == "jsonl":
        arriving = reader.option("encoding", "UTF-8").text(directory)
        positioned = feeds.positioned_lines
    else:
        raise ValueError(f"unknown stream format {fmt!r}")

    def load(batch: DataFrame, batch_id: int) -> None:
        # Positions are numbered here, as a streaming plan may not contain row ids.
        raw = positioned(batch, spec)
        load_records(store, raw, table, as_of, run_ts, f"{name}-{batch_id:09d}", whole_files=fmt == "json")

    return (
        arriving.select("*", "_metadata")
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", progress or f"{store.root}/_progress/{name}")
        .trigger(availableNow=True)
        .start()
    )
