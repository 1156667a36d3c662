"""Runs registered queries next to their SQL and reports the differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from altcredit.checks.oracle import ORACLES
from altcredit.checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x: object) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    return repr(float(x)) if isinstance(x, float) else str(x)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty when both sides agree, else what differs first."""
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(set(df.columns) ^ set(columns))}"
    mine, theirs = canonical(df.columns, got), canonical(columns, want)
    if mine == theirs:
        return "" if mine else "no rows"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows, SQL has {len(theirs)}"
    names = sorted(columns)
    for a, b in zip(mine, theirs):
        if a != b:
            cells = [f"{n}: {x} / {y}" for n, x, y in zip(names, a, b) if x != y]
            return f"{a[: 2]} {cells[:6]}"
    return "?"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found = differences(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(found)
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - start:.2f}s {found}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
