"""Block sums: merged they are the sums of all rows, and loads keep them up to date."""

from __future__ import annotations

import json
import random
import re
import shutil
import tempfile
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from altcredit.operators import partials as pt
from altcredit.operators import summaries as sm
from altcredit.plans import load, reports
from altcredit.plans import scorecard as sc
from altcredit.schemas import TABLES
from altcredit.sources import paths, sums
from altcredit.sources.store import MOST_IDS, TableStore, of_customers
from tests import samples as s

LATER = s.RUN_TS + timedelta(days=1)


def _random_rows(spark, table, seed):
    """Customers with gaps, missing values and single months."""
    draw = random.Random(seed)
    names = TABLES[table].names
    kinds = {f.name: f.dataType.simpleString() for f in TABLES[table].fields}
    rows = []
    for c in range(12):
        if table == pt.DAILY:
            days = draw.sample(range(900), draw.choice([1, 2, 40, 200]))
            places = [{"txn_date": date(2022, 1, 1) + timedelta(days=d)} for d in days]
        else:
            months = draw.sample(range(72), draw.choice([1, 2, 3, 30, 60]))
            places = [{"year": 2019 + m // 12, "month": m % 12 + 1} for m in months]
        for place in places:
            row = {"customer_id": f"C{c}", **place}
            for name in names:
                if name in row or draw.random() < 0.15:
                    continue
                if kinds[name] in ("int", "bigint"):
                    row[name] = draw.randint(-5, 10**6)
                elif kinds[name] == "boolean":
                    row[name] = draw.random() < 0.3
                elif name == "day_of_week":
                    row[name] = draw.choice(["Saturday", "Sunday", "Monday"])
            rows.append(tuple(row.get(n) for n in names))
    return spark.createDataFrame(rows, TABLES[table])


def _by_customer(frame):
    return {r.customer_id: r.asDict() for r in frame.collect()}


def _all_rows(rows, table):
    return sm.summarize_upi(rows) if table == pt.DAILY else sm.summarize_monthly(rows, [pt.SOURCES[table]])


@pytest.mark.parametrize("table", pt.SUMMED)
def test_merged_blocks_are_the_sums_of_all_rows(spark, table):
    for seed in range(1):
        rows = _random_rows(spark, table, seed)
        assert _by_customer(pt.merged_sums(pt.block_sums(rows, table))) == _by_customer(_all_rows(rows, table))


@pytest.mark.parametrize("table", pt.SUMMED)
def test_a_late_month_changes_its_own_block(spark, table):
    rows = _random_rows(spark, table, 7).cache()
    late = (F.xxhash64("customer_id", *(["txn_date"] if table == pt.DAILY else ["year", "month"])) % 3) == 0
    touched = rows.filter(late).select("customer_id", pt.block_of(table).alias(pt.BLOCK)).distinct()
    fresh = pt.block_sums(rows, table).join(touched, list(pt.BLOCK_KEYS), "left_semi")
    blocks = pt.replaced(pt.block_sums(rows.filter(~late), table), fresh, touched)
    assert _by_customer(pt.merged_sums(blocks)) == _by_customer(_all_rows(rows, table))


def _load(store, folder, table, rows, run_id, run_ts=s.RUN_TS):
    path = Path(folder) / run_id
    path.mkdir()
    load.load_feed(store, s.write_feed(path, table, rows), table, s.AS_OF, run_ts, run_id)


FIRST = {
    "customers": [s.customer(c) for c in ("C1", "C2", "C3")],
    "gst_filings": [r for c in ("C1", "C2", "C3") for r in s.year(s.gst, c) if r["month"] != 5],
    "bank_statements": [r for c in ("C1", "C2") for r in s.year(s.bank, c) if r["month"] not in (4, 12)],
    "epfo_payroll": [r for c in ("C1", "C3") for r in s.year(s.epfo, c)],
    "upi_transactions": s.upi_rows("C1") + s.upi_rows("C2"),
}


@pytest.fixture(scope="module")
def loaded(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    store = TableStore(spark, f"{folder}/store", sums=True)
    store.create_tables()
    for table, rows in FIRST.items():
        _load(store, folder, table, rows, f"first-{table}")
    return store.root


@pytest.fixture
def store(spark, folder, loaded):
    shutil.copytree(loaded, f"{folder}/store")
    return TableStore(spark, f"{folder}/store", sums=True)


def _stored(store, day):
    cards = store.read("scorecards").filter(F.col("scorecard_date") == F.lit(day))
    return {r.customer_id: json.loads(r.scorecard_json) for r in cards.collect()}


def _full(store, day):
    feeds = [store.read(t) for t in ("gst_filings", "upi_transactions", "bank_statements", "epfo_payroll")]
    cards = sc.scorecards(store.read("customers"), *feeds, day)
    return {r.customer_id: json.loads(r.scorecard_json) for r in cards.select("customer_id", reports.scorecard_json(cards.columns).alias("scorecard_json")).collect()}


def test_loads_and_scores_step_by_step(store, folder):
    reports.run_incremental(store, s.AS_OF, s.RUN_TS)
    assert _stored(store, s.AS_OF) == _full(store, s.AS_OF) and len(_full(store, s.AS_OF)) == 3

    # A late month, a new one, and a corrected one, each of one customer.
    day = s.AS_OF + timedelta(days=1)
    _load(store, folder, "gst_filings", [s.gst("C2", 5), {**s.gst("C2", 1), "year": 2023}], "late")
    _load(store, folder, "bank_statements", [s.bank("C1", 4), s.bank("C1", 6, total_credits=999)], "corrected")
    reports.run_incremental(store, day, LATER)
    assert set(_stored(store, day)) == {"C1", "C2"}
    assert _stored(store, day) == {c: card for c, card in _full(store, day).items() if c != "C3"}

    # Nothing changed: nothing is scored, nothing waits.
    reports.run_incremental(store, day + timedelta(days=1), LATER)
    assert not _stored(store, day + timedelta(days=1))
    assert sums.changed(store)[1] == []


def test_a_new_customer_is_scored(store, folder):
    reports.run_incremental(store, s.AS_OF, s.RUN_TS)
    _load(store, folder, "customers", [s.customer("C4")], "more")
    reports.run_incremental(store, s.AS_OF + timedelta(days=1), LATER)
    assert set(_stored(store, s.AS_OF + timedelta(days=1))) == {"C4"}


def test_only_touched_blocks_are_read_and_written(store, spark, folder, monkeypatch):
    _load(store, folder, "gst_filings", [{**s.gst("C1", 3), "year": 2021}], "old")
    files = lambda: {str(f): f.stat().st_mtime_ns for f in Path(f"{folder}/store/_sums/blocks/gst_filings").rglob("*.parquet")}
    before, seen = files(), []
    read_blocks = TableStore.read_blocks
    monkeypatch.setattr(TableStore, "read_blocks", lambda self, t, blocks: seen.append((t, blocks)) or read_blocks(self, t, blocks))
    _load(store, folder, "gst_filings", [{**s.gst("C1", 4), "year": 2021}], "older")
    assert seen == [("gst_filings", [2021])]
    assert {f for f, t in before.items() if files().get(f) != t} == {f for f in before if "block=2021" in f}
    scan = read_blocks(store, "gst_filings", [2021])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ = 2021", scan)


def test_sums_catch_up_after_a_load_that_died(store, folder, monkeypatch):
    reports.run_incremental(store, s.AS_OF, s.RUN_TS)
    with monkeypatch.context() as m:
        m.setattr(sums, "refresh", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            _load(store, folder, "gst_filings", [s.gst("C3", 5)], "died")
    day = s.AS_OF + timedelta(days=1)
    reports.run_incremental(store, day, LATER)
    assert _stored(store, day) == {"C3": _full(store, day)["C3"]}


def test_a_scoring_run_that_died_is_repeated(store, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(store, "add", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            reports.run_incremental(store, s.AS_OF, s.RUN_TS)
    reports.run_incremental(store, s.AS_OF, s.RUN_TS)
    assert _stored(store, s.AS_OF) == _full(store, s.AS_OF)


def test_sums_of_a_store_that_had_none(spark, folder):
    plain = TableStore(spark, f"{folder}/store")
    plain.create_tables()
    for table, rows in FIRST.items():
        _load(plain, folder, table, rows, f"plain-{table}")
    kept = TableStore(spark, f"{folder}/store", sums=True)
    sums.rebuild(kept)
    for table in pt.SUMMED:
        rows = kept.read(table)
        assert _by_customer(pt.merged_sums(sums.read(kept, table))) == _by_customer(_all_rows(rows, table))


def _rows_scanned(frame):
    """Rows that the scans of a frame handed on, after skipping row groups and pages."""
    frame._jdf.collectToPython()
    plan = frame._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            node = node.executedPlan()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_lookup_reads_few_rows(spark, folder):
    store = TableStore(spark, f"{folder}/store")
    store.create_tables()
    ids = spark.range(120_000).select(F.format_string("C%07d", "id").alias("customer_id"))
    months = ids.crossJoin(spark.range(1, 3).select(F.col("id").cast("int").alias("month")))
    store.upsert(s.whole_rows(months.select("customer_id", "month", F.lit(2024).alias("year")), "gst_filings"), "gst_filings", s.RUN_TS)
    asked = spark.createDataFrame([("C0070000",), ("C0070001",), ("unknown",), (None,)], "customer_id string")
    found = of_customers(store.read("gst_filings"), asked)
    assert found.count() == 4
    assert 4 <= _rows_scanned(found.select("customer_id", "month")) <= 100_000 < store.read("gst_filings").count()
    # Many ids are joined.
    many = of_customers(store.read("gst_filings"), ids.limit(MOST_IDS + 1))
    assert many.count() == 2 * (MOST_IDS + 1)


def test_files_have_bloom_filters(spark, folder):
    store = TableStore(spark, f"{folder}/store")
    store.create_tables()
    ids = spark.range(60_000).select(F.format_string("C%07d", "id").alias("customer_id"))
    rows = ids.select("*", F.lit(1).alias("month"), F.lit(2024).alias("year"))
    store.upsert(s.whole_rows(rows, "gst_filings"), "gst_filings", s.RUN_TS)
    files = list(Path(store.path("gst_filings")).rglob("year=2024/**/*.parquet"))
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader
    opened = spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath
    found = reader.open(opened(spark._jvm.org.apache.hadoop.fs.Path(str(files[0])), spark._jsc.hadoopConfiguration()))
    columns = found.getFooter().getBlocks().get(0).getColumns()
    offsets = {columns.get(i).getPath().toDotString(): columns.get(i).getBloomFilterOffset() for i in range(columns.size())}
    found.close()
    assert offsets["customer_id"] > 0 and offsets["gstr_sales_paise"] <= 0


def test_lookups_of_a_store_by_id(store):
    assert not paths.exists(store.spark, f"{store.root}/_sums/notes/none")
    one = of_customers(store.read("gst_filings"), store.read("customers").filter("customer_id = 'C2'"))
    assert one.count() == 11
