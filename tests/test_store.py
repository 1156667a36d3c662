"""Growing buckets, added documents, and the order of loads."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from altcredit.operators.registry import FEEDS, waves
from altcredit.plans import load, reports
from altcredit.sources import paths
from altcredit.sources import store as st
from altcredit.sources.store import TableStore, bucket_of, split_buckets
from tests import samples as s

LATER = s.RUN_TS + timedelta(days=1)


def test_one_more_bucket_takes_rows_of_one_older_one(spark):
    ids = spark.range(3000).select(F.concat(F.lit("C"), "id").alias("customer_id"))
    every = [bucket_of(F.col("customer_id"), n).alias(f"b{n}") for n in range(1, 41)]
    rows = ids.select(*every).collect()
    for n in range(1, 40):
        moved = {(r[f"b{n}"], r[f"b{n + 1}"]) for r in rows if r[f"b{n}"] != r[f"b{n + 1}"]}
        assert moved == {(origin, n) for origin in split_buckets(n, n + 1)}
    assert {r.b32 for r in rows} == set(range(32))
    plain = ids.select(bucket_of(F.col("customer_id"), 32).alias("a"), F.pmod(F.xxhash64("customer_id"), F.lit(32)).alias("b"))
    assert plain.filter("a <> b").count() == 0
    assert split_buckets(32, 100) == set(range(32)) and split_buckets(40, 42) == {8, 9}


def _customers(spark, low, high, name="shop"):
    ids = spark.range(low, high).select(F.format_string("C%06d", "id").alias("customer_id"))
    return s.whole_rows(ids.withColumn("business_name", F.concat(F.lit(f"{name} "), F.sha2("customer_id", 256))), "customers")


def _names(store):
    return {r.customer_id: r.business_name.split(" ")[0] for r in store.read("customers").collect()}


def _folders(store):
    return {f.name: f.stat().st_mtime_ns for f in Path(store.path("customers")).glob("bucket=*")}


def test_buckets_grow_with_the_customers(spark, folder, monkeypatch):
    monkeypatch.setattr(st, "MIN_BUCKETS", 2)
    monkeypatch.setattr(st, "BUCKET_ROWS", 100)
    store = TableStore(spark, f"{folder}/store")
    store.create_tables()
    store.upsert(_customers(spark, 0, 600), "customers", s.RUN_TS)
    store.upsert(_customers(spark, 0, 1), "customers", s.RUN_TS)
    few = store.buckets()
    store.upsert(_customers(spark, 600, 1200), "customers", s.RUN_TS)
    store.upsert(_customers(spark, 0, 1), "customers", s.RUN_TS)
    many = store.buckets()
    assert (few, many) == (6, 12)
    assert set(_folders(store)) == {f"bucket={b}" for b in range(many)}
    assert store.read("customers").count() == 1200
    wrong = store._read_stored("customers").filter(F.col("bucket") != bucket_of(F.col("customer_id"), many))
    assert wrong.count() == 0
    # A merge of one customer touches one bucket.
    before = _folders(store)
    store.upsert(_customers(spark, 77, 78, "new"), "customers", LATER)
    after = _folders(store)
    assert sum(before[b] != after[b] for b in before) == 1
    names = _names(store)
    assert names["C000077"] == "new" and list(names.values()).count("shop") == 1199


def test_growth_that_died_is_completed(spark, folder, monkeypatch):
    monkeypatch.setattr(st, "MIN_BUCKETS", 2)
    store = TableStore(spark, f"{folder}/store")
    store.create_tables()
    store.upsert(_customers(spark, 0, 500), "customers", s.RUN_TS)
    monkeypatch.setattr(st, "BUCKET_ROWS", 100)
    with monkeypatch.context() as m:
        m.setattr(paths, "discard", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.upsert(_customers(spark, 500, 600), "customers", LATER)
    store.upsert(_customers(spark, 10, 20, "new"), "customers", LATER)
    names = _names(store)
    assert len(names) == 600 == store.read("customers").count()
    assert sorted(c for c, n in names.items() if n == "new") == [f"C{i:06d}" for i in range(10, 20)]


def _cards(spark, ids, score, day=s.AS_OF):
    rows = [(c, day, f'{{"score": {score}}}', score) for c in ids]
    return spark.createDataFrame(rows, "customer_id string, scorecard_date date, scorecard_json string, composite_score int")


def _content(store, table="scorecards"):
    return sorted(tuple(r) for r in store.read(table).collect())


def _files(store, where):
    return {str(f): f.stat().st_mtime_ns for f in Path(store.root, where).rglob("*.parquet")}


@pytest.fixture
def pair(spark, folder):
    """A store to add to, and one to merge into."""
    stores = [TableStore(spark, f"{folder}/{n}") for n in ("added", "merged")]
    for store in stores:
        store.create_tables()
        store.upsert(_cards(spark, [f"C{i}" for i in range(40)], 1), "scorecards", s.RUN_TS)
        store.upsert(_cards(spark, ["C1"], 1, date(2024, 1, 1)), "scorecards", s.RUN_TS)
    return stores


STEPS = [(["C3", "C4", "N1"], 5, 1, s.AS_OF), (["C4", "N1"], 6, 2, s.AS_OF), (["C1", "N2"], 7, 3, date(2024, 1, 1)), (["C5"], 8, 4, date(2024, 6, 1))]


def test_added_documents_read_like_merged_ones(spark, pair):
    added, merged = pair
    before = _files(added, "scorecards")
    for ids, score, days, day in STEPS:
        added.add(_cards(spark, ids, score, day), "scorecards", s.RUN_TS + timedelta(days=days))
        merged.upsert(_cards(spark, ids, score, day), "scorecards", s.RUN_TS + timedelta(days=days))
        assert _content(added) == _content(merged)
    # Nothing but the added rows was written.
    assert _files(added, "scorecards") == before
    assert spark.read.parquet(*[f for f in added._added("scorecards")]).count() == sum(len(x[0]) for x in STEPS)

    added.fold("scorecards")
    assert _content(added) == _content(merged) and added._added("scorecards") == []
    assert sorted(tuple(r) for r in added._read_stored("scorecards").select(*added.read("scorecards").columns).collect()) == _content(merged)
    untouched = [f for f in before if "scorecard_date=2025" not in f and "2024-01-01" not in f]
    assert all(_files(added, "scorecards").get(f) == before[f] for f in untouched)


def test_folding_twice_and_merging_after_adding(spark, pair, monkeypatch):
    added, merged = pair
    for store, step in ((added, added.add), (merged, merged.upsert)):
        step(_cards(spark, ["C3", "N1"], 5), "scorecards", LATER)
    with monkeypatch.context() as m:
        m.setattr(paths, "discard", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            added.fold("scorecards")
    assert _content(added) == _content(merged)
    for store in pair:
        store.upsert(_cards(spark, ["C3", "C9"], 9), "scorecards", LATER + timedelta(days=1))
    assert _content(added) == _content(merged) and added._added("scorecards") == []


def test_many_added_batches_are_folded(spark, pair, monkeypatch):
    monkeypatch.setattr(st, "MOST_ADDED", 3)
    added, merged = pair
    for k in range(5):
        added.add(_cards(spark, ["C1", f"N{k}"], k), "scorecards", LATER + timedelta(days=k))
        merged.upsert(_cards(spark, ["C1", f"N{k}"], k), "scorecards", LATER + timedelta(days=k))
        assert len(added._added("scorecards")) <= 3
    assert _content(added) == _content(merged)


def test_reports_can_be_added(spark, folder):
    store = TableStore(spark, f"{folder}/store")
    store.create_tables()
    rows = spark.createDataFrame([("C1", s.AS_OF, "{}", "fallback", s.RUN_TS)], "customer_id string, scorecard_date date, report_json string, generation_method string, generated_at timestamp")
    store.add(rows, "ai_reports", s.RUN_TS)
    store.add(rows.withColumn("report_json", F.lit("[]")), "ai_reports", LATER)
    assert [r.report_json for r in store.read("ai_reports").collect()] == ["[]"]


def test_scoring_a_few_writes_a_few(spark, folder):
    store = TableStore(spark, f"{folder}/store")
    store.create_tables()
    for table, rows in {"customers": [s.customer(f"C{i}") for i in range(6)], "gst_filings": s.year(s.gst, "C2")}.items():
        load.load_feed(store, s.write_feed(folder, table, rows), table, s.AS_OF, s.RUN_TS, table)
    reports.run_analytics(store, s.AS_OF, s.RUN_TS, "all")
    before = _files(store, "scorecards")
    asked = spark.createDataFrame([("C2",), ("nobody",)], "customer_id string")
    unknown = reports.run_analytics(store, s.AS_OF, LATER, "some", asked)
    assert [r.customer_id for r in unknown.collect()] == ["nobody"]
    assert _files(store, "scorecards") == before
    assert spark.read.parquet(*store._added("scorecards")).count() == 1
    assert store.read("scorecards").count() == 6
    assert reports.latest_scorecards(store).count() == 6


def test_waves_follow_references():
    assert waves(FEEDS) == [["customers"], ["gst_filings", "upi_transactions", "bank_statements", "epfo_payroll"]]
    spec = FEEDS["gst_filings"]
    chain = {t: replace(spec, table=t, refers_to=r) for t, r in {"c": ("b",), "a": (), "b": ("a", "elsewhere"), "d": ("d",)}.items()}
    assert waves(chain) == [["a", "d"], ["b"], ["c"]]
    with pytest.raises(ValueError, match="circle"):
        waves({t: replace(spec, table=t, refers_to=r) for t, r in {"a": ("b",), "b": ("a",), "c": ()}.items()})


def test_a_failing_feed_leaves_its_wave_loaded(spark, folder, monkeypatch):
    store = TableStore(spark, f"{folder}/store")
    data = Path(folder, "data")
    data.mkdir()
    for table, rows in {"customers": [s.customer()], "gst_filings": s.year(s.gst), "bank_statements": s.year(s.bank)}.items():
        s.write_feed(data, table, rows)
    load_feed = load.load_feed

    def failing(store, path, table, *args):
        if table == "gst_filings":
            raise RuntimeError("lost")
        return load_feed(store, path, table, *args)

    monkeypatch.setattr(load, "load_feed", failing)
    with pytest.raises(RuntimeError, match="lost"):
        load.run_etl(store, str(data), s.AS_OF, s.RUN_TS, "run")
    assert store.read("bank_statements").count() == 12 and store.read("gst_filings").count() == 0
