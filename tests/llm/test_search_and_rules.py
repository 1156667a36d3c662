from __future__ import annotations

import collections
import random
import time
import tracemalloc
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest
from conftest import CLASHING, invented
from pyspark.sql import functions as F

from altcredit.llm import decontamination, quality, sharding

ITEMS = [(1, "ONE two"), (2, None), (3, ""), (4, "!!!"), (None, "one two"), (5, "one two")]


@pytest.fixture(scope="module")
def items(spark, rows):
    text = dict((i, t) for i, t in rows if i == 10)[10]
    words = text.split()
    more = [(6, " ".join(words[20:60])), (7, " ".join(words[50:70]).upper()), (8, "not in any document " * 5)]
    return ITEMS + more


def _digest(rows, items):
    want = plain.item_hits([t for _, t in rows], items)
    return collections.Counter((i, n, hit, ",".join(found)) for (i, _), (n, hit, found) in zip(rows, want))


def _found(frame):
    return collections.Counter((r.id, r.n_words, r.n_hit, ",".join(r.items)) for r in frame.collect())


def test_phrases_match_plain(spark, docs, rows, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    assert _found(decontamination.find_items(docs, table)) == _digest(rows, items)


def test_blocks_and_a_full_index_give_the_same(spark, docs, rows, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    assert _found(decontamination.find_items(docs, table, block_bytes=100, max_terms=3)) == _digest(rows, items)


def test_proximity_allows_words_between(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma q q q alpha beta")], "doc_id long, text string")
    table = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    near = {r.id: len(r["items"]) for r in decontamination.find_items(docs, table, slop=1).collect()}
    exact = {r.id: len(r["items"]) for r in decontamination.find_items(docs, table).collect()}
    assert near == {1: 1, 2: 1, 3: 0} and exact == {1: 0, 2: 1, 3: 0}


def test_a_stored_index_of_all_terms_is_searched_again(spark, docs, rows, items):
    index = decontamination.build_index(docs, "doc_id", "text", None)
    for part in (items, items[:4], items[5:7]):
        table = spark.createDataFrame(part, "item_id long, text string")
        assert _found(decontamination.search(index, table)) == _digest(rows, part)


@pytest.mark.parametrize("slop", [0, 1])
@pytest.mark.parametrize("slice_rows", [3, 1000])
def test_search_of_few_different_words_in_slices(spark, monkeypatch, slop, slice_rows):
    """Digits: most windows share most of their terms. Proximity is compared with itself in one slice."""
    draw = random.Random(4)
    grid = [(i, " ".join(draw.choices("01", k=draw.choice([5, 60, 200])))) for i in range(12)] + [(99, "1 2 3 4")]
    asked = [(1, " ".join(draw.choices("01", k=80))), (2, grid[3][1]), (3, "0 1"), (4, "2 3"), (5, "1")]
    table, docs = spark.createDataFrame(asked, "item_id long, text string"), spark.createDataFrame(grid, "doc_id long, text string")
    whole = _found(decontamination.find_items(docs, table, window=6, slop=slop))
    if not slop:
        want = plain.item_hits([t for _, t in grid], asked, 6)
        assert whole == collections.Counter((i, n, hit, ",".join(found)) for (i, _), (n, hit, found) in zip(grid, want))
    index = decontamination.build_index(docs, "doc_id", "text", None).collect()
    counts = collections.Counter(w for _, t in grid for w in t.split())
    names = {int(decontamination._words(pa.array([w]))[0].view(np.int64)[0]): n for w, n in counts.items()}
    terms, lengths, _ = decontamination.windows_of(table.withColumnRenamed("item_id", "id").toArrow(), 6)
    tree = decontamination.Tree(*decontamination.rarest_first(terms, lengths, names), lengths)
    for row in index:
        segment = decontamination._Segment(row.asDict(), tree)
        found = [sorted(zip(*(np.concatenate(x).tolist() for x in zip(*decontamination.matches(segment, tree, slop, n))))) for n in (slice_rows, 10**6)]
        assert found[0] == found[1] and found[0]


def test_a_dense_grid_stays_small():
    """All windows of 13 digits, each in a part of the places: what is held at a time is bounded."""
    draw = random.Random(2)
    texts = [pa.array([" ".join(draw.choices("01", k=k))]) for k in (4000, 30_000)]
    item = pa.table({"id": ["1"], "text": texts[0]})
    terms, lengths, _ = decontamination.windows_of(item, 13)
    words, first = decontamination._words(texts[1])
    known, begin = np.unique(words, return_index=True)[0], np.append(0, np.cumsum(np.unique(words, return_counts=True)[1])).astype(np.int32)
    order = np.argsort(words, kind="stable").astype(np.int32)
    counts = dict(zip(known.view(np.int64).tolist(), np.diff(begin).tolist()))
    tree = decontamination.Tree(*decontamination.rarest_first(terms, lengths, counts), lengths)
    row = {"first": first, "terms": known, "begin": begin, "places": order}
    segment = decontamination._Segment({k: a.tobytes() for k, a in row.items()}, tree)
    tracemalloc.start()
    found = {int(s) for _, start in decontamination.matches(segment, tree, 0, 50_000) for s in start}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    wanted = {terms[i].tobytes() for i in range(len(terms))}
    assert found == {s for s in range(len(words) - 12) if words[s : s + 13].tobytes() in wanted}
    assert most < 60 << 20


def test_searching_nothing(spark, docs, empty, rows):
    table = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.find_items(empty, table).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.find_items(docs, table.where("false")).collect())


def test_quality_statistics_match_plain(docs, rows):
    found = quality.statistics(docs, "text").select("doc_id", "stats.*")
    want = collections.Counter((i, *plain.quality_stats(t)[:5]) for i, t in rows)
    assert collections.Counter(tuple(r) for r in found.collect()) == want


def test_quality_verdict_does_not_depend_on_the_order(docs, rows):
    want = collections.Counter((i, plain.quality_kept(t)) for i, t in rows)
    for rules in (quality.RULES, quality.RULES[::-1], quality.order(quality.RULES, quality.measure(docs, "text", sample_rows=20))):
        found = quality.cascade(docs, "text", rules).select("doc_id", "kept")
        assert collections.Counter(tuple(r) for r in found.collect()) == want


def test_quality_order_prefers_rejections_per_cost():
    measured = [{"name": r.name, "cost": c, "rejects": s} for r, c, s in zip(quality.RULES, (1, 1, 1, 1, 1, 1), (0, 0.5, 0, 0.9, 0, 0))]
    assert [r.name for r in quality.order(quality.RULES, measured)][:3] == ["lines", "repetition", "short"]


def test_quality_from_statistics_is_the_same(docs, rows):
    want = collections.Counter((i, plain.quality_kept(t)) for i, t in rows)
    found = quality.cascade(quality.statistics(docs, "text"), "text", quality.RULES, stats="stats").select("doc_id", "kept")
    assert collections.Counter(tuple(r) for r in found.collect()) == want


def test_a_costly_rule_comes_last(spark, monkeypatch):
    monkeypatch.setattr(quality, "TIMED", 0.2)
    docs = spark.createDataFrame([(i, invented(i, 300)) for i in range(200)], "doc_id long, text string")
    cheap = quality.Rule("cheap", lambda w, t: quality.n_words(w) > 10)
    slow = quality.Rule("slow", lambda w, t: quality.n_repeat_words(w) * 0 + quality.n_words(w) > 10)
    for _ in range(2):
        measured = quality.measure(docs, "text", (slow, cheap))
        assert [m["rejects"] for m in measured] == [1.0, 1.0]
        assert [r.name for r in quality.order((slow, cheap), measured)] == ["cheap", "slow"]


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 20_000)
    monkeypatch.setattr(quality, "TIMED", 0.01)
    docs = spark.createDataFrame([(i, "word " * 1000) for i in range(200)], "doc_id long, text string")
    began = time.perf_counter()
    found = quality.measure(docs, "text", quality.RULES[:1])
    assert found[0]["rejects"] == 0.0 and time.perf_counter() - began < 60


def test_quality_of_nothing(empty):
    assert quality.quality_rules(empty).count() == 0


def _placed(docs, shards=5, bucket_bytes=2000):
    placed = sharding.shuffled_shards(docs, shards, bucket_bytes=bucket_bytes)
    return placed.select("row.doc_id", "row.text", "shard", "grown_shard", "bucket", "slot").collect()


def test_shards_hold_every_row_once_in_gapless_slots(docs, rows):
    placed = _placed(docs)
    assert collections.Counter((r.doc_id, r.text) for r in placed) == collections.Counter(rows)
    slots = collections.defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.bucket for r in placed}) > 1


def test_shard_depends_on_key_and_grows_into_the_new_one_only(spark, docs):
    placed = _placed(docs)
    assert all(len({r.shard for r in placed if r.doc_id == i}) == 1 for i in {r.doc_id for r in placed})
    assert all(r.grown_shard in (r.shard, 5) for r in placed)
    ids = spark.range(2000).select(F.col("id").alias("doc_id"))
    key = F.col("doc_id")
    pairs = ids.select(sharding.shard_of(key, 6, 11).alias("six"), sharding.grown_shard_of(key, sharding.shard_of(key, 5, 11), 5, 11).alias("grown")).collect()
    assert all(r.six == r.grown for r in pairs)
    assert 200 < sum(r.grown == 5 for r in pairs) < 470


def test_order_is_repeatable_and_not_the_input_order(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    first = {r.doc_id: (r.shard, r.slot) for r in _placed(docs, 2, 10**6)}
    again = {r.doc_id: (r.shard, r.slot) for r in _placed(docs.repartition(7), 2, 10**6)}
    assert first == again
    order = [i for i, (s, _) in sorted(first.items(), key=lambda x: x[1]) if s == 0]
    assert order != sorted(order)


def test_a_key_with_a_third_of_the_rows_fills_no_bucket(spark):
    rows = [(None, f"text {k} " + "x" * 90) for k in range(300)] + [(7, "same " * 20)] * 300 + [(k, "y" * 100) for k in range(10, 310)]
    docs = spark.createDataFrame([(i, t, k // 500) for k, (i, t) in enumerate(rows)], "doc_id long, text string, part int")
    first, again = (_placed(frame, 5, 2000) for frame in (docs, docs.repartition(3)))
    assert collections.Counter((r.doc_id, r.text) for r in first) == collections.Counter(rows)
    assert sorted((r.shard, r.slot, r.text) for r in first) == sorted((r.shard, r.slot, r.text) for r in again)
    slots = collections.defaultdict(list)
    for r in first:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(collections.Counter((r.shard, r.bucket) for r in first).values()) <= 50


def test_columns_without_an_order(spark):
    rows = spark.range(300).selectExpr(
        "if(id % 3 = 0, null, id % 40) as doc_id", "if(id % 2 = 0, 'same text', concat('text ', id)) as text", "map('a', id % 5, 'b', 1) as m",
        "parse_json(concat('{\"x\": ', id % 4, '}')) as v", "array(struct(map(1, id % 2) as n)) as deep",
    )
    for size in (400, 10**6):
        first, again = (
            sharding.shuffled_shards(frame, 3, bucket_bytes=size).selectExpr("row.doc_id", "row.text", "to_json(row.m) as m", "to_json(row.v) as v", "to_json(row.deep) as deep", "shard", "slot")
            for frame in (rows, rows.repartition(5))
        )
        found = sorted(map(str, first.collect()))
        assert found == sorted(map(str, again.collect()))
        want = rows.selectExpr("doc_id", "text", "to_json(m) as m", "to_json(v) as v", "to_json(deep) as deep").collect()
        assert collections.Counter(map(tuple, first.drop("shard", "slot").collect())) == collections.Counter(map(tuple, want))


def test_places_match_a_plain_version(spark):
    """Shards by the largest draw, grown ones by one draw more, slots without gaps in bucket order."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    draws = docs.select("doc_id", *[F.xxhash64(F.lit(11), F.lit(s), "doc_id").alias(f"s{s}") for s in range(5)]).collect()
    best = {r.doc_id: [max(range(n), key=lambda s: (r[f"s{s}"], -s)) for n in (4, 5)] for r in draws}
    placed = _placed(docs, 4, 3000)
    assert {r.doc_id: [r.shard, r.grown_shard] for r in placed} == best
    for shard in range(4):
        mine = sorted((r.slot, r.bucket) for r in placed if r.shard == shard)
        assert [s for s, _ in mine] == list(range(len(mine))) and [b for _, b in mine] == sorted(b for _, b in mine)


def test_written_shards_read_back(spark, docs, folder):
    sharding.write_shards(sharding.shuffled_shards(docs, 3).select("row.doc_id", "shard", "bucket", "slot"), f"{folder}/shards")
    assert spark.read.parquet(f"{folder}/shards").count() == docs.count()


def test_sharding_nothing(empty):
    assert sharding.shuffled_shards(empty, 4).count() == 0


def test_extra_columns_survive(docs):
    kept = sharding.shuffled_shards(docs, 3).select("row.*").columns
    assert set(CLASHING) <= set(kept)
    assert zlib.crc32(b"") == 0
