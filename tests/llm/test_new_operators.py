from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import plain
import pyarrow as pa
import pytest
from conftest import CLASHING, invented
from pyspark.sql import functions as F

from altcredit.llm import exact_dedup, importance_resampling, lexical_search

# Exact dedup


def _normal(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def _groups(rows):
    members = collections.defaultdict(list)
    for i, t in rows:
        members[_normal(t)].append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in members.items()}


def _check_groups(found, rows):
    want = _groups(rows)
    expected = collections.Counter((i, *want[_normal(t)], plain.sha(_normal(t))) for i, t in rows)
    assert collections.Counter((r.id, r.keep_id, r.group_size, r.name) for r in found) == expected
    kept = [r for r in found if r.kept]
    assert all(r.id == r.keep_id for r in kept)
    assert collections.Counter(r.name for r in kept) == collections.Counter(plain.sha(t) for t in want)


def _named(frame):
    return frame.withColumn("name", F.lower(F.hex("digest"))).collect()


def test_exact_groups_match_plain(docs, rows):
    _check_groups(_named(exact_dedup.exact_groups(docs)), rows)


def test_exact_groups_of_hot_copies_are_salted(spark):
    draw = random.Random(3)
    rows = [(i, "the  same\ttext" if draw.random() < 0.4 else f"text {draw.randint(0, 60)}") for i in range(900)]
    rows += [(None, "the same text")] * 60 + [(5, "twice the same row")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    _check_groups(_named(exact_dedup.exact_groups(docs, hot=10)), rows)
    _check_groups(_named(exact_dedup.exact_groups(docs, hot=1)), rows)


def test_equal_digests_make_no_texts_equal(spark, docs, rows):
    want = _groups(rows)
    expected = collections.Counter((i, *want[_normal(t)]) for i, t in rows)
    for hot in (1, 5, 2000):
        found = exact_dedup.exact_groups(docs, digest=lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(3)), hot=hot).collect()
        assert collections.Counter((r.id, r.keep_id, r.group_size) for r in found) == expected
        assert sum(r.kept for r in found) == len(want)


def test_kept_documents_have_all_columns(docs, rows):
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and set(CLASHING) <= set(kept.columns)
    want = _groups(rows)
    assert collections.Counter((r.doc_id, _normal(r.text)) for r in kept.collect()) == collections.Counter((i, t) for t, (i, _) in want.items())


def test_kept_documents_may_hold_maps_and_text_ids(spark):
    docs = spark.sql("select * from values ('b', 'x  y', map('k', 1)), ('a', 'x y', map('k', 2)), (null, 'z', null) as t(doc_id, text, m)")
    assert sorted((str(r.doc_id), r.m) for r in exact_dedup.exact_dedup(docs).collect()) == [("None", None), ("a", {"k": 2})]


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0


# Importance resampling


def _features(text, most):
    w = plain.bench_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def _plain_draw(rows, target, most=1, percent=10, least=20, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in rows for f in _features(t, most))
    t = collections.Counter(bucket(f) for x in target for f in _features(x, most))
    wide, narrow = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * wide / ((s[b] + 1) * narrow)))
    out = []
    for i, text in rows:
        f = [bucket(x) for x in _features(text, most)]
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(plain.bench_words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = collections.Counter((x[0], x[4], k + 1) for k, x in enumerate(able[: len(able) * percent // 100]))
    return collections.Counter(out), drawn


def _check_draw(found, rows, target, **options):
    every, drawn = _plain_draw(rows, target, **options)
    assert collections.Counter((r.id, r.n_words, r.n_features, r.weight, r.score) for r in found) == every
    assert collections.Counter((r.id, r.score, r["rank"]) for r in found if r["rank"] is not None) == drawn


TARGET = [invented(2, 60), None, "", "ONE two", invented(50, 40)]


@pytest.mark.parametrize("most", [1, 3])
def test_draw_matches_plain(spark, docs, rows, most):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    found = importance_resampling.resampled(docs, target, most=most, percent=40).collect()
    _check_draw(found, rows, TARGET, most=most, percent=40)


def test_drawn_documents_have_all_columns(spark, docs, rows):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    kept = importance_resampling.resampled_documents(docs, target, percent=40)
    assert kept.columns == docs.columns
    _, drawn = _plain_draw(rows, TARGET, percent=40)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in drawn}


def test_draw_does_not_depend_on_the_dictionary(spark, docs, rows):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    for size in (1, 7):
        found = importance_resampling.resampled(docs, target, percent=60, frequent=size, per_task=size).collect()
        _check_draw(found, rows, TARGET, percent=60)


def test_draw_over_many_tasks_and_rows_of_equal_score(spark, monkeypatch):
    monkeypatch.setattr(importance_resampling, "RANK_ROWS", 20)
    rows = [(i, invented(i, 25)) for i in range(150)] + [(7, "again " * 30)] * 100 + [(None, "none " * 25)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([(invented(3, 200),)], "text string")
    _check_draw(importance_resampling.resampled(docs, target, percent=50).collect(), rows, [invented(3, 200)], percent=50)


def test_draw_of_nothing(spark, docs, empty, rows):
    none = spark.createDataFrame([], "text string")
    assert importance_resampling.resampled(empty, none).count() == 0
    _check_draw(importance_resampling.resampled(docs, none, least_words=10**6).collect(), rows, [], least=10**6)


def test_composed_crcs_are_those_of_the_joined_words():
    draw = random.Random(1)
    words = [bytes(draw.randrange(33, 255) for _ in range(draw.choice([1, 2, 3, 9, 300, 70_000]))) for _ in range(40)]
    owner = np.sort(np.array([draw.randrange(6) for _ in words]))
    crc = np.array([zlib.crc32(w) for w in words], np.uint64)
    for n, (mine, runs) in enumerate(importance_resampling.composed(crc, np.array([len(w) for w in words]), owner, 4), 1):
        at = [i for i in range(len(words) - n + 1) if owner[i] == owner[i + n - 1]]
        assert mine.tolist() == [owner[i] for i in at]
        assert runs.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in at]


def test_scan_gives_every_word_its_payload(monkeypatch):
    monkeypatch.setattr(importance_resampling, "SCAN_BYTES", 50)
    texts = ["Alpha beta", "beta,alpha!ALPHA", None, "", "é alphabet beta" * 20, "gamma" + "x" * 500]
    for known in ([], [b"alpha", b"beta"], [b"alpha", b"alphabet", b"x", "é".encode()]):
        crc, lengths, owner = importance_resampling.Scanner(known).payloads(pa.chunked_array([pa.array(texts, pa.string())]))
        want = [(i, zlib.crc32(w.encode()), len(w.encode())) for i, t in enumerate(texts) for w in plain.bench_words(t)]
        assert list(zip(owner.tolist(), crc.tolist(), lengths.tolist())) == want


# Ranked search


def _plain_search(rows, items, k=10):
    every = [(i, plain.bench_words(t)) for i, t in rows]
    docs = [(i, collections.Counter(w), len(w)) for i, w in every if w]
    total = sum(n for _, _, n in docs)
    df = collections.Counter(t for _, tf, _ in docs for t in tf)
    out = []
    for item, text in items:
        scores = []
        for i, tf, n in docs:
            m = 25 + (75 * n * len(docs)) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in plain.bench_words(text) if tf[t]
            )
            scores.append((-score, i is None, i or 0))
        best = sorted(x for x in scores if x[0] < 0)[:k]
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(best, 1)]
    return collections.Counter(out)


ITEMS = [
    (1, "ONE two"), (1, "ONE two"), (None, "one word"), (2, None), (3, ""), (4, "nothing of this zzzz"), (5, invented(2, 60)),
    (6, invented(1, 30) + " aaaa aaaa tail"), (7, " ".join(["x"] * 5) + " word " + invented(8, 200)),
]


def _searched(frame):
    return collections.Counter((r["item"], r["rank"], r["id"], r["score"]) for r in frame.collect())


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_matches_plain(spark, docs, rows, k):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert _searched(lexical_search.ranked_search(docs, items, k)) == _plain_search(rows, ITEMS, k)


def test_search_in_blocks_and_small_segments_over_all_terms(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lexical_search, "SEGMENT_BYTES", 2000)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = lexical_search.ranked_search(docs.repartition(3), items, 4, max_terms=3, block_bytes=200)
    assert _searched(found) == _plain_search(rows, ITEMS, 4)


def _segment(texts, k):
    counts = [collections.Counter(t.split()) for t in texts]
    names = sorted({t for c in counts for t in c}, key=lambda t: int(lexical_search._terms(pa.array([t]))[0][0]))
    terms = np.array([int(lexical_search._terms(pa.array([t]))[0][0]) for t in names], np.uint64)
    places = [[(d, c[t]) for d, c in enumerate(counts) if c[t]] for t in names]
    row = {
        "ids": np.arange(len(texts)), "none": np.zeros(len(texts), bool), "lengths": np.array([sum(c.values()) for c in counts]), "terms": terms,
        "begin": np.append(0, np.cumsum([len(p) for p in places])), "docs": np.array([d for p in places for d, _ in p], np.int32),
        "tf": np.array([n for p in places for _, n in p], np.int32),
    }
    df = dict(zip(terms.view(np.int64).tolist(), [len(p) for p in places]))
    segment = lexical_search.Segment({n: a.tobytes() for n, a in row.items()}, len(texts), int(row["lengths"].sum()))
    return segment, lambda text: lexical_search.Query(lexical_search._terms(pa.array([text]))[0], df, len(texts))


def test_accumulators_stop_and_scores_stay_exact():
    draw = random.Random(5)
    texts = [" ".join(draw.choices(["common", "usual", "often", "x", "y"], k=20)) for _ in range(400)]
    for d in range(0, 400, 40):
        texts[d] += " rare rarer" * 3
    segment, query = _segment(texts, 5)
    opened: list[int] = []
    best = segment.best(query("common usual rare rarer"), 5, 0, opened)
    every = segment.best(query("common usual rare rarer"), 400, 0)
    assert best == every[:5] and opened[0] < 400
    # What the task has found already keeps accumulators closed, and loses none that ties with it.
    assert segment.best(query("common usual rare rarer"), 5, best[4][0]) == best
    assert segment.best(query("common"), 5, 10**9) == []


def test_search_of_equal_scores_goes_by_id(spark):
    rows = [(i, "same words here") for i in range(300, 0, -1)] + [(None, "same words here"), (0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = lexical_search.ranked_search(docs, spark.createDataFrame([(9, "words here")], "item_id long, text string"))
    assert [(r["rank"], r["id"]) for r in found.orderBy("rank").collect()] == [(k, k) for k in range(1, 11)]


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.ranked_search(empty, items).count() == 0
    assert lexical_search.ranked_search(docs, items.where("false")).count() == 0
