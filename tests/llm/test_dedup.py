from __future__ import annotations

import collections
import random

import numpy as np
import plain
import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from altcredit.llm import kernels as K
from altcredit.llm import ngram_jaccard, signature_tree, substring_dedup, suffix_dedup, suffix_order
from altcredit.llm import recurring as R


def test_span_and_window_hashes_depend_on_content_only():
    data = np.frombuffer(b"abcabc xabc", np.uint8)
    starts, ends = np.array([0, 1, 3, 8]), np.array([3, 4, 6, 11])
    h = K.span_hashes(data, starts, ends)
    assert h[0] == h[2] == h[3] != h[1]
    assert K.window_hashes(K.byte_values()[data], 3)[0] == h[0]


def test_words_do_not_cross_texts():
    data, offsets = K.flat(__import__("pyarrow").array(["ab", "cd e", None, "", " f "]))
    starts, ends, first = K.word_spans(data, offsets, K.byte_set(*K.WHITE))
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"cd", b"e", b"f"]
    assert first.tolist() == [0, 1, 3, 3, 3, 4]


def test_suffix_arrays_sort_all_strings():
    draw = random.Random(5)
    for _ in range(150):
        letters = draw.choice([1, 2, 3, 20, 256])
        strings = [bytes(draw.randrange(letters) for _ in range(draw.randint(1, 60))) for _ in range(draw.randint(1, 8))]
        begin = np.append(0, np.cumsum([len(s) for s in strings]))
        got = suffix_order.suffix_arrays(np.frombuffer(b"".join(strings), np.uint8), begin)
        want = [b + i for b, s in zip(begin, strings) for i in sorted(range(len(s)), key=lambda i: s[i:])]
        assert got.tolist() == want


def test_tree_links_all_pairs_of_a_block():
    draw = random.Random(3)
    for _ in range(5):
        base = [draw.sample(range(1, 400), 40) for _ in range(6)]
        sets = []
        for _ in range(150):
            one = list(draw.choice(base))
            for _ in range(draw.randint(0, 9)):
                one[draw.randrange(40)] = draw.randrange(1, 2000)
            sets.append(np.unique(np.array(one, np.uint64)))
        union = plain.Union(len(sets))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                    union.join(max(union.find(i), union.find(j)), min(union.find(i), union.find(j)))
        begin = np.append(0, np.cumsum([len(s) for s in sets]))
        block = signature_tree.Block(np.concatenate(sets), begin, np.diff(begin))
        got = signature_tree.link(block, np.zeros(len(sets), int), np.arange(len(sets)), 75)
        assert got.tolist() == [union.find(i) for i in range(len(sets))]


def test_seeds_do_not_depend_on_where_a_text_stands():
    draw = random.Random(2)
    text = b"".join(draw.choice([b"ab", b"abc", b"xyxyxyxyxyxy", b"q"]) for _ in range(400))

    def seeds(before):
        data = np.frombuffer(b"." * before + text, np.uint8)
        start, count, place, seed = K.smallest_seeds(data, np.array([0, before, len(data)]), 50, 24)
        mine = start >= before
        return [(start[mine] - before).tolist(), count[mine].tolist(), (place[mine] - before).tolist(), seed[mine].tolist()]

    assert all(seeds(n) == seeds(0) for n in (1, 13, 64, 100, 127, 128, 1000))


def _components(rows):
    groups, sizes = plain.jaccard_groups([t for _, t in rows])
    out = []
    for (i, text), members, size in zip(rows, groups, sizes):
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        out.append((i, size, min(ids) if ids else None))
    return collections.Counter(out)


def test_components_match_all_pairs(docs, rows):
    found = ngram_jaccard.jaccard_components(docs)
    assert collections.Counter((r.id, r.n_shingles, r.component) for r in found.collect()) == _components(rows)
    assert "row" in found.columns


def test_components_of_a_large_family_in_small_trees(spark, monkeypatch):
    """A family of near copies, more than one tree holds, with links only along a chain."""
    monkeypatch.setattr(ngram_jaccard, "TREE_BYTES", 20_000)
    monkeypatch.setattr(ngram_jaccard, "TASK_BYTES", 40_000)
    draw = random.Random(1)
    words = [f"w{draw.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(150):
        if i % 3 == 0:
            words[draw.randrange(80)] = f"v{i}"
        one = list(words)
        one[draw.randrange(80)] = f"u{i}"
        rows.append((i, " ".join(one)))
    found = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter((r.id, r.n_shingles, r.component) for r in found.collect()) == _components(rows)


def _links(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(plain.shingles(t)), []).append(i)
    least = [(min([i for i in ids if i is not None], default=None), s) for s, ids in sets.items() if s]
    out = []
    for k, (i, a) in enumerate(least):
        for j, b in least[:k]:
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted([(i, len(a)), (j, len(b))])
                out.append((x[0], y[0], len(a & b), x[1], y[1]))
    return sorted(out)


def test_all_links_inside_a_family(spark, monkeypatch):
    draw, rows = random.Random(7), []
    base = [f"w{i}" for i in range(80)]
    for k in range(60):
        one = list(base)
        for _ in range(draw.randint(0, 4)):
            one[draw.randrange(80)] = f"x{draw.randrange(50)}"
        rows.append((k, " ".join(one)))
    rows += [(100, "a b c d e f g"), (101, "a b c d e f g"), (102, "alone " * 9), (None, ""), (103, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _links(rows)
    assert len(want) > 100
    for most in (2000, 20):
        monkeypatch.setattr(ngram_jaccard, "TREE_SETS", most)
        assert sorted(tuple(r) for r in ngram_jaccard.jaccard_links(docs).collect()) == want


def test_a_large_block_is_compared_in_bounded_tables(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TREE_BYTES", 4096)
    monkeypatch.setattr(ngram_jaccard, "TASK_BYTES", 4096)
    kernel = ngram_jaccard._tree_kernel

    class Most(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    most = spark.sparkContext.accumulator(0, Most())

    def measured(percent, prefix_out):
        run = kernel(percent, prefix_out)

        def inner(table):
            most.add(sum(len(x) + 64 for x in table["tokens"].to_pylist()))
            return run(table)

        return inner

    monkeypatch.setattr(ngram_jaccard, "_tree_kernel", measured)
    sets = [(k, 20, np.arange(k * 20, k * 20 + 20, dtype=np.uint64).tobytes()) for k in range(400)]
    sets = spark.createDataFrame([(k, n, bytearray(t)) for k, n, t in sets], "name long, size long, tokens binary")
    members = sets.select(F.lit(1).cast("long").alias("block"), "name", F.col("name").alias("root"))
    assert ngram_jaccard._pairs_of_parts(members, sets, 75).count() == 0
    assert 0 < most.value < 3 * 4096


def test_repeated_rows_are_spread_over_groups(spark, monkeypatch):
    texts = [" ".join(f"r{i}" for i in range(90)), " ".join(f"s{i}" for i in range(90))]
    rows = [(1, texts[0])] * 200 + [(None, texts[1])] * 150 + [(None, None)] * 300
    rows += [(k, " ".join(f"t{k}x{i}" for i in range(60))) for k in range(2, 90)] + [(95, texts[0] + " end"), (0, texts[1])]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source int").repartition(5)
    dealt, groups = R.dealt(docs, "doc_id", "text", 4096)
    sizes = dealt.groupBy("g").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).collect()
    assert max(r.n for r in sizes) < 8 * 4096 and {r.g for r in sizes} <= set(range(groups))
    first, again = (sorted((r.row.source, r.g) for r in dealt.collect()) for _ in range(2))
    assert first == again and [k for k, _ in first] == list(range(len(rows)))
    monkeypatch.setattr(R, "dealt", lambda docs, key, text, *_, deal=R.dealt: deal(docs, key, text, 4096))
    found = ngram_jaccard.jaccard_components(docs).collect()
    components = {(r.id, r.n_shingles): r.component for r in found}
    assert len(found) == len(rows) and components[1, 86] == components[95, 87] == 1 and components[None, 86] == components[0, 86] == 0
    cut = {(r.id, r.n_bytes): r.n_removed for r in suffix_dedup.suffix_dedup(docs.select("doc_id", "text")).collect()}
    assert cut[1, len(texts[0])] == 0 and cut[95, len(texts[0]) + 4] > 300 and cut[0, len(texts[1])] == 0
    passages = substring_dedup.substring_dedup(docs.select("doc_id", "text")).collect()
    assert collections.Counter((r.id, r.n_removed) for r in passages) == collections.Counter(
        (i, n) for (i, _), n in zip(rows, [90] * 350 + [0] * 300 + [0] * 88 + [90, 90])
    )


def test_prefixes_hold_the_rarest(spark):
    sent = [R.send(g, 8, R.codes(np.array(keys, np.uint64) << np.uint64(33), 8), narrow=True) for g, keys in enumerate([[1, 2, 3], [1, 2], [1, 4], [1, 2]])]
    back = R.answers(spark.createDataFrame(pa.concat_tables(sent).to_pandas(), R.SENT), narrow=True, often=True)
    keys, often = R.received_often(back.where("g = 0").toArrow())
    assert keys.tolist() == [2, 4] and often.tolist() == [2, 1]


def test_components_of_nothing(empty):
    assert ngram_jaccard.jaccard_components(empty).count() == 0


def test_suffix_dedup_matches_plain(docs, rows):
    found = suffix_dedup.suffix_dedup(docs).select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, plain.suffix_removed(rows)))
    assert collections.Counter(tuple(r) for r in found.collect()) == want


def test_suffix_dedup_over_several_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 3000)
    draw = random.Random(9)
    parts = ["".join(draw.choice("abc ") for _ in range(70)) for _ in range(12)] + ["xy" * 35, "pqr" * 25, "z" * 70]
    rows = [(i // 2, "".join(draw.choice(parts)[draw.randrange(20) :] for _ in range(draw.randint(0, 6)))) for i in range(80)]
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    found = found.select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, plain.suffix_removed(rows)))
    assert collections.Counter(tuple(r) for r in found.collect()) == want


def test_classes_come_from_the_order_of_the_suffixes(monkeypatch):
    """Equal strings of a batch are one class only because their suffixes are neighbours."""
    draw = np.random.default_rng(3)
    base = draw.integers(97, 101, 300).astype(np.uint8).tobytes()
    texts = [base, base[:150] + b"#" + base[150:], b"x" + base, base[40:260]]
    group = suffix_dedup._Group(pa.table({"id": pa.array(range(4)), "text": [t.decode() for t in texts]}), 50, 24)
    which = np.arange(len(group.start))
    monkeypatch.setattr(suffix_dedup, "STRING_BYTES", 1 << 30)
    keys, least, most = suffix_dedup._classes(group, which)
    seeds = group.seed[which]
    per_seed = sum(len({texts_of[k : k + 50] for texts_of, k in _windows(group, seeds == s)}) for s in np.unique(seeds))
    assert len(keys) == per_seed
    monkeypatch.setattr(suffix_dedup.suffix_order, "suffix_arrays", lambda data, begin: np.random.default_rng(1).permutation(len(data)))
    assert len(suffix_dedup._classes(group, which)[0]) > 1.5 * per_seed


def _windows(group, which):
    raw = group.data.tobytes()
    return [(raw, int(s) + k) for s, n in zip(group.start[which], group.count[which]) for k in range(n)]


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_passages_match_plain(docs, rows):
    found = substring_dedup.substring_dedup(docs).select("id", "n_words", "n_removed", "kept")
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, plain.passages_removed([t for _, t in rows])))
    assert collections.Counter(tuple(r) for r in found.collect()) == want


def test_whole_texts_stay_as_they_are(docs, rows):
    found = {(r.id, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(docs, whole=True).collect()}
    for (i, text), (_, removed, _) in zip(rows, plain.passages_removed([t for _, t in rows])):
        if not removed:
            assert (i, 0, text) in found


def test_passages_of_nothing(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0
