from __future__ import annotations

import collections
import itertools
import time

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF_DIR
from pyspark.sql import functions as F

from altcredit.llm import language_id, pieces, queries, sentencepiece_viterbi, token_counts, toxicity
from altcredit.llm.queries import fold, model_path


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(model_path())


def test_counts_are_the_librarys(docs, rows, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    counted = token_counts.token_counts(docs, model_path(), per_task=20, frequent=50)
    want = sorted((i is not None, i or 0, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counted.collect())
    assert got == want


def test_counts_over_a_table(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = queries.documents(spark, SF_DIR)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op2_token_counts(spark, SF_DIR).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_counting_nothing(empty):
    assert token_counts.token_counts(empty, model_path()).count() == 0


def _plain_search(text: str, search, vocabulary) -> list[int]:
    known = {vocabulary.bytes[i].decode(): int(i) for i in vocabulary.normal}
    best, back = [0.0], [None]
    for end in range(1, len(text) + 1):
        choice = None
        for start in range(max(0, end - search.longest), end):
            i = known.get(text[start:end])
            score = vocabulary.scores[i] if i is not None else search.unknown if start == end - 1 else None
            if score is not None and (choice is None or best[start] + score > choice[0]):
                choice = (best[start] + score, start, i)
        best.append(choice[0])
        back.append(choice)
    ids, end = [], len(text)
    while end:
        _, start, i = back[end]
        ids = ([i] if i is not None else [int(vocabulary.byte_id[b]) for b in text[start:end].encode()]) + ids
        end = start
    return ids


def test_batched_search_is_the_plain_search(rows, model):
    vocabulary = pieces.Vocabulary(model)
    search = sentencepiece_viterbi.Search(vocabulary)
    texts = [f" {t}" for _, t in rows if t and len(t) < 600]
    ids, begin = search.encode(pa.array([t.replace("▁", " ").encode() for t in texts], pa.large_binary()))
    for k, text in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == _plain_search(text.replace("▁", " "), search, vocabulary)


def test_search_scores_at_least_as_well_as_the_library(spark, model):
    """The library's unigram search over the same pieces and scores."""
    unigram = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([0x12, 2, 0x18, 1]))
    scores = pieces.Vocabulary(model).scores
    docs = queries.documents(spark, SF_DIR).where("length(text) < 1500").limit(60)
    for r in sentencepiece_viterbi.encoded(docs, model_path()).collect():
        assert scores[r.ids].sum() >= scores[unigram.encode(r.text)].sum() - 1e-6


def test_merges_are_the_librarys(rows, model, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    vocabulary = pieces.Vocabulary(model)
    assert vocabulary.bpe and not pieces.is_bpe(model + bytes([0x12, 2, 0x18, 1]))
    spaces = [" " * 37 + "a" + " " * 5, "\t\n  x" * 30, "xxxxxxx" * 9, "日本語のテキスト😀 안녕", "ababababa" * 20, "", "é" * 70]
    texts = [t for _, t in rows if t] + spaces + spaces
    segments, first = pieces.segments(*pieces.marked(pa.array(texts)), vocabulary.joint)
    for most in (sentencepiece_viterbi.ROUNDS, 3):
        monkeypatch.setattr(sentencepiece_viterbi, "ROUNDS", most)
        ids, begin = sentencepiece_viterbi.Merges(vocabulary).encode(segments)
        assert [ids[begin[i] : begin[j]].tolist() for i, j in zip(first, first[1:])] == library.encode(texts)


def test_ids_are_the_librarys(spark, docs, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for frame in (docs, queries.documents(spark, SF_DIR)):
        found = sentencepiece_viterbi.encoded(frame, model_path(), ids="codes", as_model=True)
        back = sentencepiece_viterbi.decoded(found, model_path(), ids="codes").collect()
        assert [r.codes for r in back] == library.encode([r.text or "" for r in back])
        assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)


def test_registered_encoding_agrees_with_the_counts(spark):
    one = {r.doc_id: r.n_tokens for r in queries.op2_token_counts(spark, SF_DIR).collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op10_sentencepiece(spark, SF_DIR).collect()} == one


def test_round_trip(docs, rows, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    back = sentencepiece_viterbi.decoded(sentencepiece_viterbi.encoded(docs, model_path(), ids="codes"), model_path(), ids="codes")
    for r in back.collect():
        assert r.decoded == (r.text or "").replace("▁", " ")
        assert library.decode(r.codes) == r.decoded
        assert "ids" in r


def test_encoding_nothing(empty):
    assert sentencepiece_viterbi.decoded(sentencepiece_viterbi.encoded(empty, model_path()), model_path()).count() == 0


def test_ngrams_of_a_text():
    table = language_id.letters_table()
    found, owner = language_id.symbols(pa.array(["Ab", None, "1 É!"]), table)
    who, gram, count = language_id.ngram_counts(found, owner)
    spell = lambda g: "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s & 0x1FFFFF)
    got = {(w, spell(g)): n for w, g, n in zip(who.tolist(), gram.tolist(), count.tolist())}
    assert got == {(0, "a"): 1, (0, "b"): 1, (0, " a"): 1, (0, "ab"): 1, (0, "b "): 1, (0, " ab"): 1, (0, "ab "): 1,
                   (2, "é"): 1, (2, " é"): 1, (2, "é "): 1, (2, " é "): 1}


def test_slices_do_not_change_counts(monkeypatch):
    table = language_id.letters_table()
    found, owner = language_id.symbols(pa.array(["abc de", "xyz", "", "aa bb"] * 5), table)
    whole = language_id.ngram_counts(found, owner)
    monkeypatch.setattr(language_id, "SLICE", 4)
    for a, b in zip(whole, language_id.ngram_counts(found, owner)):
        assert a.tolist() == b.tolist()


def _out_of_place(text, profiles, top):
    import collections

    counts = collections.Counter()
    for word in "".join(c.lower() if c.isalpha() else " " for c in text).split():
        padded = f" {word} "
        counts.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n].strip())
    code = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    ranked = sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]
    far = {lang: sum(abs(p[code(g)] - i) if code(g) in p else top for i, g in enumerate(ranked)) for lang, p in profiles.items()}
    return min(sorted(far), key=far.get)


def test_language_is_the_smallest_distance(spark):
    docs = queries.documents(spark, SF_DIR).select("doc_id", "text", "lang")
    train = fold(3) != 1
    profiles: dict = {}
    for r in language_id.profiles(docs.where(train), "text", "lang").collect():
        profiles.setdefault(r.language, {})[r.gram] = r["rank"] - 1
    found = language_id.identified(docs, train).collect()
    assert all(r.lang_pred == _out_of_place(r.text, profiles, 300) for r in found)
    assert all(0 <= r.score <= 1 for r in found)


def test_held_out_languages(spark):
    found = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(queries.documents(spark, "/root/testdata/sf0.01"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_language_edge_cases(docs, empty):
    found = language_id.identified(docs, F.lit(True))
    assert {r.lang_pred for r in found.where("text is null or trim(text) = ''").collect()} == {"und"}
    assert {(r.lang_pred, r.score) for r in language_id.identified(docs, F.lit(False)).collect()} == {("und", 0.0)}
    assert language_id.identified(empty, F.lit(True)).count() == 0


def _model(frame):
    counts = frame.orderBy("code").toPandas()
    single = counts[(counts.code >= 0) & (counts.code < 1 << 21)]
    return toxicity.CharacterModel(counts.code.to_numpy(), counts.n.to_numpy(), int(single.n.sum()))


@pytest.fixture(scope="module")
def characters(spark):
    seen = toxicity.observed(queries.documents(spark, "/root/testdata/sf0.01"), "text")
    return _model(toxicity.character_counts(seen))


def _read(model, *tokens):
    return toxicity.Decoder(list(tokens)).read(model)[0]


@pytest.mark.parametrize("seen, word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("$tupid", "stupid"), ("st.u.pid", "stupid"),
                                        ("stuuuupid", "stupid"), ("p@thetic", "pathetic"), ("s-c-u-m", "scum"), ("tr@sh", "trash"),
                                        ("!diot", "idiot"), ("|oser", "loser"), ("idiot!", "idiot"), ("lo$er", "loser"), ("(trash", "trash")])
def test_disguised_words_are_restored(characters, seen, word):
    assert toxicity.trimmed(seen)[1] == seen and toxicity.disguised(seen)
    assert _read(characters, seen) == [word]


@pytest.mark.parametrize("seen, bare, look", [("trash###", "trash", "trash"), ('"!diot"', "diot", "!diot"), ("word.", "word", "word"), ("hey!", "hey", "hey!"),
                                              ("***", "", ""), ("a$$", "a", "a$$"), ("(hey)", "hey", "(hey"), ("-|x|-", "x", "|x|"), ("c#.", "c", "c#")])
def test_one_or_two_letter_marks_at_an_edge_stay(seen, bare, look):
    assert toxicity.trimmed(seen) == (bare, look)


def _hidden(text):
    return toxicity.Units(pa.array([text])).hidden


def test_single_letters_are_read_as_words(characters):
    assert _hidden("x y") == [] and _hidden("0 1 0 1") == []
    assert _hidden("you s t u p i d thing") == ["s t u p i d"]
    assert _hidden("é t a b l i") == ["é t a b l i"]
    assert _hidden("y o u  d o p e") == ["y o u\nd o p e"]
    assert _read(characters, "s t u p i d", "y o u\nd o p e", "y o u s t u p i d", "s t * p ! d") == ["stupid", "you dope", "youstupid", "stupid"]


def _scalar(model, a, b, c):
    return float(model.cost(*(np.array([x], np.int64) for x in (a, b, c)))[0])


def _every_reading(token, model):
    """The best score of all readings of a token."""
    spaced = toxicity.GAP in token or toxicity.WIDE_GAP in token
    best, marks = -np.inf, toxicity.LETTER_MARKS
    choices = [
        toxicity._readings(c, i > 0 and token[i - 1] == c, not token[: i + 1].strip(marks), not token[i:].strip(marks), spaced, toxicity.WIDE_GAP in token)
        for i, c in enumerate(token)
    ]
    for path in itertools.product(*choices):
        a = b = toxicity.BORDER
        score = 0.0
        for c, channel in path:
            score += channel
            if not c or (c == b == toxicity.BORDER):
                continue
            score += _scalar(model, a, b, c)
            a, b = (toxicity.BORDER, c) if c == toxicity.BORDER else (b, c)
        score += 0.0 if b == toxicity.BORDER else _scalar(model, a, b, toxicity.BORDER)
        best = max(best, score)
    return best


def test_decoding_finds_the_best_of_all_readings(characters):
    tokens = ["1d10t", "!d!0t", "a**b", "l00ser", "x", "", "€uro$", "aaa", "s t u p", "t 0\no 1", "#*#", "b2b-x", "é3é", "66ab", "o.o.o", "漢1字"]
    read, best = toxicity.Decoder(tokens).read(characters)
    for token, value in zip(tokens, best.tolist()):
        assert value == pytest.approx(_every_reading(token, characters), abs=1e-9), token
    # Alone or among others, a token is read alike; the counts asked for are all that it takes.
    assert [_read(characters, t)[0] for t in tokens] == read
    asked = toxicity.Decoder(tokens).asked()
    known = np.isin(characters.codes, asked)
    less = toxicity.CharacterModel(characters.codes[known], characters.counts[known], characters.total - 1)
    assert toxicity.Decoder(tokens).read(less)[0] == read


def test_long_tokens_are_read_in_pieces(characters):
    draw = np.random.default_rng(1)
    token = "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), 2_000_000))
    began = time.perf_counter()
    units = toxicity.Units(pa.array([token[:1_000_000] + "1d10t" + token[1_000_000:]]))
    assert max(map(len, units.hidden)) == toxicity.LONGEST and "1d10t" in "".join(units.hidden)
    assert any("1d10t" in x for x in units.hidden)
    toxicity.Decoder(units.hidden[:5000]).read(characters)
    assert time.perf_counter() - began < 20
    spaced = toxicity.Units(pa.array([" ".join("ab" * 5000)]))
    assert max(len(x.replace(" ", "")) for x in spaced.hidden) == toxicity.LONGEST
    assert toxicity.pieces("x" * 64) == ["x" * 64] and [len(x) for x in toxicity.pieces("x" * 130)] == [64, 64, 50]


def _plain_score(text, readings, known):
    """The sum that a document's distinct words give, one token after the other."""
    units, words = toxicity.Units(pa.array([text], pa.string())), set()
    for raw in (text or "").lower().split():
        bare, look = toxicity.trimmed(raw)
        words.update(w for t in toxicity.pieces(look) for w in readings[t].split()) if toxicity.disguised(look) else words.add(bare)
    words.update(w for t in units.hidden for w in readings[t].split())
    return sum(toxicity.word_weight(w, known) for w in words)


def test_sums_match_a_plain_scorer(spark, docs, rows):
    known = {"idiot": 3.0, "stup-": 2.5, "moron": 1.25, "tail": 0.5, "word": 0.75, "two": 2.0}
    more = [(50, "!diot IDIOT m0r0n"), (51, "s t u p i d and stupid"), (52, "1d10t."), (53, "un m0r0n é t a b l i")]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    read = toxicity.readings(toxicity.observed(frame, "text"))
    readings = {r.token: r.reading for r in read.collect()}
    assert len(readings) == read.count()
    found = toxicity.matched(frame, "text", spark.sparkContext.broadcast(known), read)
    keyed = frame.select("text", *toxicity._text_id("text")).distinct().join(found, ["_id", "_id2"], "left").collect()
    for r in keyed:
        assert (r.total or 0.0) == pytest.approx(_plain_score(r.text, readings, known)), r.text
    assert sum(r.total is not None for r in keyed) >= 6


def test_no_count_is_left_out(spark):
    docs = spark.createDataFrame([(i, " ".join(chr(0x4E00 + 7 * i + j) + chr(0x4E00 + 11 * i + j) for j in range(40))) for i in range(200)], "doc_id long, text string")
    counts = {r.code: r.n for r in toxicity.character_counts(toxicity.observed(docs, "text")).collect()}
    plain = collections.Counter()
    for r in docs.collect():
        for word in r.text.split():
            padded = [32, *map(ord, word), 32]
            for n in (1, 2, 3):
                for k in range(len(padded) - n + 1):
                    gram = padded[k : k + n]
                    if (n == 1 and gram != [32]) or n == 2 or (n == 3 and gram[1] != 32):
                        plain[sum(c << 21 * (n - 1 - i) for i, c in enumerate(gram))] += 1
                        if n == 3 or (n == 2 and gram[0] == 32):
                            plain[-(gram[0] << 21 * (n - 2) | gram[n - 2]) - 1 if n == 3 else -33] += 1
    assert counts == dict(plain) and len(counts) > 10_000


def test_the_sample_holds_a_document_once(spark):
    docs = spark.createDataFrame([(7, f"text {i % 3}") for i in range(900)] + [(i, "else") for i in range(8, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] * 2, "doc_id long, toxic int")
    sample, totals = toxicity.labelled_sample(docs, labels, F.lit(True), "doc_id", "text", "toxic", 10)
    assert sample.count() <= 20 and totals == {0: 30, 1: 30}


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = queries.op3_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in found)
    assert hits / sum(r.toxic for r in found) > 0.85
    assert hits / sum(r.predicted for r in found) > 0.85


def test_toxicity_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (14, 0), (None, 1), (999, 1), (8, None)], "doc_id long, toxic int")
    found = toxicity.scored(docs, labels, F.lit(True))
    assert found.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert len({r.score for r in toxicity.scored(docs, labels.where("false"), F.lit(True)).collect()}) == 1
    assert toxicity.scored(empty, labels, F.lit(True)).count() == 0


def test_logistic_regression_separates():
    x = np.array([0.0, 1, 2, 3, 6, 7, 8, 9])
    slope, start = toxicity.logistic(x, (x > 4).astype(float), np.ones(8), 0.01)
    assert slope * 2 + start < 0 < slope * 7 + start
