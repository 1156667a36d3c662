"""Language by rank-order n-gram profiles (Cavnar and Trenkle 1994).

A language's profile is the ranking of its ``top`` most frequent character n-grams (one to three
letters, lower case, a border before and after each word) over all training documents; a document's
is that of its own most frequent ones. Their distance sums, over the document's n-grams, how far each
is out of its place in the language's ranking, and ``top`` for one that the language lacks. The
language with the smallest distance is the answer. Its score is a half, plus half of the share of the
largest possible distance by which the second language is farther.

Counts are taken in the tasks over whole texts, ``SLICE`` letters at a time, and added up by Spark, so
a language with a third of all rows is a table of counts a task. Rankings are by count, then by
n-gram. The profiles, ``top`` rows a language, go to all tasks; more than ``MAX_LANGUAGES`` languages
are refused.

Defined results: a null text or one without a letter is ``und`` with score 0; equal distances go to
the first language in alphabetical order; documents without a language are predicted but not learned
from; without any training document every document is ``und``; other columns are kept, and
an input column with the name of a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altcredit.llm import kernels as K
from altcredit.llm.common import packed, schema, small_batches, unpacked

MAX_LANGUAGES = 1000
SLICE = 1 << 20
BATCH = 2 << 20
UNKNOWN = "und"
BORDER = 32


def letters_table() -> np.ndarray:
    """Lower-case code point of each letter, ``BORDER`` for all other characters."""
    table = np.full(0x110000, BORDER, np.int32)
    for code in range(0x110000):
        if chr(code).isalpha():
            low = chr(code).lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def symbols(column, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and borders of the texts of a batch, one border between words, and the text of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    # A line feed ends each text, so no word crosses the border of two texts.
    ended = pc.binary_join_element_wise(column.fill_null("").cast(pa.large_utf8()), *[pa.scalar(x, pa.large_utf8()) for x in ("\n", "")])
    data, offsets = K.flat(ended)
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.int32)
    except UnicodeDecodeError:
        return symbols(pa.array([bytes(x).decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]), table)
    begin = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    found = table[points]
    keep = np.append(True, (found[1:] != BORDER) | (found[:-1] != BORDER))[: len(found)]
    owner = np.repeat(np.arange(len(column)), np.diff(begin))
    return np.append(BORDER, found[keep]), np.append(0, owner[keep])


def ngram_counts(found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, n-gram and count, ordered by owner; an n-gram has 21 bits a symbol."""
    present = np.flatnonzero(np.bincount(found, minlength=BORDER + 1))
    place = np.zeros(int(found.max()) + 1, np.int64)
    place[present] = np.arange(len(present))
    at, border, base = place[found], place[BORDER], len(present)
    size = base + base**2 + base**3
    codes, counts = [], []
    for low in range(0, len(at), SLICE):
        part, own = at[max(0, low - 2) : low + SLICE], owner[max(0, low - 2) : low + SLICE] * size
        skip = low - max(0, low - 2)
        one = (own + part)[skip:][part[skip:] != border]
        two = (own[1:] + base + part[:-1] * base + part[1:])[max(0, skip - 1) :]
        middle = (part[1:-1] != border)[max(0, skip - 2) :]
        three = (own[2:] + base + base**2 + (part[:-2] * base + part[1:-1]) * base + part[2:])[max(0, skip - 2) :][middle]
        # Two borders meet only where a text has no letter.
        two = two[((part[:-1] != border) | (part[1:] != border))[max(0, skip - 1) :]]
        every = np.sort(np.concatenate([one, two, three]))
        new = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
        codes.append(every[new])
        counts.append(np.diff(np.append(new, len(every))))
    code, count = np.concatenate(codes), np.concatenate(counts)
    if len(codes) > 1:
        code, back = np.unique(code, return_inverse=True)
        count = np.bincount(back, count, len(code)).astype(np.int64)
    who, gram = code // size, code % size
    letter = present.astype(np.int64)
    two, three = gram - base, gram - base - base**2
    wide = np.where(
        three >= 0,
        letter[three % base] | letter[three // base % base] << 21 | letter[np.maximum(three, 0) // base**2] << 42,
        np.where(two >= 0, letter[two % base] | letter[two // base % base] << 21, letter[gram % base]),
    )
    return who, wide, count


def profiles(docs: DataFrame, text: str, language: str, top: int = 300) -> DataFrame:
    """Rows (language, gram, rank) of each language's profile."""
    table = docs.sparkSession.sparkContext.broadcast(letters_table())

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for rows in K.gathered(batches, BATCH):
            names = rows["language"].combine_chunks().dictionary_encode()
            found, owner = symbols(rows["text"], table.value)
            who, gram, n = ngram_counts(found, names.indices.to_numpy()[owner])
            for i, name in enumerate(names.dictionary.to_pylist()):
                old = held.get(name, (gram[:0], n[:0]))
                grams, back = np.unique(np.append(old[0], gram[who == i]), return_inverse=True)
                held[name] = grams, np.bincount(back, np.append(old[1], n[who == i]), len(grams)).astype(np.int64)
        for name, (grams, n) in held.items():
            yield from pa.table({"language": pa.array([name] * len(grams), pa.string()), "gram": grams, "n": n}).to_batches(50_000)

    rows = docs.select(F.col(language).cast("string").alias("language"), F.col(text).alias("text")).where("language is not null and text is not null")
    counts = rows.mapInArrow(count, "language string, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("language", "gram", "rank")


def _ranks(profile: list, top: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, sorted n-grams, and each language's place for each; ``top`` where it has none."""
    names = sorted({r.language for r in profile})
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    grams = np.array(sorted({r.gram for r in profile}), np.int64)
    places = np.full((len(names), len(grams) + 1), top, np.int64)
    for r in profile:
        places[names.index(r.language), np.searchsorted(grams, r.gram)] = r.rank - 1
    return names, grams, places


def identified(
    docs: DataFrame, train: Column, text: str = "text", language: str = "lang", top: int = 300,
    out: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """The input with a language and a score; learns from the rows where ``train`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    learned = profiles(docs.where(train), text, language, top).limit((MAX_LANGUAGES + 1) * top)
    sent = spark.sparkContext.broadcast((*_ranks(learned.collect(), top), letters_table()))

    def predict(batches):
        names, grams, places, table = sent.value
        for rows in K.gathered(batches, BATCH):
            n = len(rows)
            found, owner = symbols(rows["text"], table)
            who, gram, count = ngram_counts(found, owner)
            order = np.lexsort((gram, -count, who))
            who, gram = who[order], gram[order]
            first = np.searchsorted(who, np.arange(n))
            rank = np.arange(len(who)) - first[who]
            who, gram, rank = who[rank < top], gram[rank < top], rank[rank < top]
            at = np.minimum(np.searchsorted(grams, gram), max(len(grams) - 1, 0))
            if len(grams):
                at = np.where(grams[at] == gram, at, len(grams))
            most = np.bincount(who, minlength=n) * float(top)
            far = np.empty((max(len(names), 1), n))
            far[0] = most
            for i in range(len(names)):
                place = places[i, at]
                far[i] = np.bincount(who, np.where(place < top, np.minimum(abs(place - rank), top), top), n)
            best = far.argmin(axis=0)
            least = far[best, np.arange(n)]
            second = np.partition(far, 1, axis=0)[1] if len(far) > 1 else most
            known = (most > 0) & (len(names) > 0)
            value = np.where(known, 0.5 + (second - least) / np.maximum(most, 1) / 2, 0.0)
            answer = np.where(known, np.array(names or [UNKNOWN], object)[best], UNKNOWN)
            yield from pa.table({"row": rows["row"], "language": pa.array(answer, pa.string()), "score": value}).to_batches()

    rows = packed(docs, text=text)
    found = rows.mapInArrow(predict, schema(rows, ["row"], "language string, score double"))
    return unpacked(found, docs, **{out: F.col("language"), score: F.col("score")})
