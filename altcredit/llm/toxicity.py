"""Toxicity scores of deobfuscated text.

Noisy channel: a token that shows signs of disguise (digits or symbols among letters or at an edge, separators
between letters, a letter three times in a row, single letters with spaces between) is a lattice of
characters. An observed character may stand for itself, for the letters that look like it, or for
nothing, if it separates, repeats or is punctuation; a space between single letters may be a word border. Each
reading has a channel cost. Viterbi decoding finds the reading with the best channel and language model score,
the model being one of character trigrams counted over all documents. The restored words are then scored.

All counts of the model stay a table. The distinct disguised tokens of all documents are dealt into groups; a
group asks for the n-grams that its lattices hold, gets their counts by a join, and decodes its tokens
once, all of them a character further at a time (``Decoder``). Tokens of more than ``LONGEST`` characters are
read in pieces of that length that overlap, so any word of up to ``OVERLAP`` characters lies in one.

Classifier: log-odds of words and of their first four to six letters, from a bounded sample of labelled
documents (``sample_rows`` a class, the ones with the smallest hash of the id; of rows that repeat an id one). In toxic
rows a feature is counted once a preceding word, so that copies of one text count once. Features that occur
``least`` times there and are ``odds`` times likelier there than in other rows remain and go to all tasks; they are
no more than the sample's words. A document's distinct restored words add up, each by its strongest
feature; its score is a logistic function of the sum, fitted on the sample with each class weighted as
in all labelled rows, and without such a word the smoothed share of toxic rows among the sampled ones
that have none. Only the text enters a score.

Defined results: null and empty texts score like texts without a known word; without labelled rows of
both classes all documents score alike; labels of documents that don't exist, null labels and repeated
label rows do no harm; an empty table gives an empty result; other columns are kept, and an
input column with the name of the score is replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altcredit.llm import kernels as K
from altcredit.llm import language_id as N
from altcredit.llm.common import pieces_of, small_batches, text_of, written

PREFIXES = (4, 5, 6)
#: Letters that a character may stand for. Fixed values.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
SEPARATORS = " .-_~*'`,/\\:"
EDGES = " \t\n\x0b\x0c\r.,;:?!\"'()[]{}<>*#%&|-_~$+@€£"
#: Marks that may be letters although they stand at an edge, one or two of them.
LETTER_MARKS = "".join(c for c in EDGES if c in LOOKS)
#: Those that punctuation seldom puts before a word.
RARE_IN_FRONT = "!|$+@€£"
READ_AS, SKIP_MARK, SKIP_REPEAT, SKIP_RARE, SKIP_OTHER = (math.log(p) for p in (0.3, 0.5, 0.2, 0.001, 0.0001))
#: Between single letters: the same word goes on, or another one begins. Wider gaps always part words, and
#: where a run of letters has such gaps, the others part none.
SAME_WORD, NEXT_WORD = math.log(0.95), math.log(0.05)
GAP, WIDE_GAP = " ", "\n"
REPEATED = re.compile(r"(\w)\1\1")
#: Characters of a token that are read at once, and those that neighbouring pieces of a longer one share.
LONGEST, OVERLAP = 64, 24
#: Bytes of distinct tokens that are decoded together.
GROUP_BYTES = 256 << 10
BORDER = N.BORDER
_BITS = 21


class CharacterModel:
    """Log-probability of a letter after two others, interpolated; a border begins and ends a word.

    ``codes`` are sorted: n-grams as ``language_id`` codes them, and for each pair ``after`` it, how often any
    letter follows.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, total: int):
        self.codes, self.counts, self.total = codes, counts, total + 1

    def count(self, code: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(code))
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.counts[at], 0).astype(float)

    def cost(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        single, pair, triple, after, before = _codes(a, b, c)
        one = (self.count(single) + 0.1) / self.total
        two = (self.count(pair) + 10 * one) / (self.count(before) + 10)
        return np.log((self.count(triple) + 10 * two) / (self.count(after) + 10))


def after_code(pair):
    """Of all triples that begin with a pair, or all pairs that begin with a border."""
    return -pair - 1


def _codes(a, b, c) -> tuple[np.ndarray, ...]:
    pair = a << _BITS | b
    return c, b << _BITS | c, pair << _BITS | c, after_code(pair), np.where(b == BORDER, after_code(b), b)


def _readings(char: str, repeats: bool, front: bool, back: bool, spaced: bool, parted: bool) -> list[tuple[int, float]]:
    """What an observed character may stand for, with channel costs; 0 is nothing."""
    if spaced and char == GAP:
        return [(0, 0.0)] if parted else [(0, SAME_WORD), (BORDER, NEXT_WORD)]
    if spaced and char == WIDE_GAP:
        return [(BORDER, 0.0)]
    if char.isalpha():
        return [(ord(char), 0.0), *([(0, SKIP_REPEAT)] if repeats else [])]
    looks = LOOKS.get(char, "")
    # A letter mark at an edge may be punctuation.
    mark = char in SEPARATORS or ((front or back) and char in LETTER_MARKS)
    skip = SKIP_RARE if front and char in RARE_IN_FRONT else SKIP_MARK if mark else SKIP_OTHER
    return [*((ord(c), READ_AS - math.log(len(looks))) for c in looks), (0, skip)]


class Decoder:
    """Lattices of many tokens, advanced together a character at a time.

    A state is a token with its last two letters; each has one row with its best score and the place of the
    step that led to it, so a token takes memory in proportion to its length.
    """

    def __init__(self, tokens: list[str]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        width = int(self.lengths.max(initial=0))
        self.chars = np.zeros((len(tokens), width), np.int64)
        points = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.chars[np.arange(width) < self.lengths[:, None]] = points
        # The marks at the edges of a token.
        marks = np.isin(self.chars, [ord(c) for c in LETTER_MARKS])
        inside = np.arange(width) < self.lengths[:, None]
        self.front = np.logical_and.accumulate(marks, axis=1)
        self.back = np.logical_and.accumulate((marks | ~inside)[:, ::-1], axis=1)[:, ::-1] & inside
        self.parted = (self.chars == ord(WIDE_GAP)).any(axis=1)
        self.spaced = (self.chars == ord(GAP)).any(axis=1) | self.parted

    def _column(self, t: int) -> tuple[np.ndarray, ...]:
        """For position t: where each token's readings begin, their number, what they emit and cost."""
        char = self.chars[:, t]
        repeats = (char == self.chars[:, t - 1]) if t else np.zeros(len(char), bool)
        marks = repeats << 4 | self.front[:, t] << 3 | self.back[:, t] << 2 | self.spaced << 1 | self.parted
        kinds, kind = np.unique(char << 5 | marks, return_inverse=True)
        lists = [_readings(chr(k >> 5), *(bool(k & b) for b in (16, 8, 4, 2, 1))) for k in kinds.tolist()]
        number = np.array([len(x) for x in lists])
        begin = np.cumsum(number) - number
        flat = [x for r in lists for x in r]
        return begin[kind], number[kind], np.array([c for c, _ in flat], np.int64), np.array([s for _, s in flat])

    def _steps(self, model: CharacterModel | None):
        """For each position the states, with the letters and the rows that they came from; then the finished ones."""
        n = len(self.lengths)
        token, a, b, score = np.arange(n), np.full(n, BORDER), np.full(n, BORDER), np.zeros(n)
        row = np.arange(n)
        for t in range(self.chars.shape[1] + 1):
            done = self.lengths[token] == t
            if done.any():
                last = score[done]
                if model:
                    last = last + np.where(b[done] == BORDER, 0.0, model.cost(a[done], b[done], np.full(done.sum(), BORDER)))
                yield "done", token[done], a[done], b[done], last, row[done]
                token, a, b, score, row = (x[~done] for x in (token, a, b, score, row))
            if not len(token):
                return
            begin, number, emits, costs = self._column(t)
            many = number[token]
            at = np.repeat(np.arange(len(token)), many)
            reading = K.ranges(begin[token], many)
            c, value = emits[reading], score[at] + costs[reading]
            # A border where there is one already adds nothing.
            c = np.where((c == BORDER) & (b[at] == BORDER), 0, c)
            letter = c > 0
            if model:
                value[letter] += model.cost(a[at][letter], b[at][letter], c[letter])
            else:
                yield "asked", None, a[at][letter], b[at][letter], c[letter], None
            first = np.where(c == BORDER, BORDER, np.where(letter, b[at], a[at]))
            second = np.where(letter, c, b[at])
            key = token[at] << 2 * _BITS | first << _BITS | second
            order = np.lexsort((-value, key))
            order = order[np.append(True, key[order][1:] != key[order][:-1])]
            yield "step", None, c[order], row[at[order]], None, None
            token, a, b, score, row = token[at[order]], first[order], second[order], value[order], np.arange(len(order))

    def asked(self) -> np.ndarray:
        """Codes of all counts that decoding looks up."""
        found = [np.zeros(0, np.int64)]
        for what, _, a, b, c, _ in self._steps(None):
            if what == "asked":
                found.append(np.unique(np.concatenate(_codes(a, b, c))))
            elif what == "done":
                found.append(np.unique(np.concatenate(_codes(a, b, np.full(len(a), BORDER)))))
        return np.unique(np.concatenate(found))

    def read(self, model: CharacterModel) -> tuple[list[str], np.ndarray]:
        """The best reading of each token, words apart by one space, and its score."""
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        best, end, at = np.full(len(self.lengths), -np.inf), np.zeros(len(self.lengths), np.int64), np.zeros(len(self.lengths), np.int64)
        for what, token, x, y, score, row in self._steps(model):
            if what == "step":
                steps.append((x, y))
            elif what == "done":
                order = np.lexsort((-score, token))
                order = order[np.append(True, token[order][1:] != token[order][:-1])]
                mine = token[order]
                best[mine], end[mine], at[mine] = score[order], len(steps), row[order]
        letters = np.zeros((len(self.lengths), len(steps)), np.uint32)
        for t in range(len(steps) - 1, -1, -1):
            mine = np.flatnonzero(end > t)
            emits, came = steps[t]
            letters[mine, t] = emits[at[mine]]
            at[mine] = came[at[mine]]
        return [" ".join(row[row > 0].tobytes().decode("utf-32-le", "replace").split()) for row in letters], best


def disguised(token: str) -> bool:
    """Whether a token (lower case, without marks at its edges but for letter marks) shows signs of disguise."""
    if token.isalpha():
        return REPEATED.search(token) is not None
    return any(c.isalpha() for c in token) and sum(c.isalpha() or c in LOOKS for c in token) >= 3


def trimmed(token: str) -> tuple[str, str]:
    """A token without the marks at its edges, and with letter marks that stand there, if they are one or two equal ones."""
    bare = token.strip(EDGES)
    if not bare:
        return "", ""
    at = token.index(bare)
    return bare, _letter_marks(token[:at][::-1])[::-1] + bare + _letter_marks(token[at + len(bare) :])


def _letter_marks(marks: str) -> str:
    """The marks next to a word that may be letters of it."""
    same = marks[: len(marks) - len(marks.lstrip(marks[:1]))] if marks else ""
    return same if same[:1] in LETTER_MARKS and len(same) <= 2 else ""


def pieces(token: str) -> list[str]:
    """A token to be read at once, or the overlapping pieces of a longer one."""
    if len(token) <= LONGEST:
        return [token]
    return [token[i : i + LONGEST] for i in _begins(len(token))]


def _begins(n: int) -> range:
    return range(0, max(1, n - OVERLAP), LONGEST - OVERLAP)


class Units:
    """The words and the disguised tokens of a batch of texts, each distinct one once."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.data, self.offsets = K.flat(pc.utf8_lower(column.fill_null("").cast(pa.large_utf8())))
        self.starts, self.ends, first = K.word_spans(self.data, self.offsets, K.byte_set(*K.WHITE))
        owner = np.repeat(np.arange(len(self.offsets) - 1), np.diff(first))
        #: The plain words, the disguised tokens, and for each occurrence its text and its number in one of them.
        self.plain, self.hidden = pa.array([], pa.large_utf8()), []
        self.plain_owner, self.plain_at, self.hidden_owner, self.hidden_at = (np.zeros(0, np.int64) for _ in range(4))
        if not len(self.starts):
            return
        raw = K.texts(self.data[self.starts[0] :], np.append(self.starts, len(self.data)) - self.starts[0], pa.large_binary()).dictionary_encode()
        at = raw.indices.to_numpy().astype(np.int64)
        tokens = self._decoded(raw.dictionary)
        self.plain = pc.utf8_trim(tokens, characters=EDGES)
        odd = np.flatnonzero(self._odd(tokens))
        named: dict[str, int] = {}
        groups: list[list[int]] = [[] for _ in range(len(tokens))]
        for k, token in zip(odd.tolist(), tokens.take(pa.array(odd)).to_pylist()):
            _, look = trimmed(token)
            if disguised(look):
                groups[k] = [named.setdefault(x, len(named)) for x in pieces(look)]
        size = np.array([len(x) for x in groups], np.int64)
        many = size[at]
        flat = np.array([x for g in groups for x in g], np.int64)
        hidden_at = flat[K.ranges((np.cumsum(size) - size)[at], many)] if len(flat) else flat
        self.plain_owner, self.plain_at = owner[many == 0], at[many == 0]
        more = self._spaced(owner, named)
        self.hidden = list(named)
        self.hidden_owner = np.append(np.repeat(owner, many), [o for o, _ in more]).astype(np.int64)
        self.hidden_at = np.append(hidden_at, [k for _, k in more]).astype(np.int64)

    @staticmethod
    def _decoded(tokens) -> pa.Array:
        try:
            out = tokens.cast(pa.large_utf8())
            out.validate(full=True)
            return out
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in tokens.to_pylist()], pa.large_utf8())

    def _odd(self, tokens: pa.Array) -> np.ndarray:
        """Tokens that may be disguised: with other characters than letters inside, letter marks or a letter thrice."""
        bare = pc.utf8_trim(tokens, characters="".join(c for c in EDGES if c not in LETTER_MARKS))
        odd = ~pc.utf8_is_alpha(bare).to_numpy(zero_copy_only=False)
        alpha = np.flatnonzero(~odd)
        if len(alpha):
            words = bare.take(pa.array(alpha)).to_pylist()
            begin = np.cumsum([0, *(len(w) + 1 for w in words)])
            hits = [m.start() for m in REPEATED.finditer("\n".join(words))]
            odd[alpha[np.searchsorted(begin, hits, "right") - 1]] = True
        return odd

    def _spaced(self, owner: np.ndarray, named: dict[str, int]) -> list[tuple[int, int]]:
        """Runs of three or more single characters, some of them letters, each read as one token."""
        begins = np.append(0, np.cumsum((self.data & 0xC0) != 0x80))
        single = (begins[self.ends] - begins[self.starts] == 1).astype(np.int8)
        edge = np.diff(np.concatenate([[0], single, [0]]))
        out = []
        for low, high in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()):
            cuts = (np.flatnonzero(owner[low + 1 : high] != owner[low : high - 1]) + low + 1).tolist()
            for i, j in zip([low, *cuts], [*cuts, high]):
                if j - i < 3:
                    continue
                chars = bytes(self.data[K.ranges(self.starts[i:j], self.ends[i:j] - self.starts[i:j])]).decode("utf-8", "replace")
                if len(chars) != j - i or not any(c.isalpha() for c in chars):
                    continue
                gaps = np.where(self.starts[i + 1 : j] - self.ends[i : j - 1] > 1, WIDE_GAP, GAP).tolist()
                for k in _begins(len(chars)):
                    part = "".join(c + g for c, g in zip(chars[k : k + LONGEST], [*gaps, ""][k : k + LONGEST]))
                    out.append((int(owner[i]), named.setdefault(part.strip(GAP + WIDE_GAP), len(named))))
        return out

    def words(self, readings: dict[str, str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Text and word number of each occurrence, and the words, disguised ones as they are read."""
        words = self.plain.to_pylist()
        read = [readings.get(t, "").split() for t in self.hidden]
        size = np.array([len(x) for x in read], np.int64)
        many = size[self.hidden_at] if len(size) else np.zeros(0, np.int64)
        begin = len(words) + np.cumsum(size) - size
        more = K.ranges(begin[self.hidden_at], many) if len(size) else many
        owner = np.append(self.plain_owner, np.repeat(self.hidden_owner, many))
        return owner, np.append(self.plain_at, more).astype(np.int64), words + [w for x in read for w in x]


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)] if word else []


def word_weight(word: str, known: dict[str, float]) -> float:
    return max((known.get(f, 0.0) for f in features(word)), default=0.0)


def observed(docs: DataFrame, text: str) -> DataFrame:
    """Rows (code, n) of character n-grams and rows (token) of disguised tokens, of all documents, from one reading."""
    table = docs.sparkSession.sparkContext.broadcast(N.letters_table())

    def collect(batches):
        grams, counts, tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), set()
        for rows in K.gathered(batches, N.BATCH):
            found, _ = N.symbols(rows["text"], table.value)
            _, gram, n = N.ngram_counts(found, np.zeros(len(found), np.int64))
            grams, back = np.unique(np.append(grams, gram), return_inverse=True)
            counts = np.bincount(back, np.append(counts, n), len(grams)).astype(np.int64)
            tokens.update(Units(rows["text"]).hidden)
            if len(tokens) > 200_000:
                yield from seen(tokens)
                tokens = set()
        yield from seen(tokens)
        none = pa.nulls(len(grams), pa.string())
        yield from pa.table({"code": grams, "n": counts, "token": none}).to_batches(50_000)

    def seen(tokens):
        none = pa.nulls(len(tokens), pa.int64())
        yield from pa.table({"code": none, "n": none, "token": pa.array(list(tokens), pa.string())}).to_batches(50_000)

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(collect, "code bigint, n bigint, token string")
    return written(rows, "observed")


def character_counts(seen: DataFrame) -> DataFrame:
    """Rows (code, n): all letters, pairs and triples of letters with word borders, and how often pairs are followed."""
    grams = seen.where("code is not null").groupBy("code").agg(F.sum("n").alias("n"))
    pair = F.shiftright("code", _BITS)
    begins = (F.col("code") >= F.lit(1 << 2 * _BITS)) | (pair == BORDER)
    # A pair's first letter, where that is a border; else the first two of three.
    followed = grams.where(begins).groupBy(after_code(pair).alias("code")).agg(F.sum("n").alias("n"))
    return grams.unionByName(followed)


def readings(seen: DataFrame) -> DataFrame:
    """Rows (token, reading): each distinct disguised token of all documents and the words behind it."""
    counts = written(character_counts(seen), "characters")
    total = counts.where((F.col("code") >= 0) & (F.col("code") < F.lit(1 << _BITS))).agg(F.sum("n").alias("n")).first()["n"] or 0
    distinct = written(seen.where("token is not null").select("token").distinct(), "tokens")
    size = distinct.agg(F.sum(F.octet_length("token")).alias("n")).first()["n"] or 0
    group = F.pmod(F.xxhash64("token"), F.lit(pieces_of(size, GROUP_BYTES))).cast("int").alias("g")
    tokens = distinct.select(group, "token")

    def ask(key, table):
        codes = Decoder(table["token"].to_pylist()).asked()
        return pa.table({"g": pa.array(np.full(len(codes), key[0].as_py(), np.int32)), "code": codes})

    def decode(key, table, found):
        order = np.argsort(found["code"].to_numpy())
        model = CharacterModel(found["code"].to_numpy()[order], found["n"].to_numpy()[order], total)
        words = table["token"].to_pylist()
        return pa.table({"token": table["token"], "reading": pa.array(Decoder(words).read(model)[0] if words else [], pa.string())})

    known = tokens.groupBy("g").applyInArrow(ask, "g int, code bigint").join(counts, "code").select("g", "code", "n")
    return written(tokens.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(decode, "token string, reading string"), "readings")


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, key: str, text: str, label: str, sample_rows: int):
    """At most ``sample_rows`` training documents of each class, as a table, and all training rows by class."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), train.alias("train"))
    marked = marked.where("train and label in (0, 1) and key is not null").select("key", "label").dropDuplicates(["key"])
    totals = {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    one = [marked.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(sample_rows) for v in (0, 1)]
    chosen = F.broadcast(one[0].unionByName(one[1]))  # at most 2 * sample_rows rows of two numbers
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").join(chosen, "key")
    # Of rows that repeat an id the first text, so the sample is as large as it says.
    return written(rows.groupBy("key", "label").agg(F.min("text").alias("text")).select("text", "label"), "labelled"), totals


def sample_readings(sample: DataFrame, read: DataFrame) -> dict[str, str]:
    """The readings of the sample's disguised tokens."""

    def tokens(batches):
        for rows in K.gathered(batches, N.BATCH):
            yield pa.RecordBatch.from_pydict({"token": pa.array(Units(rows["text"]).hidden, pa.string())})

    mine = sample.select("text").mapInArrow(tokens, "token string").distinct()
    return {r.token: r.reading for r in read.join(mine, "token").collect()}


def _toxic_features(sample: DataFrame, read, least: int) -> DataFrame:
    """Rows (feature, n): features of toxic rows by the number of words that precede them."""

    def count(batches):
        for rows in K.gathered(batches, N.BATCH):
            owner, at, words = Units(rows["text"]).words(read.value)
            pairs = _pairs(at, np.append(-1, np.where(owner[1:] == owner[:-1], at[:-1], -1))[: len(at)])
            found = [(f, words[b] if b >= 0 else "") for a, b in pairs.T.tolist() for f in features(words[a])]
            yield pa.RecordBatch.from_pydict({"feature": pa.array([f for f, _ in found], pa.string()), "before": pa.array([b for _, b in found], pa.string())})

    pairs = sample.where("label = 1").select("text").mapInArrow(count, "feature string, before string").distinct()
    return pairs.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _other_counts(sample: DataFrame, read, known) -> DataFrame:
    """Rows (feature, n): occurrences of known features in other rows."""

    def count(batches):
        wanted, seen = known.value, {}
        for rows in K.gathered(batches, N.BATCH):
            _, at, words = Units(rows["text"]).words(read.value)
            for word, n in zip(words, np.bincount(at, minlength=len(words)).tolist()):
                for f in features(word):
                    if f in wanted:
                        seen[f] = seen.get(f, 0) + n
        yield pa.RecordBatch.from_pydict({"feature": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    part = sample.where("label = 0").select("text").repartition(16).mapInArrow(count, "feature string, n bigint")
    return part.groupBy("feature").agg(F.sum("n").alias("n"))


def weights(sample: DataFrame, read, least: int = 5, odds: float = 20.0) -> dict[str, float]:
    """Log-odds of the features that mark toxic rows."""
    spark = sample.sparkSession
    rows = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(rows) < 2:
        return {}
    toxic = {r.feature: r.n for r in _toxic_features(sample.repartition(16), read, least).collect()}
    other = {r.feature: r.n for r in _other_counts(sample, read, spark.sparkContext.broadcast(set(toxic))).collect()}
    ratio = {f: (n + 0.5) / (rows[1] + 1) / ((other.get(f, 0) + 0.5) / (rows[0] + 1)) for f, n in toxic.items()}
    return {f: min(math.log(r), 12.0) for f, r in ratio.items() if r >= odds}


class Weights:
    """Weights of many plain words at once."""

    def __init__(self, known: dict[str, float]):
        self.tables = []
        for n in (None, *PREFIXES):
            mine = {f[:-1] if n else f: w for f, w in known.items() if (n is None) != (f.endswith("-") and len(f) - 1 in PREFIXES)}
            if n:
                mine = {f: w for f, w in mine.items() if len(f) == n}
            self.tables.append((n, pa.array(mine, pa.large_utf8()), np.array([*mine.values(), 0.0])))

    def of(self, words: pa.Array) -> np.ndarray:
        out = np.zeros(len(words))
        for n, names, weight in self.tables:
            value = words if n is None else pc.utf8_slice_codeunits(words, 0, n)
            at = pc.index_in(value, value_set=names).fill_null(len(names)).to_numpy(zero_copy_only=False)
            out = np.maximum(out, weight[at])
        return out


def _pairs(owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each pair once."""
    return np.unique(np.stack([owner, at]), axis=1) if len(owner) else np.zeros((2, 0), np.int64)


def _text_id(text: str) -> list[Column]:
    """What stands for a text in the join of scores to documents: 96 bits of hashes."""
    value = text_of(f"`{text}`")
    return [F.xxhash64(value).alias("_id"), F.hash(value).alias("_id2")]


def matched(texts: DataFrame, text: str, known, read: DataFrame) -> DataFrame:
    """Rows (_id, _id2, total): for each text with a known word, the sum of its distinct words' weights."""

    def find(batches):
        weigh = Weights(known.value)
        for rows in K.gathered(batches):
            units = Units(rows["text"])
            weight = weigh.of(units.plain)
            owner, at = units.plain_owner, units.plain_at
            hit = np.flatnonzero(weight[at] > 0) if len(at) else at
            plain, hidden = _pairs(owner[hit], at[hit]), _pairs(units.hidden_owner, units.hidden_at)
            names = pa.concat_arrays([units.plain.take(pa.array(plain[1])), pa.array(units.hidden, pa.large_utf8()).take(pa.array(hidden[1]))])
            of = pa.array(np.append(plain[0], hidden[0]))
            value = pa.array(np.append(weight[plain[1]], np.zeros(hidden.shape[1])))
            out = {"_id": rows["_id"].take(of), "_id2": rows["_id2"].take(of), "word": names.cast(pa.string()), "weight": value}
            yield from pa.table(out).to_batches()

    def restored(batches):
        for batch in batches:
            found = [(t, w, word_weight(w, known.value)) for t, r in zip(batch["token"].to_pylist(), batch["reading"].to_pylist()) for w in r.split()]
            found = [x for x in found if x[2] > 0]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("token", "restored", "value"), columns, (pa.string(), pa.string(), pa.float64()))})

    # Few tokens stand for known words; as a table their size is known, and decides how they are joined.
    behind = written(read.mapInArrow(restored, "token string, restored string, value double"), "restored")
    rows = texts.select(*_text_id(text), F.col(f"`{text}`").alias("text"))
    # Weight 0: a disguised token.
    found = rows.mapInArrow(find, "_id bigint, _id2 int, word string, weight double")
    # Plain words match no token, and are spread like the texts.
    hidden = F.when(F.col("weight") == 0, F.col("word")).otherwise(F.concat(F.lit(WIDE_GAP), F.col("_id").cast("string")))
    words = found.join(behind, hidden == F.col("token"), "left").where("weight > 0 or value is not null")
    words = words.select("_id", "_id2", F.coalesce("restored", "word").alias("word"), F.coalesce("value", "weight").alias("weight"))
    each = words.groupBy("_id", "_id2", "word").agg(F.max("weight").alias("weight"))
    sums = each.groupBy("_id", "_id2").agg(F.sum("weight").alias("total"))
    return written(sums, "matched")


def scored(
    docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
    score: str = "score", sample_rows: int = 10_000,
) -> DataFrame:
    """The input with a score from 0 to 1; learns from the label rows where ``train`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    read = readings(observed(docs, text))
    sample, totals = labelled_sample(docs, labels, train, key, text, label, sample_rows)
    mine = spark.sparkContext.broadcast(sample_readings(sample, read))
    known = weights(sample, mine)

    def match(batches):
        for rows in K.gathered(batches, N.BATCH):
            owner, at, words = Units(rows["text"]).words(mine.value)
            total = np.zeros(rows.num_rows)
            for d, w in {(d, words[k]) for d, k in zip(owner.tolist(), at.tolist())}:
                total[d] += word_weight(w, known)
            yield from pa.table({"label": rows["label"], "total": total}).to_batches()

    seen = sample.mapInArrow(match, "label int, total double").toPandas()  # at most 2 * sample_rows rows
    share = {v: totals.get(v, 0) / max((seen.label == v).sum(), 1) for v in (0, 1)}
    weight = seen.label.map(share).to_numpy(float)
    hit, label = (seen.total > 0).to_numpy(), seen.label.to_numpy(float)
    missed, clean = (weight[~hit & (label == v)].sum() for v in (1, 0))
    absent = (missed + 0.5) / (missed + clean + 10)
    slope, start = logistic(seen.total.to_numpy(float)[hit], label[hit], weight[hit])
    sums = matched(docs, text, spark.sparkContext.broadcast(known), read)
    value = F.when(F.col("total") > 0, 1 / (1 + F.exp(-(F.col("total") * F.lit(slope) + F.lit(start))))).otherwise(F.lit(absent))
    rest = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*rest).alias("row"), *_text_id(text)).join(sums, ["_id", "_id2"], "left")
    return named.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != score], value.alias(score))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> tuple[float, float]:
    """Slope and start of a weighted logistic regression on one number, by Newton's method."""
    if not len(x):
        return 0.0, 0.0
    design, at = np.stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ design, -30, 30)))
        slope = design @ (weight * (y - p)) - penalty * at
        curve = (design * (weight * p * (1 - p))) @ design.T + penalty * np.eye(2)
        at = at + np.linalg.solve(curve, slope)
    return float(at[0]), float(at[1])
