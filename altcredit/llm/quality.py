"""Quality rules as a short-circuit cascade, in built-in functions only.

A rule is a condition over one or two cheap statistics of a text. ``measure`` runs every rule on
a bounded sample and takes its cost (its own work a row) and its selectivity (share of rows that it
rejects); ``cascade`` evaluates the rules in the order of rejections per cost, and stops at the
first that rejects. The order changes the work, never the verdict.

Defined results: a null text has no words and no lines (all counts 0) and is rejected; an empty
table gives an empty result and keeps the declared order; copies get equal results; columns of
the input are kept, and one with the name of a result (the caller may choose it) is replaced. There
is no bound on the length of a text: the costliest statistic sorts the three-word windows of a text,
nothing is compared pairwise.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altcredit.llm.common import checkpoint_folder, let, text_of, utf8_bytes, words_of

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``reject`` gets the names of the word array and of the text, and gives a condition.

    ``known`` gives the same one from the struct of ``statistics`` and the text, where that is cheaper.
    """

    name: str
    reject: Callable[[Column, Column], Column]
    known: Callable[[Column, Column], Column] | None = None


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def n_capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Z]")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def n_dup_lines(lines: Column) -> Column:
    """Lines equal to an earlier one."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words inside a three-word window that occurs at least twice in the text.

    Windows are compared by a 64-bit hash. Only texts in which two windows agree sort them:
    equal neighbours give the places of repeated windows, whose union is then counted.
    """

    def windows(w: Column) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        return F.when(F.size(w) >= 3, hashed).otherwise(F.array().cast("array<bigint>"))

    def repeated(ordered: Column) -> Column:
        same = lambda e, other: F.get(ordered, other)["h"].eqNullSafe(e["h"])
        found = F.filter(ordered, lambda e, i: same(e, i - 1) | same(e, i + 1))
        return F.sort_array(F.transform(found, lambda e: e["at"]))

    def union(places: Column) -> Column:
        spans = F.transform(places, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - x, F.lit(3))))
        return F.aggregate(spans, F.lit(0), lambda total, x: total + x)

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return let(let(ordered, repeated), union)

    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))
    return let(let(words, windows), some).cast("long")


def _too_many_lines(n_dup: Column, text: Column) -> Column:
    """Lines are counted only if enough of them are repeated."""
    return (n_dup >= 4) & (n_dup * 10 > F.size(lines_with_words(text)) * 3)


def _odd_words(chars: Column, words: Column) -> Column:
    return (chars < words * 2) | (chars > words * 15)


#: The base rules and four more of the kind that Rae et al. (2021) apply to web text.
RULES = (
    Rule("short", lambda w, t: n_words(w) < 50, lambda s, t: s["n_words"] < 50),
    Rule("repetition", lambda w, t: n_repeat_words(w) * 100 > n_words(w) * 50, lambda s, t: s["n_repeat_words"] * 100 > s["n_words"] * 50),
    Rule("symbols", lambda w, t: n_symbols(t) * 10 > n_words(w), lambda s, t: s["n_symbols"] * 10 > s["n_words"]),
    Rule(
        "lines",
        lambda w, t: let(lines_with_words(t), lambda x: let(n_dup_lines(x), lambda n: (n >= 4) & (n * 10 > F.size(x) * 3))),
        lambda s, t: _too_many_lines(s["n_dup_lines"], t),
    ),
    Rule("word_length", lambda w, t: let(word_chars(w), lambda c: _odd_words(c, n_words(w))), lambda s, t: _odd_words(s["word_chars"], s["n_words"])),
    Rule("capitals", lambda w, t: n_capitals(t) * 2 > word_chars(w), lambda s, t: n_capitals(t) * 2 > s["word_chars"]),
)

#: Work that a rule is timed over, in seconds, and the rows of the sample that it is timed on.
TIMED, TIMED_ROWS = 0.1, 200
#: Bytes of text that the sample holds about.
SAMPLE_BYTES = 16 << 20


def measure(docs: DataFrame, text: str, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, seed: int = 7) -> list[dict]:
    """Cost (seconds a row) and selectivity of each rule on a sample of about ``sample_rows`` rows.

    The sample decides the order of the rules and nothing else; it holds about ``SAMPLE_BYTES`` at most. It is
    written to the shared checkpoint folder once, so that each rule is timed on its own over the same rows, by
    one task. A rule is run once for its selectivity, then on the first ``TIMED_ROWS`` rows once and many times over
    each: the difference is the rule's own work, without what a job costs. Costs are rounded to powers of
    two, as times vary from run to run.
    """
    checkpoint_folder(docs.sparkSession)
    found = docs.agg(F.count("*").alias("rows"), F.sum(utf8_bytes(f"`{text}`")).alias("bytes")).first()
    fraction = min(1.0, sample_rows / max(found["rows"], 1), SAMPLE_BYTES / max(found["bytes"] or 0, 1))
    part = docs.select(text_of(text).alias("text")).sample(fraction=fraction, seed=seed)
    part = part.repartition(1).select("text", words_of("text").alias("words")).checkpoint()
    size, few = part.count(), part.limit(TIMED_ROWS)

    def seconds(rule: Rule, times: int) -> float:
        hits = F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.lit(0), lambda n, _: n + rule.reject(F.col("words"), F.col("text")).cast("int"))
        began = time.perf_counter()
        few.agg(F.sum(hits)).first()
        return time.perf_counter() - began

    out = []
    for rule in rules:
        rejected = part.agg(F.count_if(rule.reject(F.col("words"), F.col("text"))).alias("n")).first()["n"]
        seconds(rule, 1)
        once, times = seconds(rule, 1), 2
        more = seconds(rule, 1 + times)
        while more - once < TIMED and times < 4096:
            times *= 8
            more = seconds(rule, 1 + times)
        cost = max(more - once, 1e-6) / times / max(min(size, TIMED_ROWS), 1)
        out.append({"name": rule.name, "cost": 2.0 ** round(math.log2(cost)), "rejects": rejected / max(size, 1)})
    return out


def order(rules: Sequence[Rule], measured: list[dict]) -> list[Rule]:
    """Most rejections per cost first; equal ones stay as declared."""
    worth = {m["name"]: m["rejects"] / max(m["cost"], 1e-12) for m in measured}
    return sorted(rules, key=lambda r: -worth[r.name])


def cascade(docs: DataFrame, text: str, rules: Sequence[Rule], out: str = "kept", stats: str | None = None) -> DataFrame:
    """The input with a boolean: no rule rejects. Rules after the first that rejects don't run.

    ``stats`` names a column of ``statistics``, if there is one: what it holds isn't computed again.
    """

    def verdict(rejects: Callable[[Rule], Column]) -> Column:
        case = F
        for rule in rules:
            case = case.when(rejects(rule), False)
        return case.otherwise(True)

    if stats and all(rule.known for rule in rules):
        return docs.withColumn(out, verdict(lambda rule: rule.known(F.col(stats), text_of(text))))
    pair = F.struct(words_of(text).alias("w"), text_of(text).alias("t"))
    return docs.withColumn(out, let(pair, lambda p: verdict(lambda rule: rule.reject(p["w"], p["t"]))))


def statistics(docs: DataFrame, text: str, out: str = "stats") -> DataFrame:
    """The input with a struct of the statistics that the rules use."""

    def all_of(pair: Column) -> Column:
        w, t = pair["w"], pair["t"]
        return F.struct(
            n_words(w).alias("n_words"),
            word_chars(w).alias("word_chars"),
            n_symbols(t).alias("n_symbols"),
            let(lines_with_words(t), n_dup_lines).alias("n_dup_lines"),
            n_repeat_words(w).alias("n_repeat_words"),
        )

    return docs.withColumn(out, let(F.struct(words_of(text).alias("w"), text_of(text).alias("t")), all_of))


def quality_rules(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The input with ``kept``, the rules ordered by what a sample shows."""
    return cascade(docs, text, order(rules, measure(docs, text, rules, sample_rows)))
