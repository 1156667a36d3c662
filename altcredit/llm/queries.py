"""Registered queries of the operators, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altcredit.llm import (
    decontamination,
    exact_dedup,
    importance_resampling,
    language_id,
    lexical_search,
    ngram_jaccard,
    quality,
    sentencepiece_viterbi,
    sharding,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
)
from altcredit.llm.common import utf8_bytes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def model_path() -> str:
    """The public SentencePiece model of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fold(divisor: int):
    """Remainder of the CRC-32 of the document's id as text; -1 without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor, F.lit(-1))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard.jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(documents(spark, sf_dir).select("doc_id", "text"), model_path())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.scored(docs, labels, (fold(4) != 2) & (fold(4) >= 0))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffled_shards(documents(spark, sf_dir).select("doc_id", "text"), shards=40)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return placed.select(
        F.col("row.doc_id").alias("doc_id"),
        (utf8_bytes("row.text") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.suffix_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = language_id.identified(docs, (fold(3) != 1) & (fold(3) >= 0))
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = quality.order(quality.RULES, quality.measure(docs, "text"))
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return (
        quality.cascade(quality.statistics(docs, "text"), "text", rules, stats="stats")
        .select("doc_id", "stats.*", "kept")
        .withColumn("base_failed", base_failed)
    )


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = sentencepiece_viterbi.encoded(documents(spark, sf_dir).select("doc_id", "text"), model_path(), as_model=True)
    back = sentencepiece_viterbi.decoded(ids, model_path())
    return back.select(
        "doc_id",
        utf8_bytes("text").alias("n_bytes"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.col("decoded") == F.col("text"), F.col("decoded") == "").alias("round_trip"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    drawn = importance_resampling.resampled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(documents(spark, sf_dir))
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", digest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_quality": op8_quality,
    "op9_substring": op9_substring,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
}

#: Lower case for A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_W = r"'[^\x20\x09-\x0D]+'"
_TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES: dict[str, str] = {
    "op8_quality": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM g),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM n, (VALUES (0), (1), (2)) o(k) WHERE c > 1 GROUP BY r),
s AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_W})) AS lines,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
       OR (len(lines) - len(list_distinct(lines)) >= 4 AND 10 * (len(lines) - len(list_distinct(lines))) > 3 * len(lines))
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_capitals > word_chars) AS kept
FROM s""",
    "op4_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(lower_ascii(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
        regexp_extract_all(lower_ascii(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, w[k : k + least(13, len(w)) - 1] AS win, least(13, len(w)) AS m
       FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, m, k, w[k : k + m - 1] AS win
       FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, m WHERE len(w) >= m)),
h AS (SELECT r, k, m, item FROM dw JOIN iw USING (m, win)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + m)) AS p FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)""".replace("lower_ascii(coalesce(text, ''))", _LOWER),
    "op9_substring": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
x AS (SELECT r, k, sha256(array_to_string(w[k : k + 34], ' ')) AS h
      FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, k FROM (SELECT r, k, count(*) OVER (PARTITION BY h) AS c FROM x) WHERE c > 1),
gone AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(k, k + 35)) AS p FROM rep) GROUP BY r),
kept AS (SELECT r, string_agg(t, ' ' ORDER BY p) AS kept
         FROM (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) x
         WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT r, unnest(gone) AS p FROM gone) g WHERE g.r = x.r AND g.p = x.p)
         GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)""",
    "op1_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_W}) AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT r, r AS c FROM d UNION SELECT reach.r, e.y FROM reach JOIN e ON e.x = reach.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.least AS component_id
FROM d LEFT JOIN n USING (r)
JOIN (SELECT reach.r, min(o.doc_id) AS least FROM reach JOIN d o ON o.r = reach.c GROUP BY ALL) m USING (r)""",
    "op11_importance_resampling": rf"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS w FROM documents),
dw AS (SELECT r, unnest(w) AS t FROM d),
tw AS (SELECT unnest(regexp_extract_all({_LOWER}, {_TERM})) AS t FROM benchmark),
words AS (SELECT t, hex(encode(t)) AS h FROM (SELECT t FROM dw UNION SELECT t FROM tw)),
b AS (
  SELECT t, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(h), 2), lambda k: CAST('0x' || substr(h, CAST(k + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1]))) % 10000 AS bucket
  FROM words, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN b USING (t) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM tw JOIN b USING (t) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM tw) AS t),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (total.s + 10000) / ((s.n + 1) * (total.t + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket), total),
w AS (SELECT r, CAST(floor(CAST(sum(g) AS BIGINT) / count(*)) AS BIGINT) AS weight FROM dw JOIN b USING (t) JOIN gain USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(w) AS n, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d),
scored AS (
  SELECT h.doc_id, h.n AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM h LEFT JOIN w USING (r)),
e AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
        count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS wanted FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM e""",
    "op12_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_TERM}) AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
q AS (SELECT i, t, count(*) AS times
      FROM (SELECT i, unnest(w) AS t FROM (SELECT row_number() OVER () AS i, regexp_extract_all({_LOWER}, {_TERM}) AS w FROM benchmark)) GROUP BY i, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight
      FROM (SELECT t, count(*) AS df FROM p WHERE t IN (SELECT t FROM q) GROUP BY t), c),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * c.n) // c.l AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT i, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY i, r),
k AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s JOIN m USING (r) WHERE score > 0),
n AS (SELECT row_number() OVER () AS i, item_id FROM benchmark)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN n USING (i) WHERE rank <= 10""",
    "op13_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM d""",
}
