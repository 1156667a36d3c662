"""Exact duplicates by skew-safe combining, in built-in functions only.

Texts are equal if they are identical after every run of white space has become one space. A first
pass writes a narrow row for each document: id, digest of the normalised text, size. Digests whose
copies hold more than ``1 / HOT`` of all bytes are hot; there are at most ``HOT`` of them, whatever the
input. The second pass carries the texts:

1. each task keeps one row for each different text that it reads (map-side aggregation);
2. those rows meet by digest; the rows of a hot digest by digest and salt, the salt being the task that
   read them, modulo the square root of the number of tasks;
3. the winners of the salts are combined, one row for each text.

All three group by the digest *and* the text itself, so equal digests alone make nothing equal. Step 3
carries the texts of hot digests only, the others are complete after step 2. The documents then learn
their group from the narrow rows: by digest where a digest has a single text, else (no such digest of
SHA-256 is known) by digest and text.

Defined results: a null text counts as empty; ids may be of any type that can be ordered, a null id comes
after all others; of rows that repeat the smallest id of their group one is kept; an empty table gives an
empty result; other columns, whatever their names, don't take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altcredit.llm.common import WHITE, text_of, written

HOT = 2000
#: What a row counts for besides its text.
ROW_BYTES = 64
#: ``monotonically_increasing_id`` holds the task above this bit.
TASK_BIT = 33


def normalised(text: str) -> Column:
    return F.regexp_replace(text_of(f"`{text}`"), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, hot: int = HOT) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, digest), one for each document."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), normalised(text).alias("text")).select("id", "text", digest(F.col("text")).alias("digest"))
    number = F.monotonically_increasing_id().alias("number")
    marks = written(rows.select("id", "digest", (F.octet_length("text") + ROW_BYTES).cast("long").alias("size"), number), "marks")
    total = marks.agg(F.sum("size").alias("size"), F.max(F.shiftright("number", TASK_BIT)).alias("task")).first()
    copies = marks.groupBy("digest").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    # At most `hot` rows of a digest.
    often = F.broadcast(copies.where((F.col("n") > 1) & (F.col("size") * hot > (total["size"] or 0))).select("digest", F.lit(True).alias("hot")))
    winners = written(_winners(rows.join(often, "digest", "left"), salts=int(((total["task"] or 0) + 1) ** 0.5) + 1), "winners")
    single, several = winners.where("texts = 1"), winners.where("texts > 1").select("digest")
    found = _labelled(marks, ["digest"], single, often)
    if several.isEmpty():
        return found
    # Digests that several texts share: their rows once more, with the texts.
    number = F.monotonically_increasing_id().alias("number")
    shared = written(rows.join(several, "digest", "left_semi").select("id", "digest", "text", number), "shared")
    classes = shared.groupBy("digest", "text").agg(*_combined("id", F.lit(1)))
    return found.unionByName(_labelled(shared, ["digest", "text"], classes))


def _combined(keep: str, n: Column) -> list[Column]:
    """The smallest id, null if there is none, and the number of rows."""
    return [F.min(keep).alias("keep"), F.sum(n).cast("long").alias("n")]


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """Rows (digest, keep, n, texts): for each digest the smallest id, the number of rows and of different texts."""
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0).alias("salt")
    merged = rows.select("digest", "text", "id", "hot", salt).groupBy("digest", "salt", "hot", "text").agg(*_combined("id", F.lit(1)))
    # A text that isn't hot has one row here; a hot one has a row for each salt, compared by content again.
    content = F.when(F.col("hot"), F.col("text")).alias("text")
    texts = merged.select("digest", content, "keep", "n").groupBy("digest", "text").agg(
        *_combined("keep", F.col("n")), F.when(F.isnull("text"), F.count("*")).otherwise(1).alias("texts")
    )
    return texts.groupBy("digest").agg(*_combined("keep", F.col("n")), F.sum("texts").alias("texts"))


def _labelled(rows: DataFrame, by: list[str], classes: DataFrame, often: DataFrame | None = None) -> DataFrame:
    """The rows with what is known of their class; the classes of hot digests go to all tasks, no more than ``HOT``."""
    # The row that stays is one of those with the smallest id.
    stays = rows.groupBy(*by).agg(F.coalesce(F.min_by("number", "id"), F.min("number")).alias("stays"))
    classes = classes.join(stays, by).select(*by, F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "stays")
    out = ["id", "keep_id", "group_size", (F.col("number") == F.col("stays")).alias("kept"), "digest"]
    if often is None:
        return rows.join(classes, by).select(*out)
    hot = rows.join(often, by, "left_semi").join(F.broadcast(classes.join(often, by, "left_semi")), by).select(*out)
    return rows.join(often, by, "left_anti").join(classes, by).select(*out).unionByName(hot)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the smallest id.

    Of rows that repeat this id and the normalised text, any one stays.
    """
    stay = exact_groups(docs, key, text).where("kept").select(F.col("id").alias("stay_id"), F.col("digest").alias("stay_digest"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{key}`").alias("id"), normalised(text).alias("text")).withColumn("digest", sha256(F.col("text")))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("digest") == F.col("stay_digest")), "left_semi")
    return kept.groupBy("id", "text").agg(F.first("row").alias("row")).select("row.*")
