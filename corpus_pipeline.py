"""A training corpus from raw documents, in five stages.

Each stage takes the documents that the one before it kept, as a table, and its decisions take effect:
rejected, repeated and contaminated documents go, repeated passages are cut out, and the last stage gives
the ids of the remaining texts. Stages carry all columns, whatever their names; rows with null ids or texts,
repeated rows and empty tables pass as the operators' descriptions say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altcredit.llm import decontamination, ngram_jaccard, quality, sentencepiece_viterbi, substring_dedup
from altcredit.llm.common import release, tables_written, written
from altcredit.llm.queries import documents, model_path


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    judged = docs.select(F.struct(*_columns(docs)).alias("row"), F.col("text").alias("text"))
    return quality.quality_rules(judged, "text").where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: the one with the smallest id, a null being last."""
    rest = F.struct(*_columns(docs.drop("text"))).alias("rest")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"), rest)
    linked = ngram_jaccard.jaccard_components(rows, "id", "text", whole=True)
    columns = [F.col("text") if c == "text" else F.col(f"row.rest.`{c}`").alias(c) for c in docs.columns]
    # Written once: both halves of the union read it.
    found = written(linked.select("id", "root", F.struct(*columns).alias("whole")), "components")
    alone = found.where("root is null").select("whole.*")
    order = F.struct(F.isnull("id"), F.col("id"))
    first = found.where("root is not null").groupBy("root").agg(F.min_by("whole", order).alias("whole"))
    return alone.unionByName(first.select("whole.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur more than once."""
    rest = docs.select(F.col("text").alias("text"), F.col("doc_id").alias("id"), F.struct(*[c for c in _columns(docs.drop("text"))]).alias("rest"))
    cut = substring_dedup.substring_dedup(rest, "id", "text", whole=True).select("kept", "n_removed", "row.rest")
    out = {c: F.col(f"rest.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[out[c].alias(c) for c in docs.columns])


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    found = decontamination.find_items(
        docs.select(key.alias("key"), F.col("text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="key"
    )
    bad = found.where(decontamination.contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("id").alias("bad")).distinct()
    packed = docs.select(F.struct(*_columns(docs)).alias("row"), key.alias("key"))
    return packed.join(bad, packed["key"].eqNullSafe(bad["bad"]), "left_anti").select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the text that they decode to."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    packed = docs.select(F.col("text").alias("text"), F.struct(*rest).alias("rest"))
    ids = sentencepiece_viterbi.encoded(packed, model_path(), as_model=True).drop("text")
    back = sentencepiece_viterbi.decoded(ids, model_path(), text="text")
    kept = [F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    return back.select(*kept, "text", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("contamination", contamination),
    ("sentencepiece", sentencepiece),
]

#: The last stage can't be written in SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage has read or left goes once its result is written."""
    docs, others = documents(spark, sf_dir), tables_written()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, *others, tables_written()[-1])
    return docs
