from __future__ import annotations

import collections

import corpus_pipeline
import plain
import pytest
import sentencepiece
from conftest import SF_DIR, documents
from pyspark.sql import functions as F

import __spark_entry__
from altcredit.llm.queries import model_path


def _first_of_groups(rows):
    groups, _ = plain.jaccard_groups([t for _, t in rows])
    kept = []
    for k, members in enumerate(groups):
        first = min(members, key=lambda m: (rows[m][0] is None, rows[m][0] or 0, m))
        if first == k:
            kept.append(rows[k])
    return kept


def _plain(rows, items):
    rows = [(i, t) for i, t in rows if plain.quality_kept(t)]
    rows = _first_of_groups(rows)
    cut = plain.passages_removed([t for _, t in rows])
    rows = [(i, kept if removed else t) for (i, t), (_, removed, kept) in zip(rows, cut)]
    hits = plain.item_hits([t for _, t in rows], items)
    return [(i, t) for (i, t), (n, hit, _) in zip(rows, hits) if not (hit and 20 * hit >= n)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    mine = spark.createDataFrame([(None if i is None else i + 10_000, t) for i, t in documents()], "doc_id long, text string")
    mine = mine.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("ids").alias("source"), F.length("text").cast("long").alias("n_chars"))
    every = docs.unionByName(mine).withColumn("ids", F.lit("clash")).withColumn("kept", F.col("lang"))
    every.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_matches_plain_stages(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "kept", "ids", "n_tokens"}
    found = out.collect()
    want = _plain(rows, items)
    assert 20 < len(want) < len(rows)
    assert collections.Counter((r.doc_id, r.text) for r in found) == collections.Counter((i, t.replace("▁", " ")) for i, t in want)
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert all(library.decode(r.ids) == r.text and len(r.ids) == r.n_tokens and r.n_chars == len(r.text) for r in found)


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), sf_dir)
        assert out.count() == 0
        if name != "sentencepiece":
            assert out.columns == docs.columns


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert names["pipeline"] is corpus_pipeline.run


def test_queries_with_sql_agree(spark):
    import duckdb

    names = ("op1_ngram_jaccard", "op4_decontamination", "op8_quality", "op9_substring")
    for name in (*names, "op11_importance_resampling", "op12_lexical_search", "op13_exact_dedup"):
        con = duckdb.connect()
        for table in ("documents", "benchmark"):
            con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
        got = __spark_entry__.queries()[name](spark, SF_DIR)
        want = con.execute(__spark_entry__.oracle_sql()[name])
        columns = sorted(d[0] for d in want.description)
        order = [[d[0] for d in want.description].index(c) for c in columns]
        assert sorted(got.columns) == columns
        assert sorted(map(str, (tuple(r[i] for i in order) for r in want.fetchall()))) == sorted(map(str, map(tuple, got.select(*columns).collect())))
