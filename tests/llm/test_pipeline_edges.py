"""Stages and the whole pipeline on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.near_dedup import drop_near_duplicates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def tables(spark, folder, rows, labels, benchmark):
    for name, schema, data in (("documents", DOCS, rows), ("labels", "doc_id long, quality int, toxic int", labels), ("benchmark", "item_id long, text string", benchmark)):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def corpus():
    rng = random.Random(1)
    item = sentence(rng, 30)
    rows = [(i, sentence(rng, 60), "en", f"s{i % 3}", 1) for i in range(60)]
    copy = sentence(rng, 80)
    rows += [(100, copy, "en", "s0", 1), (101, copy, "en", "s0", 1), (102, copy + " tail", None, None, None)]
    rows += [(200, f"{sentence(rng, 20)} {item} {sentence(rng, 20)}", "en", "s1", 1)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \t\n", "en", "s1", 3), (None, sentence(rng, 50), "en", "s2", 1), (303, sentence(rng, 40_000), "de", "s2", 1)]
    rows += [rows[0], (304, "x", "xx", "", 1)]
    return rows, [(1, item), (2, None), (None, ""), (3, "two words")]


def test_pipeline_keeps_clean_rows_and_drops_what_it_must(spark, tmp_path):
    rows, benchmark = corpus()
    folder = tables(spark, tmp_path, rows, [(1, 1, 0), (2, None, None), (None, 1, 1)], benchmark)
    out = corpus_pipeline.run(spark, folder)
    assert set(out.columns) >= {"doc_id", "text", "lang", "source", "shard", "slot"}
    stages = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        stages = stage(spark, stages, folder)
        assert stages.columns == DOCS.replace(" long", "").replace(" string", "").split(", "), name
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in stages.select("doc_id").collect())
    assert kept == [-1, 0, 0, *range(1, 60), 100, 300, 301, 302, 303, 304]
    sharded = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("d")).collect()
    assert all(r["n"] == r["last"] + 1 == r["d"] for r in sharded)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} <= {r["doc_id"] for r in stages.select("doc_id").collect()}


def test_pipeline_on_empty_tables(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("name", ["__gone", "__GONE_", "__bad", "__bad_text", "__id", "__text", "win", "rep", "node"])
def test_stages_stand_clashing_columns(spark, name):
    rng = random.Random(2)
    copy, item = sentence(rng, 30), sentence(rng, 12)
    df = spark.createDataFrame([(1, copy), (2, copy), (3, f"some {item} more"), (4, None)], "doc_id long, text string").withColumn(name, F.lit("mine"))
    left = drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]
    clean = drop_contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert clean.columns == df.columns and sorted((r["doc_id"], r[name]) for r in clean.collect()) == [(1, "mine"), (2, "mine"), (4, "mine")]


def test_text_ids_that_are_numbers_are_taken(spark):
    rng = random.Random(3)
    copy = sentence(rng, 30)
    df = spark.createDataFrame([("1", copy), ("2", copy)], "doc_id string, text string")
    assert [r["doc_id"] for r in drop_near_duplicates(df).collect()] == ["1"]
