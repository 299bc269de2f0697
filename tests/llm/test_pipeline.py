"""Each stage of the pipeline against what its operator decides, on the smallest tables."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerforge.llm import language_id, ngram_join, toxicity
from ledgerforge.llm.common import read_table


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, found = read_table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        found[name] = (docs, docs := spark.read.parquet(path))
    return found


def test_stages_keep_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert 0 < after.count() <= before.count()


def test_toxic_documents_go(stages, spark, sf):
    before, after = stages["toxicity"]
    labels = read_table(spark, sf, "labels")
    scores = toxicity.toxicity(before, labels)
    expected = {r["doc_id"] for r in scores.filter("score < 0.5").collect()}
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == expected


def test_languages_stay(stages):
    before, after = stages["language_id"]
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    letters = {r["doc_id"] for r in before.filter(F.col("text").rlike(r"\p{L}{3}")).select("doc_id").collect()}
    assert len(letters - kept) <= 0.02 * len(letters)
    model = language_id.learn(before)
    und = {r["doc_id"] for r in language_id.identify(before, model).filter("lang_pred = 'und'").collect()}
    assert not und & kept


def test_lines_are_kept_once(stages):
    _, after = stages["line_dedup"]
    lines = [line for r in after.collect() for line in (r["text"] or "").split("\n") if len(line) >= 20]
    assert len(lines) == len(set(lines))
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_one_of_each_group_stays(stages):
    before, after = stages["ngram_join"]
    groups = ngram_join.ngram_components(before).filter("n_shingles > 0").collect()
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    for r in groups:
        assert (r["doc_id"] in kept) == (r["doc_id"] == r["component_id"])


def test_everything_left_is_packed(stages):
    before, after = stages["packing"]
    assert {r["doc_id"] for r in before.select("doc_id").collect()} == {r["doc_id"] for r in after.select("doc_id").collect()}
    sizes = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).collect()
    assert all(r["n"] == r["m"] <= 2048 for r in sizes)


def test_fold_matches_crc(spark):
    rows = spark.range(50).withColumn("fold", language_id.fold_of("id")).collect()
    assert all(r["fold"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)
