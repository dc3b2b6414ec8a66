from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from opinionspark.llm.minhash import near_duplicates
from opinionspark.llm.mixing import mix_sources
from opinionspark.llm.quality import quality_scores

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")


def test_stages_take_effect(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "minhash_dedup", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    documents = docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, TABLES).write.parquet(f"{tmp_path}/{name}")
        seen[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != names[-1]:
            assert docs.columns == documents.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    assert ids(seen[names[0]]) == ids(quality_scores(documents, labels).filter("predicted = 1"))
    assert ids(seen[names[1]]) == ids(near_duplicates(seen[names[0]]).filter("doc_id = class_id"))
    assert ids(seen[names[2]]) == ids(seen[names[1]])
    mix = {r.doc_id: r.taken // r["size"] for r in mix_sources(seen[names[2]]).collect() if r["size"]}
    copies = {r.doc_id: r["count"] for r in seen[names[3]].groupBy("doc_id").count().collect()}
    assert copies == {i: n for i, n in mix.items() if n}
    assert ids(seen[names[4]]) == set(copies)


def test_run_gives_the_rows_of_its_stages(spark):
    got = corpus_pipeline.run(spark, TABLES)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got.collect())
    assert places and all(a[1] + a[2] == b[1] for a, b in zip(places, places[1:]) if a[0] == b[0])


def test_registered_queries():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert names["pipeline"] is corpus_pipeline.run
