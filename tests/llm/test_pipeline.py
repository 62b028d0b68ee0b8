"""The corpus pipeline against its stages' brute-force versions, and over awkward tables."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from test_corpus_operators import brute_groups, brute_hits

from rostrum.llm import quality


def test_pipeline_equals_brute_force(spark, folder, documents):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.learn(documents, labels)
    kept = {r.doc_id: r.text for r in documents.collect()}
    good = {r.doc_id for r in quality.score(documents, model).where("predicted = 1").collect()}
    kept = {i: t for i, t in kept.items() if i in good}
    last = {}
    for i in sorted(kept):
        last[kept[i]] = i
    kept = {i: t for i, t in kept.items() if last[t] == i}
    groups = brute_groups(kept, 5, (80, 100))
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute_hits(list(kept.items()), items) if not r[5]}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == clean and len(rows) == len(clean)
    assert all(r.decoded_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_the_columns(spark, folder, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontaminate", "tokens"]
    some = documents.where("doc_id < 60").withColumn("text", F.when(F.col("doc_id") != 7, F.col("text")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, some, folder).columns == documents.columns


def test_stages_take_awkward_and_empty_tables(spark, folder, awkward, empty):
    for docs in (awkward, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, folder).count() <= docs.count()
