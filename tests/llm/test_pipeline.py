"""The pipeline's stages, each held to what its operator says of the stage's own input."""

import os
import re

import corpus_pipeline
from townloom.llm import decontamination, jaccard_join, quality
from townloom.session import scratch_path

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        before = docs
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        rows[name] = docs.count()
        if name == "quality":
            good = {r.doc_id for r in quality.classify_quality(before, labels).where("predicted = 1").collect()}
            assert {r.doc_id for r in docs.collect()} == good
        if name == "near_copies":
            found = jaccard_join.similarity_components(before, 5, 80).collect()
            assert sorted(r.doc_id for r in docs.collect()) == sorted({r.component_id for r in found})
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            bad = {r.doc_id for r in decontamination.contaminated(before, bench).collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - bad
        if name == "pii":
            old = {r.doc_id: r.text for r in before.collect()}
            for r in docs.collect():
                assert len(r.text) == len(old[r.doc_id]) or "." in old[r.doc_id]
                for card in re.findall(r"\+1 \(\d{3}\) 555-\d{4}", old[r.doc_id]):
                    assert card not in r.text
        if name != "packing":
            assert docs.columns == columns
    assert rows["packing"] >= rows["pii"] == rows["decontamination"] <= rows["near_copies"] <= rows["quality"]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
