"""The pipeline's stages, each against plain Python over its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decision_list, mixing
from tests.conftest import SMALL

SPACE = re.compile(r"[\x20\x09-\x0D]")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        path = str(tmp_path / name)
        out.write.parquet(path)
        after = spark.read.parquet(path)
        ids = {r[0] for r in after.select("doc_id").collect()}
        before = docs.collect()
        if name == "quality_rules":
            labels = spark.read.parquet(f"{SMALL}/labels.parquet")
            assert ids == {r["doc_id"] for r in decision_list.judge_documents(docs, labels).where("kept").collect()}
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best.setdefault(SPACE.sub("", r["text"]), []).append((-len(r["text"]), r["doc_id"]))
            assert ids == {min(v)[1] for v in best.values()}
        elif name == "near_dedup":
            from tests.llm.test_operators import brute_components

            assert ids == {c for _, _, c in brute_components(before, 5, 80)}
        elif name == "mix_sources":
            assert ids == {r["doc_id"] for r in mixing.mix_documents(docs, keep_share=0.8).where("sampled").collect()}
        else:
            assert ids == {r["doc_id"] for r in before}
        if name != "pack":
            assert after.columns == columns
            docs = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack"]


def test_run_ends_in_full_sequences(spark):
    out = corpus_pipeline.run(spark, SMALL)
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("s"))
    assert sums.where("s > 1024").isEmpty() and out.count() > 0
