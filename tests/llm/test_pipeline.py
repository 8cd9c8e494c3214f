"""The corpus pipeline, each stage against what its operator says of the stage's input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tessera.llm import decontaminate, near_dedup, perplexity, secrets
from tessera.llm.common import table, write_table
from tessera.llm.registry import tokenizer_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = [docs]
    for name, stage in p.STAGES:
        seen.append(write_table(stage(spark, seen[-1], SF), "test"))
        assert set(columns) <= set(seen[-1].columns)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] == {r["doc_id"] for r in perplexity.quality(docs, table(spark, SF, "labels")).where("kept").collect()}
    assert ids[2] == {r["component_id"] for r in near_dedup.near_duplicates(seen[1]).collect()}
    assert ids[3] == ids[2] - {r["doc_id"] for r in decontaminate.contaminated(seen[2], table(spark, SF, "benchmark")).collect()}
    assert ids[4] == ids[3]
    found = secrets.secret_digest(seen[4], tokenizer_path("byte_bpe_50k.tiktoken"))
    assert found.where("spans <> ''").count() == 0
    last = seen[5]
    assert last.where("taken <= 0 or taken > 2 * size").count() == 0
    spread = last.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).where(F.abs(F.col("t") - F.col("g")) > 1)
    assert spread.count() == 0


def test_run_bears_null_and_repeated_ids(spark, tmp_path):
    docs = table(spark, SF, "documents").limit(60)
    n = F.pmod(F.xxhash64("text"), F.lit(3))
    docs = docs.withColumn("doc_id", F.when(n == 0, F.lit(None)).when(n == 1, F.lit(7)).otherwise(F.col("doc_id")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = p.run(spark, str(tmp_path)).collect()
    assert any(r["doc_id"] is None for r in rows) and sum(r["doc_id"] == 7 for r in rows) > 1
    whole = [r for r in rows if r["taken"] == r["size"]]
    assert len({(r["doc_id"], r["text"], r["copy"]) for r in whole}) == len(whole)
    taken, target = {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == len(r["text"].split()) and 0 < r["taken"] <= r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
