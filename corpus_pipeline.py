"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. Rows that share a doc_id share the verdict of the first two stages:
they stay if one would; a null doc_id is such an id too. Later stages judge each row. Long texts are
taken whole, an empty table stays empty in each stage, and documents may have further columns of
any names, which stay; only the last stage renames those that clash with the columns it adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, near_dedup, perplexity, registry, secrets
from tessera.llm.common import table, write_table


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    ids = verdicts.where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is that of trusted text of their language.

    Null and empty texts go, unless their doc_id has a row that stays.
    """
    return _kept(docs, perplexity.quality(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    Documents without words are in no group and stay, as do rows without a doc_id. Of rows that
    repeat a doc_id and a text one stays, by a hash of its other columns, so reruns agree.
    """
    left = _kept(docs, near_dedup.near_duplicates(docs, k=5, percent=80))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return left.distinct()
    one = left.groupBy("doc_id", "text").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_rest"))
    return one.select("doc_id", "text", *(F.col("_rest").getField(c).alias(c) for c in rest)).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item; null and empty texts stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced by a mark; null and empty texts stay as they are."""
    return secrets.redact(docs, registry.tokenizer_path("byte_bpe_50k.tiktoken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in order: a row for each copy that it takes, the last words of a source cut at its target.

    Null and empty texts have no words and are never taken; repeated rows queue each.
    """
    return mixing.mixed_texts(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing", mixing_stage),
]

#: The trained stages can't be written in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
