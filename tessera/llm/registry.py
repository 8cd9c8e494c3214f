"""Queries of this subpackage and their SQL, by the names that ``__spark_entry__`` registers."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import decontaminate, dense_topk, language_id, mixing, near_dedup, perplexity, pii, secrets, token_count, toxicity
from .common import table


def tokenizer_path(name: str) -> str:
    """A vocabulary file: in ``TESSERA_TOKENIZERS`` if that is set, else in ``public_tokenizers``."""
    folder = os.environ.get("TESSERA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_topk(spark, sf_dir):
    return dense_topk.dense_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op3_secrets(spark, sf_dir):
    return secrets.secret_digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark, sf_dir):
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_token_counts(spark, sf_dir):
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_pii(spark, sf_dir):
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return perplexity.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_topk, op3_secrets, op4_mixing, op5_language_id, op6_near_dedup, op7_token_counts, op8_pii, op9_quality, op10_decontamination)
}

SQL = {"op2_topk": dense_topk.SQL, "op4_mixing": mixing.SQL}
