"""The training-data queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sweeplane.llm import bpe, divergence, embed_dedup, langid, media, packing, quality, secrets, simhash, topk, toxicity, trie, warc
from sweeplane.llm.common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op1(load(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(load(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op3(load(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_encode(load(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digests=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op6(load(spark, sf_dir, "pages"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op7(load(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(load(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op11(load(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(load(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_simhash": op2_simhash,
        "op3_language": op3_language,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_quality": op5_quality,
        "op6_warc": op6_warc,
        "op7_media": op7_media,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "op11_top_k": op11_top_k,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op6_warc": warc.OP6_SQL, "op8_embedding_dedup": embed_dedup.OP8_SQL, "op11_top_k": topk.OP11_SQL}
    out |= {"op12_prefix_trie": trie.OP12_SQL, "op13_source_divergence": divergence.OP13_SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
