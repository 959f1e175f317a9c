"""A training corpus from the documents table, in stages that are each written and read again.

Every stage works on all that the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplane.llm import langid, packing, secrets, simhash, toxicity
from sweeplane.llm.common import load, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those rejected (no letter, or far from every centroid) go."""
    return langid.keep_identified(docs, langid.fit_languages(docs, langid.learn_rows()))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold of toxicity."""
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, load(spark, sf_dir, "labels"), toxicity.learn_rows))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id."""
    return simhash.keep_one(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked; n_chars follows the text."""
    found = secrets.scan_secrets(docs, F.concat_ws("/", F.col("source"), F.col("lang")), F.col("source"))
    masked = secrets.redact(docs, found)
    changed = F.contains(F.col("text"), F.lit(secrets.MASK))
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("simhash", near_duplicates),
    ("secrets", secret_spans),
    ("packing", pack),
]

#: SQL has neither the models nor the tokenizer; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a written table."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
