"""The corpus pipeline: language ID, quality, near-duplicates, packing. Each stage works on all that the stage before
it kept; ``run`` writes each result to the shared folder and reads it again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trawlnet.llm import langid, packing, quality, simhash
from trawlnet.plans.shared import materialise
from trawlnet.plans.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but for those without letters and those of whose n-grams no learnt language holds half."""
    return langid.keep_identified(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from ``labels`` and these documents, accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return simhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("simhash_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express none of the stages whole; tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
