"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trawlnet.llm import bpe, langid, licenses, media, packing, quality, rules, simhash, urlfilter, wrapper
from trawlnet.plans.spread import spread
from trawlnet.plans.tables import table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, dealt over all cores if it is small and in few files."""
    return spread(table(spark, sf_dir, name))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_digest(_table(spark, sf_dir, "pages"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urlfilter.train(urlfilter.labelled_urls())
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), urlfilter.RULES, model)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_byte_bpe,
        op3_simhash_dedup,
        op4_html_extraction,
        op5_media_columns,
        op6_language_id,
        op7_license_scan,
        op8_url_filter,
        op9_best_fit_packing,
        op10_quality_rules,
    )
}
#: SQL can't express any of these whole; their tests hold them against brute force, round trips or held-out rows.
ORACLES: dict[str, str] = {}
