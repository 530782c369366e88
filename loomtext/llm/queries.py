"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import contamination, langid, mixing, pii, quality, sharding, simhash, substrings, suffixes, urls
from loomtext.llm.common import read_table
from loomtext.llm.sql import SQL

URL_RULES = (
    urls.UrlRule("allow", "org", "/"),
    urls.UrlRule("block", "example.org", "/es/"),
    urls.UrlRule("block", "example.org", "/en/1"),
    urls.UrlRule("allow", "com", "/fr/"),
    urls.UrlRule("block", "com", "/de/"),
)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", ("doc_id", "text"))).select("doc_id", "fingerprint", "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ("doc_id", "text"))
    return contamination.digest(contamination.contaminate(docs, read_table(spark, sf_dir, "benchmark", ("item_id", "text"))))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(read_table(spark, sf_dir, "documents", ("doc_id", "text")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read_table(spark, sf_dir, "pages", ("page_id", "url")), URL_RULES)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(read_table(spark, sf_dir, "documents", ("doc_id", "text")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents", ("doc_id", "text"))).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ("doc_id", "text", "source"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(read_table(spark, sf_dir, "documents", ("doc_id", "text"))))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ("doc_id", "text", "lang"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.fit(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model).select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents", ("doc_id", "text")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_decontaminate, op3_suffix_array, op4_url_filter, op5_substring_dedup, op6_sharding, op7_mixing, op8_pii, op9_language_id, op10_quality, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
