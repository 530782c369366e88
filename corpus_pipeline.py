"""From raw documents to shards of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import contamination, langid, mixing, neardup, sharding
from loomtext.llm.common import materialize, read_table, small_batches, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those in none of the known languages: their n-grams are less
    likely under the best mixture than drawn evenly. Several languages in one document are no fault.

    The model is learned from the labelled rows of docs. With none, only letters count.
    """
    small_batches(spark)
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = unused(docs, "__language")
    judged = langid.identify(docs, model, out=found)
    return judged.where((F.col(f"{found}.lang") != "und") & (F.col(f"{found}.gain") >= 0)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-duplicates: texts that op1's anchors
    link (fingerprints within two bits) or that share four fifths of their five-word shingles, directly or
    through others."""
    small_batches(spark)
    return neardup.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover one word in twenty or more."""
    small_batches(spark)
    benchmark = read_table(spark, sf_dir, "benchmark", ("item_id", "text"))
    hits = unused(docs, "__hits")
    judged = contamination.contaminate(docs, benchmark, out=hits)
    return judged.where(~contamination.contaminated(hits)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, drops and (one document of a source) shortens documents to the sources' targets."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: SQL cannot express the language model or the links of near-duplicates; tests/llm has a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
