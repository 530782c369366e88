"""What stages of the pipeline send to Python at a time is bounded in bytes, however many rows that is."""

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import common

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def bounded(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 16, raising=False)
    yield spark
    spark.conf.unset(SETTING)


def largest(spark):
    def size(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([sum(len(x.as_py()) for x in b)] * len(b), pa.int64())

    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text"))
    return texts.select(F.arrow_udf(size, "bigint")("text").alias("n")).agg(F.max("n")).first()[0]


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "decontaminate"])
def test_bytes_of_a_batch(bounded, tmp_path, name):
    spark = bounded
    text = lambda k: " ".join(f"w{(i * k) % 101}" for i in range(40))
    rows = [(i, text(i + 1), "en", "s", 0) for i in range(6)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(3))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert largest(spark) == 400 * 2000
    dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert largest(spark) <= (1 << 16) + 2000


def test_a_smaller_setting_stays(bounded):
    for given, then in (("1k", "1k"), ("4m", str(1 << 16))):
        bounded.conf.set(SETTING, given)
        common.small_batches(bounded)
        assert bounded.conf.get(SETTING) == then
