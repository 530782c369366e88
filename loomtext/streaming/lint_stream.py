"""Lint of arriving documents: every detector looks at one document, so batches need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomtext.operators.lint import lint, prepared
from loomtext.operators.parse import parse
from loomtext.plans.profiles import LATIN, Profile

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def lint_stream(spark: SparkSession, path: str, out: str, checkpoint: str, profile: Profile = LATIN, trigger: dict | None = None) -> StreamingQuery:
    """Appends findings of Parquet documents that arrive at ``path`` to ``out``; a batch that is repeated
    after a failure replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        cached = prepared(parse(batch, profile), profile).persist()
        lint(cached, profile).write.mode("overwrite").parquet(f"{out}/batch={number}")
        cached.unpersist()

    stream = spark.readStream.schema(SCHEMA).parquet(path)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
