"""Readers: text files, corpus trees, genre maps, baselines, embedding services."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a document, and of a baseline.
MAX_DOCUMENT, MAX_BASELINE = 20 << 20, 256 << 20


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def read_documents(spark: SparkSession, path: str, limit: int = MAX_DOCUMENT, glob: str | None = None) -> DataFrame:
    """``path, text, reason``: text null and a reason where a file is too large or no UTF-8."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    reason = F.when(F.col("length") > limit, "too large").when(~valid, "invalid UTF-8")
    return files.select("path", F.when(reason.isNull(), line_feeds(F.col("content").cast("string"))).alias("text"), reason.alias("reason"))


def read_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Documents (path, grp, text, chars) of human/aozora, human/web and ai below ``root``, and the
    skipped ones (path, reason). Blank documents are dropped silently."""
    files = read_documents(spark, root, glob="*.{txt,md}")
    grp = F.when(F.col("path").contains("/human/aozora/"), "human_aozora").when(F.col("path").contains("/human/web/"), "human_web").when(F.col("path").contains("/ai/"), "ai")
    rows = files.withColumn("grp", grp).where("grp is not null")
    good = rows.where(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    return good.select("path", "grp", "text", F.length("text").alias("chars")), rows.where("reason is not null").select("path", "reason")


def genre_map(spark: SparkSession, path: str) -> DataFrame:
    """``id, genre`` from a JSON array; elements that are no objects or lack an id are ignored, the last
    of an id wins, and text that is no JSON array gives no rows."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "array<string>", {"mode": "PERMISSIVE"})
    rows = text.select(F.posexplode(items).alias("i", "x")).select("i", F.from_json("x", "struct<id:string,genre:string>").alias("o"))
    rows = rows.select("i", "o.id", "o.genre").where("id is not null and id <> ''")
    return rows.groupBy("id").agg(F.max_by("genre", "i").alias("genre"))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Findings of an earlier report; elements without their text fields are dropped."""
    text = spark.read.text(path, wholetext=True)
    kind = "struct<findings:array<struct<line:int,category:string,excerpt:string,severity:string>>>"
    rows = text.select(F.posexplode(F.from_json("value", kind)["findings"]).alias("seq", "f")).select("seq", "f.*")
    return rows.where("category is not null and excerpt is not null")


def embed(sentences: DataFrame, client: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 64) -> DataFrame:
    """Adds ``embedding`` by calling ``client`` with at most ``batch`` texts at a time."""

    def run(texts: pa.Array) -> pa.Array:
        values, out = texts.to_pylist(), []
        for i in range(0, len(values), batch):
            part = client(values[i : i + batch])
            if len(part) != len(values[i : i + batch]) or len({len(v) for v in part}) > 1:
                raise ValueError("embeddings of unequal number or dimension")
            out += part
        return pa.array(out, pa.list_(pa.float64()))

    return sentences.withColumn("embedding", F.arrow_udf(run, "array<double>")(F.col(text)))


def http_client(endpoint: str, model: str, timeout: float = 120, limit: int = 64 << 20) -> Callable[[list[str]], list[list[float]]]:
    """Client of an embeddings endpoint; answers are put in order by their index."""

    def call(texts: list[str]) -> list[list[float]]:
        request = urllib.request.Request(endpoint, json.dumps({"model": model, "input": texts}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            body = answer.read(limit + 1)
        if len(body) > limit:
            raise ValueError("answer too large")
        rows = sorted(json.loads(body)["data"], key=lambda x: x["index"])
        if [r["index"] for r in rows] != list(range(len(texts))):
            raise ValueError("missing or repeated index")
        return [r["embedding"] for r in rows]

    return call


def batches(items: list, size: int) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]
