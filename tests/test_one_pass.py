"""Lint, the reading lane and the sweeps go from a document to its findings in one pass, with nothing kept."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.operators import calibrate, lint, morph, parse, tokens
from loomtext.plans.profiles import JA, LATIN, SWEEPS

TEXTS = {1: "rain falls on hills. " * 8, 2: "12 a. " * 900, 3: "# Summary", 4: "", 5: "the a the b the c. and so on", 6: "この事実は変化を示す。使うことができる。"}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_scan_and_nothing_cached(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    p = parse.parse(spark.read.parquet(str(tmp_path / "d")), LATIN)
    for df in (lint.lint(p), morph.reading_load(p, LATIN), calibrate.metrics(p)):
        assert plan(df).count("Relation ") == 1 and "InMemoryRelation" not in plan(df)


def test_own_morphemes_give_what_given_ones_give(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")
    for profile in (LATIN, JA):
        p = parse.parse(docs, profile)
        full = tokens.with_morphemes(p, profile)
        one = lambda df: sorted(map(str, df.collect()))
        assert one(lint.lint(p, profile)) == one(lint.lint(full, profile)) != []
        assert one(morph.reading_load(p, profile)) == one(morph.reading_load(full, profile))
        metric = calibrate.metrics(p, profile)
        assert one(metric) == one(calibrate.metrics(full, profile)) and metric.count() == len(TEXTS) * len(SWEEPS)
    assert {r.doc_id for r in lint.lint(parse.parse(docs, LATIN)).where(F.col("category") == "boilerplate_heading").collect()} == {3}


def test_tokenizer_gives_results_of_bounded_size():
    documents = [["a b"] * 40_000, [], None, ["x"], ["c d e"]] + [["w " * 1000]] * 100
    parts = list(tokens.tokenizer(LATIN)(iter([pa.array(documents, pa.list_(pa.string()))])))
    assert sum(map(len, parts)) == len(documents) and len(parts) > 3
    assert all(sum(len(s) for d in part.to_pylist()[:-1] for s in d) < tokens.WORDS for part in parts)
