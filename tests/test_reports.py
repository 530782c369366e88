"""Reports: the reading lane in the JSON of a document, numbers that JSON lacks, genres of texts from the web."""

import json

from pyspark.sql import functions as F

from loomtext.operators import calibrate, lint, morph, parse, tokens
from loomtext.plans.profiles import LATIN
from loomtext.sources import sinks


def test_reading_lane_in_the_report(spark):
    texts = {1: "A " + "very " * 50 + "long one. Short one. " + "so " * 70 + "on.", 2: "Short. And short.", 3: ""}
    df = tokens.with_morphemes(parse.parse(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), LATIN), LATIN)
    lane = sinks.lane_stats(morph.too_long(morph.each_sentence(df), LATIN.params), df, "essay")
    files = spark.createDataFrame([(k, f"{k}.md") for k in texts], "doc_id int, path string")
    out = {r.doc_id: json.loads(r.json) for r in sinks.lint_json(lint.forbidden_phrases(df, LATIN), files, lane).collect()}
    assert all(list(o) == ["file", "stats", "findings", "reading_load"] for o in out.values())
    loads = {k: o["reading_load"] for k, o in out.items()}
    assert [loads[k]["stats"]["total"] for k in texts] == [2, 0, 0] and [loads[k]["stats"]["sentences"] for k in texts] == [3, 2, 0]
    assert all(list(x["stats"]) == ["total", "sentences", "genre", "by_category"] and x["stats"]["genre"] == "essay" for x in loads.values())
    assert list(loads[1]["stats"]["by_category"].values()) == [2] and loads[2]["stats"]["by_category"] == {} and loads[3]["findings"] == []
    assert len(loads[1]["findings"]) == 2


def test_numbers_without_a_json_form_are_null(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate((float("nan"), float("inf"), -float("inf"), 0.5, None))], "doc_id int, i int, x double")
    assert [r["x"] for r in json.loads(sinks.rows_json(rows, "rows", ["i"]).first()["json"])["rows"]] == [None, None, None, 0.5, None]


def test_web_texts_are_business_by_the_map(spark):
    paths = [(1, "h/a.md", "human_web"), (2, "h/business-b.md", "human_web"), (3, "h/c.x.md", "human_web"), (4, "ai/business-d.md", "ai"), (5, "ai/a.md", "ai"), (6, "a.md", "human_aozora")]
    corpus = spark.createDataFrame(paths, "doc_id int, path string, grp string")
    genres = spark.createDataFrame([("a", "business"), ("c.x", "business"), ("business-b", "tech")], "id string, genre string")
    second = calibrate.groups(corpus, genres=genres).where(F.col("grp").contains("business"))
    assert {(r.doc_id, r.grp) for r in second.collect()} == {(1, "human_business"), (3, "human_business"), (4, "ai_business")}
    assert calibrate.groups(corpus, genres=genres).count() == 9
