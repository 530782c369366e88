"""What depends on places in the text: comments in the structural layer, fences in outlines, raw excerpts,
counts without overlap, and time that grows with the text only."""

import time

import pytest
from pyspark.sql import functions as F

from loomtext.operators import documents, lint, morph, parse, tokens
from loomtext.plans.profiles import JA, LATIN


def one(spark, text, profile=JA):
    return parse.parse(spark.createDataFrame([(1, text)], "doc_id int, text string"), profile)


def test_comments_do_not_count_as_structure(spark):
    p = one(spark, "<!-- **a** **b** **c** -->\nplain")
    assert lint.structural(p, JA).count() == 0
    assert [r.category for r in lint.structural(p, JA, raw=True).collect()] == ["high_bold_density"]
    docs = p.select("doc_id", "text")
    assert [lint.structure_stats(docs, JA, raw=raw).first().bold_spans for raw in (False, True)] == [0, 3]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("~~~\n```\n# x\n~~~\nafter", [(5, "lead", "after")]),
        ("````\n```\n# x\n````\n# y", [(5, "heading", "y")]),
        ("``` py\n# x\n``` py\n# z\n```\nafter", [(6, "lead", "after")]),
        ("---\n# x\n---\n# y", [(4, "heading", "y")]),
        ("- a\n- b\ntext", [(1, "bullets", "(箇条書き 2 項目)"), (3, "lead", "text")]),
        ("", []),
        (None, []),
    ],
)
def test_outline_fences_and_blocks(spark, text, expected):
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [tuple(r) for r in documents.outline(docs, JA).orderBy("line").select("line", "kind", "text").collect()] == expected


@pytest.mark.parametrize(
    "text, raw, shift, begin, end, expected",
    [
        ("まず               を使う", "まず`kubectl apply`を使う", 0, 13, 20, "を使う"),
        ("まず               を使う", "まず`kubectl apply`を使う", 0, 0, 2, "まず"),
        ("前半       これは", "前半`x y z`これは", 0, 5, 12, "これは"),
        ("と使う", "`x`と使う", 3, 0, 3, "と使う"),
        ("a b", "a b", 0, 1, 3, " b"),
    ],
)
def test_raw_slice(spark, text, raw, shift, begin, end, expected):
    df = spark.createDataFrame([(text, raw, shift)], "text string, raw string, shift int")
    assert df.select(morph.raw_slice(F.lit(begin), F.lit(end))).first()[0] == expected


def test_raw_offset_after_leading_code(spark):
    s = one(spark, "`x`と使う。次").first()["sentences"]
    assert [(x.text, x.raw, x.raw_offset) for x in s] == [("と使う", "`x`と使う", 3), ("次", "次", 0)]


def test_morphemes_have_places(spark):
    df = tokens.with_morphemes(one(spark, "Rain, 12 drops.", LATIN), LATIN)
    assert [(m.surface, m.pos, m.pos2, m.dict, m.begin, m.end) for m in df.first()["morphemes"][0]] == [
        ("Rain", "名詞", "固有名詞", "rain", 0, 4), (",", "補助記号", "*", ",", 4, 5), ("12", "数詞", "*", "12", 6, 8), ("drops", "名詞", "*", "drops", 9, 14),
    ]


def test_occurrences_do_not_overlap():
    assert documents.occurrences("aaaa aba", ["aa", "a", "aba", "z"]) == {"aa": 2, "a": 6, "aba": 1, "z": 0}


def seconds(run) -> float:
    run()  # compiled and started
    began = time.time()
    run()
    return time.time() - began


def test_time_grows_with_the_text_only(spark):
    """Ten times the matches on one line may take ten times as long, not a hundred."""
    for least, build in (
        (3000, lambda n: lint.translationese(one(spark, "することができる。" * n), JA)),
        (800, lambda n: documents.terms(one(spark, " ".join(f"Term{i}" for i in range(n))))),
    ):
        small, large = (seconds(lambda n=n: build(n).count()) for n in (least, 10 * least))
        assert build(10 * least).count() == 10 * least
        assert large < 12 * max(small, 1)
