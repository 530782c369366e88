"""The findings table has the rows of all detectors."""

from pyspark.sql import functions as F

from loomtext.operators import lint, morph, parse, tokens
from loomtext.plans.profiles import CATEGORIES, JA, LATIN

MORPH = {"nominal_ending", "translationese_morph", "inanimate_subject_morph", "repeated_syntax_template"}


def test_lint_has_the_morpheme_detectors(spark):
    docs = spark.createDataFrame([(1, "rain falls on hills. " * 8), (2, "12 a. " * 900)], "doc_id int, text string")
    p = parse.parse(docs, LATIN)
    m = tokens.with_morphemes(p, LATIN)
    one = lambda df: sorted(map(str, df.collect()))
    found = lint.lint(p, LATIN).where(F.col("category").isin(*MORPH))
    parts = [morph.nominal_ending(m, LATIN.params), morph.translationese_morph(m), morph.inanimate_subject_morph(m), morph.syntax_template(m, LATIN.params)]
    assert one(found) == sorted(x for d in parts for x in one(d))
    assert {r.category for r in found.collect()} >= {"repeated_syntax_template"}


def test_lint_takes_given_morphemes(spark):
    p = parse.parse(spark.createDataFrame([(1, "使うことができる。")], "doc_id int, text string"), JA)
    rows = [[(s, pos, "*", s, s, s, b, b + len(s)) for s, pos, b in (("使う", "動詞", 0), ("こと", "名詞", 2), ("が", "助詞", 4), ("できる", "動詞", 5))]]
    given = spark.createDataFrame([(1, rows)], f"doc_id int, morphemes array<array<{tokens.FIELDS}>>")
    found = {r.category for r in lint.lint(p.join(given, "doc_id"), JA).collect()}
    assert "translationese_morph" in found and found <= set(CATEGORIES)
