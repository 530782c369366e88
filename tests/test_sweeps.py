"""Each sweep counts the documents in which its detector fires at the value: the detectors run at the value."""

from dataclasses import replace

import pytest

from loomtext.operators import calibrate, lint, parse
from loomtext.plans.profiles import LATIN, SWEEPS

#: Thresholds on the size of a text, so low that the texts here have a measure of every detector.
SMALL = replace(LATIN, params=replace(
    LATIN.params, variance_sentences=2, nominal_sentences=1, nominal_chars=10, lead_paragraphs=1, uniform_paragraphs=2, burst_sentences=3,
    autocorr_pairs=2, template_grams=2, diversity_tokens=10, diversity_chars=20, specificity_chars=10, specificity_words=2,
))
TEXTS = {
    1: "The rain falls on hills. " * 8,
    2: "not the a. not the b.\n\nnot the c. of the day.\n\nAnd then some longer words came by in summer 12. A nation.",
    3: "x",
    4: "The cat sat. The cat ran far away over the hill and the dale. The dog sat.\n\nOf all things such is the best thing. " * 3,
    5: "",
    6: "12 13 14. One two three. " + "station nation ration tion tion thing. " * 5,
    7: "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Short one. Lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega.",
}
SIDES = {1: "human", 2: "ai", 3: "ai", 4: "human", 5: "human", 6: "ai", 7: "human"}


@pytest.fixture(scope="module")
def table(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")
    return lint.prepared(parse.parse(docs, SMALL), SMALL).persist()


def test_sweeps_agree_with_the_detectors(spark, table):
    sides = spark.createDataFrame(list(SIDES.items()), "doc_id bigint, side string")
    curves = {(r.detector, r.value): r for r in calibrate.sweeps(calibrate.metrics(table, SMALL), sides).collect()}
    grids = {d: calibrate.grid(*bounds) for d, (_, _, *bounds) in SWEEPS.items()}
    assert set(curves) == {(d, v) for d, vs in grids.items() for v in vs} and len(grids) == 12
    fires, runs = set(), max(map(len, grids.values()))
    # one lint gives all detectors, each at a value of its own grid
    for i in sorted({0, 2, runs // 4, runs - 1}):
        value = {d: vs[min(i, len(vs) - 1)] for d, vs in grids.items()}
        params = {SWEEPS[d][0]: int(v) if d in ("antithesis_repetition", "repeated_sentence_lead") else v for d, v in value.items()}
        found = {(r.category, r.doc_id) for r in lint.lint(table, replace(SMALL, params=replace(SMALL.params, **params))).collect()}
        for d, v in value.items():
            n = {s: sum((d, k) in found for k in TEXTS if SIDES[k] == s) for s in ("human", "ai")}
            r = curves[d, v]
            assert (r.human_fp_count, r.ai_detect_count) == (n["human"], n["ai"]), (d, v)
            assert (r.human_fp_rate, r.ai_detect_rate) == (n["human"] / 4, n["ai"] / 3)
            fires |= {d} if sum(n.values()) else set()
    assert len(fires) >= 11


def test_an_empty_side_has_no_rate_and_no_sides_no_rows(spark, table):
    metric = calibrate.metrics(table, SMALL)
    one = calibrate.sweeps(metric, spark.createDataFrame([(1, "ai")], "doc_id bigint, side string"))
    rows = one.collect()
    assert len({r.detector for r in rows}) == 12 and {(r.human_fp_count, r.human_fp_rate) for r in rows} == {(0, None)}
    assert calibrate.sweeps(metric, spark.createDataFrame([], "doc_id bigint, side string")).count() == 0


def test_recommends_for_each_detector(spark):
    rows = [("a", 0.1, 0.0, 0.5), ("a", 0.2, 0.04, 0.5), ("a", 0.3, 0.05, 0.9), ("b", 1.0, 0.0, None), ("c", 1.0, 0.5, 1.0)]
    curve = spark.createDataFrame(rows, "detector string, value double, human_fp_rate double, ai_detect_rate double")
    assert {(r.detector, r.value) for r in calibrate.recommend(curve, by=("detector",)).collect()} == {("a", 0.1), ("b", 1.0)}
