"""The matrix and the score over all detectors, against plain counts of the findings."""

from collections import Counter

from loomtext import queries
from loomtext.plans.profiles import CATEGORIES


def test_matrix_and_score_count_every_detector(spark, tmp_path):
    texts = {1: "rain falls on hills. " * 8, 2: "not the a. not the b. not the c. of the day", 3: "x"}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    found = queries.findings_union(spark, str(tmp_path)).collect()
    side = {1: "human", 2: "ai", 3: "ai"}
    fired = Counter((c, side[d]) for d, c in {(r.doc_id, r.category) for r in found})
    got = {(r.category, r.grp): r.fired for r in queries.queries()["fire_matrix_whole"](spark, str(tmp_path)).collect()}
    assert got == {(c, g): fired[c, g] for c in CATEGORIES for g in ("human", "ai")}
    assert len({c for c, _ in fired}) > 3
    load = Counter()
    for r in found:
        load[r.doc_id] += {"critical": 8, "warn": 4}.get(r.severity, 0.5)
    scores = {r.doc_id: r.score for r in queries.queries()["naturalness_score_whole"](spark, str(tmp_path)).collect()}
    assert scores == {d: max(20.0, 100 - load[d] * 1000 / max(len(t), 1000)) if len(t) >= 100 else None for d, t in texts.items()}
