"""The near_dedup stage against brute force."""

import random

import corpus_pipeline
from loomtext.llm import neardup


def brute(rows):
    """Ids kept: the smallest of each class."""
    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def test_near_copies_are_dropped_and_others_kept(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 250)))) for i in range(60)]
    for i in range(60, 160):  # copies of copies with one to five words changed
        w = r.choice(rows)[1].split()
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(200, rows[3][1].upper()), (201, ""), (202, None), (203, "one"), (204, "one two three four"), (205, "One  two three four")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == brute(rows) and len(kept) < 130


def test_a_class_held_together_by_neighbours_only(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(30)]  # each shares 88 of 104 shingles with the next
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert brute(rows) == [0] and [x.doc_id for x in neardup.representatives(docs).collect()] == [0]


def test_bands_follow_similarity():
    import numpy as np

    r = np.random.default_rng(1)
    shared = 0
    for _ in range(300):
        h = r.integers(0, 1 << 64, 120, dtype=np.uint64)
        shared += bool(set(neardup.bands(h[:108])) & set(neardup.bands(h[12:])))  # 96 of 120: similarity 0.8
    assert shared == 300


def test_what_anchors_link_is_one_class(spark):
    from loomtext.llm import simhash

    rows = [(i, "row " * 300 + " ".join(f"{w}{i}" for w in "abcdefgh")) for i in range(5)]  # one fingerprint, few shingles shared
    rows += [(10, " ".join(f"w{i}" for i in range(80)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {0, 10} and brute(rows) == [0, 1, 2, 3, 4, 10]
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 10]


def test_links_of_both_kinds_join_in_one_class(spark):
    tail = [f"t{i}" for i in range(30)]
    a, b = "row " * 300 + " ".join(tail), "row " * 300 + " ".join(f"u{i}" for i in range(30))  # linked by anchors only
    c = " ".join(["row"] * 4 + tail)  # linked to the first by shingles only
    docs = spark.createDataFrame([(3, a), (2, b), (1, c)], "doc_id bigint, text string")
    assert [x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]


def moved(spark):
    """Bytes of all shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorList(False).head().totalShuffleWrite()


def test_texts_that_stay_or_have_no_like_are_not_moved(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(f"{r.getrandbits(40):x}" for _ in range(3000))) for i in range(100)]
    rows += [(200, rows[0][1]), (201, rows[1][1])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    before = moved(spark)
    kept = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect())
    assert kept == list(range(100))
    assert moved(spark) - before < sum(len(t) for _, t in rows) / 4


def test_rows_repeated_in_id_and_text_stay_once(spark):
    r = random.Random(3)
    a, b, c, d = (" ".join(f"{r.getrandbits(30):x}" for _ in range(40)) for _ in range(4))
    rows = [(1, a), (1, a), (2, b), (None, c), (None, c), (3, c), (4, d), (4, d + " more"), (4, d), (5, d), (None, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(x.doc_id, x.text) for x in neardup.representatives(docs).collect()]
    assert len(kept) == 5 and {k for k in kept if k[1] != d and k[1] != d + " more"} == {(1, a), (2, b), (None, c), (None, None)}
    assert [k[0] for k in kept].count(4) == 1
    assert neardup.representatives(docs.where("doc_id = 99")).collect() == []
