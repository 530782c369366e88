"""The pipeline's stages against brute force, each on what the one before kept."""

from collections import Counter

import corpus_pipeline
from loomtext.llm import queries



def test_stages_and_run(spark, tmp_path):
    from loomtext.llm.contamination import contaminate, n_hit
    from loomtext.llm.mixing import mix

    words = ["north", "thing", "shall", "with", "there", "other", "water", "under", "never", "along", "house", "right"]
    text = lambda k, n: " ".join(words[(k * 7 + i * (k % 5 + 1) + i * i * k) % 12] + str((k * 31 + i * i) % 97) for i in range(n))
    rows = [(i, text(i, 60), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, rows[1][1], "en", "s1", 0), (102, "12 34 !!", "en", "s0", 0), (103, None, None, None, None), (104, "", "en", "s0", 0)]
    bench = [(1, " ".join(rows[5][1].split()[10:30]))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "shard":
            assert docs.columns == seen["language_id"].columns
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(seen["near_dedup"]) == [*range(40), 100, 101]
    assert ids(seen["decontaminate"]) == [*range(40)]
    assert ids(seen["mix_sources"]) == [i for i in range(40) if i != 5]
    assert contaminate(seen["mix_sources"], spark.read.parquet(str(tmp_path / "benchmark.parquet"))).where(n_hit() > 0).count() == 0
    taken = {r.doc_id: r.taken for r in mix(seen["mix_sources"]).collect()}
    size = Counter()
    for r in seen["shard"].collect():
        size[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == dict(size)
    counts = Counter(r.shard for r in docs.collect())
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    whole = queries.queries()["pipeline"](spark, str(tmp_path))
    assert Counter(map(tuple, whole.select("doc_id", "text", "shard").collect())) == Counter(map(tuple, docs.select("doc_id", "text", "shard").collect()))


def test_no_label_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "12"), (3, None)], "doc_id bigint, text string").selectExpr("*", "cast(null as string) as lang")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]
