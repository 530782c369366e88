"""Passages of over 50 words that stand in two documents: op3 removes those of 400 bytes, and nothing else."""

import random

from loomtext.llm import suffixes


def test_passages_of_over_50_words_go_if_they_have_400_bytes(spark):
    r = random.Random(11)
    words = lambda n, most: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, most))) for _ in range(n))
    passages = [words(n, most) for n in (51, 52, 55, 60, 70, 90) for most in (6, 8, 12) for _ in range(2)]
    for size in (399, 400):
        passages.append(words(60, 12)[:size])
    assert all(p.count(" ") >= 50 for p in passages)
    sizes = [len(p) for p in passages]
    assert min(sizes) < 400 <= max(sizes)
    # what stands before and after differs at once, so that no more than the passage is shared
    rows = [(2 * i + k, f"{words(40 + i, 9)}{'AB'[k]}{p}{'CD'[k]}{words(30, 9)}") for i, p in enumerate(passages) for k in (0, 1)]
    clean = [(1000 + i, words(200, 9)) for i in range(20)]
    got = {x.doc_id: x.n_removed for x in suffixes.digest(spark.createDataFrame(rows + clean, "doc_id bigint, text string")).collect()}
    assert got == {d: sizes[d // 2] if sizes[d // 2] >= 400 else 0 for d, _ in rows} | {d: 0 for d, _ in clean}
