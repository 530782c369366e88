"""The levels of repeats: what a level reads, and that nothing is scanned twice for its hits."""

import random
from dataclasses import replace

from loomtext.llm import repeats, suffixes


def brute(rows, size=400):
    """Bytes removed of each document."""
    seen = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - size + 1):
            seen.setdefault(b[i : i + size], []).append((d, i))
    gone = {d: set() for d, _ in rows}
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + size))
    return {d: len(x) for d, x in gone.items()}


def test_a_level_reads_only_documents_with_a_large_key(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared, common = text(700), text(300)
    rows = [(i, text(900)) for i in range(20)] + [(20, text(300) + shared), (21, shared + text(200))]
    # a sample of many contents; two share what is around it too
    rows += [(100 + i, text(350) + common + text(350)) for i in range(40)]
    rows += [(200, "x" + rows[30][1][:-1] + "y"), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(suffixes, "BYTES", replace(suffixes.BYTES, shard=5000))
    written = {}

    def spy(df, name, write=repeats.materialize):
        out = write(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(repeats, "materialize", spy)
    got = {x.doc_id: x.n_removed for x in suffixes.digest(docs).collect()}
    assert got == brute(rows)
    # one more level at least, over documents of the common sample only
    assert len(written["keys"]) > 1 and 20 <= written["source"][0] <= 45
    # the runs of each level are written, for the hits
    assert len(written["runs"]) >= 1
