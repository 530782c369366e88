"""Extra columns of any name, empty tables, null and repeated rows in the functions that return documents."""

import pytest

from loomtext.llm import langid, mixing, neardup, sharding, simhash, suffixes, urls

#: Names that the functions use themselves.
OWN = ["__id", "__h", "__n", "__key", "__m", "__b", "spans", "places", "size", "shard", "taken", "key", "band", "n", "c0"]
SCHEMA = "doc_id bigint, text string, source string, " + ", ".join(f"`{c}` string" for c in OWN)
LONG = "alpha beta gamma delta epsilon zeta " * 20
ROWS = [(1, LONG), (2, LONG), (2, LONG), (3, None), (None, None), (4, ""), (5, "one two three four five six"), (6, "one")]

FUNCTIONS = {
    "neardup": (neardup.representatives, 4),
    "simhash": (simhash.representatives, 4),
    "mixing": (mixing.mixed_documents, None),
    "sharding": (sharding.sharded_documents, len(ROWS)),
    "suffixes": (suffixes.deduplicated, len(ROWS)),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_clashing_columns_stay(spark, name):
    run, expected = FUNCTIONS[name]
    docs = spark.createDataFrame([(i, t, "s", *(f"{c}{i}" for c in OWN)) for i, t in ROWS], SCHEMA)
    out = run(docs)
    kept = [c for c in docs.columns if c != "shard"] if name == "sharding" else docs.columns
    assert out.columns == [*kept, "shard", "slot"] if name == "sharding" else out.columns == kept
    rows = out.collect()
    assert all(r["__id"] == f"__id{r.doc_id}" and r["spans"] == f"spans{r.doc_id}" and r["c0"] == f"c0{r.doc_id}" for r in rows)
    assert expected is None or len(rows) == expected
    assert run(docs.limit(0)).count() == 0


def test_language_of_repeats_long_and_foreign_texts(spark):
    words = ["the thing with the north", "der und nicht schön zwölf"]
    table = spark.createDataFrame([(i, words[i % 2] * 3, "xy"[i % 2]) for i in range(60)], "doc_id bigint, text string, lang string")
    model = langid.fit(table)
    odd = spark.createDataFrame([(1, words[0] * 30000, "clash"), (2, words[1], "clash"), (2, words[1], "clash"), (3, "日本語の文章です", "clash"), (4, "to", "clash")], "doc_id bigint, text string, language string")
    found = {r.doc_id: r.found for r in langid.identify(odd, model, out="found").collect()}
    assert (found[1].lang, found[2].lang) == ("x", "y") and found[1].gain > 1 and found[2].gain > 1
    assert found[3].gain < 0 and found[4].gain >= 0


def test_rules_beyond_the_bound_are_refused(monkeypatch):
    monkeypatch.setattr(urls, "MAX_NODES", 10)
    with pytest.raises(ValueError, match="10 nodes"):
        urls.RuleTrie([urls.UrlRule("block", f"a{i}.b", "/x") for i in range(4)])
