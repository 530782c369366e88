import json

import pytest
from pyspark.sql import functions as F

from loomtext.operators import calibrate, documents, findings, lint, morph, parse, semantic, tokens
from loomtext.plans.profiles import CATEGORIES, GENRES, JA, LATIN
from loomtext.sources import readers, sinks


def ja(spark, *texts):
    return parse.parse(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), JA)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_mask_structure_keeps_lines():
    text = "---\na: 1\n---\n# 見出し\n本文 `x = 1` です。\n- 項目\n```py\ncode\n```\n> 引用\n|a|b|\n[名](http://x)続き\n"
    assert parse.mask_lines(text) == ["", "", "", "", "本文         です。", "", "", "", "", "", "", "[名](        )続き"]


def test_fences_close_by_kind_and_length():
    assert parse.mask_lines("````\n```\nx\n`````\ny") == ["", "", "", "", "y"]
    assert parse.mask_lines("~~~\n```\nx") == ["", "", ""]


def test_comments_close_themselves():
    assert parse.mask_lines("a<!-->b\nc<!--->d\ne<!-- f\ng") == ["a     b", "c      d", "e      ", " "]


def test_sequential_and_column_masks_agree(spark):
    text = "# h\nplain [a](b) c\n- item\n1. one\n> q\n|a|b|\ntext"
    df = parse.parse(spark.createDataFrame([(1, text)], "doc_id int, text string"), LATIN)
    assert [x.masked for x in df.first()["lines"]] == parse.mask_lines(text)


def test_sentences_and_paragraphs(spark):
    df = ja(spark, "一。二。\n続き\n\n\n三！", "", None)
    assert rows(parse.sentences_table(df), "doc_id", "line", "text") == [(0, 1, "一"), (0, 1, "二"), (0, 2, "続き"), (0, 5, "三")]
    assert rows(parse.paragraphs_table(df, JA), "first_line", "text", "sentences") == [(1, "一。二。\n続き", 3), (5, "三！", 1)]


def test_raw_twin_of_masked_sentence(spark):
    df = ja(spark, "短い`code`文。次の文。")
    assert rows(parse.sentences_table(df), "text", "raw") == [("短い      文", "短い`code`文"), ("次の文", "次の文")]


def test_phrases(spark):
    found = lint.forbidden_phrases(ja(spark, "これは非常に重要です。\nこのように不可欠。\n`非常に重要`"), JA)
    assert sorted(rows(found, "line", "severity")) == [(1, "warn"), (2, "info"), (2, "info")]


@pytest.mark.parametrize("filler, severity", [(0, "critical"), (200, "info")])
def test_antithesis_severity(spark, filler, severity):
    text = "\n".join(["Aではなく、B。"] * 3 + ["普通の文。"] * filler)
    assert {r[0] for r in rows(lint.antithesis(ja(spark, text), JA), "severity")} == {severity}
    assert lint.antithesis(ja(spark, "Aではなく、B。"), JA).count() == 0


def test_uniform_sentences(spark):
    found = rows(lint.sentence_variance(ja(spark, "同じ長さの文。" * 6), JA), "excerpt")
    assert found == [("文数=6, 平均文長=6.0字, 変動係数=0.000",)]


def test_cleft_pair(spark):
    assert lint.cleft_because(ja(spark, "それは大切である。なぜなら必要だからだ。"), JA).count() == 1


def morphemes(spark, *sentences):
    fields = "surface pos pos2 dict norm reading".split()
    built = []
    for words in sentences:
        at, ms = 0, []
        for w in words:
            w = dict(zip(fields, [w, "名詞"] if isinstance(w, str) else w, strict=False))
            w = {f: w.get(f, w["surface"] if f in ("dict", "norm", "reading") else "*") for f in fields}
            ms.append((*[w[f] for f in fields], at, at + len(w["surface"])))
            at += len(w["surface"])
        built.append(ms)
    text = ["".join(m[0] for m in ms) for ms in built]
    data = [(1, [(1, t, t) for t in text], built)]
    return spark.createDataFrame(data, f"doc_id int, sentences array<struct<line:int,text:string,raw:string>>, morphemes array<array<{tokens.FIELDS}>>")


P, V = "助詞", "動詞"


def test_calque_trigram(spark):
    df = morphemes(spark, [("使う", V), "こと", ("が", P), ("できる", V)])
    assert rows(morph.translationese_morph(df), "excerpt") == [("使うことができる",)]


def test_two_morpheme_subject_matches_once(spark):
    df = morphemes(spark, [("この", "連体詞"), "事実", ("は", P), "変化", ("を", P), ("示す", V)])
    assert rows(morph.inanimate_subject_morph(df), "excerpt") == [("この事実は変化を示す",)]


def test_double_negative_but_not_obligation(spark):
    neg = lambda s: (s, "助動詞", "*", s, "ない")
    litotes = [("招か", V), neg("ない"), ("と", P), ("は", P), ("言え", V), neg("ない")]
    duty = [("行か", V), neg("なけれ"), ("ば", P), ("なら", V), neg("ない")]
    found = morph.double_negative(morph.each_sentence(morphemes(spark, litotes, duty)))
    assert rows(found, "excerpt") == [("ないとは言えない",)]


@pytest.mark.parametrize("span, yes", [("ないと動かない", True), ("なければ意味がない", True), ("なくば", True), ("ないとは言えない", False), ("ないわけではない", False)])
def test_conditional_negation(spark, span, yes):
    assert spark.range(1).select(morph.conditional_negation(F.lit(span))).first()[0] is yes


def test_noun_segment_with_brackets(spark):
    seg = ["確認", ("（", "補助記号"), ("出る", V), ("か", P), ("）", "補助記号")]
    df = morph.each_sentence(morphemes(spark, seg, ["確認", ("する", V)]))
    assert [r[0] for r in df.orderBy("i").select(morph.ends_with_noun(F.col("m"))).collect()] == [True, False]


def test_buried_list_and_no_chain(spark):
    comma = ("、", "補助記号")
    items = [w for i in range(5) for w in (f"項目{i}" * 4, comma)] + ["最後", ("を", P), ("行う", V)]
    no = ("の", P, "格助詞")
    chain = ["上限", no, "設定", no, "検討", no, "話"]
    df = morph.each_sentence(morphemes(spark, items, chain))
    assert morph.buried_list(df).count() == 1
    assert rows(morph.no_chain(df), "excerpt") == [("の設定の検討の",)]


def test_mtld():
    assert lint.mtld_of(["a", "b", "c"]) is None
    assert 0 < lint.mtld_of(["a"] * 30) <= 2


def test_mtld_counts_a_factor_at_the_threshold():
    words = ["a", "b", "c", "a"]  # the fourth word brings 3 types to 4 tokens: 0.75
    assert lint.mtld_of(words * 6, factor=0.75) == 24 / 6


def test_repeated_leads_only_lose_leading_symbols(spark):
    text = "\n".join(["「雨が降る。"] * 5 + ["雨、が降る。"] + ["API版を使う。"] * 6 + ["雨が上がる。"])
    found = lint.repeated_leads(tokens.with_tokens(ja(spark, text), JA), JA).orderBy("seq").collect()
    assert [r.line for r in found] == [1, 2, 3, 4, 5, 13, 7, 8, 9, 10, 11, 12]
    assert found[0].detail == "文頭2形態素「雨が」が6回反復（閾値6回以上）。人間の意図的な反復技法との区別がつかないため参考情報として提示。対応箇所: L1, L2, L3, L4, L5, L13"
    assert "固有名詞/技術用語由来の可能性が高い。対応箇所: L7" in found[6].detail and found[6].related_lines == [7, 8, 9, 10, 11, 12]


def test_syntax_template_keeps_inner_symbols(spark):
    comma, mark = ("、", "補助記号"), ("「", "補助記号")
    df = morphemes(spark, *[[mark, "雨", comma, ("降る", V), "日"]] * 4, *[["雨", ("が", P), ("降る", V), "日"]] * 3)
    found = morph.syntax_template(df).collect()
    assert len(found) == 4 and found[0].detail.startswith("文頭品詞4-gram「名詞/補助記号/動詞/名詞」が全文の57.1%で一致（閾値40%以上）。")


def test_rhythm_counts_mora(spark):
    texts = "。".join(["ファイル"] * 6)
    r = lint.rhythm(tokens.with_tokens(ja(spark, texts), JA), JA).first()
    assert (r["mean"], r.burstiness) == (3.0, -1.0)
    low = lint.burstiness(tokens.with_tokens(ja(spark, texts), JA), JA).first()
    assert low.excerpt == "burstiness=-1.000 (モーラ近似長 平均=3.0, 標準偏差=0.0)" and "閾値(-0.24)未満" in low.detail


def test_low_specificity_shows_the_first_line(spark):
    text = "側面 観点 重要性 可能性 存在 意味 本質 価値 意義 課題 問題 要素 要因 背景 傾向 姿勢 視点 概念 特徴 性質 状況 状態 変化 側面 観点 重要性 可能性 存在 意味 本質 価値"
    found = lint.low_specificity(ja(spark, text), JA).collect()
    assert [r.excerpt for r in found] == [text[:40]] and "抽象名詞率=1.000, 例示マーカー=なし。" in found[0].detail


def test_mora(spark):
    total = spark.createDataFrame([("キョウ",), ("ハ",)], "r string").agg(F.sum(tokens.mora(F.col("r")))).first()[0]
    assert total == 3


def test_baseline_pairs_one_to_one(spark):
    def f(*items):
        return spark.createDataFrame([(1, i, c, e, 0, 0) for i, (c, e) in enumerate(items)], "doc_id int, line int, category string, excerpt string, rank int, seq int")

    old = f(("a", "x"), ("a", "x"), ("b", "y"), ("low_burstiness", "B=-0.3"))
    new = f(("a", "x x"), ("a", " x"), ("low_burstiness", "B=-0.5"))
    counts = dict(rows(documents.compare(new, old).groupBy("status").count(), "status", "count"))
    assert counts == {"resolved": 2, "new": 1, "persisting": 2}


def test_outline_blocks(spark):
    text = "# 題 #\n前文。続き。\n- a\n  続き\n- b\n本文\n\n> 引用\n```\n# code\n```\n## 二"
    got = rows(documents.outline(spark.createDataFrame([(1, text)], "doc_id int, text string"), JA).orderBy("line"), "line", "kind", "level", "text")
    assert got == [(1, "heading", 1, "題"), (2, "lead", None, "前文。"), (3, "bullets", None, "(箇条書き 2 項目)"), (6, "lead", None, "本文"), (12, "heading", 2, "二")]


def test_terms(spark):
    df = ja(spark, "APIとは何か。<!-- SECRET -->\nクラウドのAPIを使う。")
    got = rows(documents.terms(df).orderBy("first_line", "first_off"), "term", "first_line", "count", "has_gloss_hint")
    assert got == [("API", 1, 2, True), ("クラウド", 2, 1, True)]


def test_semantic_closed_form(spark):
    vectors = [(1, i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 2.0], [0.8, 0.6]])] + [(2, 0, [1.0]), (2, 1, [1.0])]
    got = {r.doc_id: r for r in semantic.metrics(spark.createDataFrame(vectors, "doc_id int, sent_no int, embedding array<double>")).collect()}
    assert (round(got[1].adjacent_range, 9), round(got[1].adjacent_min, 9), round(got[1].other_max, 9)) == (0.6, 0.0, 0.8)
    assert got[2].adjacent_range is None


def test_sweep_and_recommend(spark):
    metric = spark.createDataFrame([("human", 0.5), ("human", 0.9), ("human", None), ("ai", 0.1), ("ai", 0.3)], "side string, x double")
    curve = calibrate.sweep(metric, [0.2, 0.4, 0.6])
    assert rows(curve, "value", "human_fp_count", "ai_detect_count") == [(0.2, 0, 1), (0.4, 0, 2), (0.6, 1, 2)]
    assert calibrate.recommend(curve).first()["value"] == 0.4
    assert len(calibrate.grid(-0.9, -0.2, 0.02)) == 36 and len(calibrate.grid(0.05, 0.6, 0.02)) == 28


def test_fire_matrix_has_all_categories(spark):
    docs = spark.createDataFrame([(1, "ai", 1000), (2, "human", 500)], "doc_id int, grp string, chars int")
    found = spark.createDataFrame([(1, "translationese")] * 2, "doc_id int, category string")
    m = {(r.category, r.grp): r for r in calibrate.fire_matrix(spark, found, docs, CATEGORIES).collect()}
    assert len(m) == 2 * 23 and m["translationese", "ai"].per_1000 == 2.0 and m["translationese", "human"].fired == 0


def test_least_effective_bin(spark):
    bins = spark.createDataFrame([(0, "ai", 4, 1), (0, "human", 4, 2), (1, "ai", 3, 3), (1, "human", 2, 1), (2, "ai", 1, 1)], "bin int, side string, total int, fired int")
    assert calibrate.least_effective_bin(bins).first()["bin"] == 1


def test_filters_and_genres(spark):
    f = spark.createDataFrame([("high_bold_density",), ("forbidden_phrase",), ("paragraph_lead_conjunction",)], "category string")
    assert findings.filtered(f).count() == 1 and findings.filtered(f, experimental=True, genre="business").count() == 2
    assert GENRES["essay"].long_sentence == 110 and GENRES[None].long_sentence == 90


def test_reports(spark):
    found = lint.forbidden_phrases(ja(spark, "総じて良い。\nまさしく。", "無し"), JA)
    files = spark.createDataFrame([(0, "a.md"), (1, "b.md")], "doc_id int, path string")
    out = {r.doc_id: json.loads(r.json) for r in sinks.lint_json(found, files).collect()}
    assert list(out[0]) == ["file", "stats", "findings"] and out[0]["stats"]["total_findings"] == 2
    assert out[1]["findings"] == [] and out[1]["stats"]["total_findings"] == 0
    assert sinks.lint_text(found).first()["text"].startswith("L1 [warn] forbidden_phrase: 総じて")


def test_readers(spark, tmp_path):
    (tmp_path / "human/web").mkdir(parents=True)
    (tmp_path / "ai").mkdir()
    (tmp_path / "human/web/business-1.md").write_bytes("甲\r\n乙".encode())
    (tmp_path / "ai/bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "ai/blank.md").write_text(" \n")
    good, skipped = readers.read_corpus(spark, str(tmp_path))
    assert rows(good, "grp", "text", "chars") == [("human_web", "甲\n乙", 3)] and [r[0] for r in rows(skipped, "reason")] == ["invalid UTF-8"]
    (tmp_path / "s.json").write_text('[{"id":"a","genre":"x"},{"id":"a","genre":"y"},{"id":""},3]')
    assert rows(readers.genre_map(spark, str(tmp_path / "s.json")), "id", "genre") == [("a", "y")]
    corpus = good.withColumn("doc_id", F.lit(1)).withColumn("genre", F.lit(None).cast("string"))
    assert sorted(r[0] for r in rows(calibrate.groups(corpus), "grp")) == ["human_business", "human_web"]


def test_stream(spark, tmp_path):
    from loomtext.streaming.lint_stream import lint_stream

    spark.createDataFrame([(1, "in the of the and. " * 4)], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    lint_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("category = 'forbidden_phrase'").count() == 2
