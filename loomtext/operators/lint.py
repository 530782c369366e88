"""Lint detectors: each takes parsed documents and gives findings. None shuffles."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import WS, blank, cut, fixed, int_list, mean, percent, pstdev, strip
from loomtext.operators import morph
from loomtext.operators.findings import Parts, capped, detector, emit, finding, gathered, grouped, one_if, related_text
from loomtext.operators.parse import HEADING, LIST_ITEM, keep, mask_comments, piece_count
from loomtext.operators.tokens import mora, morphemes_of, part_of_speech, with_morphemes, with_parts_of_speech, with_tokens
from loomtext.plans.profiles import LATIN, Profile


def line_of(text: Column, pattern: str) -> Column:
    """Line of the first match."""
    before = F.get(F.split(text, pattern, 2), F.lit(0))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


@detector
def forbidden_phrases(parsed: DataFrame, profile: Profile = LATIN) -> Parts:
    """Each phrase once a line, at its first place."""
    phrases = F.array(*[F.lit(p) for p in profile.forbidden])
    weak = lambda p: p.isin(*profile.weak) if profile.weak else F.lit(False)

    def of_line(x: Column) -> Column:
        hits = F.filter(phrases, lambda p: F.instr(x["masked"], p) > 0)
        return F.transform(
            hits,
            lambda p, i: finding(
                x["line"],
                strip(cut(x["raw"], F.instr(x["masked"], p) - 11, F.instr(x["masked"], p) - 1 + F.length(p) + 10)),
                F.concat(F.lit("禁止語/LLM常套句ヒット: 「"), p, F.lit("」"), F.when(weak(p), "（コーパス校正で人間側にも一定数出現する弱いシグナルと判定、severity低下）").otherwise("")),
                F.when(weak(p), "info").otherwise("warn"),
                seq=F.array_position(phrases, p),
            ),
        )

    some = F.filter("lines", lambda x: x["masked"].rlike("|".join(map(_quoted, profile.forbidden))))
    return keep(parsed, "__x", some), [("forbidden_phrase", 2, F.flatten(F.transform("__x", of_line)))]


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in s)


_HITS = pa.list_(pa.struct([("line", pa.int32()), ("excerpt", pa.string()), ("pattern", pa.string()), ("seq", pa.int32())]))


def pattern_finder(patterns: tuple[str, ...], around: int) -> Callable[[pa.Array], pa.Array]:
    """Matches need their places in the line for the excerpt of the raw text. Cut by column functions, each
    would be sought from the start of the line; here a line is passed once for each pattern."""
    compiled = [re.compile(p) for p in patterns]

    def of_line(x: dict) -> list[dict]:
        line, masked, raw = x["line"], x["masked"], x["raw"]
        return [
            {"line": line, "excerpt": raw[max(0, m.start() - around) : m.end() + around], "pattern": p.pattern, "seq": i + 1000 * k}
            for k, p in enumerate(compiled)
            for i, m in enumerate(p.finditer(masked))
        ]

    return lambda documents: pa.array([[h for x in lines.as_py() for h in of_line(x)] for lines in documents], _HITS)


def pattern_hits(parsed: DataFrame, patterns: tuple[str, ...], around: int) -> Column:
    """Array of (line, excerpt, pattern, number of it) in the order line, pattern, place. Only lines with a
    match leave the JVM."""
    some = F.filter("lines", lambda x: x["masked"].rlike("|".join(f"(?:{p})" for p in patterns)))
    found = F.arrow_udf(pattern_finder(patterns, around), "array<struct<line int, excerpt string, pattern string, seq int>>")
    return found(some)


def searched(parsed: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Adds the matches of the three detectors that need their places, and the measures of diversity, so that
    one worker finds them in one pass. ``parsed`` has tokens."""
    df, columns = diversity_columns(parsed, profile)
    return df.select(
        *parsed.columns, *[c.alias(f"diversity_{name}") for c, name in zip(columns, DIVERSITY, strict=True)], pattern_hits(parsed, profile.translationese, 10).alias("translationese_hits"),
        pattern_hits(parsed, profile.antithesis, 0).alias("antithesis_hits"), pattern_hits(parsed, profile.inanimate, 0).alias("inanimate_hits"),
    )


def hits_of(parsed: DataFrame, name: str, patterns: tuple[str, ...], around: int) -> Column:
    """The matches that :func:`searched` has found; else found now."""
    return F.col(f"{name}_hits") if f"{name}_hits" in parsed.columns else pattern_hits(parsed, patterns, around)


@detector
def translationese(parsed: DataFrame, profile: Profile = LATIN) -> Parts:
    df = keep(parsed, "__h", hits_of(parsed, "translationese", profile.translationese, 10))
    detail = lambda h: F.concat(F.lit("翻訳調パターン: /"), h["pattern"], F.lit("/ に一致"))
    return df, [("translationese", 3, F.transform("__h", lambda h: finding(h["line"], strip(h["excerpt"]), detail(h), "info", seq=h["seq"])))]


@detector
def antithesis(parsed: DataFrame, profile: Profile = LATIN) -> Parts:
    """All hits of a document that has enough of them; the severity follows hits by sentences."""
    p = profile.params
    df = keep(parsed, "__h", hits_of(parsed, "antithesis", profile.antithesis, 0))
    ratio = F.when(F.size("sentences") > 0, F.size("__h") / F.size("sentences")).otherwise(0.0)
    severity = F.when(ratio < p.antithesis_info_below, "info").when(ratio >= p.antithesis_critical_from, "critical").otherwise("warn")
    lines = F.transform("__h", lambda h: h["line"])
    df = keep(df, "__d", F.concat(
        F.lit("否定→肯定対比パターンが文書内で"), F.size("__h").cast("string"), F.lit(f"回検出（閾値{p.antithesis_hits}回以上、総文数に対する比率="),
        percent(ratio, 1), F.lit("）。"), related_text(lines),
    ))
    df = keep(df, "__r", capped(lines))
    found = F.when(
        F.size("__h") >= p.antithesis_hits, F.transform("__h", lambda h: finding(h["line"], strip(h["excerpt"]), F.col("__d"), severity, F.col("__r"), h["seq"]))
    )
    return df, [("antithesis_repetition", 4, found)]


def sentence_lengths(parsed: DataFrame, profile: Profile = LATIN) -> tuple[DataFrame, Column]:
    """Lengths of sentences in ``__n``, and how much these vary; null if there are not enough."""
    enough = F.size("sentences") >= profile.params.variance_sentences
    df = keep(parsed, "__n", F.when(enough, F.transform("sentences", lambda s: F.length(s["text"]))))
    return df, pstdev(F.col("__n")) / mean(F.col("__n"))


@detector
def sentence_variance(parsed: DataFrame, profile: Profile = LATIN) -> Parts:
    p = profile.params
    df, cv = sentence_lengths(parsed, profile)
    excerpt = F.concat(F.lit("文数="), F.size("__n").cast("string"), F.lit(", 平均文長="), fixed(mean(F.col("__n")), 1), F.lit("字, 変動係数="), fixed(cv, 3))
    detail = F.lit(f"文長の変動係数が閾値({p.variance_cv})未満。リズムが均質でAI臭い可能性")
    return df, [("low_sentence_variance", 5, one_if(cv < p.variance_cv, finding(F.get("sentences", F.lit(0))["line"], excerpt, detail, "warn")))]


@detector
def inanimate_subject(parsed: DataFrame, profile: Profile = LATIN) -> Parts:
    df = keep(parsed, "__h", hits_of(parsed, "inanimate", profile.inanimate, 0))
    detail = F.lit("無生物主語+他動詞的述語（表層パターン、英語統語の直訳調の可能性、要人間判断）")
    return df, [("english_syntax_inanimate_subject", 6, F.transform("__h", lambda h: finding(h["line"], h["excerpt"], detail, "info", seq=h["seq"])))]


@detector
def cleft_because(parsed: DataFrame, profile: Profile = LATIN) -> Parts:
    """A sentence of the first form followed by one of the second, over lines and paragraphs."""
    n = F.size("sentences")
    pairs = F.filter(
        F.transform("sentences", lambda s, i: F.struct(s.alias("a"), F.get("sentences", i + 1).alias("b"), i.alias("i"))),
        lambda p: (p["i"] + 1 < n) & p["a"]["text"].rlike("(?d)" + profile.cleft[0].replace("$", "\\z")) & p["b"]["text"].rlike(profile.cleft[1]),
    )
    detail = F.lit("「それは〜である。なぜなら〜だ」型の強調構文（英語 It is ... because ... の直訳調）")
    found = F.transform(pairs, lambda p: finding(p["a"]["line"], F.concat(p["a"]["raw"], F.lit("。"), p["b"]["raw"]), detail, "warn", seq=p["i"] + 100000))
    return parsed, [("english_syntax_cleft_because", 6, found)]


def led_paragraphs(parsed: DataFrame, profile: Profile = LATIN) -> tuple[DataFrame, Column]:
    """``__h``, the paragraphs that a conjunction leads, and their share."""
    words = F.array(*[F.lit(c) for c in profile.conjunctions])
    hits = F.transform("paragraphs", lambda x: F.struct(x["first"].alias("line"), strip(F.get(F.split(x["text"], "\n", 2), F.lit(0))).alias("text")))
    hits = F.transform(hits, lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text"), F.get(F.filter(words, lambda w: x["text"].startswith(w)), F.lit(0)).alias("word")))
    df = keep(parsed, "__h", F.filter(hits, lambda x: x["word"].isNotNull()))
    return df, F.size("__h") / F.greatest(F.size("paragraphs"), F.lit(1))


@detector
def paragraph_leads(parsed: DataFrame, profile: Profile = LATIN) -> Parts:
    p = profile.params
    df, ratio = led_paragraphs(parsed, profile)
    lines = F.transform("__h", lambda h: h["line"])
    df = keep(df, "__d", F.concat(F.lit("」で始まる（文書全体の段落頭接続詞率="), percent(ratio, 1), F.lit(f"、閾値{p.lead_ratio * 100:.0f}%以上で警告）。"), related_text(lines)))
    df = keep(df, "__r", capped(lines))
    raw = lambda h: F.get("lines", h["line"] - 1)["raw"]
    found = F.when(
        (F.size("paragraphs") >= p.lead_paragraphs) & (ratio >= p.lead_ratio),
        F.transform("__h", lambda h: finding(h["line"], F.substr(raw(h), F.lit(1), F.lit(40)), F.concat(F.lit("段落頭が接続詞「"), h["word"], F.col("__d")), "info", F.col("__r"))),
    )
    return df, [("paragraph_lead_conjunction", 7, found)]


def paragraph_sizes(parsed: DataFrame, profile: Profile = LATIN) -> tuple[DataFrame, Column]:
    """Sentences of each paragraph in ``__n``, and how much these vary; null if there are not enough paragraphs."""
    enough = F.size("paragraphs") >= profile.params.uniform_paragraphs
    df = keep(parsed, "__n", F.when(enough, F.transform("paragraphs", lambda x: piece_count(x["text"], profile))))
    m = mean(F.col("__n"))
    return df, F.when(m == 0, 0.0).otherwise(pstdev(F.col("__n")) / F.when(m != 0, m))


@detector
def uniform_paragraphs(parsed: DataFrame, profile: Profile = LATIN) -> Parts:
    p = profile.params
    df, cv = paragraph_sizes(parsed, profile)
    excerpt = F.concat(F.lit("段落数="), F.size("__n").cast("string"), F.lit(", 各段落の文数="), int_list(F.col("__n")))
    detail = F.concat(F.lit("段落あたり文数の変動係数="), fixed(cv, 3), F.lit(f"（閾値{p.uniform_cv}未満）。どの段落もほぼ同じ文数=定型段落（例: 3文段落の量産）の疑い"))
    return df, [("uniform_paragraph_structure", 7, one_if(cv < p.uniform_cv, finding(F.lit(1), excerpt, detail, "info", seq=F.lit(1))))]


def structure_text(text: str, raw: bool) -> Column:
    return F.col(text) if raw else mask_comments(F.col(text))


def structure_stats(docs: DataFrame, profile: Profile = LATIN, text: str = "text", raw: bool = False) -> DataFrame:
    """Counts of bold spans, bullets, boilerplate headings, numbered phases and symbols of each text.

    Sees text with only comments masked, so lines in code count too; ``raw`` leaves comments in, as
    calibration wants it.
    """
    docs = keep(docs, "__s", structure_text(text, raw))
    t = F.col("__s")
    lines = F.split(F.regexp_replace(t, "\n\\z", ""), "\n", -1)
    df = keep(docs, "__l", F.filter(lines, lambda x: ~blank(x)))
    body = lambda x: F.lower(strip(F.regexp_replace(x, HEADING, "")))
    boiler = "^(?:" + "|".join(profile.boilerplate) + ")"
    chars = F.greatest(F.length(t), F.lit(1))
    bold, emoji = F.regexp_count(t, F.lit(r"\*\*[^*\n]+\*\*")), F.regexp_count(t, F.lit(profile.emoji))
    return df.select(
        "doc_id",
        F.length(t).alias("chars"),
        bold.alias("bold_spans"),
        (bold / chars * 1000).alias("bold_per_1000"),
        F.size(F.filter("__l", lambda x: x.rlike(LIST_ITEM))).alias("bullet_lines"),
        F.size("__l").alias("nonblank_lines"),
        F.size(F.filter("__l", lambda x: x.rlike(HEADING) & body(x).rlike(boiler))).alias("boilerplate_headings"),
        F.regexp_count(t, F.lit(profile.phase.format(ws=WS))).alias("phases"),
        emoji.alias("symbols"),
        (emoji / chars * 1000).alias("symbols_per_1000"),
    )


@detector
def structural(parsed: DataFrame, profile: Profile = LATIN, text: str = "text", raw: bool = False) -> Parts:
    """The five detectors of Markdown structure, on text with comments masked unless ``raw``."""
    t = F.col("__s")
    df = keep(parsed, "__s", structure_text(text, raw))
    df = keep(df, "__all", F.transform(F.split(F.regexp_replace(t, "\n\\z", ""), "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))))
    chars = F.greatest(F.length(t), F.lit(1))
    bold_re, phase_re = r"\*\*[^*\n]+\*\*", profile.phase.format(ws=WS)

    def density(name: str, rank: int, pattern: str, least: float, what: str, why: str) -> tuple[str, int, Column]:
        n = F.regexp_count(t, F.lit(pattern))
        per = n / chars * 1000
        excerpt = F.concat(F.lit(what), n.cast("string"), F.lit("箇所（1000字あたり"), fixed(per, 2), F.lit("）"))
        return (name, 1, one_if((n >= 3) & (per >= least), finding(line_of(t, pattern), excerpt, F.lit(why), "info", seq=F.lit(rank))))

    bullets = F.filter("__all", lambda x: x["text"].rlike(LIST_ITEM))
    df = keep(df, "__b", F.transform(bullets, lambda x: x["line"]))
    n = F.size(F.filter("__all", lambda x: ~blank(x["text"])))
    ratio = F.size("__b") / F.greatest(n, F.lit(1))
    bullet = ("high_bullet_ratio", 1, one_if((n >= 10) & (ratio >= 0.35), finding(
        F.get("__b", F.lit(0)), F.concat(F.lit("箇条書き行"), F.size("__b").cast("string"), F.lit("/"), n.cast("string"), F.lit("行（"), percent(ratio, 1), F.lit("）")),
        F.lit("箇条書き行の比率が閾値35%以上。文章より箇条書きに頼る構成は教科書的なAI生成文に見られる傾向（実験的検出器）"), "info",
        F.when(F.size("__b") > 1, capped(F.col("__b"))), F.lit(2),
    )))
    words = F.array(*[F.lit(w) for w in profile.boilerplate])
    body = lambda x: F.lower(strip(F.regexp_replace(x["text"], HEADING, "")))
    heads = F.filter("__all", lambda x: x["text"].rlike(HEADING) & body(x).rlike("^(?:" + "|".join(profile.boilerplate) + ")"))
    boiler = ("boilerplate_heading", 1, F.transform(heads, lambda x: finding(
        x["line"], F.substr(strip(x["text"]), F.lit(1), F.lit(40)),
        F.concat(F.lit("定型見出し「"), F.get(F.filter(words, lambda w: body(x).startswith(w)), F.lit(0)), F.lit("」系での締め。予告・構成の型のみで中身を語らない教科書的なAI生成文に見られる傾向（実験的検出器）")),
        "info", seq=F.lit(3),
    )))
    k = F.regexp_count(t, F.lit(phase_re))
    phase = ("numbered_phase_structure", 1, one_if(k >= 3, finding(
        line_of(t, phase_re), F.concat(F.lit("番号付きフェーズ表現が"), k.cast("string"), F.lit("回出現")),
        F.lit("「フェーズ/ステップ/段階+番号」の表現が閾値3回以上。機械的な段階分割は教科書的なAI生成文に見られる傾向（実験的検出器）"), "info", seq=F.lit(4),
    )))
    return df, [
        density("high_bold_density", 1, bold_re, 3.0, "太字スパン", "太字（**...**）の使用密度が閾値（1000字あたり3.0）以上。強調の多用は教科書的なAI生成文に見られる傾向（実験的検出器、閾値は暫定）"),
        bullet, boiler, phase,
        density("high_emoji_symbol_density", 5, profile.emoji, 2.0, "絵文字/装飾記号", "絵文字・装飾記号の使用密度が閾値（1000字あたり2.0）以上（実験的検出器、閾値は暫定）"),
    ]


def rhythm(tokenized: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """``doc_id``, n, mean, stdev, burstiness, autocorr, first_line: lengths of sentences in tokens' code
    points, small kana within a token aside. No row under the least number of sentences; autocorr null if a
    side does not vary."""
    df, columns = rhythm_columns(tokenized, profile)
    return df.where("__x is not null").select("doc_id", *columns)


def rhythm_columns(tokenized: DataFrame, profile: Profile = LATIN) -> tuple[DataFrame, list[Column]]:
    """The columns of :func:`rhythm`, null under the least number of sentences."""
    p = profile.params
    length = mora if profile.name == "ja" else F.length
    lengths = F.transform("tokens", lambda t: F.aggregate(t, F.lit(0), lambda a, w: a + length(w)))
    df = keep(tokenized, "__x", F.when(F.size("tokens") >= p.burst_sentences, lengths))
    n, m, sd = F.size("__x"), mean(F.col("__x")), pstdev(F.col("__x"))
    df = keep(df, "__a", F.slice("__x", F.lit(1), n - 1))
    df = keep(df, "__b", F.slice("__x", F.lit(2), n - 1))
    k = F.size("__a").cast("bigint")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, v: s + v)
    cross = total(F.zip_with("__a", "__b", lambda a, b: a.cast("bigint") * b))
    sa, sb = pstdev(F.col("__a")), pstdev(F.col("__b"))
    cov = (k * cross - total("__a") * total("__b")).cast("double") / (k * k)
    corr = F.when((k >= p.autocorr_pairs) & (sa > 0) & (sb > 0), cov / F.nullif(sa * sb, F.lit(0.0)))
    return df, [
        n.alias("n"), m.alias("mean"), sd.alias("stdev"), F.when(sd + m == 0, 0.0).otherwise((sd - m) / F.nullif(sd + m, F.lit(0.0))).alias("burstiness"),
        corr.alias("autocorr"), F.get("sentences", F.lit(0))["line"].alias("first_line"),
    ]


@detector
def burstiness(tokenized: DataFrame, profile: Profile = LATIN) -> Parts:
    p = profile.params
    df, columns = rhythm_columns(tokenized, profile)
    df = keep(df, "__rhythm", F.struct(*columns))
    of = lambda name: F.col("__rhythm")[name]
    excerpt = F.concat(F.lit("burstiness="), fixed(of("burstiness"), 3), F.lit(" (モーラ近似長 平均="), fixed(of("mean"), 1), F.lit(", 標準偏差="), fixed(of("stdev"), 1), F.lit(")"))
    low = ("low_burstiness", 10, one_if(of("burstiness") < p.burst, finding(
        of("first_line"), excerpt, F.lit(f"burstiness が閾値({p.burst})未満。文の長短のメリハリが乏しく機械的なリズムの疑い"), "warn")))
    high = ("high_length_autocorrelation", 10, one_if(of("autocorr") > p.autocorr, finding(
        of("first_line"), F.concat(F.lit("lag-1 自己相関="), fixed(of("autocorr"), 3)),
        F.lit(f"隣接する文の長さが強く相関（閾値{p.autocorr}超）。文長パターンが単調に繰り返されている疑い"), "info", seq=F.lit(1))))
    return df, [low, high]


def leads(tokenized: DataFrame, profile: Profile = LATIN) -> Column:
    """(line, raw, lead, tech) of each sentence with two tokens from the first that is no symbol."""
    first = lambda t: F.array_position(F.transform(t, lambda w: part_of_speech(w, profile) == "補助記号"), F.lit(False))
    rows = F.zip_with("sentences", "tokens", lambda s, t: F.struct(
        s["line"].alias("line"), s["raw"].alias("raw"), F.slice(t, F.greatest(first(t), F.lit(1)).cast("int"), 2).alias("w"), (first(t) > 0).alias("any"),
    ))
    return F.transform(F.filter(rows, lambda r: r["any"] & (F.size(r["w"]) == 2)), lambda r: F.struct(
        r["line"].alias("line"), r["raw"].alias("raw"), F.concat(F.get(r["w"], F.lit(0)), F.get(r["w"], F.lit(1))).alias("lead"),
        F.get(r["w"], F.lit(0)).rlike(r"^[A-Za-z][A-Za-z0-9\-_.]*\z").alias("tech"),
    ))


def lead_groups(tokenized: DataFrame, profile: Profile = LATIN) -> tuple[DataFrame, Column]:
    """(first, all): the sentences that begin with the same two tokens, for each such beginning. Sorted by
    lead, so that equal ones are neighbours."""
    rows = F.transform(leads(tokenized, profile), lambda x, i: F.struct(x["lead"].alias("lead"), i.alias("i"), x["line"].alias("line"), x["raw"].alias("raw"), x["tech"].alias("tech")))
    df = keep(tokenized, "__w", F.array_sort(rows))
    edges = F.transform("__w", lambda x, k: F.when((k == 0) | (F.get("__w", k - 1)["lead"] != x["lead"]), k))
    df = keep(df, "__s", F.filter(edges, lambda k: k.isNotNull()))
    return df, F.transform("__s", lambda k, j: F.struct(F.get("__w", k)["i"].alias("first"), F.slice("__w", k + 1, F.coalesce(F.get("__s", j + 1), F.size("__w")) - k).alias("all")))


@detector
def repeated_leads(tokenized: DataFrame, profile: Profile = LATIN) -> Parts:
    """Sentences of a document that begin with the same two tokens, where enough do: leads in the order
    in which they are first seen, then sentences."""
    p = profile.params
    df, groups = lead_groups(tokenized, profile)
    df = keep(df, "__g", F.array_sort(F.filter(groups, lambda g: F.size(g["all"]) >= p.repeated_lead)))
    lines = lambda g: F.transform(g["all"], lambda x: x["line"])
    df = keep(df, "__h", F.transform("__g", lambda g: F.struct(g["all"].alias("all"), F.size(g["all"]).cast("string").alias("n"), related_text(lines(g)).alias("text"), capped(lines(g)).alias("related"))))
    why = lambda tech: F.when(tech, "固有名詞/技術用語由来の可能性が高い。").otherwise("人間の意図的な反復技法との区別がつかないため参考情報として提示。")
    detail = lambda g, x: F.concat(F.lit("文頭2形態素「"), x["lead"], F.lit("」が"), g["n"], F.lit(f"回反復（閾値{p.repeated_lead}回以上）。"), why(x["tech"]), g["text"])
    rows = F.transform("__h", lambda g: F.transform(g["all"], lambda x: F.struct(x["line"].alias("line"), x["raw"].alias("raw"), detail(g, x).alias("detail"), g["related"].alias("related"))))
    df = keep(df, "__r", F.flatten(rows))
    return df, [("repeated_sentence_lead", 11, F.transform("__r", lambda x, k: finding(x["line"], F.substr(x["raw"], F.lit(1), F.lit(20)), x["detail"], "info", x["related"], k)))]


def lexical_diversity(tokenized: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """``doc_id``, chars, tokens, types, ttr of content tokens; ttr null for short documents."""
    df, columns = diversity_columns(tokenized, profile)
    return df.select("doc_id", *columns)


DIVERSITY = ("chars", "tokens", "types", "ttr", "mtld", "first_line")


def diversity_columns(tokenized: DataFrame, profile: Profile = LATIN) -> tuple[DataFrame, list[Column]]:
    """The columns of :func:`lexical_diversity`."""
    p = profile.params
    content = lambda t: F.transform(F.filter(t, lambda w: w.rlike(profile.content)), F.lower)
    df = keep(tokenized, "__t", F.flatten(F.transform("tokens", content)))
    chars = F.aggregate("sentences", F.lit(0), lambda a, s: a + F.length(s["raw"]))
    types, n = F.size(F.array_distinct("__t")), F.size("__t")
    ok = (chars >= p.diversity_chars) & (n >= p.diversity_tokens)
    return df, [chars.alias("chars"), n.alias("tokens"), types.alias("types"), F.when(ok, types / F.nullif(n, F.lit(0))).alias("ttr"), mtld(F.when(ok, F.col("__t"))).alias("mtld"), F.get("sentences", F.lit(0))["line"].alias("first_line")]


def mtld_of(tokens: list[str], factor: float = 0.72) -> float | None:
    """Mean of the forward and the backward measure; null under 20 tokens."""
    if len(tokens) < 20:
        return None

    def one_way(words: list[str]) -> float:
        factors, types, n = 0.0, set(), 0
        for w in words:
            types.add(w)
            n += 1
            if len(types) / n <= factor:
                factors, types, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(types) / n) / (1 - factor)
        return len(words) / factors if factors else float(len(words))

    return (one_way(tokens) + one_way(tokens[::-1])) / 2


def mtld_batch(tokens: pa.Array) -> pa.Array:
    return pa.array([None if (t := x.as_py()) is None else mtld_of(t) for x in tokens], pa.float64())


def mtld(tokens: Column) -> Column:
    """A fold whose state is a set: as a column expression each step would copy the set."""
    return F.arrow_udf(mtld_batch, "double")(tokens)


@detector
def diversity(tokenized: DataFrame, profile: Profile = LATIN) -> Parts:
    p = profile.params
    df = tokenized
    if "diversity_ttr" not in df.columns:
        df, columns = diversity_columns(tokenized, profile)
        df = df.select("*", *[c.alias(f"diversity_{name}") for c, name in zip(columns, DIVERSITY, strict=True)])
    of = lambda name: F.col(f"diversity_{name}")
    ttr = F.concat(F.lit("TTR="), fixed(of("ttr"), 3), F.lit(" (内容語 "), of("tokens").cast("string"), F.lit(" 語中 "), of("types").cast("string"), F.lit(" 種類)"))
    low = ("low_lexical_diversity_ttr", 12, one_if(of("ttr") < p.ttr, finding(of("first_line"), ttr, F.lit(f"TTR(Type-Token Ratio)が閾値{p.ttr}未満。同じ語彙の使い回しが多い疑い"), "info")))
    detail = F.lit(f"MTLD が閾値{p.mtld:g}未満。文章長で正規化した語彙多様性が低い疑い")
    return df, [low, ("low_lexical_diversity_mtld", 12, one_if(of("mtld") < p.mtld, finding(of("first_line"), F.concat(F.lit("MTLD="), fixed(of("mtld"), 1)), detail, "info", seq=F.lit(1))))]


def specificity(parsed: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Scores of paragraphs that are long enough: proper names and quantities less abstract nouns."""
    df = scored_paragraphs(parsed, profile)
    return df.select("doc_id", F.explode("__p").alias("x")).select("doc_id", *[F.col(f"x.{c}").alias(c) for c in ("line", "words", "proper", "numeric", "example", "abstract", "score", "head")])


def scored_paragraphs(parsed: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """``__p``: the rows of :func:`specificity` as an array."""
    p = profile.params
    words = lambda x: F.filter(F.regexp_extract_all(x["text"], F.lit(profile.token), F.lit(0)), lambda w: w.rlike(profile.content))
    each = F.transform("paragraphs", lambda x: F.struct(x["first"].alias("line"), x["text"].alias("text"), F.get("lines", x["first"] - 1)["raw"].alias("head"), words(x).alias("w")))
    df = keep(parsed, "__w", F.filter(each, lambda x: (F.length(x["text"]) >= p.specificity_chars) & (F.size(x["w"]) >= p.specificity_words)))
    df = keep(df, "__c", F.transform("__w", lambda x: F.struct(
        x["line"].alias("line"), F.size(x["w"]).alias("words"),
        F.size(F.filter(x["w"], lambda w: w.rlike("^[A-Z][A-Za-z0-9]+$"))).alias("proper"),
        F.regexp_count(x["text"], F.lit(profile.quantity)).alias("numeric"),
        x["text"].rlike("|".join(profile.examples)).cast("int").alias("example"),
        F.size(F.filter(x["w"], lambda w: w.isin(*profile.abstract))).alias("abstract"), x["head"].alias("head"),
    )))

    def score(x: Column) -> Column:
        n = x["words"]
        return x["proper"] / n * p.specificity_proper + x["numeric"] / n * p.specificity_numeric + x["example"] * p.specificity_example - x["abstract"] / n * p.specificity_abstract

    names = ("line", "words", "proper", "numeric", "example", "abstract", "head")
    return keep(df, "__p", F.transform("__c", lambda x: F.struct(*[x[c].alias(c) for c in names], score(x).alias("score"))))


@detector
def low_specificity(parsed: DataFrame, profile: Profile = LATIN) -> Parts:
    df, least = scored_paragraphs(parsed, profile), profile.params.specificity_score
    share = lambda x, c: fixed(x[c] / x["words"], 3)
    detail = lambda x: F.concat(
        F.lit("段落の具体性スコア="), fixed(x["score"], 3), F.lit(f"（閾値{least}未満）。固有名詞密度="), share(x, "proper"), F.lit(", 数値密度="), share(x, "numeric"), F.lit(", 抽象名詞率="), share(x, "abstract"),
        F.lit(", 例示マーカー="), F.when(x["example"] == 1, "あり").otherwise("なし"),
        F.lit("。固有名詞・数値・実例が乏しく一般論に留まっている疑い。素材不足のサインであり、文体の修正でなく情報収集を検討する"),
    )
    found = F.transform(F.filter("__p", lambda x: x["score"] < least), lambda x: finding(x["line"], F.substr(strip(x["head"]), F.lit(1), F.lit(40)), detail(x), "info"))
    return df, [("low_specificity", 13, found)]


def prepared(parsed: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """``parsed`` with tokens and morphemes, which are the profile's own tokens unless it brings some."""
    t = parsed if "tokens" in parsed.columns else with_tokens(parsed, profile)
    return t if "morphemes" in t.columns else with_morphemes(t, profile)


def lint(parsed: DataFrame, profile: Profile = LATIN, raw: bool = False) -> DataFrame:
    """All 23 detectors, as one findings table; ``raw`` as in :func:`structural`.

    One pass, from the row of a document to its findings: nothing is cached. The profile's own morphemes,
    some twenty times the text, are found only for sentences with a particle, which both detectors on
    sentences need; counts over documents take the parts of speech alone. A caller that lints again and
    again may cache ``prepared(parsed)`` itself.
    """
    t = parsed if "tokens" in parsed.columns else with_tokens(parsed, profile)
    alone = [
        forbidden_phrases, translationese, antithesis, sentence_variance, inanimate_subject, cleft_because, paragraph_leads,
        uniform_paragraphs, burstiness, repeated_leads, diversity, low_specificity,
    ]
    steps = [lambda df: structural.parts(df, profile, raw=raw), *[lambda df, d=d: d.parts(df, profile) for d in alone]]
    t, found = gathered(searched(t, profile), steps)
    own = "morphemes" not in t.columns
    t = with_parts_of_speech(t, profile) if own else t
    t, more = gathered(t, [lambda df, d=d: d.parts(df, profile.params) for d in (morph.nominal_ending, morph.syntax_template)])
    rows = morph.document_and_sentences(t, grouped(found + more))
    if own:
        rows = rows.where(F.col("d").isNotNull() | F.col("text").rlike("|".join(morph.PARTICLE))).withColumn("m", morphemes_of(F.col("text"), profile))
    rows, last = gathered(rows, [morph.translationese_of, morph.inanimate_subject_of])
    return emit(rows, F.concat(F.coalesce("d", F.array().cast(rows.schema["d"].dataType)), grouped(last)))


def replace_params(profile: Profile, **values) -> Profile:
    return replace(profile, params=replace(profile.params, **values))


def replace_lists(profile: Profile, **values) -> Profile:
    return replace(profile, **values)
