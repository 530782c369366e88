"""Profiles: delimiters, tokenizer classes, word lists and thresholds of a language.

``JA`` has the values that published results depend on. ``LATIN`` is an extension for texts in Latin
script, so that the same operators say something about them; its lists are our own.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The word lists, patterns and thresholds below decide what is found.
FORBIDDEN_JA = (
    "と言えるでしょう", "と言えるだろう", "と言えます", "ということになるでしょう", "のではないでしょうか",
    "重要なのは", "大切なのは", "ポイントは", "結論から言うと", "結論として", "いかがでしたか", "いかがでしょうか",
    "まとめると", "総じて", "非常に重要", "極めて重要", "言うまでもなく", "言うまでもありません", "まさしく",
    "さて、", "それでは、", "このように", "このような中", "ここで注目したいのは", "見ていきましょう",
    "紹介していきます", "解説していきます", "深掘りしていきます", "一概には言えません", "個人差がありますが",
    "あくまで一例ですが", "正面から扱う", "正面から見る", "正面から書く", "正面から立てる", "正面から回収する",
    "不可欠", "核心的", "鍵となる", "根本的な", "多角的", "包括的", "総合的", "掘り下げる", "深掘りする",
    "言語化する", "について見ていく", "を探求する",
)
WEAK_JA = ("重要なのは", "このように", "不可欠", "ポイントは", "さて、")
TRANSLATIONESE_JA = (
    "することができ(る|ます|た)", "することが可能(です|だ|になる)", "と言えるだろう", "という点で", "という観点(から|で)",
    "にとって(重要|不可欠)", "を持つ(こと|存在)", "することによって", "であることは間違いない", "に他ならない",
)
CONJUNCTIONS_JA = ("しかし", "また", "そして", "そのため", "さらに", "つまり", "一方", "一方で", "このように", "なぜなら", "したがって", "ただし")
ANTITHESIS_JA = ("ではなく、?.{0,30}", "だけでなく.{0,10}も")
ABSTRACT_JA = (
    "側面", "観点", "重要性", "可能性", "あり方", "存在", "意味", "本質", "価値", "意義", "課題", "問題", "要素", "要因", "背景",
    "傾向", "姿勢", "視点", "概念", "特徴", "性質", "状況", "状態", "変化",
)
EXAMPLES_JA = ("たとえば", "例えば", "実際に", "実際には", "具体的には", "具体例として", "一例として", "先日", "昨日", "現に", "実例として")
QUANTITY_JA = "[0-9０-９]+(年代|年間|世紀|年|月|日|時間|時|分|秒|人|円|%|％|kg|km|cm|mm|g|m|回|件|個|つ|割|倍|台|社|名|冊|本|杯|軒)?"
INANIMATE_JA = (
    "(これ|それ|この事実|そのこと)(は|が).{0,40}(もたらす|示す|意味する|証明する|生み出す|反映する)",
    ".{0,20}(こと|事実)(は|が).{0,40}(もたらす|示す|意味する|証明する|生み出す|反映する)",
)
CLEFT_JA = ("^(それ|これ|この)は.{0,60}(である|だ)$", "^(なぜなら|というのも)")
BOILERPLATE_JA = ("まとめ", "おわりに", "終わりに", "さいごに", "最後に", "結論", "総括", "conclusion")
PHASE_JA = "(フェーズ|ステップ|段階|ステージ)[{ws}]*[0-90-9１-９]"
EMOJI = "[\U0001f300-\U0001faff☀-➿⭐✅❌❗❓]"
TEMPLATE_HEADINGS_JA = (
    "はじめに", "背景", "概要", "本記事について", "この記事について", "まとめと今後", "今後の展望", "今後の課題", "今後について", "まとめ",
    "おわりに", "終わりに", "さいごに", "最後に", "結論", "総括", "conclusion", "introduction", "summary",
)
OBLIGATION_JA = ("といけ", "とだめ", "とダメ", "ばならな", "ばなりま", "ばいけな", "てはならな", "てはなりま", "てはいけな", "ざるを得", "ざるをえ")
NEGATIONS_JA = ("ない", "無い", "ぬ", "ず")
SUBJECTS_JA = ("これ", "それ", "あれ", "それら")
SUBJECT_NOUNS_JA = ("こと", "事実", "の")
SUBJECT_PAIRS_JA = ("この事実", "そのこと")
SUBJECT_VERBS_JA = ("もたらす", "示す", "意味する", "証明する", "生み出す", "反映する", "示唆する", "物語る", "浮き彫りにする", "後押しする")
GLOSS_JA = ("とは", "と呼ぶ", "という", "、つまり")
CATEGORIES = (
    "forbidden_phrase", "translationese", "antithesis_repetition", "low_sentence_variance", "english_syntax_inanimate_subject",
    "english_syntax_cleft_because", "nominal_ending", "paragraph_lead_conjunction", "uniform_paragraph_structure",
    "translationese_morph", "inanimate_subject_morph", "low_burstiness", "high_length_autocorrelation", "repeated_sentence_lead",
    "repeated_syntax_template", "low_lexical_diversity_ttr", "low_lexical_diversity_mtld", "low_specificity", "high_bold_density",
    "high_bullet_ratio", "boilerplate_heading", "numbered_phase_structure", "high_emoji_symbol_density",
)
EXPERIMENTAL = (
    "high_length_autocorrelation", "paragraph_lead_conjunction", "repeated_syntax_template", "english_syntax_cleft_because",
    "high_bold_density", "high_bullet_ratio", "boilerplate_heading", "numbered_phase_structure", "high_emoji_symbol_density",
)
BUSINESS_DISABLED = ("high_bullet_ratio", "high_bold_density", "boilerplate_heading", "numbered_phase_structure")
WHOLE_DOCUMENT = (
    "low_burstiness", "high_length_autocorrelation", "low_sentence_variance", "uniform_paragraph_structure",
    "low_lexical_diversity_ttr", "low_lexical_diversity_mtld",
)


@dataclass(frozen=True)
class Params:
    """Thresholds; the defaults are those for no genre."""

    antithesis_hits: int = 3
    antithesis_info_below: float = 0.02
    antithesis_critical_from: float = 0.03
    variance_sentences: int = 5
    variance_cv: float = 0.25
    nominal_sentences: int = 5
    nominal_ratio: float = 0.0
    nominal_chars: int = 2000
    lead_paragraphs: int = 3
    lead_ratio: float = 0.3
    uniform_paragraphs: int = 4
    uniform_cv: float = 0.15
    burst_sentences: int = 6
    burst: float = -0.24
    autocorr_pairs: int = 4
    autocorr: float = 0.6
    repeated_lead: int = 6
    template_grams: int = 6
    template_ratio: float = 0.4
    diversity_tokens: int = 30
    ttr: float = 0.45
    mtld: float = 40
    diversity_chars: int = 4000
    specificity_chars: int = 80
    specificity_words: int = 15
    specificity_proper: float = 1.0
    specificity_numeric: float = 1.0
    specificity_example: float = 0.1
    specificity_abstract: float = 1.5
    specificity_score: float = -0.15
    long_sentence: int = 90


GENRES = {
    None: Params(),
    "essay": Params(nominal_chars=1500, repeated_lead=5, long_sentence=110),
    "tech": Params(nominal_chars=3000, repeated_lead=7, antithesis_critical_from=0.045),
    "business": Params(nominal_chars=3000, repeated_lead=7),
}
#: Adjacent similarity range at or under which a text counts as flat.
SEMANTIC_RANGE = {None: 0.16122889518737793, "essay": 0.15813499689102173, "tech": 0.14261949062347412, "business": 0.15655699338912964}
SEMANTIC_REPETITION_MAX, SEMANTIC_JUMP_MIN = 0.9322158694267273, 0.765757143497467
#: Threshold sweeps: parameter, how a document's measure fires against it, first and last value, step.
SWEEPS = {
    "low_burstiness": ("burst", "<", -0.9, -0.2, 0.02),
    "high_length_autocorrelation": ("autocorr", ">", 0.1, 0.95, 0.05),
    "low_sentence_variance": ("variance_cv", "<", 0.05, 0.6, 0.02),
    "nominal_ending": ("nominal_ratio", "<=", 0.05, 0.6, 0.02),
    "paragraph_lead_conjunction": ("lead_ratio", ">=", 0.05, 0.7, 0.02),
    "uniform_paragraph_structure": ("uniform_cv", "<", 0.02, 0.5, 0.02),
    "antithesis_repetition": ("antithesis_hits", ">=", 1, 8, 1),
    "repeated_sentence_lead": ("repeated_lead", ">=", 1, 8, 1),
    "repeated_syntax_template": ("template_ratio", ">=", 0.1, 0.9, 0.05),
    "low_lexical_diversity_ttr": ("ttr", "<", 0.2, 0.7, 0.02),
    "low_lexical_diversity_mtld": ("mtld", "<", 10, 90, 2),
    "low_specificity": ("specificity_score", "<", -0.3, 0.6, 0.02),
}
# End of the fixed values.


@dataclass(frozen=True)
class Profile:
    name: str
    delimiters: str
    token: str
    content: str  # pattern of tokens that carry content
    forbidden: tuple[str, ...]
    weak: tuple[str, ...]
    translationese: tuple[str, ...]
    conjunctions: tuple[str, ...]
    antithesis: tuple[str, ...]
    cleft: tuple[str, str]
    inanimate: tuple[str, ...]
    abstract: tuple[str, ...]
    examples: tuple[str, ...]
    quantity: str
    boilerplate: tuple[str, ...]
    phase: str
    emoji: str = EMOJI
    params: Params = field(default_factory=Params)


JA = Profile(
    "ja", "。！？", "[一-鿿々]+|[ァ-ヶー]+|[ぁ-ゖ]+|[A-Za-z0-9_.-]+|[^\\s]", "^(?:[一-鿿々]|[ァ-ヶー]|[A-Za-z])", FORBIDDEN_JA, WEAK_JA, TRANSLATIONESE_JA,
    CONJUNCTIONS_JA, ANTITHESIS_JA, CLEFT_JA, INANIMATE_JA, ABSTRACT_JA, EXAMPLES_JA, QUANTITY_JA, BOILERPLATE_JA, PHASE_JA,
)
#: Words that occur in prose of the driver's tables; an extension without published counterpart.
LATIN = Profile(
    "latin", ".!?", "[A-Za-z\u00c0-\u024f0-9]+|[^A-Za-z\u00c0-\u024f0-9 \t\n\r]", "^[A-Za-z\u00c0-\u024f]",
    ("of the", "in the", "that the", "de la", "in der", "for the"), ("of the", "de la"),
    ("(to|of) the [a-z]+ and", "that (is|are|was) [a-z]+", "with the (in|on|th)[a-z]*"),
    ("The", "And", "Of", "La", "De", "Der", "Les"), ("not the .{0,30}", "the [a-z]+ and .{0,10}the"),
    ("^(The|It|This) .{0,60}[a-z]$", "^(And|Of|The)"), ("(it|this|that) .{0,40}(tion|ing)s",), ("tion", "ation", "thing", "heand"),
    ("for", "such", "por", "pour"), "[0-9]+", ("summary", "conclusion"), "(step|phase|stage)[ \t]*[0-9]",
    emoji="[#$%&]{3}", params=replace(Params(), long_sentence=160, diversity_chars=1500, antithesis_hits=2, ttr=0.6, repeated_lead=4),
)
