"""Quality rules as weak supervision. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import SPACE_CHARS, discard, materialize, trimmed

WS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


#: A word of letters, in marks that prose has around words.
PROSE_WORD = r"""(?<![^\x20\x09-\x0D])["'(\[]*+\p{L}[\p{L}\p{M}'’-]*+["')\],.;:!?…]*+(?![^\x20\x09-\x0D])"""


@dataclass(frozen=True)
class Rule:
    """Votes -1 (bad) where ``bad`` holds, else +1 (good) where ``good`` holds, else abstains (0)."""

    name: str
    bad: str
    good: str


#: SQL over the measures of :func:`measure`. Each fault is looked at by more than one rule, so that rules
#: which see the same fault support each other and one that goes off alone can be outvoted.
RULES = (
    Rule("length", "n_words < 20", "n_words >= 40"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words", "word_chars >= 4 * n_words and word_chars <= 9 * n_words"),
    Rule("symbols_by_words", "10 * n_symbols > 2 * n_words", "50 * n_symbols <= n_words"),
    Rule("symbols_by_characters", "100 * n_symbols > 5 * word_chars", "200 * n_symbols <= word_chars"),
    Rule("prose_words", "10 * n_prose < 7 * n_words", "10 * n_prose >= 9 * n_words"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words", "n_words >= 8 and 100 * n_repeat_words <= n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines", "n_lines >= 2 and n_dup_lines = 0"),
    Rule("repeated_types", "n_words >= 50 and 10 * n_types < 3 * n_words and n_types < 60", "10 * n_types >= 4 * n_words or n_types >= 100"),
    Rule("last_word", "not ends_sentence", "ends_sentence"),
    Rule("stops", "n_words >= 60 and 200 * n_stops < n_words", "n_stops >= 1 and 60 * n_stops >= n_words"),
)
#: What is believed before any vote is seen: the share of good documents, how often a vote on a good one is
#: good and on a bad one bad (a bad document has one fault or two, and passes the rules for others). Held as
#: firmly as STRENGTH documents would, so that rules that hardly vote, and tiny corpora, stay near it.
PRIOR, RIGHT_ON_GOOD, RIGHT_ON_BAD, STRENGTH = 0.8, 0.9, 0.4, 20.0


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the measures that rules vote on, one row for each row of ``docs``.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as in the contract; n_lines (lines
    with a word), n_types (distinct words), n_stops (words that end a sentence), n_prose (words of
    letters); ends_sentence (the last word does). Null text: all 0.

    Everything stays within the row: no text is shuffled. Words are hashed once, and 8-word windows
    from the hashes of their words, to 64 bits; where
    all hashes of a text differ (a primitive hash set tells), nothing repeats; else the hashes are
    sorted with their positions and equal neighbours mark repeats. ``explode(array(x))`` keeps x from
    being inlined into the lambdas, where it would be evaluated for each element.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    once = lambda df, name, x: df.select("*", F.explode(F.array(x)).alias(name))
    base = docs.select(*keep, t.alias("__t"))
    core = trimmed(F.col("__t"))
    base = once(base, "__w", F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, f"[{SPACE_CHARS}]+")))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.trim(x, F.lit(WS)) != "")
    stops = F.size(F.filter("__w", lambda w: w.endswith(".") | w.endswith("!") | w.endswith("?")))
    base = once(base.withColumn("n_stops", stops.cast("long")), "__h", F.transform("__w", lambda w: F.xxhash64(w)))
    base = base.select(
        *keep,
        "__h",
        "n_stops",
        core.rlike(r"""[.!?…]["')\]]*\z""").alias("ends_sentence"),
        F.regexp_count("__t", F.lit(PROSE_WORD)).cast("long").alias("n_prose"),
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", WS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.explode(F.array(lines)).alias("__l"),
    )
    base = base.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        "n_stops",
        "n_prose",
        "ends_sentence",
        F.size(F.array_distinct("__h")).cast("long").alias("n_types"),
        "__h",
    )
    # hashes of 2, 4 and 8 words from each place on
    part = lambda c, first, k: F.slice(c, F.lit(first), F.greatest(F.size(c) - k, F.lit(0)))
    for c, k, name in (("__h", 1, "__2"), ("__2", 2, "__4"), ("__4", 4, "__g")):
        base = once(base, name, F.zip_with(part(c, 1, k), part(c, k + 1, k), lambda a, b: F.xxhash64(a, b))).drop(c)
    again = F.size(F.array_distinct("__g")) < F.size("__g")
    pairs = F.when(
        again, F.array_sort(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    base = once(base.select("*").withColumn("__s", pairs).drop("__g"), "__p", F.col("__s")).drop("__s")
    size = F.size("__p")
    twin = lambda x, k: (k > 0) & (F.element_at("__p", F.greatest(k, F.lit(1)))["h"] == x["h"]) | (
        (k + 1 < size) & (F.element_at("__p", F.least(k + 2, size))["h"] == x["h"])
    )
    at = F.when(F.col("__p").isNotNull(), F.array_sort(F.transform(F.filter("__p", twin), lambda x: x["i"])))
    base = once(base, "__a", at).drop("__p")
    covered = F.aggregate(
        "__a",
        F.struct(F.lit(-8).alias("last"), F.lit(0).alias("n")),
        lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(x - s["last"], F.lit(8))).alias("n")),
        lambda s: s["n"],
    )
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__a")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_votes(measures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return measures.withColumn(
        "votes",
        F.array(*[F.expr(f"case when {r.bad} then -1 when {r.good} then 1 else 0 end").cast("int") for r in rules]),
    )


def posterior(votes: str, params: dict) -> Column:
    """P(good | votes) under rules that err independently; a rule that abstains says nothing."""
    # weights stay inside array functions, so that code compiled for one round of the fit serves all rounds
    weight = lambda a, b: F.struct(F.lit(log(a / (1 - b))).alias("up"), F.lit(log((1 - a) / b)).alias("down"))
    weights = F.array(*[weight(a, b) for a, b in zip(params["good"], params["bad"], strict=True)])
    said = F.zip_with(votes, weights, lambda v, w: F.when(v == 1, w["up"]).when(v == -1, w["down"]).otherwise(0.0))
    odds = F.aggregate(said, F.lit(log(params["prior"] / (1 - params["prior"]))), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def fit(voted: DataFrame, n_rules: int, rounds: int = 30, strength: float = STRENGTH) -> dict:
    """Expectation-maximisation over the counts of vote patterns (3 ** n_rules rows at most, so one task).

    ``prior``: share of good documents; ``good``, ``bad``: how often a rule that votes is right on good
    and on bad documents. All are learned from the votes alone: rules that agree gain weight, one that goes
    off without the others loses it. What is believed beforehand counts as ``strength`` documents. All rows
    count. Ends where nothing moves any more.
    """
    params = {"prior": PRIOR, "good": [RIGHT_ON_GOOD] * n_rules, "bad": [RIGHT_ON_BAD] * n_rules}
    patterns = materialize(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "votes")
    sums = [F.sum(F.col("n") * F.col("p")).alias("good"), F.sum("n").alias("all")]
    for i in range(n_rules):
        v = F.element_at("votes", i + 1)
        for name, vote, w in (("gg", 1, F.col("p")), ("gb", -1, F.col("p")), ("bg", 1, 1 - F.col("p")), ("bb", -1, 1 - F.col("p"))):
            sums.append(F.sum(F.when(v == vote, F.col("n") * w).otherwise(0.0)).alias(f"{name}{i}"))
    for _ in range(rounds):
        s = patterns.withColumn("p", posterior("votes", params)).agg(*sums).first()
        if not s["all"]:
            break
        before, params = params, updated(s, n_rules, strength)
        if abs(before["prior"] - params["prior"]) + sum(abs(x - y) for k in ("good", "bad") for x, y in zip(before[k], params[k], strict=True)) < 1e-6:
            break
    discard(patterns)
    return params


def updated(s: dict, n_rules: int, strength: float) -> dict:
    """Rates from expected counts: gg, gb, bg, bb of rule i are good and bad documents by good and bad votes."""
    share = lambda hits, misses, belief: (hits + strength * belief) / (hits + misses + strength)
    return {
        "prior": share(s["good"], s["all"] - s["good"], PRIOR),
        "good": [share(s[f"gg{i}"], s[f"gb{i}"], RIGHT_ON_GOOD) for i in range(n_rules)],
        "bad": [share(s[f"bb{i}"], s[f"bg{i}"], RIGHT_ON_BAD) for i in range(n_rules)],
    }


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the measures, votes, base_failed, quality (posterior) and kept.

    Kept: not base_failed, and the posterior of the votes is at least ``threshold``. Null or empty
    text fails. No rows: no rows. Repeated rows are judged alike.
    """
    voted = materialize(with_votes(measure(docs, text, keep), rules), "quality")
    params = fit(voted, len(rules))
    return (
        voted.withColumn("base_failed", base_failed())
        .withColumn("quality", posterior("votes", params))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )
