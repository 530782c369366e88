"""Tokenizers as column expressions. A morphological analyser can take their place: any function from
sentences to arrays of the same struct."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.parse import keep
from loomtext.plans.profiles import LATIN, Profile

#: Words of one result of the tokenizer, those of its last document aside, and words whose kinds it remembers: a
#: word takes some hundred bytes here and in Arrow, so a whole batch of documents would not fit a worker.
WORDS = 1 << 15

#: surface, pos (1st part of speech), dict (dictionary form), reading, begin, end
FIELDS = "struct<surface:string,pos:string,pos2:string,dict:string,norm:string,reading:string,begin:int,end:int>"


def part_of_speech(x: Column, profile: Profile) -> Column:
    """By character class: 名詞 for content words, 固有名詞 beneath it for capitalized Latin ones."""
    if profile.name == "ja":
        return (
            F.when(x.rlike("^[ぁ-ゖ]+$"), "助詞").when(x.rlike("^(?:[一-鿿々]|[ァ-ヶー]|[A-Za-z0-9])"), "名詞").otherwise("補助記号")
        )
    return F.when(x.rlike(profile.content), "名詞").when(x.rlike("^[0-9]"), "数詞").otherwise("補助記号")


def tokenizer(profile: Profile) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Token structs of each sentence of each document. Offsets need the places of matches, which column
    functions do not give, so this is one Arrow pass; what depends on the word alone is found once a word.
    Documents are read one by one, and results leave by :data:`WORDS`."""
    find = re.compile(profile.token, re.ASCII).finditer
    content, capital = re.compile(profile.content).search, re.compile("[A-Z][A-Za-z0-9]+").fullmatch
    hiragana, noun = re.compile("[ぁ-ゖ]+").fullmatch, re.compile("[一-鿿々]|[ァ-ヶー]|[A-Za-z0-9]").match

    def kinds(word: str) -> tuple[str, str, str]:
        if profile.name == "ja":
            pos = "助詞" if hiragana(word) else "名詞" if noun(word) else "補助記号"
        else:
            pos = "名詞" if content(word) else "数詞" if "0" <= word[0] <= "9" else "補助記号"
        return pos, "固有名詞" if capital(word) else "*", word.lower()

    known: dict[str, tuple[str, str, str]] = {}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for documents in batches:
            words, begin, end, per_sentence, per_document = [], [], [], [], []
            for document in documents:
                sentences = document.as_py() or ()
                per_document.append(len(sentences))
                for sentence in sentences:
                    before = len(words)
                    for m in find(sentence):
                        words.append(m[0])
                        begin.append(m.start())
                        end.append(m.end())
                    per_sentence.append(len(words) - before)
                if len(words) >= WORDS:
                    yield result(words, begin, end, per_sentence, per_document)
                    words, begin, end, per_sentence, per_document = [], [], [], [], []
            yield result(words, begin, end, per_sentence, per_document)

    def result(words: list[str], begin: list[int], end: list[int], per_sentence: list[int], per_document: list[int]) -> pa.Array:
        if len(known) > WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = kinds(w)
        columns = zip(*[known[w] for w in words], strict=True) if words else ((), (), ())
        pos, pos2, base = (pa.array(c, pa.string()) for c in columns)
        surface = pa.array(words, pa.string())
        parts = [surface, pos, pos2, base, base, surface, pa.array(begin, pa.int32()), pa.array(end, pa.int32())]
        structs = pa.StructArray.from_arrays(parts, ["surface", "pos", "pos2", "dict", "norm", "reading", "begin", "end"])
        offsets = lambda sizes: pa.array([0, *accumulate(sizes)], pa.int32())
        return pa.ListArray.from_arrays(offsets(per_document), pa.ListArray.from_arrays(offsets(per_sentence), structs))

    return run


def surfaces(text: Column, profile: Profile = LATIN) -> Column:
    """Only the surfaces: what most statistics need, at a fraction of the cost."""
    return F.regexp_extract_all(text, F.lit(profile.token), F.lit(0))


def with_tokens(parsed: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Adds ``tokens``: an array of surfaces for each sentence."""
    return keep(parsed, "tokens", F.transform("sentences", lambda s: surfaces(s["text"], profile)))


def with_parts_of_speech(tokenized: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """``morphemes`` with the part of speech only, of ``tokens``: what counts over a whole document need, without
    a worker and at a small part of the size."""
    kind = lambda w: F.struct(part_of_speech(w, profile).alias("pos"))
    return keep(tokenized, "morphemes", F.transform("tokens", lambda t: F.transform(t, kind)))


def morphemes_of(text: Column, profile: Profile = LATIN) -> Column:
    """Token structs of one sentence; null of null."""
    return F.get(F.arrow_udf(tokenizer(profile), f"array<array<{FIELDS}>>")(F.array_compact(F.array(text))), F.lit(0))


def with_morphemes(parsed: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Adds ``morphemes``: an array of token structs for each sentence."""
    tokens = F.arrow_udf(tokenizer(profile), f"array<array<{FIELDS}>>")
    return parsed.withColumn("morphemes", tokens(F.transform("sentences", lambda s: s["text"])))


def mora(reading: Column) -> Column:
    """Code points less small kana that are not in front."""
    return F.length(reading) - F.regexp_count(F.substr(reading, F.lit(2)), F.lit("[ァィゥェォャュョヮ]"))
