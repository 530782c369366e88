"""Language identification by multilingual mixtures of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import discard, materialize, pieces, text_bytes

#: Bits of a hashed n-gram: the model has 2 ** BITS numbers for each language.
BITS = 15
#: Most languages of one model, which is sent to every task: 33 MB.
MAX_LANGUAGES = 256
#: Bytes of text that are turned into arrays at a time; fewer where there are more than eight languages, since
#: each n-gram has a number for each. One document has 2 ** BITS n-grams at most.
CHUNK = 1 << 20
LETTER = regex.compile(r"\p{L}")

_codes = np.zeros(256, np.uint32)  # what is not a letter: 0
_codes[[*range(65, 91), *range(97, 123)]] = [*range(1, 27), *range(1, 27)]
_codes[128:] = 27 + np.arange(128) * 7 % 211


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: log P(n-gram | language), languages x 2 ** BITS, in float32
    log_p: np.ndarray


def grams(data: np.ndarray) -> np.ndarray:
    """The hashed n-gram that ends at each byte: three symbols, letters without case, anything else as one gap."""
    c = _codes[data]
    h = c * np.uint32(0x9E3779B1)
    h[1:] += c[:-1] * np.uint32(0x85EBCA6B)
    h[2:] += c[:-2] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BITS)


def useful(data: np.ndarray) -> np.ndarray:
    """Bytes that end an n-gram with a letter in its middle."""
    letter = _codes[data] > 0
    out = np.zeros(len(data), bool)
    out[2:] = letter[1:-1]
    return out


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, n-gram and count of the n-grams within each document."""
    ok = useful(data)
    for shift in (0, 1):  # n-grams that reach over the start of a document
        at = offsets[:-1] + shift
        ok[at[at < len(data)]] = False
    where = np.flatnonzero(ok)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[where]
    both, n = np.unique(doc.astype(np.int64) << BITS | grams(data)[where], return_counts=True)
    return both >> BITS, both & ((1 << BITS) - 1), n


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", add: float = 0.1) -> Model:
    """N-gram rates of each language over all rows with text and lang.

    Each task sums its rows to at most 2 ** BITS counts a language, so the shuffle and what the driver
    collects are bounded by languages and tasks, not by documents. No labelled row: no languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            data, offsets = text_bytes(batch.column(0))
            for i, j in pieces(offsets, CHUNK):
                part = offsets[i : j + 1]
                doc, gram, n = counts(data[part[0] : part[-1]], part - part[0])
                names = {x: k for k, x in enumerate(dict.fromkeys(langs[i:j]))}
                by = np.array([names[x] for x in langs[i:j]])[doc]
                for name, k in names.items():
                    total = seen.setdefault(name, np.zeros(1 << BITS, np.int64))
                    total += np.bincount(gram[by == k], n[by == k], 1 << BITS).astype(np.int64)
        for name, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "gram", "n"])

    known = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    rows = known.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    per_lang = rows.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams"))
    per_lang = materialize(per_lang, "languages")
    if (most := per_lang.count()) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: {most}")
    names, rates = [], []
    for row in per_lang.orderBy("lang").toLocalIterator():  # one language at a time
        n = np.full(1 << BITS, add)
        n[[g.gram for g in row.grams]] += [g.n for g in row.grams]
        names.append(row.lang)
        rates.append(np.log(n / n.sum()).astype(np.float32))
    discard(per_lang)
    return Model(tuple(names), np.array(rates, np.float32).reshape(len(names), 1 << BITS))


def mixtures(doc: np.ndarray, gram: np.ndarray, n: np.ndarray, docs: int, log_p: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language proportions of each document, its best language, and what the mixture gains for each n-gram,
    in log likelihood, over n-grams drawn evenly (0 without any).

    Expectation-maximisation over all languages gives proportions; those under one twentieth leave.
    Of the sets {first}, {first, second}, ... by proportion, the one with the highest likelihood less
    half of log(n-grams) for each language stays, and its proportions are those of the document.
    """
    langs = len(log_p)
    p = np.exp(log_p[:, gram].T.astype(np.float64))  # rows x languages
    starts = np.searchsorted(doc, np.arange(docs))
    ends = np.searchsorted(doc, np.arange(docs), "right")
    full = np.flatnonzero(ends > starts)
    pi = np.full((docs, langs), 1.0 / max(langs, 1))
    if not len(full) or not langs:
        return pi, np.zeros(docs, np.int64), np.zeros(docs)
    total = np.add.reduceat(n, starts[full]).astype(float)

    def em(pi: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(times):
            r = p * pi[doc]
            s = r.sum(1)
            r *= (n / s)[:, None]
            pi = pi.copy()
            pi[full] = np.add.reduceat(r, starts[full], axis=0) / total[:, None]
        like = np.zeros(docs)
        like[full] = np.add.reduceat(n * np.log((p * pi[doc]).sum(1)), starts[full])
        return pi, like

    pi, _ = em(pi, rounds)
    order = np.argsort(-pi, axis=1, kind="stable")
    sizes = np.clip((pi >= 0.05).sum(1), 1, langs)  # each document's own, whatever stands beside it
    most = int(sizes.max())
    best, best_score = pi, np.full(docs, -np.inf)
    for k in range(1, most + 1):
        some = np.full((docs, langs), 1e-12)
        rows = np.arange(docs)[:, None]
        some[rows, order[:, :k]] = np.maximum(pi[rows, order[:, :k]], 1e-6)
        some /= some.sum(1, keepdims=True)
        fitted, like = em(some, 3 if k > 1 else 0)
        score = np.full(docs, -np.inf)
        score[full] = like[full] - 0.5 * k * np.log(total)
        score[sizes < k] = -np.inf
        better = score > best_score
        best = np.where(better[:, None], fitted, best)
        best_score = np.where(better, score, best_score)
    gain = np.zeros(docs)
    gain[full] = em(best, 0)[1][full] / total + BITS * np.log(2)
    return best, best.argmax(1), gain


def language(text: Column, model: Model) -> Column:
    """Struct of lang, score (its proportion), languages (map of the chosen set) and gain: how much better
    than n-grams drawn evenly they explain an n-gram; below 0, the text is in none of them.

    Null, or no letter: lang ``und``, score 0, no languages, gain 0. Whole texts; very long ones in one piece.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64())), ("gain", pa.float64())])

    def identify_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, log_p = shared.value.languages, shared.value.log_p
        for texts in batches:
            data, offsets = text_bytes(texts)
            has = [t is not None and LETTER.search(t) is not None for t in texts.to_pylist()]
            out: list[dict] = []
            for i, j in pieces(offsets, CHUNK * 8 // max(8, len(names))):
                part = offsets[i : j + 1]
                doc, gram, n = counts(data[part[0] : part[-1]], part - part[0])
                pi, best, gain = mixtures(doc, gram, n, j - i, log_p)
                for k in range(j - i):
                    if has[i + k] and names:
                        chosen = {names[m]: float(pi[k, m]) for m in np.flatnonzero(pi[k] > 1e-6)}
                        out.append({"lang": names[best[k]], "score": float(min(1.0, pi[k, best[k]])), "languages": list(chosen.items()), "gain": float(gain[k])})
                    else:
                        out.append({"lang": "und", "score": 0.0, "languages": [], "gain": 0.0})
            yield pa.array(out, kind)

    return F.arrow_udf(identify_batches, "struct<lang string, score double, languages map<string, double>, gain double>")(text)


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the struct column ``out``; see :func:`language`."""
    return docs.withColumn(out, language(F.col(text), model))
