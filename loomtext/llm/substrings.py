"""Removal of repeated word sequences by prefix-partitioned suffix trees."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import SPACE_CHARS
from loomtext.llm.repeats import Windows, covered, removal_spans, with_spans

#: Words of a sequence that only its first document keeps.
LENGTH = 13
#: Suffixes of a group whose subtree is grown at a time.
GROUP = 1 << 18


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text."""
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes: list[int] = []
    ends = [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        hashes += map(digest, raw[a:b].split())
        ends.append(len(hashes))
    return np.array(hashes, np.uint64), np.array(ends, np.int64)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of words before each text."""
    inside = ~np.isin(data, np.frombuffer(SPACE_CHARS.encode(), np.uint8))
    full = offsets[1:] > offsets[:-1]
    fresh, over = np.ones(len(data), bool), np.ones(len(data), bool)
    fresh[1:] = ~inside[:-1]
    over[:-1] = ~inside[1:]
    fresh[offsets[:-1][full]] = True
    over[offsets[1:][full] - 1] = True
    first = np.flatnonzero(inside & fresh)
    return first, np.flatnonzero(inside & over) + 1, np.searchsorted(first, offsets)


def word_symbols(bodies: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words, which are compared whole."""
    return pa.array([x for b in bodies for x in b.split()], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)


def prefix_groups(symbols: np.ndarray, starts: np.ndarray, depth: int, most: int) -> list[tuple[np.ndarray, int]]:
    """Splits suffixes by prefixes of varying length until a group has ``most`` at most, or its prefix
    has ``depth`` words: (suffixes, words that they share)."""
    done, todo = [], [(starts, 0)]
    while todo:
        group, d = todo.pop()
        if len(group) <= most or d == depth:
            done.append((group, d))
            continue
        word = symbols[group + d]
        order = np.argsort(word, kind="stable")
        cuts = np.flatnonzero(np.diff(word[order])) + 1
        parts = np.split(group[order], cuts)
        # neighbouring small parts stay together under the shorter prefix
        pile, size = [], 0
        for part in parts:
            if len(part) > most:
                todo.append((part, d + 1))
            elif size + len(part) > most:
                done.append((np.concatenate(pile), d))
                pile, size = [part], len(part)
            else:
                pile.append(part)
                size += len(part)
        if pile:
            done.append((np.concatenate(pile), d))
    return done


def deep_nodes(symbols: np.ndarray, suffixes: np.ndarray, shared: int, depth: int) -> np.ndarray:
    """Grows the subtree of suffixes that share ``shared`` words down to ``depth``, a word a level.

    Gives the internal node at that depth under which each suffix lies, numbered from 0, or -1 for a
    suffix that is a leaf before: its first ``depth`` words are no repeat.
    """
    node = np.zeros(len(suffixes), np.int64)
    out = np.full(len(suffixes), -1, np.int64)
    live = np.arange(len(suffixes))
    for d in range(shared, depth):
        word = symbols[suffixes[live] + d]
        order = np.lexsort((word, node))
        n, w = node[order], word[order]
        new = np.concatenate(([True], (n[1:] != n[:-1]) | (w[1:] != w[:-1])))
        child = np.cumsum(new) - 1
        inner = np.bincount(child)[child] > 1  # others are leaves
        live, node = live[order[inner]], child[inner]
        if not len(live):
            return out
        node = np.unique(node, return_inverse=True)[1]
    out[live] = node
    return out


def window_classes(symbols: np.ndarray, offsets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes of equal windows: deep nodes of the subtrees; a leaf is alone."""
    total = int(n.sum())
    starts = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    window = np.empty(len(symbols), np.int64)
    window[starts] = np.arange(total)
    cls = np.empty(total, np.int64)
    used = 0
    for group, shared in prefix_groups(symbols, starts, LENGTH, GROUP):
        node = deep_nodes(symbols, group, shared, LENGTH)
        inner = node >= 0
        nodes = int(node.max(initial=-1)) + 1
        cls[window[group[inner]]] = used + node[inner]
        leaves = int((~inner).sum())
        cls[window[group[~inner]]] = used + nodes + np.arange(leaves)
        used += nodes + leaves
    return cls


WORDS = Windows(size=LENGTH, grams=(4, 8, 11, LENGTH), units=word_units, places=word_places, symbols=word_symbols, index=window_classes, shard=1 << 20, keep_first=True)

RESULT = "struct<n_words bigint, n_removed bigint, kept_sha256 string>"


def _kept(texts: pa.Array, spans: pa.Array):
    for text, found in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True):
        words = text.split() if text else []
        n = len(words)
        if found:
            gone = covered(n, np.array([x["s"] for x in found]), np.array([x["e"] for x in found]))
            words = [words[i] for i in np.flatnonzero(~gone).tolist()]
        yield n, words


def cut_digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = [{"n_words": n, "n_removed": n - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()} for n, kept in _kept(texts, spans)]
    return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, a row for each row of ``docs``.

    Null text: no words. A null doc_id counts as the smallest. Rows of one doc_id are one document:
    none of them is first before another. No rows: no rows.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cut = F.arrow_udf(cut_digest, RESULT)
    return with_spans(plain, removal_spans(plain, WORDS)).select("doc_id", cut("text", "spans").alias("r")).select("doc_id", "r.*")
