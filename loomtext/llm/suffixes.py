"""Exact removal of repeated byte strings by suffix arrays of shards, made by induced sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import text_bytes
from loomtext.llm.repeats import Windows, covered, removal_spans, with_spans

#: Bytes of a string that may stand only once.
LENGTH = 400


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last, the sentinel, counts as smaller)."""
    n = len(s)
    up = s[1:].astype(np.int16) - s[:-1]
    at = np.where(up != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(up[np.minimum(following, n - 2)] > 0, True)


def name_substrings(s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each leftmost-smaller position to the next, equal ones alike.

    Eight bytes at a time; after the first, only what still ties goes on. Behind its end a substring
    counts as larger than anything: there it ends in a smaller-type symbol, where a longer one that
    agrees so far has a larger-type one, which comes first.
    """
    m = len(lms)
    length = np.append(np.diff(lms) + 1, 1)
    padded = np.append(s, np.zeros(8, np.uint8))
    step = np.arange(8)

    def words(of: np.ndarray, k: int) -> np.ndarray:
        at = np.minimum(lms[of] + k, len(s) - 1)[:, None] + step
        inside = step < (length[of] - k)[:, None]
        return np.ascontiguousarray(np.where(inside, padded[at], np.uint8(255))).view(">u8").ravel().astype(np.uint64)

    order = np.argsort(w := words(np.arange(m), 0), kind="stable")
    new = np.concatenate(([True], w[order][1:] != w[order][:-1]))
    rank = np.empty(m, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    k = 8
    while True:
        size = np.bincount(rank, minlength=m)
        live = np.flatnonzero((size[rank] > 1))
        if not len(live) or not (length[live] > k).any():
            return rank
        # classes in which some member goes on
        going = np.bincount(rank[live], length[live] > k, m) > 0
        live = live[going[rank[live]]]
        w = words(live, k)
        order = np.lexsort((w, rank[live]))
        r, w = rank[live][order], w[order]
        head = np.concatenate(([True], r[1:] != r[:-1]))
        new = head | np.concatenate(([True], w[1:] != w[:-1]))
        at = np.arange(len(r))
        base = np.maximum.accumulate(np.where(head, at, 0))
        rank[live[order]] = r + np.maximum.accumulate(np.where(new, at, 0)) - base
        k += 8


def order_names(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced string, by rank doubling: it replaces the recursion, whose
    buckets are too small there for array operations."""
    m, width = len(rank), 1
    while True:
        second = np.zeros(m, np.int64)
        second[:-width] = rank[width:] + 1
        key = rank * (m + 1) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        if new.all() or width >= m:
            return order
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(new) - 1
        width *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of bytes under 255, by induced sorting with whole buckets as arrays."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    s = np.append(text + np.uint8(1), np.uint8(0))
    small = suffix_types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    rank = name_substrings(s, lms)
    lms = lms[order_names(rank)]
    sizes = np.bincount(s, minlength=256)
    ends = np.cumsum(sizes)
    sa = np.zeros(n + 1, np.int64)
    sa[0] = n
    by_symbol = np.argsort(s[lms], kind="stable")
    grouped = lms[by_symbol]
    lms_end = np.cumsum(np.bincount(s[lms], minlength=256))
    head = ends - sizes
    free = head.copy()
    symbols = np.flatnonzero(sizes).tolist()

    def put_large(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[~small[before]]
        c = s[before]
        order = np.argsort(c, kind="stable")
        count = np.bincount(c, minlength=256)
        c = c[order]
        sa[free[c] + np.arange(len(c)) - (np.cumsum(count) - count)[c]] = before[order]
        free[:] += count

    for c in symbols:
        at = int(head[c])
        while at < free[c]:
            block, at = sa[at : free[c]].copy(), int(free[c])
            put_large(block)
        put_large(grouped[(lms_end[c - 1] if c else 0) : lms_end[c]])
    last = ends.copy()

    def put_small(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[small[before]]
        c = s[before]
        order = np.argsort(c, kind="stable")
        count = np.bincount(c, minlength=256)
        c = c[order]
        sa[last[c] - 1 - (np.arange(len(c)) - (np.cumsum(count) - count)[c])] = before[order]
        last[:] -= count

    for c in reversed(symbols):
        at = int(ends[c])
        while at > last[c] and c:
            block, at = sa[last[c] : at][::-1].copy(), int(last[c])
            put_small(block)
        put_small(sa[head[c] : free[c]][::-1] if c else sa[:1])
    return sa[1:]


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text position, the suffix before it in the array (-1: none) and their common prefix.

    Only where the symbols before the two differ is anything compared; elsewhere the prefix is the
    one of the position before, less one.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.append(text, np.zeros(8, np.uint8))
    word = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 1, 8), (1, 1))
    at = np.arange(n)
    apart = (phi <= 0) | (at == 0)
    apart[1:] |= text[at[1:] - 1] != text[phi[1:] - 1]
    heads = np.flatnonzero(apart)
    length = np.zeros(n, np.int64)
    live = heads[phi[heads] >= 0]
    x, y = live.copy(), phi[live]
    while len(live):
        ok = (x <= n - 8) & (y <= n - 8)
        a = np.ascontiguousarray(word[np.minimum(x, n)]).view(np.uint64).ravel()
        b = np.ascontiguousarray(word[np.minimum(y, n)]).view(np.uint64).ravel()
        diff = a ^ b
        same = ok & (diff == 0)
        end = ~same
        if end.any():
            d = diff[end]
            lowest = (d & (~d + np.uint64(1))).astype(np.float64)
            more = np.where(d == 0, 8, np.log2(np.where(d == 0, 1.0, lowest)).astype(np.int64) // 8)
            room = n - np.maximum(x[end], y[end])
            length[live[end]] = x[end] - live[end] + np.minimum(more, np.maximum(room, 0))
        live, x, y = live[same], x[same] + 8, y[same] + 8
    head = np.maximum.accumulate(np.where(apart, at, 0))
    return phi, length[head] - (at - head)


def window_classes(text: np.ndarray, offsets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes of equal LENGTH-byte strings among the windows that lie within a content."""
    sa = suffix_array(text)
    _, common = permuted_lcp(text, sa)
    cls = np.empty(len(text), np.int64)
    cls[sa] = np.cumsum(common[sa] < LENGTH)
    total = int(n.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    return np.unique(cls[inside], return_inverse=True)[1]


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def byte_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(data) + 1)
    return at[:-1], at[1:], offsets


def byte_symbols(bodies: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bodies), np.uint8)


BYTES = Windows(
    size=LENGTH, grams=(64, 224, 336, 384, LENGTH), units=byte_units, places=byte_places, symbols=byte_symbols, index=window_classes, shard=2 << 20, keep_first=False
)

RESULT = "struct<n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string>"


def _cut(texts: pa.Array, spans: pa.Array):
    data, offsets = text_bytes(texts)
    for i, found in enumerate(spans.to_pylist()):
        raw = data[offsets[i] : offsets[i + 1]]
        if found:
            gone = covered(len(raw), np.array([x["s"] for x in found]), np.array([x["e"] for x in found]))
            yield len(raw), gone, raw[~gone].tobytes()
        else:
            yield len(raw), None, raw.tobytes()


def cut_digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for n, gone, kept in _cut(texts, spans):
        runs = 0 if gone is None else int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append({"n_bytes": n, "n_removed": n - len(kept), "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def cut_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """What is left; a character of which only some bytes go is dropped whole."""
    return pa.array([None if t is None else kept.decode(errors="ignore") for t, (_, _, kept) in zip(texts.to_pylist(), _cut(texts, spans), strict=True)], pa.string())


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, a row for each row of ``docs``.

    Null text: empty. A row that occurs twice has every string of LENGTH bytes twice, so both lose
    them. No rows: no rows.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cut = F.arrow_udf(cut_digest, RESULT)
    return with_spans(plain, removal_spans(plain, BYTES)).select("doc_id", cut("text", "spans").alias("r")).select("doc_id", "r.*")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated strings of LENGTH bytes cut out of the texts. Other columns, of any name, stay."""
    packed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*docs.columns).alias("row"))
    cut = F.arrow_udf(cut_text, "string")(F.col("text"), F.col("spans"))
    left = with_spans(packed, removal_spans(docs, BYTES, doc_id, text)).select("row", cut.alias("left"))
    return left.select(*[F.col("left").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
