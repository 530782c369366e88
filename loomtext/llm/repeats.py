"""Repeated windows of a corpus, in four steps that never gather the copies of anything.

1. Each run of windows with one content-defined sample (:mod:`sampling`) has that sample as its key.
   Keys are counted; those found once cannot hold a repeat and go, by a Bloom filter.
2. Runs are grouped by (key, content hash), with map-side combining: copies of a run become a count,
   the smallest document and one place.
3. Each distinct content of a key that may hold a repeat is read once. Keys are packed into shards of
   bounded size, which the caller's index (suffix array, suffix tree) takes whole. A key with more
   distinct text than a shard holds is left to the next level, where samples are longer, so that its
   windows part into more keys; at the last level the sample is the window itself, which has one content.
   A level reads only the documents that have such a key at the level before.
4. What was found for a content goes back to all its places and is gathered by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import bloom
from loomtext.llm.common import discard, materialize, pieces, row_key, text_bytes
from loomtext.llm.sampling import MOST, regions

#: Bytes of text worked on at a time in a scan.
CHUNK = 1 << 20

#: Of a shard: units, offsets of contents in them, numbers of windows and smallest documents. Gives the
#: class of each window, in order; equal windows have the same, and alone ones have one of their own.
Index = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Windows:
    """What a window is: ``size`` units, which ``units`` makes of the bytes of a text."""

    size: int
    #: length of the sample at each level; the last is ``size``
    grams: tuple[int, ...]
    #: units (uint8 or uint64) of each text in a run of texts: all units and len + 1 offsets
    units: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    #: first byte and end of each unit of a run of texts, and len + 1 offsets
    places: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: numbers that are equal for equal units, of the text of contents end to end
    symbols: Callable[[list[bytes]], np.ndarray]
    index: Index
    #: units of a shard
    shard: int
    #: whether the first document keeps its copy, or every copy goes
    keep_first: bool


def _segments(units: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Parts that one call can take: whole documents, or overlapping pieces of a very long one."""
    if len(units) <= MOST:
        yield units, offsets, 0, 0
        return
    for d in range(len(offsets) - 1):
        a, b = int(offsets[d]), int(offsets[d + 1])
        step = MOST - size
        for s in range(a, max(a + 1, b - size + 1), step):
            part = units[s : min(b, s + step + size - 1)]
            yield part, np.array([0, len(part)]), d, s - a


def at_level(u: np.ndarray, o: np.ndarray, w: Windows, level: int, large: list) -> tuple[np.ndarray, ...]:
    """The runs of a level: of the windows whose keys were too large at all levels before."""
    only = None
    for k in range(level):
        _, start, n, key = regions(u, o, w.size, w.grams[k], only)
        ok = large[k].value.contains(key)
        edge = np.zeros(len(u) + 1, np.int32)
        np.add.at(edge, start[ok], 1)
        np.add.at(edge, (start + n)[ok], -1)
        only = np.cumsum(edge[:-1]) > 0
    return regions(u, o, w.size, w.grams[level], only)


def _scan(batches: Iterator[pa.RecordBatch], w: Windows, level: int, large: list, emit: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.num_columns - 1))
        for i, j in pieces(offsets, CHUNK):
            part = offsets[i : j + 1]
            units, at = w.units(data[part[0] : part[-1]], part - part[0])
            for u, o, first, shift in _segments(units, at, w.size):
                doc, start, n, key = at_level(u, o, w, level, large)
                if len(doc):
                    yield emit(batch, u, start, n, key, doc + i + first, start - o[doc] + shift)


def keys_of(w: Windows, level: int, large: list) -> Callable:
    def emit(batch, u, start, n, key, doc, at):
        return pa.record_batch([pa.array(key.view(np.int64))], ["key"])

    return lambda batches: _scan(batches, w, level, large, emit)


def runs_of(w: Windows, level: int, large: list, shared) -> Callable:
    def emit(batch, u, start, n, key, doc, at):
        ok = np.flatnonzero(shared.value.contains(key))
        raw, size = u.tobytes(), u.itemsize
        digest = xxhash.xxh64_intdigest
        ends = (start[ok] + n[ok] + w.size - 1) * size
        content = np.array([digest(raw[a:b]) for a, b in zip((start[ok] * size).tolist(), ends.tolist(), strict=True)], np.uint64)
        ids, hashes = (batch.column(k).to_numpy()[doc[ok]] for k in (0, 1))
        return pa.record_batch(
            [pa.array(x) for x in (key[ok].view(np.int64), content.view(np.int64), ids, hashes, at[ok].astype(np.int32), n[ok].astype(np.int32))],
            ["key", "content", "id", "h", "start", "n"],
        )

    return lambda batches: _scan(batches, w, level, large, emit)


def only(docs) -> Callable:
    """The rows whose first column is in the filter ``docs``, without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = docs.value.contains(batch.column(0).to_numpy().view(np.uint64))
            yield batch.select(range(1, batch.num_columns)).filter(pa.array(ok))

    return run


def slices_of(w: Windows) -> Callable:
    """Text of the contents whose places are in the column ``places`` of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            places = batch.column(0)
            starts = places.offsets.to_numpy()
            flat = places.values
            fields = {f.name: flat.field(k) for k, f in enumerate(places.type.value_type)}
            begin, n = fields["start"].to_numpy(), fields["n"].to_numpy()
            for i, j in pieces(offsets, CHUNK):
                part = offsets[i : j + 1]
                raw = data[part[0] : part[-1]]
                first, end, at = w.places(raw, part - part[0])
                lo, hi = int(starts[i]), int(starts[j])
                doc = np.searchsorted(starts[i : j + 1], np.arange(lo, hi), "right") - 1
                a = at[doc] + begin[lo:hi]
                b = a + n[lo:hi] + (w.size - 2)
                raw = raw.tobytes()
                body = [raw[x:y] for x, y in zip(first[a].tolist(), end[b].tolist(), strict=True)]
                cut = slice(lo, hi)
                yield pa.record_batch([*(fields[k][cut] for k in BODY[:-1]), pa.array(body, pa.binary())], list(BODY))

    return run


def _spans(cls: np.ndarray, n: np.ndarray, occ: np.ndarray, least: np.ndarray, keep_first: bool) -> tuple[np.ndarray, ...]:
    """Content, first and end window and smallest document of the runs of windows to be removed."""
    owner = np.repeat(np.arange(len(n)), n)
    if keep_first:
        order = np.lexsort((least[owner], cls))
        first = np.concatenate(([True], np.diff(cls[order]) != 0))
        low = np.empty(len(cls), np.int64)
        low[order] = least[owner][order][np.maximum.accumulate(np.where(first, np.arange(len(cls)), 0))]
        value, ok = low, np.ones(len(cls), bool)
    else:
        count = np.bincount(cls, minlength=int(cls.max()) + 1 if len(cls) else 1)
        ok = (count[cls] > 1) | (occ[owner] > 1)
        value = np.zeros(len(cls), np.int64)
    inner = np.arange(len(cls)) - (np.cumsum(n) - n)[owner]
    edge = np.ones(len(cls), bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (ok[1:] != ok[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(edge)
    length = np.diff(np.append(at, len(cls)))
    good = ok[at]
    at, length = at[good], length[good]
    return owner[at], inner[at], inner[at] + length, value[at]


def shards_of(w: Windows) -> Callable:
    """Indexes whole keys, sorted, as many at a time as a shard holds."""

    def judge(rows: list[tuple[np.ndarray, ...]], bodies: list[bytes]) -> pa.RecordBatch:
        key, content, n, occ, least = (np.concatenate(x) for x in zip(*rows, strict=True))
        offsets = np.concatenate(([0], np.cumsum(n.astype(np.int64) + w.size - 1)))
        owner, a, b, low = _spans(w.index(w.symbols(bodies), offsets, n), n, occ, least, w.keep_first)
        who, first = np.unique(owner, return_index=True)
        parts = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(low)], ["s", "e", "least"])
        parts = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), parts)
        return pa.record_batch([pa.array(key[who]), pa.array(content[who]), parts], ["key", "content", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bodies, size, last = [], [], 0, None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(5)]
            text = batch.column(5).to_pylist()
            key = cols[0]
            cuts = np.flatnonzero(np.diff(key)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if lo == hi:
                    continue
                new = int((cols[2][lo:hi].astype(np.int64) + w.size - 1).sum())
                if rows and key[lo] != last and size + new > w.shard:
                    yield judge(rows, bodies)
                    rows, bodies, size = [], [], 0
                rows.append(tuple(c[lo:hi] for c in cols))
                bodies += text[lo:hi]
                size += new
                last = key[hi - 1]
        if rows:
            yield judge(rows, bodies)

    return run


#: Of a distinct content: its key and hash, windows, copies, smallest document and text.
BODY = ("key", "content", "n", "occ", "least", "body")
RUN = "key bigint, content bigint, id bigint, h bigint, start int, n int"


def _level(source: DataFrame, w: Windows, level: int, large: list) -> tuple[DataFrame | None, object, DataFrame | None]:
    """Of a level: ``id, h, s, e`` of what goes, the Bloom filter of the keys left to the next level, and
    the rows of ``source`` that have one."""
    counted = source.select("text").mapInArrow(keys_of(w, level, large), "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    twice = materialize(counted.where("n > 1").select("key"), "keys")
    n_twice = twice.count()
    if not n_twice:
        discard(twice)
        return None, None, None
    shared = bloom.build(twice, n_twice)
    discard(twice)
    # written, as they are read again for the hits, long after the scan
    runs = materialize(source.mapInArrow(runs_of(w, level, large, shared), RUN), "runs")
    contents = materialize(
        runs.groupBy("key", "content", "n").agg(F.count(F.lit(1)).alias("occ"), F.min("id").alias("least"), F.max("id").alias("most"), F.min(F.struct("id", "h", "start")).alias("rep")),
        "contents",
    )
    by_key = contents.groupBy("key").agg(
        F.sum("occ").alias("all"), F.min("least").alias("low"), F.max("most").alias("high"), F.sum(F.col("n").cast("bigint") + (w.size - 1)).alias("units")
    )
    too_large = (F.col("units") > w.shard) & F.lit(level + 1 < len(w.grams))
    wanted = materialize(by_key.where("high > low" if w.keep_first else "all > 1").select("key", too_large.alias("large")), "wanted")
    places = contents.join(wanted.where("not large").select("key"), "key").groupBy(F.col("rep.id").alias("__id"), F.col("rep.h").alias("__h")).agg(
        F.collect_list(F.struct(F.col("rep.start").alias("start"), "n", "key", "content", "occ", "least")).alias("places")
    )
    bodies = source.join(places, ["__id", "__h"]).select("places", "text").mapInArrow(slices_of(w), "key bigint, content bigint, n int, occ bigint, least bigint, body binary")
    found = bodies.repartition("key").sortWithinPartitions("key").mapInArrow(shards_of(w), "key bigint, content bigint, parts array<struct<s int, e int, least bigint>>")
    # written, so that both sides of the join are plain exchanges, which AQE can split where a content is hot
    decided = materialize(found, "decided")
    rest = wanted.where("large").select("key")
    n_rest = rest.count()
    left, following = bloom.build(rest, n_rest) if n_rest else None, None
    if n_rest:
        docs = materialize(runs.join(rest, "key").select(F.xxhash64("id", "h").alias("doc")).distinct(), "docs")
        inside = bloom.build(docs, docs.count())
        following = materialize(source.select(F.xxhash64("__id", "__h").alias("doc"), *source.columns).mapInArrow(only(inside), source.schema), "source")
        discard(docs)
    discard(contents)
    discard(wanted)
    hits = runs.join(decided, ["key", "content"]).select("id", "h", "start", F.explode("parts").alias("p"))
    if w.keep_first:
        hits = hits.where(F.col("id") > F.col("p.least"))
    start = F.col("start")
    return hits.select("id", "h", (start + F.col("p.s")).alias("s"), (start + F.col("p.e") + (w.size - 1)).alias("e")), left, following


def removal_spans(docs: DataFrame, w: Windows, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``__id, __h, spans``: for each document with something to remove, its spans of units (s, e)."""
    source = row_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).where("text is not null").select("__id", "__h", "text")
    hits, large = None, []
    for level in range(len(w.grams)):
        more, left, following = _level(source, w, level, large)
        if level:
            discard(source)
        if more is not None:
            hits = more if hits is None else hits.unionByName(more)
        if left is None:
            break
        large.append(left)
        source = following
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], "id bigint, h bigint, s int, e int")
    return hits.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the column ``spans``, null where nothing is to be removed."""
    keyed = row_key(docs)
    return keyed.join(spans, ["__id", "__h"], "left").drop("__id", "__h")


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` units lie in a span."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(ends, n), -1)
    return np.cumsum(depth[:n]) > 0
