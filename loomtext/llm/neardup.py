"""Near-duplicates: texts that ``op1`` links by anchors, and those whose word shingles are alike.

Fingerprints within two bits are linked as :mod:`simhash` links them. A similarity of 0.8 is some ten bits,
which anchors do not cover; for such texts MinHash bands propose more pairs, and exact sets confirm them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm import bloom, simhash
from loomtext.llm.common import NULL_ID, any_names, discard, materialize
from loomtext.llm.components import components
from loomtext.llm.simhash import shingle_hashes

#: Words of a shingle, and the least similarity (shared shingles by all) of linked texts, as a fraction.
WORDS, SIMILAR = 5, (4, 5)
#: A pair at the least similarity shares no band, and is missed, with probability (1 - 0.8 ** ROWS) ** BANDS: 5e-6.
BANDS, ROWS = 40, 6
#: Shingles hashed at a time.
CHUNK = 1 << 9


@cache
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(42)
    factor, shift = r.integers(0, 1 << 32, (2, 1, BANDS * ROWS), dtype=np.uint32)
    return factor | np.uint32(1), shift


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted, distinct hashes of the text's shingles; fewer words are one shingle, no word has none."""
    return np.unique(shingle_hashes(text or b"", WORDS))


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima; no shingle, no keys."""
    if not len(hashes):
        return []
    factor, shift = multipliers()
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    for i in range(0, len(short), CHUNK):
        np.minimum(least, (short[i : i + CHUNK] * factor + shift).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [signed(xxhash.xxh64_intdigest(rows[k].tobytes(), k)) for k in range(BANDS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketches(texts: pa.Array) -> pa.Array:
    """key (of the set of shingles) and bands of each text."""
    out = []
    for t in texts.cast(pa.binary()).to_pylist():
        s = shingles(t)
        out.append({"key": signed(xxhash.xxh64_intdigest(s.tobytes())), "bands": bands(s)})
    return pa.array(out, pa.struct([("key", pa.int64()), ("bands", pa.list_(pa.int64()))]))


def sets(texts: pa.Array) -> pa.Array:
    return pa.array([shingles(t).view(np.int64) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))


def similar(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough, by their whole sets. ``known``: key, set."""
    both = pairs.join(known.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
    both = both.join(known.select(F.col("key").alias("a"), F.col("set").alias("x")), "a")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("all"))
    return both.where(F.col("n") * SIMILAR[1] >= (F.col("all") - F.col("n")) * SIMILAR[0]).select("a", "b")


def shareable(known: DataFrame, rounds: int = 2) -> DataFrame:
    """``key, n, r``: shingles of each set, and those of them that another set has too.

    Only such can be shared, so a set of which they are too few has no similar one and leaves. Then what
    it alone shared with others counts no more: a second round.
    """
    for _ in range(rounds):
        each = known.select("key", F.explode("set").alias("h"))
        own = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1").groupBy("key").agg(F.count(F.lit(1)).alias("u"))
        marks = known.select("key", F.size("set").alias("n")).join(own, "key", "left").select("key", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("r"))
        marks = materialize(marks.where(F.col("r") * SIMILAR[1] >= F.col("n") * SIMILAR[0]), "marks")
        known = known.join(marks.select("key"), "key", "left_semi")
    return marks


def possible(r: Column, n: Column, s: Column, m: Column) -> Column:
    """Sets of n and m shingles can be similar, if they share all of the fewer shareable ones (r, s)."""
    return F.least(r, s) * sum(SIMILAR) >= (n + m) * SIMILAR[0]


def anchored(prints: DataFrame) -> DataFrame:
    """Of each class of linked fingerprints, the smallest key beside each other one (a, b). ``prints``: key, fp."""
    prints = materialize(prints.distinct(), "prints")
    _, roots = simhash.classes(prints.select("fp").distinct())
    placed = materialize(prints.join(roots, "fp", "left").select("key", F.coalesce("root", "fp").alias("root")), "anchored")
    least = placed.groupBy("root").agg(F.min("key").alias("a"), F.max("key").alias("most")).where("a <> most").select("root", "a")
    return placed.join(materialize(least, "least"), "root").where("a <> key").select("a", F.col("key").alias("b"))


def classes(keys: DataFrame, texts: Callable[[DataFrame], DataFrame], linked: DataFrame) -> DataFrame:
    """``node, root`` of all keys linked to others. ``keys``: key, bands; ``texts``: key, text of the rows of
    ``key`` it is given; ``linked``: pairs (a, b) that are linked as it is.

    In each band the key with the least share of shingles of its own is compared with the others, so a
    large class costs its size and not its square. Then, in bands whose keys are not all in one class,
    every pair of two classes is compared that can be similar: pairs within a class would change nothing.
    """
    rows = keys.select("key", F.explode("bands").alias("band"))
    shared = materialize(rows.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("band"), "shared")
    # written, here and below, so that AQE can split the joins where a band is hot
    members = materialize(rows.join(shared, "band").select("band", "key"), "members")
    known = texts(members.select("key").distinct()).select("key", F.arrow_udf(sets, "array<bigint>")("text").alias("set"))
    known = materialize(known, "sets")
    members = materialize(members.join(shareable(known), "key").select("band", "key", "n", "r"), "viable")
    least = members.groupBy("band").agg(F.min(F.struct(((F.col("n") - F.col("r")) / F.col("n")).alias("own"), "key", "n", "r")).alias("l"), F.count(F.lit(1)).alias("k"))
    least = materialize(least.where("k > 1").select("band", F.col("l.key").alias("a"), F.col("l.n").alias("m"), F.col("l.r").alias("s")), "least")
    bound = possible(F.col("r"), F.col("n"), F.col("s"), F.col("m"))
    first = members.join(least, "band").where((F.col("a") != F.col("key")) & bound)
    first = materialize(first.select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct(), "first")
    roots = materialize(components(similar(first, known).unionByName(linked)), "roots")
    placed = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "n", "r", F.coalesce("root", "key").alias("root"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    left = materialize(placed.join(mixed, "band").join(keys, "key"), "mixed")
    other = left.select("band", F.col("key").alias("b"), F.col("n").alias("m"), F.col("r").alias("s"), F.col("root").alias("t"), F.col("bands").alias("c"))
    once = F.array_min(F.array_intersect("bands", "c")) == F.col("band")  # a pair comes from one of its bands
    pairs = left.join(other, "band").where((F.col("root") < F.col("t")) & bound & once).select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b"))
    pairs = materialize(pairs.join(first, ["a", "b"], "left_anti"), "second")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(similar(pairs, known)))


def place() -> Column:
    """Of a row: equal for rows alike in ``__id`` and ``__h``, and hardly for others."""
    return F.xxhash64("__id", "__h")


def picked(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``keyed`` that ``rows`` (``__id, __h`` and more, each once, written) has, with its columns.
    Only they are moved, and a few others that pass its Bloom filter."""
    inside = bloom.build(rows.select(place().alias("place")), rows.count())
    return keyed.where(bloom.passes(inside, place())).join(rows, ["__id", "__h"])


def one_each(keyed: DataFrame, all_rows: DataFrame, first: DataFrame) -> DataFrame:
    """Of ``keyed`` one row for each ``__id, __h`` of ``first`` (each once, written). ``all_rows`` has those of
    every row.

    What stands alone and stays is not moved: a Bloom filter has all the others, those that leave or are
    repeated, and only what passes it and that of ``first`` is joined.
    """
    counts = all_rows.groupBy("__id", "__h").agg(F.count(F.lit(1)).alias("n"))
    other = counts.join(first.withColumn("stays", F.lit(True)), ["__id", "__h"], "left").where("stays is null or n > 1")
    other = materialize(other.select(place().alias("place")).distinct(), "other")
    n_other = other.count()
    if not n_other:
        return keyed
    doubtful = bloom.passes(bloom.build(other, n_other), place())
    discard(other)
    return keyed.where(~doubtful).unionByName(picked(keyed.where(doubtful), first).dropDuplicates(["__id", "__h"]))


@any_names("doc_id", "text")
def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: that of the smallest doc_id (then text
    hash); of rows alike in both, one. Texts without a word are one class."""
    keyed = docs.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), "__h": F.xxhash64(F.col(text))})
    sketch, sign = F.arrow_udf(sketches, "struct<key bigint, bands array<bigint>>"), F.arrow_udf(simhash.fingerprints_of, "bigint")
    base = keyed.select("__id", "__h", sketch(F.col(text)).alias("s"), sign(F.col(text)).alias("fp"))
    base = materialize(base.select("__id", "__h", "fp", "s.*"), "sketches")
    keys = materialize(base.groupBy("key").agg(F.min(F.struct("__id", "__h")).alias("k"), F.first("bands").alias("bands")), "keys")

    def texts(wanted: DataFrame) -> DataFrame:
        rows = keys.join(wanted, "key").select("key", F.col("k.__id").alias("__id"), F.col("k.__h").alias("__h"))
        found = picked(keyed.select("__id", "__h", F.col(text).alias("text")), materialize(rows, "wanted"))
        return found.dropDuplicates(["__id", "__h", "key"]).select("key", "text")

    roots = classes(keys.select("key", "bands"), texts, anchored(base.select("key", "fp")))
    of = keys.select("key", "k").join(roots.withColumnRenamed("node", "key"), "key", "left")
    first = of.groupBy(F.coalesce("root", "key").alias("class")).agg(F.min("k").alias("k"))
    first = materialize(first.select(F.col("k.__id").alias("__id"), F.col("k.__h").alias("__h")), "first")
    discard(keys)
    kept = one_each(keyed, base.select("__id", "__h"), first)
    discard(base)
    return kept.select(*docs.columns)
