"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import NULL_ID, any_names, materialize, row_key
from loomtext.llm.components import components

#: Bits that may differ between linked fingerprints.
THRESHOLD = 2
#: The binary Golay code: length, radius within which it covers every word, generator polynomial.
LENGTH, RADIUS, POLYNOMIAL = 23, 3, 0b110001110101
#: First bits of the two blocks that carry a Golay code. The other 18 bits are covered by one word.
BLOCKS = (0, 23)
#: Shingles hashed at a time.
CHUNK = 1 << 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of ``size`` words, in order, repeats included.

    A-Z are lower-cased; fewer words are one shingle; no word: none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = (ends[size - 1 :] if len(words) >= size else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: bytes) -> int:
    """64 majority bits of the XXH64 (seed 42) of the text's three-word shingles, repeats included.

    A-Z are lower-cased; fewer than three words are one shingle; no word: 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - 2)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = (ends[2:] if len(words) > 2 else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)], np.uint64)
        ones += bit_counts(hashes)
    return int((ones * 2 > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from the lowest."""
    columns = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # sums of bytes in place, 255 rows at a time, are summed on as 64-bit numbers
    return np.add.reduceat(columns, np.arange(0, len(columns), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)


def fingerprints_of(texts: pa.Array) -> pa.Array:
    out = np.fromiter((fingerprint(t) if t else 0 for t in texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts))
    return pa.array(out.view(np.int64), pa.int64())


@cache
def cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each syndrome: where its error words of weight up to RADIUS + THRESHOLD start, and they and
    their excess over RADIUS. Adding one to a word gives an anchor (code word) that far away."""
    from itertools import combinations

    words = [sum(1 << i for i in c) for w in range(RADIUS + THRESHOLD + 1) for c in combinations(range(LENGTH), w)]
    words = np.array(words, np.int64)
    syndromes = syndrome(words)
    excess = np.maximum(0, np.bitwise_count(words).astype(np.int64) - RADIUS)
    order = np.lexsort((excess, syndromes))
    starts = np.searchsorted(syndromes[order], np.arange((1 << 11) + 1))
    return starts[:-1], np.diff(starts), words[order], excess[order]


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator: 0 for code words."""
    rest = words.copy()
    for i in range(LENGTH - 1, 10, -1):
        rest ^= np.where(rest >> i & 1, POLYNOMIAL << (i - 11), 0)
    return rest


def near_anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code word and excess over RADIUS of all code words within RADIUS + THRESHOLD of each word."""
    first, n, errors, excess = cosets()
    s = syndrome(words)
    rows = np.repeat(np.arange(len(words)), n[s])
    at = np.arange(len(rows)) - np.repeat(np.cumsum(n[s]) - n[s], n[s]) + first[s][rows]
    return rows, words[rows] ^ errors[at], excess[at]


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and whether it is the row's own (the nearest) of all anchors of each fingerprint.

    An anchor has a code word in each block. A fingerprint within THRESHOLD of x exceeds the covering
    radius of x's own anchor by THRESHOLD in all blocks together at most, so those it goes to.
    """
    mask = (1 << LENGTH) - 1
    rows, anchor, used = near_anchors(prints >> BLOCKS[0] & mask)
    for at in BLOCKS[1:]:
        more, word, extra = near_anchors(prints >> at & mask)
        n = np.bincount(more, minlength=len(prints))
        first = np.cumsum(n) - n
        take = n[rows]
        left = np.repeat(np.arange(len(rows)), take)
        right = np.arange(len(left)) - np.repeat(np.cumsum(take) - take, take) + first[rows][left]
        total = used[left] + extra[right]
        ok = total <= THRESHOLD
        left, right = left[ok], right[ok]
        rows, anchor, used = rows[left], anchor[left] << LENGTH | word[right], total[ok]
    return rows, anchor, used == 0


def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for i in range(0, len(prints), 4096):
            part = prints[i : i + 4096]
            rows, anchor, own = anchors(part)
            yield pa.record_batch([pa.array(anchor), pa.array(part[rows]), pa.array(own)], ["anchor", "fp", "own"])


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a < b) of the distinct fingerprints ``fp`` that differ in THRESHOLD bits at most, each once."""
    placed = prints.mapInArrow(replicate, "anchor bigint, fp bigint, own boolean")
    own = placed.where("own").select("anchor", F.col("fp").alias("a"))
    near = placed.select("anchor", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD
    return own.join(near.hint("shuffle_merge"), "anchor").where((F.col("a") < F.col("b")) & close).select("a", "b")


def classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The linked pairs of the distinct fingerprints ``fp``, and ``fp, root`` of those with a link."""
    # each row becomes some sixty: the number of tasks must not follow the few bytes before
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = materialize(links(prints.select("fp").repartition(tasks, "fp")), "pairs")
    return pairs, components(pairs).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, n_links, class, __id, __h``, a row for each row of ``docs``.

    Copies share a fingerprint, so pairs are only ever sought between distinct fingerprints;
    ``n_links`` is the number of other fingerprints linked to the row's. ``component_id`` is the
    smallest doc_id reachable by links, null ids counting as the smallest number.

    Null or empty text: fingerprint zero, linked like any other. No rows: no rows.
    """
    sign = F.arrow_udf(fingerprints_of, "bigint")
    base = row_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    base = materialize(base.select("doc_id", "__id", "__h", sign("text").alias("fp")), "prints")
    prints = materialize(base.groupBy("fp").agg(F.min("__id").alias("least")), "fps")
    pairs, roots = classes(prints)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    known = prints.join(roots, "fp")
    smallest = known.groupBy("root").agg(F.min("least").alias("smallest"))
    of_root = known.select("fp", "root").join(smallest, "root").join(degree, "fp").select("fp", "root", "smallest", "n_links")
    of_print = prints.join(of_root, "fp", "left").select(
        "fp", F.coalesce("smallest", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "fp").alias("class")
    )
    # written, so that AQE can split the join where a fingerprint is hot
    return base.join(materialize(of_print, "classes"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links", "class", "__id", "__h"
    )


@any_names("doc_id", "text")
def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (then text hash); of rows alike
    in both, one."""
    first = near_duplicates(docs, doc_id, text).groupBy("class").agg(F.min(F.struct("__id", "__h")).alias("k"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)), "__h": F.xxhash64(F.col(text))})
    kept = keyed.join(first.select(F.col("k.__id").alias("__id"), F.col("k.__h").alias("__h")), ["__id", "__h"])
    return kept.dropDuplicates(["__id", "__h"]).select(*docs.columns)
