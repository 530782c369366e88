"""A set of 64-bit keys as a bit array of bounded size: no key is missed, a few others pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block; a key has its bits within one block.
BLOCK = 1 << 16
#: The array never has more bits (64 MB). With more keys it lets more others pass, and stays right.
MOST_BITS = 1 << 29
PER_KEY = 16


def _bits(keys: np.ndarray, blocks: int) -> list[np.ndarray]:
    h = keys.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    block = (h >> np.uint64(40)) % np.uint64(blocks)
    h ^= h >> np.uint64(35)
    h *= np.uint64(0x9FB21C651E98DF25)
    return [(block * np.uint64(BLOCK) + (h >> np.uint64(s)) % np.uint64(BLOCK)).astype(np.int64) for s in (48, 32, 16)]


class Bloom:
    def __init__(self, array: np.ndarray):
        self.array = array

    def __contains__(self, keys: np.ndarray) -> bool:
        return bool(self.contains(np.atleast_1d(keys)).all())

    def contains(self, keys: np.ndarray) -> np.ndarray:
        ok = np.ones(len(keys), bool)
        for bit in _bits(keys, len(self.array) * 8 // BLOCK):
            ok &= (self.array[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
        return ok


def build(keys: DataFrame, count: int) -> Broadcast:
    """Of the distinct keys in the one bigint column; each block is made by the task that has its keys."""
    wanted = max(1, min(MOST_BITS, count * PER_KEY) // BLOCK)
    blocks = 1 << (wanted - 1).bit_length() if wanted > 1 else 1
    name = keys.columns[0]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            bits = np.concatenate(_bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), blocks))
            bits.sort()
            at = bits // BLOCK
            for part in np.split(bits, np.flatnonzero(np.diff(at)) + 1) if len(bits) else ():
                b = int(part[0]) // BLOCK
                flags = own.setdefault(b, np.zeros(BLOCK, bool))
                flags[part - b * BLOCK] = True
        for b, flags in own.items():
            yield pa.record_batch([pa.array([b]), pa.array([np.packbits(flags, bitorder="little").tobytes()])], ["block", "bits"])

    # the block as _bits has it, so that a block is filled in one place
    made = keys.select(F.col(name).alias("key")).mapInArrow(fill, "block bigint, bits binary") if blocks == 1 else None
    if made is None:

        def with_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.record_batch([batch.column(0), pa.array(_bits(k.view(np.uint64), blocks)[0] // BLOCK)], ["key", "block"])

        placed = keys.select(F.col(name).alias("key")).mapInArrow(with_block, "key bigint, block bigint")
        made = placed.repartition("block").select("key").mapInArrow(fill, "block bigint, bits binary")
    array = np.zeros(blocks * BLOCK // 8, np.uint8)
    for row in made.toLocalIterator():
        at = row["block"] * BLOCK // 8
        array[at : at + BLOCK // 8] |= np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(Bloom(array))


def passes(inside: Broadcast, key: Column) -> Column:
    """Whether the filter has the key (bigint, never null). Only the key goes to Python, not the row."""
    return F.arrow_udf(lambda k: pa.array(inside.value.contains(k.to_numpy(zero_copy_only=False).view(np.uint64))), "boolean")(key)
