"""Content-defined samples: of all grams within a window, the one with the least hash.

Equal windows have equal samples, wherever they stand. So what repeats can be sought among windows
with the same sample, and runs of windows with one sample stand for all of them.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_LOW = 24
_MASK = np.uint64((1 << _LOW) - 1)
#: Units (bytes or words) in one call, so that positions fit beside the hashes.
MOST = 1 << (_LOW - 1)
_B = 0x9E3779B97F4A7C15 | 1


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_B, pow(_B, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        for k in range(bits):  # doubling
            p[1 << k : 2 << k] = p[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
        out.append(p)
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` units from each position that has as many after it."""
    n = len(units)
    if n < gram:
        return np.zeros(0, np.uint64)
    up, down = _powers(max(4, (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position on."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return np.minimum(behind[:last], ahead[width - 1 : width - 1 + last])


def regions(units: np.ndarray, offsets: np.ndarray, window: int, gram: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, number of windows and sample of each run of windows with the same sample.

    ``units`` are documents end to end, at ``offsets``; a run lies in one document and starts at
    ``start`` units in all. The sample is the last gram with the least hash in the window, so a
    window's place beside it follows from its content, and no two windows of a run are equal. ``only``
    tells the starts of windows that count.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    lengths = np.diff(offsets)
    n = len(units)
    if n < window or not (lengths >= window).any() or (only is not None and not only.any()):
        return none
    hashes = gram_hashes(units, gram)
    at = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(hashes & ~_MASK | (_MASK - at), window - gram + 1)
    anchor = (_MASK - (least & _MASK)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)  # windows that end within their document
    ok = lengths >= window
    inside[offsets[:-1][ok]] += 1
    inside[offsets[1:][ok] - window + 1] -= 1
    within = np.cumsum(inside[:n]) > 0
    valid = np.flatnonzero(within if only is None else within & only)
    if not len(valid):
        return none
    a = anchor[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(valid)))
    start = valid[first]
    return np.searchsorted(offsets, start, "right") - 1, start, count, hashes[a[first]]
