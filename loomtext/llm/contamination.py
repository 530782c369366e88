"""Benchmark decontamination by an FM-index of each training shard."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window.
WINDOW = 13
#: Bytes of benchmark text in a block. A block holds numbers for words and windows (about 25 bytes a word)
#: and its vocabulary (about 120 bytes a distinct word): 100 MB at worst, if no word of it occurs twice. The
#: driver and each worker hold one block at a time.
BLOCK_BYTES = 4 << 20
#: Windows searched at a time.
SEARCH = 1 << 16
#: Tokens of a training shard, the unit that is indexed at a time within a task.
SHARD_TOKENS = 1 << 19
#: One in so many positions keeps its place in the text.
SAMPLE = 8

#: A-Z to a-z; what is neither a letter, a digit nor beyond ASCII to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WaveletTree:
    """Rank over a sequence of integers: one bit vector a level, from the highest bit down."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(values), bits, []
        for b in range(bits - 1, -1, -1):
            bit = values >> b & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
            self.levels.append((ones, self.n - int(ones[-1])))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of ``symbol`` stand before ``at``, for arrays of both."""
        low, high = np.zeros_like(at), at
        for (ones, zeros), b in zip(self.levels, range(self.bits - 1, -1, -1), strict=True):
            up = (symbol >> b & 1).astype(bool)
            l1, h1 = ones[low], ones[high]
            low, high = np.where(up, zeros + l1, low - l1), np.where(up, zeros + h1, high - h1)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for ones, zeros in self.levels:
            one = ones[at + 1] - ones[at]
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
            value = value << 1 | one
        return value


class FMIndex:
    """Backward search over a token sequence; symbol 0 separates and is never searched."""

    def __init__(self, tokens: np.ndarray, symbols: int):
        tokens = np.concatenate((tokens, [0])).astype(np.int64)
        n = len(tokens)
        sa = rank_doubling(tokens)
        self.bwt = WaveletTree(tokens[sa - 1], max(1, int(symbols).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=symbols + 2))))
        # the first token of a run is sampled too: no step leads over a separator
        self.marked = (sa % SAMPLE == 0) | (tokens[sa - 1] == 0)
        self.sampled = sa[self.marked]
        self.before = np.concatenate(([0], np.cumsum(self.marked, dtype=np.int32)))
        self.n = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern (rows of equal length)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            s = patterns[live, k]
            low[live] = self.first[s] + self.bwt.rank(s, low[live])
            high[live] = self.first[s] + self.bwt.rank(s, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps to the previous token until a sampled position."""
        out, steps, rows, live = np.zeros(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(live):
            here = rows[live]
            done = self.marked[here]
            out[live[done]] = self.sampled[self.before[here[done]]] + steps
            live = live[~done]
            here = rows[live]
            s = self.bwt.access(here)
            rows[live] = self.first[s] + self.bwt.rank(s, here)
            steps += 1
        return out % self.n


def rank_doubling(tokens: np.ndarray) -> np.ndarray:
    """Suffix array; each separator gets a rank of its own, so that order is settled at the next one.

    Runs between separators decide the number of rounds.
    """
    n = len(tokens)
    rank = tokens + n  # tokens sort after all separators
    stops = np.flatnonzero(tokens == 0)
    rank[stops] = np.arange(len(stops))
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-width] = rank[width:] + 1
        key = np.where(rank < len(stops), 0, second)
        order = np.lexsort((key, rank))
        r, k = rank[order], key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], (r[1:] != r[:-1]) | (k[1:] != k[:-1]))))
        if new.max() == n - 1 or width >= n:
            return order
        rank = new
        width *= 2


class Windows:
    """The distinct windows of some benchmark items: the numbers of all words end to end, and of each length
    the place of every window in them and the items that have it."""

    def __init__(self, items: list[tuple[object, bytes | None]]):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[str, int] = {}
        tokens: list[np.ndarray] = []
        owners: dict[int, dict[bytes, list[int]]] = {}  # by length: a place, then items
        size = 0
        for item, text in items:
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or b"")], np.int32)
            if len(words):
                own, k, raw = number.setdefault(str(item), len(number)), min(WINDOW, len(words)), words.tobytes()
                of_length = owners.setdefault(k, {})
                for i in range(len(words) - k + 1):
                    found = of_length.setdefault(raw[4 * i : 4 * (i + k)], [size + i])
                    if own not in found[1:]:
                        found.append(own)
                tokens.append(words)
                size += len(words)
        self.items = list(number)
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        self.starts = {k: np.array([v[0] for v in found.values()], np.int32) for k, found in owners.items()}
        self.ends = {k: np.cumsum([len(v) - 1 for v in found.values()], dtype=np.int32) for k, found in owners.items()}
        self.owned = {k: np.array([x for v in found.values() for x in v[1:]], np.int32) for k, found in owners.items()}
        self.shortest = min(owners, default=0)

    def patterns(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """Windows of ``k`` words, some at a time, with the number of the first."""
        for a in range(0, len(self.starts[k]), SEARCH):
            yield a, self.tokens[self.starts[k][a : a + SEARCH, None] + np.arange(k)].astype(np.int64)

    def owners(self, k: int, window: int) -> list[int]:
        return self.owned[k][self.ends[k][window - 1] if window else 0 : self.ends[k][window]].tolist()


def runs(ids: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Stretches of known words that a window can lie in."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ids > 0, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= shortest
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def find(texts: list[bytes | None], windows: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[set[int]]]:
    """Of each text: number of words, merged spans of hit words, and numbers of the items found.

    Words that no item has end every window, so a shard's sequence holds only the stretches of known
    words as long as the shortest window, with a separator after each.
    """
    n_words, spans, found = [], [[] for _ in texts], [set() for _ in texts]
    tokens: list[np.ndarray] = []
    places: list[tuple[int, int, int]] = []  # position in the shard, text, word
    size = 0
    zero = np.zeros(1, np.int64)

    def flush() -> None:
        nonlocal tokens, places, size
        if places:
            index = FMIndex(np.concatenate(tokens), len(windows.vocabulary))
            at = np.array([p[0] for p in places])
            for k in windows.starts:
                for before, patterns in windows.patterns(k):
                    low, high = index.search(patterns)
                    for w in np.flatnonzero(high > low).tolist():
                        owners = windows.owners(k, before + w)
                        # a very common window is located in parts
                        for a in range(int(low[w]), int(high[w]), 1 << 16):
                            where = index.locate(np.arange(a, min(a + (1 << 16), int(high[w]))))
                            for p, run in zip(where.tolist(), (np.searchsorted(at, where, "right") - 1).tolist(), strict=True):
                                start, text, word = places[run]
                                spans[text].append((word + p - start, word + p - start + k))
                                found[text].update(owners)
        tokens, places, size = [], [], 0

    get = windows.vocabulary.get
    for t, text in enumerate(texts):
        words = words_of(text) if text else []
        n_words.append(len(words))
        if len(words) >= windows.shortest > 0:
            ids = np.array([get(w, 0) for w in words], np.int64)
            for a, b in runs(ids, windows.shortest):
                places.append((size, t, a))
                tokens += [ids[a:b], zero]
                size += b - a + 1
            if size >= SHARD_TOKENS:
                flush()
    flush()
    return n_words, [merged(s) for s in spans], found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


RESULT = "struct<n_words bigint, spans array<struct<s bigint, e bigint>>, items array<string>>"
KIND = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def judge(blocks: list[Broadcast]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            raw = texts.cast(pa.binary()).to_pylist()
            n, spans, items = [len(words_of(t)) if t else 0 for t in raw], [[] for _ in raw], [set() for _ in raw]
            for block in blocks:
                windows = block.value
                for own, names, more, found in zip(spans, items, *find(raw, windows)[1:], strict=True):
                    own += more
                    names.update(windows.items[k] for k in found)
                del windows
                if len(blocks) > 1:  # else all blocks would stay in the worker; a later batch reads it again
                    vars(block).pop("_value", None)
            rows = zip(n, spans, items, strict=True)
            yield pa.array([{"n_words": a, "spans": [{"s": x, "e": y} for x, y in merged(b)], "items": sorted(c)} for a, b, c in rows], KIND)

    return hits


def contaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "hits") -> DataFrame:
    """``docs`` with the struct ``out``: n_words, spans (merged, of hit words) and items found.

    The benchmark is taken in blocks of about BLOCK_BYTES, each read to the driver and sent to all tasks,
    which search one after the other in one pass over the documents. One item is never divided. Rows of
    one item_id are one item with the windows of all. A null item_id is named ``null``; null or wordless
    texts have no window. No shuffle: each row is judged where it is, in shards of SHARD_TOKENS.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    shared, blocks = [], -(-size // BLOCK_BYTES) or 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).toLocalIterator()
        shared.append(spark.sparkContext.broadcast(Windows([(r.i if r.i is not None else "null", r.t.encode() if r.t is not None else None) for r in rows])))
    return docs.withColumn(out, F.arrow_udf(judge(shared), RESULT)(F.col(text)))


def n_hit(hits: str = "hits"):
    """Words covered by the spans, which may overlap after several passes."""
    return F.aggregate(
        F.array_sort(f"{hits}.spans"),
        F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["e"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def contaminated(hits: str = "hits"):
    """At least one word in twenty is hit."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(f"{hits}.n_words"))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
