"""Removing repeated word sequences: a compressed FM-index per shard answers how far a text matches another one.

Contexts (see `repeats`) are streamed against the FM-index of their shard: backward search over a wavelet matrix extends
matches word by word to the left and stops where a match is unique. Where it reaches the window's length
the window occurs in another context. The length reached is the matching statistic of the window's last word, cut off at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats

WINDOW = 35


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of an integer text whose suffixes all differ within `depth` symbols, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k, n = 1, len(text)
    while k <= 2 * depth and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable")


class Bits:
    """A bit vector with constant-time rank: packed words and a running count for each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        low = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class FMIndex:
    """The Burrows-Wheeler transform of an integer text in a wavelet matrix, a bit vector for each bit of a symbol."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        order = suffix_array(text, depth)
        column = text[order - 1]  # the symbol before each suffix; that of the first is the last one, a separator
        size = int(text.max()) + 1
        self.size = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, size.bit_length()) - 1, -1, -1):
            on = (column >> bit) & 1
            self.levels.append((bit, Bits(on), int(len(on) - on.sum())))
            column = np.concatenate([column[on == 0], column[on == 1]])
        self.begin = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbols >> bit) & 1, zeros + ones, i - ones)
        return i

    def step(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """One backward step of interval ends: suffixes that start with the symbol before the first i."""
        return self.first[symbols] + self._walk(symbols, i) - self.begin[symbols]


def matching(index: FMIndex, text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For windows of the indexed text: symbols from their end that occur at least twice, at most `length`."""
    reached = np.zeros(len(starts), np.int64)
    alive = np.arange(len(starts))
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), index.size, np.int64)
    for back in range(1, length + 1):
        symbols = text[starts[alive] + length - back]
        low, high = index.step(symbols, low), index.step(symbols, high)
        more = high - low > 1  # one occurrence is the window itself
        alive, low, high = alive[more], low[more], high[more]
        reached[alive] = back
        if not len(alive):
            break
    return reached


def find(length: int):
    def run(shard: pa.Table) -> pa.Table:
        first, contexts = repeats.distinct_contexts(shard)
        words = [np.frombuffer(c, "<u8") for c in contexts]
        sizes = np.array([len(w) for w in words])
        ids = np.unique(np.concatenate(words), return_inverse=True)[1] + len(words)
        ends = np.cumsum(sizes)
        text = np.insert(ids, ends, np.arange(len(words)))  # a separator of its own ends each context
        begin = ends - sizes + np.arange(len(words))
        windows = sizes - length + 1
        which = np.repeat(np.arange(len(words)), windows)
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        index = FMIndex(text, int(sizes.max()) + 1)
        hit = matching(index, text, begin[which] + at, length) >= length
        return repeats.window_rows(shard, first, which[hit], at[hit], length)

    return run


def word_codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w) for w in (text or "").encode().split()], dtype="<u8")
    return hashes | np.uint64(1), hashes


def dedup(docs: DataFrame, window: int = WINDOW, hot: int = repeats.HOT, shard: int = repeats.SHARD) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, removed array<struct<start, stop>> in words, kept (the kept words, a space between).

    A word is removed if any window of `window` words that covers it starts at another place as well, in this or
    another document. One row out per row in; rows repeated with their id and text are places of their own. Null and empty texts have no
    words. Very long texts are read in overlapping pieces. Other columns are not read. An empty table gives no rows.
    """
    scheme = repeats.Scheme(window, 3, max(2, window // 3), word_codes)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string"))
    found = repeats.repeated(rows, scheme, find(window), hot, shard)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, starts, stops in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = repeats.merged(starts, stops)
                stay, at = [], 0
                for a, b in gone:
                    stay += words[at:a]
                    at = b
                sizes.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in gone])
                kept.append(b" ".join(stay + words[at:]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string())], names=["doc_id", "n_words", "removed", "kept"])

    joined = repeats.with_stretches(rows, found).select("doc_id", "text", "starts", "stops")
    return joined.mapInArrow(cut, "doc_id long, n_words long, removed array<struct<start:long,stop:long>>, kept string")
