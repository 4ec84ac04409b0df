"""Removing repeated byte strings: suffix arrays by prefix-free parsing.

In a shard, contexts (see `repeats`) are cut into phrases where a rolling hash triggers, each phrase reaching a trigger's
width into the next, so that none is a proper prefix of another. Different phrases form the dictionary, their
ranks in each context the parse. Suffixes of the dictionary's phrases and suffixes of the parse are
sorted by prefix doubling; together they order the corpus's suffixes: first by what is left of the phrase, then by the parse from the next
phrase on. Equal windows are neighbours in that order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats

WINDOW = 400
#: Bytes of a phrase trigger, and one trigger in so many places on average.
TRIGGER, EVERY = 8, 32
#: Contexts of a shard: a parse holds some ten numbers of eight bytes for each byte, about 150 MB here.
SHARD = 2_000

_SYMBOLS = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), "<u8") | np.uint64(1)


def classes(first: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """Ranks (from 1) of the suffixes that run to `ends`, equal ones alike, from ranks `first` of their first `step` symbols.

    Prefix doubling; a class's rank is the place of its first member, so that a round only touches classes still mixed.
    """
    n = len(first)
    order = np.argsort(first)
    fresh = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place + 1
    alone = fresh & np.append(fresh[1:], True)
    mixed = order[~alone]
    while len(mixed):
        follows = mixed + step
        after = np.where(follows < ends[mixed], rank[np.minimum(follows, n - 1)], 0)
        before, going = rank[mixed], after > 0
        sort = np.argsort(before * (n + 2) + after)
        mixed, before, after, going = mixed[sort], before[sort], after[sort], going[sort]
        old = np.concatenate([[True], before[1:] != before[:-1]])
        new = old | np.concatenate([[True], after[1:] != after[:-1]])
        here = np.arange(len(mixed))
        base = np.maximum.accumulate(np.where(old, here, 0))
        own = np.maximum.accumulate(np.where(new, here, 0))
        rank[mixed] = before + own - base
        mixed = mixed[~(new & np.append(new[1:], True)) & going]  # alone, or at their ends: settled
        step *= 2
    return rank


class Parse:
    """Prefix-free parse of many byte strings; `key(positions)` orders their suffixes."""

    def __init__(self, texts: list[bytes], trigger: int = TRIGGER, every: int = EVERY) -> None:
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        self.raw, self.begin = raw, ends - sizes
        self.rolling = repeats.Rolling(_SYMBOLS[raw])
        cut = np.zeros(len(raw), bool)
        if len(raw) >= trigger:
            cut[: len(raw) - trigger + 1] = repeats.mix(self.rolling.fixed(trigger)) % np.uint64(every) == 0
        for back in range(trigger):  # a trigger lies inside its text
            cut[ends[sizes > back] - 1 - back] = False
        cut[self.begin[sizes > 0]] = True
        start = np.flatnonzero(cut)
        text_end = ends[np.searchsorted(ends, start, side="right")]
        stop = np.minimum(np.minimum(np.append(start[1:], len(raw)), text_end) + trigger, text_end)
        stop = np.where(np.append(start[1:], len(raw)) >= text_end, text_end, stop)
        name = repeats.mix(self.rolling.of(start, stop) ^ repeats.mix((stop - start).astype(np.uint64)))
        _, pick, phrase = np.unique(name, return_index=True, return_inverse=True)
        length = (stop - start)[pick]  # the dictionary: one copy of each phrase
        at = np.cumsum(length) - length
        letters = raw[np.repeat(start[pick] - at, length) + np.arange(length.sum())].astype(np.int64) + 1
        ends_ = np.repeat(at + length, length)
        head, here = np.zeros(len(letters), np.int64), np.arange(len(letters))
        for i in range(6):  # six letters of nine bits start the doubling
            head = head * 512 + np.where(here + i < ends_, letters[np.minimum(here + i, len(letters) - 1)], 0)
        self.suffix = classes(head, ends_, 6)
        order = self.suffix[at][phrase]
        owner = np.searchsorted(ends, start, side="right")
        parse_end = np.searchsorted(owner, owner, side="right")
        tail = np.append(classes(order, parse_end, 1), 0)
        following = np.arange(len(start)) + 1
        self.next = np.where(following < parse_end, tail[np.minimum(following, len(start))], 0)
        self.start, self.at = start, at[phrase]

    def key(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of the rest of the phrase, rank of the parse after it)."""
        phrase = np.searchsorted(self.start, positions, side="right") - 1
        return self.suffix[self.at[phrase] + positions - self.start[phrase]], self.next[phrase]


def find(length: int):
    def run(shard: pa.Table) -> pa.Table:
        first, contexts = repeats.distinct_contexts(shard)
        parse = Parse(contexts)
        windows = np.array([len(c) for c in contexts]) - length + 1
        which = np.repeat(np.arange(len(contexts)), windows)
        at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        place = parse.begin[which] + at
        rest, after = parse.key(place)
        order = np.lexsort((after, rest))
        string = parse.rolling.of(place[order], place[order] + length)
        same = string[1:] == string[:-1]
        hit = np.zeros(len(place), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        return repeats.window_rows(shard, first, which[hit], at[hit], length)

    return run


def byte_codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return _SYMBOLS[raw], raw


def dedup(docs: DataFrame, window: int = WINDOW, hot: int = repeats.HOT, shard: int = SHARD) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, removed array<struct<start, stop>> in bytes, kept binary (the other bytes).

    A byte is removed if any string of `window` bytes that covers it starts at another place as well, in this or
    another document. One row out per row in; rows repeated with their id and text are places of their own. Null and empty texts have no
    bytes. Very long texts are read in overlapping pieces. Other columns are not read. An empty table gives no rows. Kept bytes may end
    inside a character, so they are binary.
    """
    scheme = repeats.Scheme(window, 16, max(2, min(128, window // 3)), byte_codes)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string"))
    found = repeats.repeated(rows, scheme, find(window), hot, shard)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, starts, stops in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                gone = repeats.merged(starts, stops)
                stay, at = [], 0
                for a, b in gone:
                    stay.append(raw[at:a])
                    at = b
                sizes.append(len(raw))
                spans.append([{"start": a, "stop": b} for a, b in gone])
                kept.append(b"".join([*stay, raw[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    joined = repeats.with_stretches(rows, found).select("doc_id", "text", "starts", "stops")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")
