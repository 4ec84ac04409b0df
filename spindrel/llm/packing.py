"""Packing documents into fixed windows: non-negative least squares over length combinations, then a greedy rest.

Each task packs the documents that it reads, in blocks of bounded size, so there is no shuffle, no length is a
hot key, and a lost task is simply run again. A document of more than a window is cut into whole windows and a
rest. The histogram of the rests' lengths is met by repeat counts of shallow combinations (two or three lengths
that fill a window exactly), found by non-negative least squares and rounded down; what stays is packed
greedily, longest first into the fullest open window, cutting a piece where it fills a window to the end. The
open windows at the end of a block are carried to the next one; at the end of a task their content goes
into windows of powers of two, which are not padded.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END = 1
VOCABULARY = "byte_bpe_50k"
#: Documents whose rests are packed together; bounds a task's memory with BLOCK_IDS.
BLOCK_ROWS, BLOCK_IDS = 20_000, 2_000_000
#: Combinations tried for a block.
COMBINATIONS = 6000
#: Texts outside these ranges go to the `tokenizers` library itself; inside, its ids and tiktoken's were found equal.
PLAIN = r"[^\x00-ͯЀ-ӿ‐-‧€]|<\|"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long, sequence_tokens long"


class Encoder:
    """Ids of texts as `tokenizers` gives them for byte_bpe_50k.json without added special tokens.

    The same vocabulary as ranks, through tiktoken, is several times faster; it is used for texts without
    characters on whose classes the two libraries' Unicode tables could differ and without special tokens.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import base64
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.exact = public_tokenizers.path(f"{vocabulary}.json"), None
        self.odd = re.compile(PLAIN)

    def __call__(self, text: str) -> list[int]:
        if self.odd.search(text):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that (nearly) minimises |a x - b|, by projected gradients with momentum; `a` as (lengths per row, ids) lists."""
    n = len(a)
    x = np.zeros(n)
    z, t = x, 1.0
    size = len(b)
    weight = (a < size).astype(float)
    at = np.minimum(a, size - 1)
    degree = np.bincount(at.ravel(), weights=weight.ravel(), minlength=size)
    step = 1.0 / max(1.0, (degree[at] * weight).sum(1).max())
    for _ in range(rounds):
        fit = np.bincount(at.ravel(), weights=(weight * z[:, None]).ravel(), minlength=size)
        new = np.maximum(0.0, z - step * ((fit - b)[at] * weight).sum(1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int, most: int) -> np.ndarray:
    """Pairs and triples of present lengths that fill the window; a row each, in triples padded with `window` + 1."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    pairs = lengths[have[window - lengths] & (lengths * 2 <= window)]
    rows = [np.column_stack([pairs, window - pairs, np.full(len(pairs), window + 1)])]
    left = most - len(pairs)
    common = lengths[np.argsort(-counts, kind="stable")]
    for a in common:
        if left <= 0:
            break
        b = lengths[(lengths >= a) & (window - a - lengths >= lengths)]
        c = window - a - b
        fits = have[c] & (c > 0)
        b, c = b[fits][:left], c[fits][:left]
        rows.append(np.column_stack([np.full(len(b), a), b, c]))
        left -= len(b)
    return np.concatenate(rows)


class Packer:
    """Packs one task's documents; `full` gets (row, start, length, sequence, offset, total) of finished sequences."""

    def __init__(self, base: int, window: int = WINDOW) -> None:
        self.base, self.window, self.next = base, window, 0
        self.open: list[list[tuple[int, int, int]]] = []
        self.out: list[tuple[int, int, int, int, int, int]] = []

    def emit(self, pieces: list[tuple[int, int, int]]) -> None:
        total, at = sum(p[2] for p in pieces), 0
        for row, start, length in pieces:
            self.out.append((row, start, length, self.base + self.next, at, total))
            at += length
        self.next += 1

    def block(self, sizes: list[tuple[int, int]]) -> None:
        """sizes: (row, tokens). Whole windows first, then combinations, then the greedy rest."""
        window, rests = self.window, defaultdict(deque)
        for row, n in sizes:
            whole = n // window * window
            for start in range(0, whole, window):
                self.emit([(row, start, window)])
            if n > whole:
                rests[n - whole].append((row, whole, n - whole))
        lengths = np.array(sorted(rests), dtype=np.int64)
        if len(lengths):
            counts = np.array([len(rests[n]) for n in lengths.tolist()])
            if len(combos := combinations(lengths, counts, window, COMBINATIONS)):
                histogram = np.zeros(window + 1)
                histogram[lengths] = counts
                repeats = np.floor(nnls(combos, histogram) + 1e-6).astype(int)
                for k in np.argsort(-repeats, kind="stable").tolist():
                    need = [n for n in combos[k].tolist() if n <= window]
                    for _ in range(min(repeats[k], *(len(rests[n]) // need.count(n) for n in need))):
                        self.emit([rests[n].popleft() for n in need])
        self.greedy([p for n in sorted(rests, reverse=True) for p in rests[n]])

    def greedy(self, pieces: list[tuple[int, int, int]]) -> None:
        """Best fit by remaining room; a piece that fits nowhere fills the fullest window and its rest goes on."""
        room: list[list[list[tuple[int, int, int]]]] = [[] for _ in range(self.window + 1)]
        free = np.zeros(self.window + 1, np.int64)

        def put(pack: list) -> None:
            left = self.window - sum(p[2] for p in pack)
            if left:
                room[left].append(pack)
                free[left] += 1
            else:
                self.emit(pack)

        for pack in self.open:
            put(pack)
        for row, start, length in pieces:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                left = int(fits[0]) + length
            elif free.any() and free.sum() >= 8:  # cutting starts when windows stay open, so that few do
                left = int(np.flatnonzero(free)[-1])
            else:
                put([(row, start, length)])
                continue
            pack = room[left].pop()
            free[left] -= 1
            put([*pack, (row, start, min(length, left))])
            if length > left:
                put([(row, start + left, length - left)])
        self.open = [pack for packs in room for pack in packs]

    def finish(self) -> None:
        """The open windows' pieces, cut into windows of the powers of two that add up to them: nothing is padded."""
        pieces = deque(p for pack in self.open for p in pack)
        total, self.open = sum(p[2] for p in pieces), []
        while total:
            size = min(self.window, 1 << (total.bit_length() - 1))
            total, pack = total - size, []
            while size:
                row, start, length = pieces.popleft()
                take = min(size, length)
                pack.append((row, start, take))
                size -= take
                if take < length:
                    pieces.appendleft((row, start + take, length - take))
            self.emit(pack)


def pack(docs: DataFrame, window: int = WINDOW, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text, ...) -> a row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_tokens.

    Null and empty texts are documents of the end id alone. Repeated rows are packed each for itself, a very long text is cut into as
    many windows as it needs. Sequence ids carry the task's number in their upper bits. Other columns are
    not read. An empty table gives no rows. `window` must be a power of two.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 33, window)
        kept: dict[int, tuple] = {}
        serial, waiting, held = 0, [], 0

        def drain() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(packer.out), 1024):
                part = packer.out[at : at + 1024]
                cols = list(zip(*part, strict=True))
                docs_ = [kept[row] for row in cols[0]]
                ids = [d[1][4 * s : 4 * (s + n)] for d, s, n in zip(docs_, cols[1], cols[2], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d[0] for d in docs_], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(ids, pa.binary()), pa.array([len(d[1]) // 4 for d in docs_], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[3:])],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"],
                )
            packer.out.clear()
            still = {p[0] for pack_ in packer.open for p in pack_}
            for row in [row for row in kept if row not in still]:
                del kept[row]

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end)
                kept[serial] = (doc_id, np.array(ids, dtype="<u4").tobytes())
                waiting.append((serial, len(ids)))
                held += len(ids)
                serial += 1
                if len(waiting) >= BLOCK_ROWS or held >= BLOCK_IDS:
                    packer.block(waiting)
                    waiting, held = [], 0
                    yield from drain()
        packer.block(waiting)
        packer.finish()
        yield from drain()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
