"""Where fixed-length strings of symbols occur more than once in a corpus: the frame of byte and word dedup.

Every window of `length` symbols has an anchor, the smallest gram hash among its first `span` grams (a rolling-hash
trigger, so equal windows have it at the same place). Consecutive windows with one anchor are a run; the stretch of text that a run
covers is its context. A run has two hashes: `whole` of its context and shape, and `core` of the part that any window with this
anchor would hold. Equal windows have equal cores. Three passes over the texts, none of which moves a text:

1. cores are counted; those that occur twice set bits of a filter of fixed size (a filter lets too many pass, never too few);
2. runs whose cores pass are kept. Runs that share `whole` are repeats in full. The others, the open runs, stand at
   the edges of repeats (or passed by chance, and then are alone with their core);
3. contexts of runs whose core has an open run and another context are dealt to shards by core. In a shard, an index over its
   contexts says which single windows occur in more than one. A core with very many different contexts would be a hot
   shard: its windows are counted by hash instead, which any number of tasks can do.

Covered stretches are then joined to the texts by id and text hash. Symbol hashes have 64 bits; equal hashes count as equal strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Symbols of one numpy chunk; bits of a filter; contexts of a shard; different contexts of a core that are too many for a shard.
CHUNK, FILTER_BITS, SHARD, HOT = 400_000, 1 << 27, 8_000, 2_000
#: Contexts that a task remembers so as to send each only once.
SEEN = 500_000

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of any stretch of a symbol array in constant time, through wrapping prefix sums."""

    def __init__(self, symbols: np.ndarray) -> None:
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def fixed(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n]


@dataclass(frozen=True)
class Scheme:
    """length: symbols of a window. gram, span: symbols of a gram and grams that the anchor is chosen from. codes: text -> (symbol hashes, raw symbols)."""

    length: int
    gram: int
    span: int
    codes: Callable[[str | None], tuple[np.ndarray, np.ndarray]]


@dataclass
class Runs:
    """Runs of a chunk: row of the batch, first and last window start in the row's symbols, hashes, and contexts as (start, stop) in `raw`."""

    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    whole: np.ndarray
    core: np.ndarray
    start: np.ndarray
    raw: np.ndarray
    rolling: Rolling


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    width = 1
    while width * 2 <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (span - width)], x[span - width :]) if width < span else x


def chunk_runs(pieces: list[tuple[int, int, np.ndarray, np.ndarray]], scheme: Scheme) -> Runs | None:
    """pieces: (row, offset in the row, symbol hashes, raw symbols), each at least a window long."""
    if not pieces:
        return None
    symbols = np.concatenate([p[2] for p in pieces])
    raw = np.concatenate([p[3] for p in pieces])
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    n, length, span = len(symbols), scheme.length, scheme.span
    rolling = Rolling(symbols)
    grams = mix(rolling.fixed(scheme.gram))
    grams = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(grams, span)[: n - length + 1] & np.uint64(0xFFFFFF)).astype(np.int64)
    inside = np.ones(n - length + 1, bool)
    for end in ends[:-1]:
        inside[max(0, end - length + 1) : end] = False
    at = np.flatnonzero(inside)
    which = anchor[at]
    cut = np.flatnonzero((np.diff(which) != 0) | (np.diff(at) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    lo, hi, which = at[first], at[last], which[first]
    shape = ((which - lo) << 32 | (hi - lo)).astype(np.uint64)
    whole = mix(rolling.of(lo, hi + length) ^ mix(shape + np.uint64(1)))
    core = mix(rolling.of(which, which - span + 1 + length))
    piece = np.searchsorted(ends, lo, side="right")
    base = (ends - sizes)[piece] - np.array([p[1] for p in pieces])[piece]
    return Runs(np.array([p[0] for p in pieces])[piece], lo - base, hi - base, whole.view(np.int64), core.view(np.int64), lo, raw, rolling)


def runs_of(texts, scheme: Scheme) -> Iterator[Runs]:
    """All runs of a batch of texts, in chunks; very long texts are cut into overlapping pieces that keep every window."""
    pieces, size = [], 0
    for row, text in enumerate(texts):
        hashes, raw = scheme.codes(text)
        for offset in range(0, max(1, len(hashes) - scheme.length + 1), CHUNK):
            part = hashes[offset : offset + CHUNK + scheme.length - 1]
            if len(part) < scheme.length:
                continue
            pieces.append((row, offset, part, raw[offset : offset + len(part)]))
            size += len(part)
            if size >= CHUNK:
                yield chunk_runs(pieces, scheme)
                pieces, size = [], 0
    if pieces:
        yield chunk_runs(pieces, scheme)


def filter_of(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> bytes:
    """A filter of `bits` bits with those of the given hashes set; its size does not depend on the data."""
    place = F.pmod(F.col(column), F.lit(bits))
    parts = hashes.select((place / 32768).cast("long").alias("part"), (place % 32768).alias("bit"))
    rows = parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # at most bits / 32768 rows of 4 KB
    out = bytearray(bits // 8)
    for r in rows:
        out[r["part"] * 4096 : r["part"] * 4096 + len(r["bits"])] = r["bits"]
    return bytes(out)


def passes(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    place = hashes % (len(bits) * 8)
    return (np.frombuffer(bits, np.uint8)[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def repeated(docs: DataFrame, scheme: Scheme, find: Callable[[pa.Table], pa.Table], hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """docs(doc_id long, th long, text) -> (doc_id, th, start, stop): stretches of symbols whose windows all occur elsewhere.

    Their union covers each window that starts at two places or more. `find` gets a shard's contexts (core, whole, doc_id, th, lo,
    context) and returns (doc_id, th, start, stop) of the windows that occur in two different contexts. Rows with one id and one text
    (repeated rows) share their stretches.
    """
    spark, length = docs.sparkSession, scheme.length
    texts = docs.select("doc_id", "th", "text")

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for runs in runs_of((x.as_py() for x in batch.column(0)), scheme):
                yield batch_of(core=runs.core)

    counts = texts.select("text").mapInArrow(cores, "core long").groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = spark.sparkContext.broadcast(filter_of(counts, "core"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = np.array(batch.column(0).to_pylist(), dtype=object), np.asarray(batch.column(1))
            for runs in runs_of((x.as_py() for x in batch.column(2)), scheme):
                at = np.flatnonzero(passes(twice.value, runs.core))
                if len(at):
                    row = runs.row[at]
                    yield batch_of(core=runs.core[at], whole=runs.whole[at], doc_id=pa.array(ids[row].tolist(), pa.int64()), th=ths[row], lo=runs.lo[at], hi=runs.hi[at])

    runs_ = table(texts.mapInArrow(kept, "core long, whole long, doc_id long, th long, lo long, hi long"))
    full = table(runs_.groupBy("whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("whole"))
    closed = runs_.join(full, "whole", "left_semi").select("doc_id", "th", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))
    variants = runs_.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"))
    variants = variants.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least"))
    unsure = table(variants.where("n > 1 AND least = 1"))  # an open run, and other contexts to find its windows in
    crowded = unsure.where(F.col("n") > hot)
    sizes = unsure.agg(F.sum("n"), F.sum((F.col("n") > hot).cast("long"))).first()
    n_contexts, n_hot = sizes[0] or 0, sizes[1] or 0
    wanted = spark.sparkContext.broadcast(filter_of(unsure, "core"))
    spread = spark.sparkContext.broadcast(filter_of(crowded, "core", 1 << 20))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for runs in runs_of((x.as_py() for x in batch.column(2)), scheme):
                at = np.flatnonzero(passes(wanted.value, runs.core) & ~passes(spread.value, runs.core))
                new = []
                for i, whole in zip(at.tolist(), runs.whole[at].tolist(), strict=True):
                    if whole not in seen:  # the same context again: both are repeats in full already
                        seen.add(whole)
                        new.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                if new:
                    stop = runs.start[new] + (runs.hi[new] - runs.lo[new]) + length
                    row = runs.row[new].tolist()
                    yield batch_of(core=runs.core[new], whole=runs.whole[new], doc_id=pa.array([ids[r] for r in row], pa.int64()), th=pa.array([ths[r] for r in row], pa.int64()), lo=runs.lo[new], context=pa.array([runs.raw[a:b].tobytes() for a, b in zip(runs.start[new].tolist(), stop.tolist(), strict=True)], pa.binary()))

    sent = texts.mapInArrow(contexts, "core long, whole long, doc_id long, th long, lo long, context binary")
    shards = max(1, -(-n_contexts // shard))
    sent = sent.withColumn("shard", F.pmod(F.xxhash64("core"), F.lit(shards)))
    single = sent.groupBy("shard").applyInArrow(find, "doc_id long, th long, start long, stop long")
    found = closed.union(single)
    if n_hot:

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for runs in runs_of((x.as_py() for x in batch.column(2)), scheme):
                    for i in np.flatnonzero(passes(wanted.value, runs.core) & passes(spread.value, runs.core)).tolist():
                        if (whole := int(runs.whole[i])) in seen:
                            continue
                        seen.add(whole)
                        here = np.arange(runs.hi[i] - runs.lo[i] + 1)
                        each = mix(runs.rolling.of(runs.start[i] + here, runs.start[i] + here + length)).view(np.int64)
                        same = np.full(len(here), -1)
                        yield batch_of(window=each, whole=same + 1 + whole, doc_id=pa.array([ids[runs.row[i]]] * len(here), pa.int64()), th=pa.array([ths[runs.row[i]]] * len(here), pa.int64()), start=runs.lo[i] + here)
                    if len(seen) > SEEN:
                        seen.clear()

        each = table(texts.mapInArrow(windows, "window long, whole long, doc_id long, th long, start long"))
        often = table(each.groupBy("window").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a < b").select("window"))
        found = found.union(each.join(often, "window", "left_semi").select("doc_id", "th", "start", (F.col("start") + length).alias("stop")))
    return found


def with_stretches(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs(doc_id, th, ...) with `starts` and `stops`, arrays (not in order, may overlap; null: none)."""
    per = found.distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("_at"))
    per = per.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("_at.start").alias("starts"), F.col("_at.stop").alias("stops"))
    return docs.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").drop("_id", "_th")


def merged(starts: list[int] | None, stops: list[int] | None) -> list[tuple[int, int]]:
    """Union of stretches as maximal ones, in order; stretches that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts or (), stops or (), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def distinct_contexts(shard: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Row numbers of a shard's different contexts and the contexts."""
    _, first = np.unique(np.asarray(shard["whole"].combine_chunks()), return_index=True)
    return first, shard["context"].take(pa.array(first)).to_pylist()


def window_rows(shard: pa.Table, first: np.ndarray, which: np.ndarray, at: np.ndarray, length: int) -> pa.Table:
    """Found windows (number of the context, start in it; in order) -> (doc_id, th, start, stop), neighbours as one stretch."""
    if not len(which):
        none = pa.array([], pa.int64())
        return pa.table({"doc_id": none, "th": none, "start": none, "stop": none})
    cut = np.flatnonzero((np.diff(which) != 0) | (np.diff(at) != 1)) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    rows = pa.array(first[which[a]])
    lo = np.asarray(shard["lo"].combine_chunks())[first[which[a]]]
    return pa.table({"doc_id": shard["doc_id"].take(rows), "th": shard["th"].take(rows), "start": lo + at[a], "stop": lo + at[b] + length})
