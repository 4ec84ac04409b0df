"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments (22, 21, 21 bits). Two fingerprints at most 2 bits apart agree
exactly in at least one segment, and in any other segment differ in at most 2 bits. The perfect binary Golay
code [23, 12, 7] decodes every 23-bit word; a word and its one-bit neighbours decode to one or six codewords, and two words at
most 2 bits apart have a neighbour in common, so they share a codeword. A fingerprint's keys are, for each
segment taken as exact, that segment with each codeword of the next one. Fingerprints that share a key are
joined and verified. Keys with many fingerprints are not paired up: their members are linked through their
one-bit neighbours, of which two fingerprints at most 2 bits apart share one, and at most 65 members meet in each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .graph import components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys with more fingerprints than this take the way through one-bit neighbours.
PAIRED = 48
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the Golay code (fixed value).
GENERATOR = 0b101011100011


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials modulo the generator."""
    rest = words.astype(np.int64)
    for shift in range(11, -1, -1):
        rest = np.where((rest >> (shift + 11)) & 1, rest ^ (GENERATOR << shift), rest)
    return rest


def error_table() -> np.ndarray:
    """Error pattern of weight at most 3 for each of the 2048 syndromes: the code is perfect, so each has exactly one."""
    bits = [1 << i for i in range(23)]
    errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i])]
    errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    out = np.zeros(2048, np.int64)
    out[syndromes(np.array(errors))] = errors
    return out


class Golay:
    def __init__(self) -> None:
        self.errors = error_table()
        self.low, self.high = syndromes(np.arange(1 << 12)), syndromes(np.arange(1 << 11) << 12)

    def decode(self, words: np.ndarray) -> np.ndarray:
        """Index (the 12 data bits) of the codeword nearest to each 23-bit word."""
        return (words ^ self.errors[self.low[words & 4095] ^ self.high[words >> 12]]) >> 11

    def near(self, words: np.ndarray, width: int) -> np.ndarray:
        """Indices of the codewords that each word and its one-bit neighbours decode to, a column each, with repeats."""
        flips = np.array([0, *(1 << i for i in range(width))])
        return self.decode(words[:, None] ^ flips)


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (over UTF-8) of the text's word shingles in order, in blocks; a text of fewer words is one shingle, one without words none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return
    digest = xxhash.xxh64_intdigest
    size, joined = min(shingle, len(words)), b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    total = len(words) - size + 1
    for at in range(0, total, 65536):
        stop = min(total, at + 65536)
        starts = [ends[at - 1] if at else 0, *ends[at : stop - 1]]
        yield np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[at + size - 1 :])], dtype="<u8")


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The 64 bits that more than half of the hashes have; 0 without hashes."""
    total, counts = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        total += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def keys(fps: DataFrame) -> DataFrame:
    """(fp) distinct -> (key, fp), a row for each of a fingerprint's Golay keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            if not len(fp):
                continue
            parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            rows = np.arange(len(fp))
            for exact in range(3):
                other = (exact + 1) % 3
                near = np.sort(golay.near(parts[other], SEGMENTS[other][1]), axis=1)
                new = np.ones(near.shape, bool)
                new[:, 1:] = near[:, 1:] != near[:, :-1]
                at, col = np.nonzero(new)
                key = (exact << 36) | (parts[exact][at] << 12) | near[at, col]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows[at]].view(np.int64))], names=["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def neighbours(fps: DataFrame) -> DataFrame:
    """(fp) -> (key, fp): a fingerprint under itself and its 64 one-bit neighbours."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    return fps.select(F.explode(flips).alias("_flip"), "fp").select(F.col("fp").bitwiseXOR(F.col("_flip")).alias("key"), "fp")


def links(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(fp) distinct -> (a, b): links that connect all fingerprints at most 2 bits apart (not each pair of a large group)."""
    keyed = table(keys(fps))
    counts = table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    known = keyed.join(counts, "key")
    few = known.where(F.col("n") <= paired).select("key", "fp")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key").where("a < b").where(apart <= 2).select("a", "b")
    many = known.where(F.col("n") > paired).select("fp").distinct()
    meet = neighbours(many).groupBy("key").agg(F.sort_array(F.collect_set("fp")).alias("all")).where(F.size("all") > 1)
    chains = meet.select(F.explode(F.arrays_zip(F.slice("all", 1, F.size("all") - 1).alias("a"), F.slice("all", 2, F.size("all") - 1).alias("b"))).alias("e"))
    return pairs.union(chains.select("e.a", "e.b")).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, paired: int = PAIRED) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, fp, component_id: the smallest doc_id reachable over links of at most 2 bits.

    One row out per row in, repeated rows included. Null and empty texts have fingerprint 0 and link like any
    other. A null doc_id takes part and is never the smallest unless the component has no other. Very long texts
    are hashed in blocks. Other columns are not read. An empty table gives no rows.
    """
    prints = table(fingerprints(docs, shingle))
    own = table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(own.select("fp"), paired))
    named = own.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = table(named)
    lowest = table(named.groupBy("label").agg(F.min("first").alias("component_id")))
    of = table(named.join(lowest, "label").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")
