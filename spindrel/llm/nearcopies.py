"""Near copies: SimHash links of at most 2 bits, and every pair whose word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of such pairs are up to a quarter of their bits apart, which no segment of a 64-bit fingerprint survives, so
candidates come from MinHash: 25 bands of 5 minima, of which a pair at similarity s shares one with probability 1 - (1 - s^5)^25 (0.99995 at 0.8).
Candidates are verified on their shingle sets. At each band, a text is first compared with the first and the one before
it; only texts that are then still in different components are compared with all others there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, small_join, table
from .graph import components
from .simhash import links, majority, shingle_hashes

SIMILARITY = (4, 5)
BANDS, ROWS = 25, 5
#: Minima in all; each leaves one bit in a sketch of two longs.
MINIMA = 128
#: Bits of the sketch in which a pair may differ: at 0.8, 12.8 on average with a standard deviation of 3.4.
APART = 32
_DRAWN = np.random.default_rng(42).integers(0, 1 << 32, (2, MINIMA, 1), dtype=np.uint64).astype(np.uint32)
FACTORS, SHIFTS = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def minima(hashes: np.ndarray) -> np.ndarray:
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 1024):
        low = np.minimum(low, (folded[at : at + 1024] * FACTORS + SHIFTS).min(1))
    return low


def marks(docs: DataFrame, shingle: int) -> DataFrame:
    """docs(doc_id, th, text) -> (doc_id, th, node, fp, n, keys, bits): texts of the same words are one node; n different shingles, a key for each band."""
    import xxhash

    def mark(text: str | None):
        blocks = list(shingle_hashes(text, shingle))
        if not blocks:
            return 0, 0, 0, [], [0, 0]
        hashes = np.concatenate(blocks)
        low = minima(hashes)
        keys = [xxhash.xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
        bits = np.packbits((low * np.uint32(0x9E3779B1)) >> np.uint32(31), bitorder="little").view("<i8").tolist()
        return xxhash.xxh64_intdigest(hashes.tobytes()), majority(blocks), len(np.unique(hashes)), keys, bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
        for batch in batches:
            node, fp, n, keys, bits = zip(*map(mark, batch.column(2).to_pylist()), strict=True) if batch.num_rows else ((),) * 5
            made = [pa.array(signed(node)), pa.array(signed(fp)), pa.array(n, pa.int64()), pa.array([signed(k) for k in keys], pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "th", "node", "fp", "n", "keys", "bits"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, node long, fp long, n long, keys array<long>, bits array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, text) -> (node, w): the different shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.concatenate(list(shingle_hashes(t, shingle)))).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "w"])

    return texts.select("node", "text").mapInArrow(run, "node long, w array<long>")


def may_match(similarity: tuple[int, int]) -> F.Column:
    """Whether sizes and sketches of a and b allow the similarity."""
    p, q = similarity
    length = (F.col("na") * q >= F.col("nb") * p) & (F.col("nb") * q >= F.col("na") * p)
    differ = sum((F.bit_count(F.get("xa", i).bitwiseXOR(F.get("xb", i))) for i in range(2)), F.lit(0))
    return length & (differ <= APART)


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) of the pairs whose shingle sets have a Jaccard similarity of at least p / q."""
    p, q = similarity
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("w").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("w").alias("y")), "b")
    return both.where(F.size(F.array_intersect("x", "y")) * (p + q) >= (F.size("x") + F.size("y")) * p).select("a", "b")


def near_groups(docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, th (the text's hash), label: equal for documents that links connect, at most 2 bits or similarity p / q.

    One row out per row in, repeated rows included. Texts without words (null ones too) are one node. Links of at most 2
    bits are those of `simhash_groups` and not verified. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string"))
    marked = table(marks(rows, shingle))
    nodes = table(marked.dropDuplicates(["node"]).drop("doc_id"))
    by_key = Window.partitionBy("key").orderBy("node")
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = nodes.select("node", F.explode("keys").alias("key"))
    met = met.withColumns({"many": F.count(F.lit(1)).over(whole), "first": F.first("node").over(whole), "prior": F.lag("node").over(by_key)})
    met = table(met.where("many > 1").drop("many"))
    wanted = table(met.select("node").distinct().join(nodes.select("node", "th"), "node"))
    texts = small_join(rows.select("th", "text"), wanted, "th").dropDuplicates(["node"])
    sets = table(shingle_sets(texts, shingle))

    def side(k: str) -> DataFrame:
        return nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"x{k}"))

    near = met.select(F.explode(F.array("first", "prior")).alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    near = table(near.join(side("a"), "a").join(side("b"), "b").where(may_match(similarity)).select("a", "b"))
    own = table(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    edges = nodes.join(own, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    bits = links(own.select("fp")).join(own.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(own.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    edges = table(edges.union(bits.select("ra", "rb")).union(verified(near, sets, similarity)))
    labels = components(edges)
    open_ = met.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = open_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_ = table(open_.join(apart, "key").join(nodes.select("node", "n", "bits"), "node"))
    one, two = (open_.select("key", F.col("node").alias(k), F.col("label").alias(f"l{k}"), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"x{k}")) for k in "ab")
    rest = one.join(two, "key").where("a < b AND la <> lb").where(may_match(similarity)).select("a", "b").distinct().join(near, ["a", "b"], "left_anti")
    rest = table(rest)
    more = table(verified(rest, sets, similarity))
    if not more.isEmpty():
        labels = components(edges.union(more))
    drop(nodes, met, wanted, sets, near, own, edges, open_, rest, more)
    return marked.select("doc_id", "th", "node").join(labels, "node", "left").select("doc_id", "th", F.coalesce("label", "node").alias("label"))
