"""From documents to packed sequences: five stages, each on all that the one before kept.

1. toxicity: a classifier fitted on the labelled documents (those of fold 0 held out) scores every window; documents at 0.5 or more go.
2. line dedup: lines with a similar line (Jaccard of words 0.8 or more) before them go; documents left without words go.
3. SimHash near-dedup over five-word shingles: of documents linked by fingerprints at most 2 bits apart or by a Jaccard similarity of their shingles of 0.8 or more, the one with the smallest id stays.
4. mixing: sources share the total of all words by weight, at most three times their own; documents are repeated or left out.
5. packing into sequences of at most 2048 tokens; one row per piece, with its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.llm import linededup, mixing, nearcopies, packing, toxicity
from spindrel.llm.common import read, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts score near 0 and stay; very long ones are scored whole, in chunks of windows.

    Repeated rows score alike. Documents or labels without an id are scored, but not learned from. Empty tables: a constant model, no rows. Columns besides COLUMNS go.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("toxicity < 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an equal or similar line before them go (order: doc_id with null first, text hash, line), then documents left without a word.

    Null and empty texts have no lines and stay; very long ones are taken apart like any other. Repeated rows lose the same lines. n_chars of changed texts is counted anew.
    Empty tables give no rows. Columns besides COLUMNS go.
    """
    done = linededup.dedup(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    length = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", length).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group, the document with the smallest id stays, and of that id the one with the smallest text hash; null ids come last. Of repeated rows one stays.

    Texts without words, null ones too, are one group. Very long texts are hashed in blocks. Empty tables give no rows. Columns besides COLUMNS go.
    """
    near = nearcopies.near_groups(docs.select("doc_id", "text"), shingle=5)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("one")
    chosen = near.groupBy("label").agg(first).select(F.col("one.doc_id").alias("_id"), F.col("one.th").alias("_th"))
    stay = table(near.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")))
    keyed = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("_k"), F.xxhash64(F.col("text").cast("string")).alias("_t"))

    def of(those: DataFrame) -> DataFrame:
        return keyed.join(those.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")), F.col("_k").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left_semi")

    many = stay.where("n > 1")
    if many.isEmpty():
        return of(stay).select(*COLUMNS)
    alone, shared = of(stay.where("n = 1")), of(many)
    one = shared.groupBy("_k", "_t").agg(F.min(F.struct(*COLUMNS)).alias("r"))
    return alone.select(*COLUMNS).unionByName(one.select("r.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for. Null sources are a source of their own.

    Null and empty texts have no words: once for each complete epoch. A very long text may end a source further from its target, by half its size at most.
    Repeated rows, of which the stage before leaves one, are taken alike. Empty tables give no rows. Columns besides COLUMNS go.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("th"))
    taken = mixing.mix(keyed, carry=("th",)).where("epochs > 0").groupBy("doc_id", "th").agg(F.max("epochs").alias("epochs"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "epochs")
    joined = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    return joined.withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), "epochs"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece. Null and empty texts are packed as their end mark alone; very long ones are cut; repeated rows are packed each. Empty tables give no rows."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("SimHash near-dedup", drop_near_copies), ("mixing sources to target weights", mix_sources), ("packing", pack)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs)
    return docs
