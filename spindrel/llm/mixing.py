"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets, in DataFrame operations only.

Each document draws an exponential key -ln(u) / w, w its quality weight and u a reproducible hash; in order of
their keys, documents are a weighted sample without replacement. A source whose budget is e whole sources and a
rest takes every document e times (complete epochs), and then the documents whose keys come first until their
prefix sum reaches the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, prefix_sums, small_join, table, unit_hash

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Characters that lower a document's quality weight by their share.
NOISE = r"[^0-9!?#$%&@*<>{}|~_=+]"


def quality_weight(text) -> F.Column:
    """1 for plain prose, towards 0 as digits and symbols fill the text; empty and null texts weigh 1."""
    noise = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), NOISE, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * noise / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1)))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with `target`: the total shared by weight, cut off at `most` source sizes, the excess reshared.

    Sources fill up in order of most * size / weight: behind a prefix of full ones, the rest share what is left
    by weight. That level rises with the prefix as long as the next source is above its limit and falls from
    then on, so its maximum is the solution. One row per source is sorted in one place, documents never are.
    An empty total gives targets of 0.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    at = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", left / F.sum("_w").over(onward))
    solved = ranked.withColumn("_level", F.max("_level").over(everything))
    target = F.least(F.col("_cap"), F.col("_level") * F.col("_w"))
    return solved.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 42, weight=None, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, source, size, source_size, target, epochs (times taken), taken and the columns of `carry`.

    One row out per row in. Null text: size 0. Null source: a source of its own, the last. Repeated rows count
    as separate documents. Documents of size 0 are taken once per complete epoch and, holding no words, change
    nothing. The document that a budget ends in is taken if that brings the source nearer to its target. Rows
    that tie on their key are ordered by doc_id and size, so reruns agree. Other columns are not read.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    weight = quality_weight(F.col("text")) if weight is None else weight
    drawn = -F.log(unit_hash(F.lit(seed), F.col("doc_id"))) / weight
    rows = docs.select("doc_id", "source", *carry, size.alias("size"), drawn.alias("_key"))
    rows = table(rows.withColumn("_unit", F.lit(1.0) - F.exp(-F.col("_key"))))  # texts are read once; what follows reads these few columns
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = targets(sources, weights, most).withColumnRenamed("source", "_s")
    ordered = prefix_sums(rows, "source", "_key", "_unit", "size", ["doc_id", "size"])
    ordered = small_join(ordered, shares, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(most))
    ordered = ordered.withColumn("_whole", whole.cast("long"))
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    more = (F.col("before") + F.col("size") / 2.0 <= rest) & (F.col("_whole") < most) & (F.col("size") > 0)
    ordered = ordered.withColumn("epochs", F.col("_whole") + F.when(more, 1).otherwise(0))
    return ordered.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"), *carry)
