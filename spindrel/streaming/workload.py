"""Constructed update workloads, counters, and measures taken while updates go on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrel.operators import ivf, search
from spindrel.operators.cut import cut
from spindrel.operators.evaluate import hits, recall
from spindrel.operators.search import Corpus

#: Order in which events that are due together are applied (fixed values).
ORDER = {"insert": 0, "delete": 1, "set_attrs": 2}


def constructed(spark: SparkSession, rows: int, seconds: int, rates: dict[str, int]) -> DataFrame:
    """(seq, due_us, op, id, add_tags, remove_tags): three streams, each evenly paced at its rate per second, merged by due time.

    Inserts take new ids from `rows` on, deletes and attribute changes ids below it by a fixed stride; changes add
    one of a thousand tags and remove one of ten in turn.
    """
    none = F.array().cast("array<bigint>")
    parts = []
    for op, rate in rates.items():
        i = F.col("id")
        events = spark.range(rate * seconds).select("id", F.expr(f"id * 1000000 div {rate}").alias("due_us"))
        id_ = {"insert": i + rows, "delete": (i * 7919) % rows, "set_attrs": (i * 104_729 + 13) % rows}[op]
        add = F.when(F.lit(op == "insert"), F.array(i % 1000)).when(F.lit(op == "set_attrs") & (i % 2 == 0), F.array(i % 1000)).otherwise(none)
        remove = F.when(F.lit(op == "set_attrs") & (i % 2 == 1), F.array(id_ % 10)).otherwise(none)
        # the paces are known, so an event's place among all is a sum: of each other stream, what is due before it
        before = [F.least(F.lit(r * seconds), F.expr(f"((due_us + {int(ORDER[o] < ORDER[op])}) * {r} + 999999) div 1000000")) for o, r in rates.items() if o != op]
        seq = reduce(lambda x, y: x + y, before, i + 1).cast("long")
        parts.append(events.select(seq.alias("seq"), "due_us", F.lit(op).alias("op"), id_.alias("id"), add.alias("add_tags"), remove.alias("remove_tags")))
    return reduce(DataFrame.unionByName, parts)


def paced(spark: SparkSession, rate: int) -> DataFrame:
    """An open-loop stream of (i, due): arrivals at a fixed rate whatever the consumer does; latency counts from `due`."""
    return spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("value").alias("i"), F.col("timestamp").alias("due"))


def counters(events: DataFrame, arrival: str | None = None) -> DataFrame:
    """(op, applied, skipped, last_seq). In order of seq per id: a repeated seq is skipped. In order of the column `arrival`: one that is not above all before it is skipped."""
    if arrival is None:
        seen = events.withColumn("_done", F.row_number().over(Window.partitionBy("id", "seq").orderBy("op")) == 1)
    else:
        before = Window.partitionBy("id").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
        newest = F.max("seq").over(before)
        seen = events.withColumn("_done", newest.isNull() | (F.col("seq") > newest))
    done = F.col("_done")
    return seen.groupBy("op").agg(F.sum(F.when(done, 1).otherwise(0)).alias("applied"), F.sum(F.when(done, 0).otherwise(1)).alias("skipped"), F.max("seq").alias("last_seq"))


def merge_recall(corpus: Corpus, queries: DataFrame, k: int, nprobe: int, share: int) -> DataFrame:
    """As `tombstone_drift` for one share, after the file is built anew (centroids as the means of the rows left in each cell)."""
    live = corpus.items.where((F.col("row") * 7919) % 100 >= share)
    held = live.select("row", "u8").join(corpus.cells, "row").withColumnRenamed("cell", "label")
    cells, centroids = ivf.label_cells(held)
    return checkpoint_recall(Corpus(corpus.items, corpus.tags, corpus.attrs, cells, cut(centroids), nested=corpus.nested), live.select("row"), queries, k, nprobe)


def checkpoint_recall(corpus: Corpus, live: DataFrame, queries: DataFrame, k: int, nprobe: int) -> DataFrame:
    """(queries, hits, possible, recall) of the inverted file against the exact search, both over the live rows (row) of a snapshot."""
    sets = corpus.sets().join(live, "row", "left_semi")
    now = Corpus(corpus.items.join(live, "row", "left_semi"), corpus.tags.join(live, "row", "left_semi"), corpus.attrs, corpus.cells, corpus.centroids, nested=sets)
    truth = search.s0(now, queries, k)
    return recall(hits(search.s4(now, queries, k, nprobe), truth, k))


def tombstone_drift(corpus: Corpus, queries: DataFrame, k: int, nprobe: int, shares: tuple[int, ...]) -> DataFrame:
    """(share, queries, hits, possible, recall) after deleting a growing percentage of rows from a file whose cells stay as built."""
    parts = [checkpoint_recall(corpus, corpus.items.where((F.col("row") * 7919) % 100 >= s).select("row"), queries, k, nprobe).select(F.lit(s).alias("share"), "*") for s in shares]
    return reduce(DataFrame.unionByName, parts)
