"""The data model over the driver's tables: items, tags, attributes, queries and catalog events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions.vectors import projection, quantise

#: Order of event types (fixed values).
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, u8, label)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), quantise("embedding").alias("u8"), "label")


def attributes(rows: DataFrame) -> DataFrame:
    """items -> (row, uniform, proj), the constructed range attributes."""
    return rows.select("row", ((F.col("row") * 7919) % 1_000_003).alias("uniform"), projection("u8").alias("proj"))


def tags_of_event() -> F.Column:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return F.array((F.lit(9) + F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type"))).cast("bigint"), (F.lit(100) + F.floor(k * k / 100)).cast("bigint"))


def item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, tag), distinct: postings in long form."""
    base = read(spark, sf_dir, "embeddings")
    n = base.count()
    own = base.select(F.col("vec_id").alias("row"), F.col("label").cast("bigint").alias("tag"))
    more = read(spark, sf_dir, "events").select((F.col("event_id") % n).alias("row"), F.explode(tags_of_event()).alias("tag"))
    return own.union(more).distinct()


def item_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, tags): each row's tags as a set."""
    return item_tags(spark, sf_dir).groupBy("row").agg(F.collect_set("tag").alias("tags"))


def queries(spark: SparkSession, sf_dir: str, sets: DataFrame | None = None) -> DataFrame:
    """(qid, qv, qtags): every tenth row's vector with the smallest, the largest or both tags of another row, in turn. sets: `item_sets`, where they are at hand."""
    base = items(spark, sf_dir).where("row % 10 = 0")
    n = read(spark, sf_dir, "embeddings").count()
    if sets is None:
        bounds = item_tags(spark, sf_dir).groupBy("row").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"))
    else:
        bounds = sets.select("row", F.array_min("tags").alias("lo"), F.array_max("tags").alias("hi"))
    base = base.select(F.col("row").alias("qid"), F.col("u8").alias("qv"), ((F.col("row") * 7 + 3) % n).alias("from"), (F.floor(F.col("row") / 10) % 3).alias("kind"))
    tags = F.when(F.col("kind") == 0, F.array("lo")).when(F.col("kind") == 1, F.array("hi")).otherwise(F.array_distinct(F.array("lo", "hi")))
    return base.join(bounds, base["from"] == bounds["row"]).select("qid", "qv", tags.alias("qtags"))


def catalog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, id, op, add_tags, remove_tags, produced_at): sign-ups insert, errors delete, the rest sets attributes."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("set_attrs")
    none = F.array().cast("array<bigint>")
    add = F.when(op == "delete", none).when(op == "insert", F.array_distinct(F.array(k % 7, k % 11))).when(F.col("event_type") == "view", F.array(k % 13)).otherwise(F.array(k % 5))
    remove = F.when((op == "set_attrs") & (F.col("event_type") != "view"), F.array(k % 7)).otherwise(none)
    return read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("id"), op.alias("op"), add.alias("add_tags"), remove.alias("remove_tags"), F.col("ts").alias("produced_at"))
