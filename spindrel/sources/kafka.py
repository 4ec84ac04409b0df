"""Catalog events from and to Kafka, where Spark's connector is on the class path; file streams otherwise.

Events are keyed by id, so that an id's events stay in one partition and in order; values are JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "seq long, id long, op string, add_tags array<long>, remove_tags array<long>, produced_at timestamp"
#: Producer settings of the sink (fixed values): no acknowledged event is lost, none is sent twice.
PRODUCER = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.linger.ms": "2", "kafka.batch.size": "262144"}


def available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider", False, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    except Exception:  # noqa: BLE001  py4j wraps the ClassNotFoundException
        return False
    return True


def encode(events: DataFrame) -> DataFrame:
    return events.select(F.col("id").cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def decode(records: DataFrame) -> DataFrame:
    return records.select(F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("e.*")


def read(spark: SparkSession, where: str, topic: str | None = None) -> DataFrame:
    """A stream of events from brokers and a topic, or from JSON files in a folder where no topic is named."""
    if topic is None:
        return spark.readStream.schema(EVENT).json(where)
    if not available(spark):
        raise RuntimeError("Spark's Kafka connector is not on the class path")
    return decode(spark.readStream.format("kafka").option("kafka.bootstrap.servers", where).option("subscribe", topic).option("startingOffsets", "earliest").load())


def write(events: DataFrame, where: str, topic: str | None = None) -> None:
    """A batch of events to a topic, or appended as JSON files."""
    if topic is None:
        events.write.mode("append").json(where)
    elif not available(events.sparkSession):
        raise RuntimeError("Spark's Kafka connector is not on the class path")
    else:
        encode(events).write.format("kafka").options(**PRODUCER).option("kafka.bootstrap.servers", where).option("topic", topic).save()
