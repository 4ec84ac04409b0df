"""Catalog events: idempotent application by (id, seq), as streaming state and as plain relational algebra.

Events: (seq, id, op, add_tags, remove_tags, produced_at). An event is skipped unless its seq is above the id's version;
otherwise the version rises, also where the event changes nothing (attributes of a dead id, deleting an unknown one).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATE = "id long, version long, live boolean, tags array<long>, applied long, skipped long"


def set_attrs(tags, add, remove) -> F.Column:
    """Tags after removing and adding; a tag that is both stays."""
    return F.array_sort(F.array_union(F.array_except(tags, F.array_except(remove, add)), add))


def apply_one(version: int, live: bool, tags: set, event) -> tuple[int, bool, set, bool]:
    """(version, live, tags) after an event, and whether it was applied."""
    if event.seq <= version:
        return version, live, tags, False
    add = set(event.add_tags if event.add_tags is not None else ())
    remove = set(event.remove_tags if event.remove_tags is not None else ())
    if event.op == "insert":
        live, tags = True, add
    elif event.op == "delete":
        live, tags = False, set()
    elif live:
        tags = (tags - (remove - add)) | add
    return event.seq, live, tags, True


def stateful(events: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """A stream of events -> a stream of the ids' states after each micro-batch.

    State is keyed by id in the state store; within a batch an id's events are taken in order of seq. `seed` (id, tags) are live ids at
    version 0. Use the RocksDB state store and a checkpoint location.
    """
    from pyspark.sql.streaming import StatefulProcessor
    import pandas as pd

    class Applier(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("item", "version long, live boolean, tags array<long>, applied long, skipped long")

        def handleInitialState(self, key, initialState, timerValues) -> None:
            for tags in initialState["tags"]:
                self.state.update((0, True, sorted({int(t) for t in tags}), 0, 0))

        def handleInputRows(self, key, rows, timerValues):
            version, live, tags, applied, skipped = self.state.get() if self.state.exists() else (-1 << 62, False, [], 0, 0)
            tags = set(tags or ())
            for event in sorted((e for part in rows for e in part.itertuples(index=False)), key=lambda e: e.seq):
                version, live, tags, done = apply_one(version, live, tags, event)
                applied, skipped = applied + done, skipped + (not done)
            self.state.update((int(version), bool(live), [int(t) for t in sorted(tags)], applied, skipped))
            yield pd.DataFrame({"id": [key[0]], "version": [int(version)], "live": [bool(live)], "tags": [[int(t) for t in sorted(tags)]], "applied": [applied], "skipped": [skipped]})

        def close(self) -> None:
            pass

    start = None if seed is None else seed.select("id", F.col("tags").cast("array<long>").alias("tags")).groupBy("id")
    return events.groupBy("id").transformWithStateInPandas(Applier(), outputStructType=STATE, outputMode="Update", timeMode="None", initialState=start)


def final_state(events: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """The same states over a batch of events in any order without repeats by seq: (id, version, live, tags), built-ins only.

    An id's last insert or delete resets it; the attribute events after that decide tag by tag, the last one per tag.
    """
    one = F.min(F.struct("op", F.coalesce("add_tags", F.array().cast("array<bigint>")).alias("add_tags"), F.coalesce("remove_tags", F.array().cast("array<bigint>")).alias("remove_tags"))).alias("e")
    events = events.groupBy("id", "seq").agg(one).select("id", "seq", "e.*")  # of different events of one seq the smallest, in every run
    if seed is not None:
        none = F.array().cast("array<bigint>")
        events = events.select("id", "seq", "op", "add_tags", "remove_tags").union(seed.select("id", F.lit(0).cast("long"), F.lit("insert"), F.col("tags").cast("array<bigint>"), none))
    reset = F.max(F.when(F.col("op") != "set_attrs", F.struct("seq", "op", "add_tags")))
    heads = events.groupBy("id").agg(F.max("seq").alias("version"), reset.alias("reset"))
    heads = heads.select("id", "version", F.coalesce(F.col("reset.op") == "insert", F.lit(False)).alias("live"), F.col("reset.seq").alias("since"), F.col("reset.add_tags").alias("base"))
    live = heads.where("live")
    changes = events.where("op = 'set_attrs'").join(live.select("id", "since"), "id").where(F.col("seq") > F.col("since"))
    gone = changes.select("id", "seq", F.explode(F.array_except("remove_tags", "add_tags")).alias("tag"), F.lit(0).alias("on"))
    come = changes.select("id", "seq", F.explode("add_tags").alias("tag"), F.lit(1).alias("on"))
    base = live.select("id", F.col("since").alias("seq"), F.explode("base").alias("tag"), F.lit(1).alias("on"))
    last = gone.union(come).union(base).groupBy("id", "tag").agg(F.max(F.struct("seq", "on")).alias("last")).where("last.on = 1")
    tags = last.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return heads.join(tags, "id", "left").select("id", "version", "live", F.coalesce("tags", F.array().cast("array<bigint>")).alias("tags"))


def lag(events: DataFrame, applied_at) -> DataFrame:
    """Milliseconds from production to application, at least 0, by op: events, median, 90th, 99th and 99.9th percentile and maximum."""
    ms = F.greatest(F.lit(0), (F.unix_micros(applied_at) - F.unix_micros("produced_at")) / 1000)
    return events.withColumn("ms", ms).groupBy("op").agg(F.count(F.lit(1)).alias("events"), F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.9).alias("p90"), F.percentile("ms", 0.99).alias("p99"), F.percentile("ms", 0.999).alias("p999"), F.max("ms").alias("most"))


def visibility(states: DataFrame, events: DataFrame, committed: DataFrame) -> DataFrame:
    """(batch, events, p50, p99, most): milliseconds until written events could be read. committed: (batch, visible_at), when a batch's states were in place.

    states: what `run` wrote, (id, version, batch, ...); an event is visible with the first batch whose state of its id is at its seq or above.
    """
    first = events.join(states.select("id", "version", "batch"), "id").where("version >= seq").groupBy("id", "seq").agg(F.min("batch").alias("batch"), F.min("produced_at").alias("produced_at"))
    ms = F.greatest(F.lit(0), (F.unix_micros("visible_at") - F.unix_micros("produced_at")) / 1000)
    return first.join(committed, "batch").withColumn("ms", ms).groupBy("batch").agg(F.count(F.lit(1)).alias("events"), F.percentile("ms", 0.5).alias("p50"), F.percentile("ms", 0.99).alias("p99"), F.max("ms").alias("most"))


def run(events: DataFrame, path: str, checkpoint: str, seed: DataFrame | None = None, after: Callable[[DataFrame, int], None] | None = None):
    """Start applying a stream: each micro-batch's states are written under path/batch=N (again if the batch is run again)."""

    def write(states: DataFrame, batch: int) -> None:
        states.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if after:
            after(states, batch)

    return stateful(events, seed).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark, path: str) -> DataFrame:
    """The last committed state of each id."""
    rows = spark.read.parquet(path)
    newest = Window.partitionBy("id").orderBy(F.col("version").desc(), F.col("batch").desc())
    return rows.withColumn("_i", F.row_number().over(newest)).where("_i = 1").drop("_i", "batch")


def overlay(base: DataFrame, arrived: DataFrame, key: str = "row", value: str = "u8") -> DataFrame:
    """Base vectors with newly arrived ones put over them."""
    new = arrived.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    joined = base.select(key, value).join(new, F.col(key) == F.col("_k"), "full")
    return joined.select(F.coalesce(key, "_k").alias(key), F.coalesce("_v", value).alias(value))


def replay(spark, steps: list[dict], items: DataFrame, search: Callable[[DataFrame, int], float]) -> list[float]:
    """A runbook over row ranges: inserts and deletes change the live rows, searches return their recall."""
    live: list[tuple[int, int]] = []
    found = []
    for i, step in enumerate(steps):
        lo, hi = step.get("start"), step.get("end")
        if step["operation"] == "insert":
            live.append((lo, hi))
        elif step["operation"] == "delete":
            live = [p for a, b in live for p in ((a, min(b, lo)), (max(a, hi), b)) if p[0] < p[1]]
        elif step["operation"] == "search":
            inside = F.lit(False)
            for a, b in live:
                inside = inside | ((F.col("row") >= a) & (F.col("row") < b))
            found.append(search(items.where(inside), i))
        else:
            raise ValueError(f"step {i}: {step['operation']!r}")
    return found
