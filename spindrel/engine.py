"""A small facade: search, upsert, delete, set attributes and statistics over one corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.functions.predicates import Range
from spindrel.operators import ivf, runner, search, stats
from spindrel.operators.cut import cut
from spindrel.operators.search import Corpus
from spindrel.plans import planner
from spindrel.streaming import applier

_EVENT = "seq long, id long, op string, add_tags array<long>, remove_tags array<long>"


class Engine:
    """Writes are numbered events over a snapshot; a search sees all writes before it. `specs` are tried by name, the first is the default."""

    def __init__(self, spark: SparkSession, items: DataFrame, tags: DataFrame, attrs: DataFrame | None = None, models: DataFrame | None = None, specs: str = "S0", knob: float = 1_000.0, **parts) -> None:
        self.spark, self.base, self.tags, self.attrs, self.parts = spark, items.select("row", "u8"), tags, attrs, parts
        self.models, self.specs, self.knob = models, planner.parse(specs), knob
        self.events: list[tuple] = []
        self.vectors: dict[int, list[int]] = {}
        self.values: dict[int, dict[str, int]] = {}

    def _write(self, op: str, row: int, add: list[int] = (), remove: list[int] = ()) -> int:
        self.events.append((len(self.events) + 1, row, op, list(add), list(remove)))
        return len(self.events)

    def upsert(self, row: int, vector: list[int], tags: list[int], **values: int) -> int:
        """values: the row's range attributes; those not given are null and in no range."""
        self.vectors[row], self.values[row] = list(vector), values
        return self._write("insert", row, tags)

    def delete(self, row: int) -> int:
        return self._write("delete", row)

    def set_attrs(self, row: int, add: list[int] = (), remove: list[int] = ()) -> int:
        return self._write("set_attrs", row, add, remove)

    def corpus(self) -> Corpus:
        """The snapshot with all events applied: only written rows are recomputed. New vectors go to the nearest cell, deleted rows leave theirs."""
        if not self.events:
            return Corpus(self.base, self.tags, self.attrs, **self.parts)
        events = self.spark.createDataFrame(self.events, _EVENT)
        touched = F.broadcast(events.select(F.col("id").alias("row")).distinct())  # the writes since the snapshot, held by the driver anyway
        old = self.tags.join(touched, "row", "left_semi").groupBy("row").agg(F.collect_set("tag").alias("tags"))
        seed = self.base.join(touched, "row", "left_semi").select("row").join(old, "row", "left").select(F.col("row").alias("id"), F.coalesce("tags", F.array().cast("array<long>")).alias("tags"))
        state = applier.final_state(events, seed).where("live").select(F.col("id").alias("row"), "tags")
        items = self.base
        if self.vectors:
            items = applier.overlay(items, self.spark.createDataFrame(sorted(self.vectors.items()), "row long, u8 array<int>"))
        items = items.join(touched, "row", "left_anti").union(items.join(state.select("row"), "row", "left_semi"))
        tags = self.tags.join(touched, "row", "left_anti").union(state.select("row", F.explode("tags").alias("tag")))
        parts, put = dict(self.parts), sorted(self.vectors)
        written = F.broadcast(self.spark.createDataFrame([(r,) for r in put], "row long"))
        if parts.get("cells") is not None:
            new = ivf.assign(items.join(written, "row", "left_semi"), parts["centroids"])
            gone = F.broadcast(state.select("row"))
            stay = parts["cells"].join(written, "row", "left_anti")
            stay = stay.join(touched, "row", "left_anti").unionByName(stay.join(gone, "row", "left_semi"))
            parts["cells"] = stay.select("row", F.col("cell").cast("int").alias("cell")).unionByName(new)
        attrs = self.attrs
        if attrs is not None and put:
            given = self.spark.createDataFrame([(r, *[self.values[r].get(c) for c in attrs.columns if c != "row"]) for r in put], "row long, " + ", ".join(f"`{c}` long" for c in attrs.columns if c != "row"))
            attrs = attrs.join(written, "row", "left_anti").unionByName(given)
        return Corpus(items, tags, attrs, **parts)

    def compact(self) -> None:
        """The writes so far become the snapshot; nothing of them is held on the driver or replayed any more."""
        now = self.corpus()
        self.base, self.tags = cut(now.items), cut(now.tags)
        self.attrs = None if now.attrs is None else cut(now.attrs)
        if now.cells is not None:
            self.parts["cells"] = cut(now.cells)
        self.events, self.vectors, self.values = [], {}, {}

    def _query(self, vector: list[int], tags: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(0, list(vector), list(tags))], "qid long, qv array<int>, qtags array<long>")

    def search(self, vector: list[int], tags: list[int] = (), ranges: tuple[Range, ...] = (), k: int = 10, mode: str | None = None) -> DataFrame:
        """(qid, rk, row, dist). mode names a strategy; without one the planner chooses if there are models, else the first spec does it."""
        corpus, query = self.corpus(), self._query(vector, tags)
        if ranges:
            return search.s0(corpus, query, k, ranges)
        name, params = next((s for s in self.specs if s[0] == mode), (mode, {})) if mode else self.specs[0]
        if mode is None and self.models is not None:
            chosen = planner.lagrange(planner.predict(self.models, stats.match_counts(corpus, query)), self.knob).first()
            name, params = next((s for s in self.specs if chosen and runner.config_name(*s) == chosen["config"]), self.specs[0])
        return runner.strategy(corpus, query, k, name, params).orderBy("rk")

    def stats(self, tags: list[int] = ()) -> DataFrame:
        return stats.selectivity(self.corpus(), self._query([], tags)).drop("qid")
