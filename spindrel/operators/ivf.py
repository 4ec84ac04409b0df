"""Inverted files: k-means with integer sums, assignment, per-tag files, save and load."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.operators.cut import cut

#: Rows that centroids are trained on at most.
SAMPLE = 100_000
#: Members of a tag that one task assigns.
PART = 20_000


def seeded(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ starting points."""
    rng = np.random.default_rng(seed)
    chosen = [points[rng.integers(len(points))]]
    far = ((points - chosen[0]) ** 2).sum(1)
    for _ in range(1, k):
        total = far.sum()
        pick = rng.integers(len(points)) if total <= 0 else np.searchsorted(np.cumsum(far), rng.random() * total)
        chosen.append(points[min(int(pick), len(points) - 1)])
        far = np.minimum(far, ((points - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def near(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre, by |c|^2 - 2 x c, in blocks."""
    norms = (centres**2).sum(1)
    return np.concatenate([(norms - 2 * points[i : i + 65_536] @ centres.T).argmin(1) for i in range(0, len(points), 65_536)] or [np.zeros(0, int)])


def kmeans(points: np.ndarray, k: int, rounds: int = 10, seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """Centres and the inertia before each round; an empty cell takes half of the largest one, nudged by a part in 1024, up and down by component."""
    centres, inertia = seeded(points, min(k, len(points)), seed).astype(np.float64), []
    for _ in range(rounds):
        at = near(points, centres)
        inertia.append(float(((points - centres[at]) ** 2).sum()))
        sizes, sums = np.bincount(at, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
        for empty in np.flatnonzero(sizes == 0):
            big = sizes.argmax()
            nudge = np.where(np.arange(centres.shape[1]) % 2 == 0, 1, -1) / 1024
            centres[empty], centres[big] = centres[big] * (1 + nudge), centres[big] * (1 - nudge)
            sizes[empty] = sizes[big] = sizes[big] // 2
    return centres, inertia


def train(items: DataFrame, k: int, sample: int = SAMPLE, rounds: int = 10, seed: int = 42) -> DataFrame:
    """(cell, c) from at most `sample` rows, the first by a hash of their number."""
    rows = items.orderBy(F.xxhash64("row", F.lit(seed)), "row").limit(sample).select("u8").toPandas()["u8"]
    centres, _ = kmeans(np.array(rows.tolist(), dtype=np.float64), k, rounds, seed)
    return items.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, c array<double>")


def assign(items: DataFrame, centroids: DataFrame) -> DataFrame:
    """(row, cell) of every item, a map over partitions."""
    rows = sorted((r["cell"], r["c"]) for r in centroids.collect())  # as few as the index has cells
    shared = items.sparkSession.sparkContext.broadcast((np.array([c for c, _ in rows]), np.array([c for _, c in rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres = shared.value
        for batch in batches:
            if batch.num_rows:
                points = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells[near(points, centres)].astype(np.int32))], names=["row", "cell"])

    return items.select("row", "u8").mapInArrow(run, "row long, cell int")


def label_cells(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels as ready-made cells: (row, cell) and (cell, c), c the mean of the members by integer sums."""
    cells = items.select("row", F.col("label").alias("cell"))
    means = items.select(F.col("label").alias("cell"), F.posexplode("u8").alias("i", "x")).groupBy("cell", "i").agg((F.sum("x").cast("double") / F.count(F.lit(1))).alias("m"))
    return cells, means.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


def per_tag(items: DataFrame, tags: DataFrame, min_count: int, per_cell: int, max_cells: int, sample_per_cell: int = 256, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(tag, cell, row) and (tag, cell, c): an inverted file for each tag with at least min_count items.

    Centroids are trained per tag on about sample_per_cell * cells rows by hash; members are then assigned in parts of
    bounded size, so that a tag of any size is spread over tasks.
    """
    counts = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    cells = F.greatest(F.lit(1), F.least(F.lit(max_cells), F.floor(F.col("n") / per_cell))).cast("int")
    sized = counts.withColumn("k", cells)
    member = tags.join(sized, "tag").join(items.select("row", "u8"), "row")
    share = F.col("k") * sample_per_cell / F.col("n")
    picked = member.where((F.pmod(F.xxhash64("row", "tag"), F.lit(1 << 20)) / float(1 << 20)) < F.greatest(share * 1.2, F.lit(0.0)))

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["row"].combine_chunks()))
        flat = table["u8"].combine_chunks()
        points = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)[order]
        tag, k = key[0].as_py(), key[1].as_py()
        centres, _ = kmeans(points, k, rounds, 17 + tag)
        return pa.table({"tag": pa.array([tag] * len(centres), pa.int64()), "cell": pa.array(range(len(centres)), pa.int32()), "c": pa.array(centres.tolist(), pa.list_(pa.float64()))})

    centroids = cut(picked.select("tag", "k", "row", "u8").groupBy("tag", "k").applyInArrow(fit, "tag long, cell int, c array<double>"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = member.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).select("tag", "part", "row", "u8")
    given = centroids.join(sized, "tag").select("tag", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "cell", "c")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            none = pa.array([], pa.int64())
            return pa.table({"tag": none, "cell": pa.array([], pa.int32()), "row": none})
        cells = np.asarray(right["cell"].combine_chunks())
        order = np.argsort(cells)
        at = near(_matrix(left["u8"]), _matrix(right["c"])[order])
        return pa.table({"tag": left["tag"], "cell": pa.array(cells[order][at].astype(np.int32)), "row": left["row"]})

    placed = dealt.groupBy("tag", "part").cogroup(given.groupBy("tag", "part")).applyInArrow(place, "tag long, cell int, row long")
    return placed, centroids


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def save(path: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{n}") for n in names]
