"""Exact work between items and batches of queries, in blocks of bounded size.

Items and queries of one cell meet in tasks of at most about ITEMS items and QUERIES queries; pairs are arrays there and never rows of a
table. Queries with the same tags share the look-up of the rows that hold these. What leaves a task is its k best rows of each query, or counts.

held: (cell, row, u8, tags), tags a set or null; asked: (cell, qid, qv, want), want from `want`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items and queries of a task at most, but for the chance of the hash that deals them.
ITEMS, QUERIES = 16_384, 8_192
#: Smaller tables are dealt to about so many tasks, of LEAST items at least.
TASKS, LEAST = 32, 1_024
#: Distances that a task holds at once.
HELD = 1 << 21


def want(tags: str = "qtags") -> Column:
    """The tags that a query asks for, in one form: queries of the same set have the same value."""
    return F.sort_array(F.array_distinct(F.coalesce(tags, F.array().cast("array<bigint>"))))


def meet(held: DataFrame, asked: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, items: int | None = None, queries: int | None = None, key: str = "qid", whole: bool = False) -> DataFrame:
    """run over every pair of a part of a cell's items and a block of its queries. `whole`: cells are small and stay in one part."""
    most, many = items or ITEMS, queries or QUERIES
    sizes = held.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    batch = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("_m"))
    blocks = F.ceil(F.col("_m") / many)
    per = F.least(F.lit(most), F.greatest(F.lit(min(LEAST, most)), F.ceil(F.col("_all") * blocks / TASKS)))
    parts = F.lit(1) if whole else F.ceil(F.col("_n") / per)
    grid = sizes.join(batch, "cell").join(F.broadcast(sizes.agg(F.sum("_n").alias("_all"))), how="cross")
    # as few rows as the index has cells
    grid = F.broadcast(grid.select("cell", parts.cast("long").alias("_parts"), blocks.cast("long").alias("_blocks")))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt = lambda df, by, c: df.withColumn(c[:-1], F.pmod(F.xxhash64(by), F.col(c)))
    left = dealt(held.join(grid, "cell"), "row", "_parts").withColumn("_block", upto("_blocks"))
    right = dealt(asked.join(grid, "cell"), key, "_blocks").withColumn("_part", upto("_parts"))
    tasks, keys = 4 * held.sparkSession.sparkContext.defaultParallelism, ["cell", "_part", "_block"]
    left, right = (df.drop("_parts", "_blocks").repartition(tasks, *keys).groupBy(*keys) for df in (left, right))
    return left.cogroup(right).applyInArrow(run, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def alike(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length, in single precision where that holds every sum of their products (integers)."""
    if x.shape[1] != q.shape[1]:
        raise ValueError(f"vectors of {x.shape[1]} and {q.shape[1]} components")
    if 4.0 * x.shape[1] * max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) ** 2 < 1 << 24:
        x, q = x.astype(np.float32), q.astype(np.float32)
    return x, q


class Postings:
    """Rows by tag, of one task. `scan`: a look-up reads the nested column instead."""

    def __init__(self, column: pa.ChunkedArray, scan: bool = False) -> None:
        lists = column.combine_chunks()
        self.n, self.scan = len(lists), scan
        self.owner, self.flat = np.asarray(pc.list_parent_indices(lists)), np.asarray(lists.flatten())
        if not scan:
            order = np.argsort(self.flat, kind="stable")
            self.owner = self.owner[order]
            tags, starts = np.unique(self.flat[order], return_index=True)
            self.at = dict(zip(tags.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)])))

    def find(self, tags: tuple[int, ...]) -> np.ndarray:
        """Numbers of the rows with all the tags, in order; of all rows for none."""
        if not tags:
            return np.arange(self.n)
        if None in tags:
            return np.zeros(0, np.int64)
        if self.scan:
            return np.flatnonzero(np.bincount(self.owner[np.isin(self.flat, tags)], minlength=self.n) == len(tags))
        spans = [self.at.get(t, (0, 0)) for t in tags]
        if len(spans) == 1:
            return self.owner[slice(*spans[0])]
        held = np.zeros(self.n, np.int32)
        for lo, hi in spans:
            held[self.owner[lo:hi]] += 1
        return np.flatnonzero(held == len(tags))


def same_tags(column: pa.ChunkedArray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Each set of tags with the numbers of the queries that ask for it."""
    found: dict[tuple[int, ...], list[int]] = {}
    for i, tags in enumerate(column.to_pylist()):
        found.setdefault(tuple(tags), []).append(i)
    for tags, at in found.items():
        yield tags, np.array(at)


def _distances(left: pa.Table, right: pa.Table, scan: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, items, squared distances) of all pairs that pass, as numbers of rows of both tables and a matrix. Integers: exact."""
    x, q = alike(matrix(left["u8"]), matrix(right["qv"]))
    xx, qq, postings = (x**2).sum(1), (q**2).sum(1), Postings(left["tags"], scan)
    for tags, at in same_tags(right["want"]):
        inside = postings.find(tags)
        if not len(inside):
            continue
        points, norms = (x, xx) if len(inside) == len(x) else (x[inside], xx[inside])
        step = max(1, HELD // len(inside))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            d = q[some] @ points.T
            d *= -2
            d += norms
            d += qq[some, None]
            yield some, inside, d


def top(held: DataFrame, asked: DataFrame, k: int | None, scan: bool = False, items: int | None = None) -> DataFrame:
    """(qid, row, dist): of each task the k first of each query by (dist, row), or as many as its column `fetch` says."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("row")
            rows, ids = np.asarray(left["row"]), np.asarray(right["qid"])
            limits = np.asarray(right["fetch"]) if k is None else None
            for some, inside, d in _distances(left, right, scan):
                keys = d.astype(np.int64) * len(rows) + inside  # in order of (dist, row), none twice
                most = int(limits[some].max()) if k is None else k
                if most < keys.shape[1]:
                    keys = np.partition(keys, most - 1, axis=1)[:, :most]
                keys.sort(axis=1)
                dist, at = np.divmod(keys, len(rows))
                qid = np.broadcast_to(ids[some, None], keys.shape)
                if k is None:
                    keep = np.arange(keys.shape[1]) < limits[some, None]
                    qid, at, dist = qid[keep], at[keep], dist[keep]
                out.append((qid.ravel(), rows[at.ravel()], dist.ravel()))
        columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["qid", "row", "dist"])

    return meet(held, asked, run, "qid long, row long, dist long", items)


def tally(held: DataFrame, asked: DataFrame) -> DataFrame:
    """held (cell, row, tags, at), asked (cell, want) -> (cell, want, at, n): rows that pass by the number `at`. No vectors take part."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wants, ats, counts = [], [], []
        if left.num_rows and right.num_rows:
            names, code = np.unique(np.asarray(left["at"]), return_inverse=True)
            postings = Postings(left["tags"])
            for tags, _ in same_tags(right["want"]):
                n = np.bincount(code[postings.find(tags)], minlength=len(names))
                for i in np.flatnonzero(n):
                    wants.append(tags), ats.append(names[i]), counts.append(n[i])
        cell = pa.array([left["cell"][0].as_py()] * len(wants) if wants else [], left.schema.field("cell").type)
        return pa.table({"cell": cell, "want": pa.array(wants, pa.list_(pa.int64())), "at": pa.array(ats, pa.int64()), "n": pa.array(counts, pa.int64())})

    held, asked = held.withColumn("cell", F.col("cell").cast("long")), asked.withColumn("cell", F.col("cell").cast("long"))
    found = meet(held.select("cell", "row", "tags", F.col("at").cast("long").alias("at")), asked.select("cell", "want").distinct(), run, "cell long, want array<long>, at long, n long", key="want")
    return found.groupBy("cell", "want", "at").agg(F.sum("n").alias("n"))


def spectrum(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(dist, n): how many pairs that pass are how far apart."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        dist, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            for _, _, d in _distances(left, right):
                flat = d.ravel().astype(np.int64)
                low = flat.min()
                if flat.max() - low < HELD:
                    n = np.bincount(flat - low)
                    values = np.flatnonzero(n)
                    n, values = n[values], values + low
                else:
                    values, n = np.unique(flat, return_counts=True)
                dist, at = np.unique(np.concatenate([dist, values]), return_inverse=True)
                total = np.bincount(at, np.concatenate([total, n])).astype(np.int64)  # sums below 2^53: exact
        return pa.table({"dist": pa.array(dist, pa.int64()), "n": pa.array(total, pa.int64())})

    return meet(held, asked, run, "dist long, n long").groupBy("dist").agg(F.sum("n").alias("n"))
