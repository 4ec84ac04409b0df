"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised with its own codebook (k-means on a bounded sample); the pair of
codes is a vector's cell. A query ranks both codebooks' centroids by inner product and walks the pairs in order of the
summed products with a heap (the multi-sequence algorithm) until the cells seen hold enough entries, which
are then scored exactly.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards

#: Centroids for each half; sample rows that codebooks are fitted on; share of a shard's rows that a query scores at least.
CODES, SAMPLE, VISIT = 64, 20_000, 0.55


def codebook(rows: np.ndarray, codes: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:codes]].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        sizes = np.bincount(near, minlength=len(centres))
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells (i, j) in decreasing order of first[i] + second[j] until those seen hold `enough` entries."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y, held = (-first[a]).tolist(), (-second[b]).tolist(), sizes[a][:, b].tolist()
    a, b = a.tolist(), b.tolist()
    heap, reached, cells = [(x[0] + y[0], 0, 0)], [0] * len(a), []  # reached[i]: cells taken in row i
    while heap and enough > 0:
        _, i, j = heapq.heappop(heap)
        if held[i][j]:
            cells.append((a[i], b[j]))
            enough -= held[i][j]
        reached[i] = j + 1
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return cells


def search_shard(k: int, books: dict[int, tuple[np.ndarray, np.ndarray]], visit: float):
    def task(ids: np.ndarray, points: np.ndarray, asking: np.ndarray, queries: np.ndarray):
        if points.shape[1] == 1:  # a zero besides makes two halves and changes no product
            points, queries = np.pad(points, ((0, 0), (0, 1))), np.pad(queries, ((0, 0), (0, 1)))
        half = points.shape[1] // 2
        if points.shape[1] not in books:  # a length so rare that the sample has none of it: the shard's own rows serve
            books[points.shape[1]] = codebook(points[:SAMPLE, :half], CODES), codebook(points[:SAMPLE, half:], CODES)
        one, two = books[points.shape[1]]
        cell = nearest(points[:, :half], one) * len(two) + nearest(points[:, half:], two)
        order = np.lexsort((ids, cell))
        points, ids, cell = points[order], ids[order], cell[order]
        ends = np.searchsorted(cell, np.arange(len(one) * len(two) + 1))
        sizes = np.diff(ends).reshape(len(one), len(two))
        first, second = queries[:, :half] @ one.T, queries[:, half:] @ two.T
        enough = max(10 * k, int(visit * len(points)))
        out: tuple[list, list, list] = ([], [], [])
        for q, query in enumerate(queries):
            cells = [i * len(two) + j for i, j in walk(first[q], second[q], sizes, enough)]
            seen = np.concatenate([np.arange(ends[c], ends[c + 1]) for c in sorted(cells)]) if cells else np.zeros(0, int)
            seen = seen[ids[seen] != asking[q]]
            rough = points[seen] @ query
            if len(seen) > k:
                seen = seen[rough >= np.partition(rough, -k)[-k] - 1e-9 * (1 + np.abs(rough).max())]
            score = (points[seen] * query).sum(1)  # row by row, so that equal vectors have equal scores
            best = np.lexsort((ids[seen], -score))[:k]
            out[0].append(np.full(len(best), q))
            out[1].append(ids[seen[best]])
            out[2].append(score[best])
        return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in out)

    return task


def neighbours(vectors: DataFrame, every: int, k: int, visit: float = VISIT, codes: int = CODES, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) -> query_id, rank, vec_id, score: (nearly) the k largest inner products of each query, in doubles.

    Queries are the rows whose id is divisible by `every`; candidates every row of another id and the same length. `sample` bounds the
    rows that codebooks are fitted on (those with the smallest hashes of their ids); every row is indexed. Scores are
    exact. Ties go to the smaller id. Vectors that are null, empty, all zero or hold a null or a non-finite
    component, and rows without id, take no part. Repeated rows are candidates each for itself; as queries they
    count once. Recall against brute force on random vectors is in the README and a test. Other columns are not read.
    """
    rows = shards.usable(vectors, id_col, vector_col, zero=False)
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"].tolist()
    books = {}
    for dim in {len(v) for v in fitted} - {1}:
        part = np.array([v for v in fitted if len(v) == dim])
        books[dim] = codebook(part[:, : dim // 2], codes), codebook(part[:, dim // 2 :], codes)
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    return shards.search(rows, asked, k, search_shard(k, books, visit), "double")
