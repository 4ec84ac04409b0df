"""Exact top-k by integer inner product: ball-tree branch and bound in each shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards

LEAF, TREE_ROWS = 64, 4_096


class BallTree:
    """Points in depth-first order with, for each level of the tree, its nodes' ranges, centres and radii."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(points))
        spans = [(0, len(points))]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # parent of each node, centres, radii
        parents = [0]
        while True:
            centres = np.array([points[order[a:b]].mean(0) for a, b in spans])
            radii = np.array([np.sqrt(((points[order[a:b]] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, centres, strict=True)])
            self.levels.append((np.array(parents), centres, radii))
            if all(b - a <= leaf for a, b in spans):
                break
            split, parents = [], []
            for i, (a, b) in enumerate(spans):
                if b - a <= leaf:
                    split.append((a, b))
                    parents.append(i)
                    continue
                part = points[order[a:b]]
                widest = (part.max(0) - part.min(0)).argmax()
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, widest], mid)]
                split += [(a, a + mid), (a + mid, b)]
                parents += [i, i]
            spans = split
        self.order, self.leaves = order, spans


def search_shard(k: int):
    """A task: every query walks the shard's trees, nodes in order of their upper bound; the kth score found so far goes on from tree to tree."""

    def task(ids: np.ndarray, points: np.ndarray, asking: np.ndarray, queries: np.ndarray):
        best = np.full((len(queries), k), -np.inf)
        best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        norms = np.sqrt((queries**2).sum(1))
        for start in range(0, len(points), TREE_ROWS):
            part, part_ids = points[start : start + TREE_ROWS], ids[start : start + TREE_ROWS]
            tree = BallTree(part)
            bound = None
            for parents, centres, radii in tree.levels:  # a node is looked at only where its parent may hold something better
                own = queries @ centres.T + norms[:, None] * radii
                own += 1e-9 * (1 + np.abs(own))  # the bound is rounded, scores are exact
                bound = own if bound is None else np.where(bound[:, parents] >= best[:, -1:], np.minimum(own, bound[:, parents]), -np.inf)
            ranked = np.argsort(-bound, axis=1, kind="stable")
            for step in range(len(tree.leaves)):
                leaf = ranked[:, step]
                alive = np.flatnonzero((bound[np.arange(len(queries)), leaf] >= best[:, -1]) & (bound[np.arange(len(queries)), leaf] > -np.inf))
                if not len(alive):
                    break
                for one in np.unique(leaf[alive]):
                    a, b = tree.leaves[one]
                    at, who = tree.order[a:b], alive[leaf[alive] == one]
                    score = queries[who] @ part[at].T
                    score[part_ids[at][None, :] == asking[who][:, None]] = -np.inf
                    new = (score >= best[who, -1:]).any(1) & (score.max(1) > -np.inf)
                    if not new.any():
                        continue
                    who, score = who[new], score[new]
                    scores = np.concatenate([best[who], score], axis=1)
                    names = np.concatenate([best_id[who], np.broadcast_to(part_ids[at], score.shape)], axis=1)
                    first = np.lexsort((names, -scores), axis=-1)[:, :k]
                    best[who], best_id[who] = np.take_along_axis(scores, first, 1), np.take_along_axis(names, first, 1)
        at, rank = np.nonzero(best > -np.inf)
        return at, best_id[at, rank], best[at, rank].astype(np.int64)

    return task


def top_k(vectors: DataFrame, every: int, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) -> query_id, rank, vec_id, score: the k highest integer inner products of each query.

    Components become floor(scale * x). Queries are the rows whose id is divisible by `every`; candidates every row of another id and the
    same length. Ties go to the smaller id; fewer than k candidates give fewer rows. Vectors that are null, empty or
    hold a null or a non-finite component, and rows without id, take no part. Repeated rows are candidates each for itself; as
    queries they count once. Sums must stay below 2^53, where doubles are exact. Other columns are not read.
    """
    rows = shards.usable(vectors, id_col, vector_col)
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")).alias("v"))
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    return shards.search(rows, asked, k, search_shard(k), "long")
