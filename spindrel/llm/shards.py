"""Searches of a stated query set against all rows, in blocks: every block of queries meets every shard of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a shard and queries of a block: what one task holds.
SHARD_ROWS, BLOCK_ROWS = 65_536, 2_048


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> DataFrame:
    """(id long, v array<double>) of the rows that take part: id and vector not null, every component finite; without all-zero vectors unless `zero`."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite)
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.ListArray) else flat.chunk(0)
    return np.asarray(flat.flatten(), dtype=dtype).reshape(len(flat), -1)


def search(rows: DataFrame, queries: DataFrame, k: int, task: Callable, score: str, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows and queries (id, v) -> query_id, rank, vec_id, score, the k best of each query by (score, smaller vec_id).

    Rows are dealt to shards, and queries to blocks, by the hash of id and vector, so that neither equal vectors nor equal ids
    gather more than their share. `task(rows' ids, rows, queries' ids, queries)` returns arrays (query number, vec_id, score) with
    at most k rows a query; vectors of another length than a query's are no candidates. Results of the shards are merged by rank.
    """
    n_rows, n_queries = rows.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_queries // block_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("v"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    kind = pa.float64() if score == "double" else pa.int64()

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            asking = np.asarray(right["id"].combine_chunks())
            at, ids, scores = task(np.asarray(left["id"].combine_chunks()), matrix(left["v"]), asking, matrix(right["v"]))
            found = (asking[at], ids, scores)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], kind)})

    by = ("block", "shard", "dim")
    found = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(both, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
