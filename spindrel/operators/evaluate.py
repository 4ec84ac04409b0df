"""Evaluation: tie-aware recall, summaries, weighting, frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hits(result: DataFrame, truth: DataFrame, count: int = 10, eps: float = 1e-6) -> DataFrame:
    """(qid, hits, possible): truth is (qid, rk, row, dist), deeper than `count` if ties at the border are to count.

    A result row is a hit if it is among the first `count` of the truth or ties with the last of these within eps;
    hits are distinct rows, at most `possible`, the rows the truth has up to `count`.
    """
    edge = truth.where(F.col("rk") == count).select("qid", F.col("dist").alias("edge"))
    good = truth.join(edge, "qid", "left").where((F.col("rk") <= count) | (F.abs(F.col("dist") - F.col("edge")) < eps)).select("qid", "row")
    got = result.select("qid", "row").distinct().join(good, ["qid", "row"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("got"))
    possible = truth.where(F.col("rk") <= count).groupBy("qid").agg(F.count(F.lit(1)).alias("possible"))
    return possible.join(got, "qid", "left").select("qid", F.least(F.coalesce("got", F.lit(0)), F.col("possible")).alias("hits"), "possible")


def recall(outcomes: DataFrame, *by: str) -> DataFrame:
    """Recall as the sum of hits over the sum of possible ones, by the given columns."""
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.sum("hits").alias("hits"), F.sum("possible").alias("possible"), (F.sum("hits") / F.sum("possible")).alias("recall"))


def summary(outcomes: DataFrame) -> DataFrame:
    """(bin, ntags, queries, recall, scored): per bin and number of tags, per bin, and overall (nulls), by rollup."""
    return outcomes.rollup("bin", "ntags").agg(F.count(F.lit(1)).alias("queries"), (F.sum("hits") / F.sum("possible")).alias("recall"), F.sum("scored").alias("scored"))


def latencies(timed: DataFrame, *by: str, column: str = "ms", digits: int = 3, weight: str | None = None) -> DataFrame:
    """Count, mean, p50, p90, p99, p999 and maximum of a column, rounded to `digits`: percentiles as the value that so many rows do not exceed.

    Values are counted first, so that a percentile sorts distinct values only; nulls are left out. weight: how often a row counts.
    """
    value = F.round(F.col(column).cast("double"), digits).alias("v")
    counted = timed.where(F.col(column).isNotNull()).groupBy(*by, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("c"))
    over = Window.partitionBy(*by)
    counted = counted.withColumn("upto", F.sum("c").over(over.orderBy("v"))).withColumn("n", F.sum("c").over(over))
    at = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
    picked = [F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * share), F.col("v"))).alias(name) for name, share in at.items()]
    return counted.groupBy(*by).agg(F.sum("c").alias("count"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), *picked, F.max("v").alias("most"))


def rate(queries: int, seconds: float) -> float:
    """Queries a second of a batch."""
    return queries / seconds if seconds > 0 else float("inf")


def weighted(per_bin: DataFrame, weights: DataFrame) -> DataFrame:
    """Recall of a population: per_bin (bin, recall), weights (bin, w)."""
    joined = per_bin.join(weights, "bin")
    return joined.agg((F.sum(F.col("w") * F.col("recall")) / F.sum("w")).alias("recall"))


def pareto(points: DataFrame) -> DataFrame:
    """(config, recall, cost) that no other point beats in both: more recall for at most the cost."""
    order = Window.orderBy(F.col("recall").desc(), "cost", "config")
    ranked = points.withColumn("_best", F.min("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return ranked.where(F.col("_best").isNull() | (F.col("cost") < F.col("_best"))).select("config", "recall", "cost")


def cheapest(points: DataFrame, least: float, *by: str) -> DataFrame:
    """The cheapest config with at least the given recall, per group; ties to the smaller name."""
    order = Window.partitionBy(*by).orderBy("cost", "config")
    return points.where(F.col("recall") >= least).withColumn("_i", F.row_number().over(order)).where("_i = 1").select(*by, "config", "recall", "cost")


def verify_truth(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row: queries, queries whose ids agree as sets, largest distance difference by rank."""
    ids = lambda df, name: df.groupBy("qid").agg(F.sort_array(F.collect_set("row")).alias(name))
    same = ids(ours, "a").join(ids(theirs, "b"), "qid", "full").agg(F.count(F.lit(1)).alias("queries"), F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("same"))
    far = ours.select("qid", "rk", F.col("dist").alias("x")).join(theirs.select("qid", "rk", F.col("dist").alias("y")), ["qid", "rk"]).agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"))
    return same.join(far, how="cross")
