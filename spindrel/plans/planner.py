"""The per-query planner: cost models fitted on observed work and recall, choices, calibration, oracle.

Work is the number of rows scored, which is exact and repeatable; wall time in Spark belongs to batches.
observations: (config, qid, hits, possible, scored, matches, ntags). models: (config, pos, ntags, bin, center, lat, rec, n).
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrel.functions.predicates import match_bin

LEAST = 20


def parse(spec: str) -> list[tuple[str, dict[str, str]]]:
    """`NAME:k=v,k=v;NAME` with `|` between alternative values -> every combination, in order."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(";"))):
        name, _, rest = part.partition(":")
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"not a strategy: {part!r}")
        pairs = [p.partition("=") for p in rest.split(",") if p]
        if any(not eq for _, eq, _ in pairs):
            raise ValueError(f"not key=value in {part!r}")
        out += [(name, dict(zip([k for k, _, _ in pairs], values, strict=True))) for values in product(*(v.split("|") for _, _, v in pairs))]
    return out


def tag_class(ntags) -> F.Column:
    """1 for one tag or none, 2 for more."""
    return F.when(ntags >= 2, 2).otherwise(1)


def fit(observations: DataFrame, least: int = LEAST) -> DataFrame:
    """Mean work and recall per config, tag class and match bin; null where fewer than `least` queries were seen."""
    per = observations.groupBy("config", tag_class(F.col("ntags")).alias("ntags"), match_bin(F.col("matches")).alias("bin"))
    fitted = per.agg(F.avg("scored").alias("lat"), (F.sum("hits") / F.sum("possible")).alias("rec"), F.count(F.lit(1)).alias("n"))
    enough = F.col("n") >= least
    return fitted.select("config", "ntags", "bin", ((F.col("bin") + 0.5) / 4).alias("center"), F.when(enough, F.col("lat")).alias("lat"), F.when(enough, F.col("rec")).alias("rec"), "n")


def predict(models: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, config, lat, rec) by linear interpolation over log10(matches) between observed bins, flat beyond the ends.

    queries: (qid, matches, ntags). Configs without an observed bin for a query's tag class predict nothing. Models are small: a few
    configs, two classes, 29 bins.
    """
    asked = queries.select("qid", tag_class(F.col("ntags")).alias("ntags"), F.log10(F.greatest(F.col("matches"), F.lit(1)).cast("double")).alias("x"))
    seen = F.broadcast(models.where("lat IS NOT NULL").select("config", "ntags", "center", "lat", "rec"))  # at most 29 rows a config and class
    joined = asked.join(seen, "ntags")
    point = F.struct("center", "lat", "rec")
    ends = joined.groupBy("qid", "config", "x").agg(F.max(F.when(F.col("center") <= F.col("x"), point)).alias("lo"), F.min(F.when(F.col("center") >= F.col("x"), point)).alias("hi"))
    share = (F.col("x") - F.col("lo.center")) / (F.col("hi.center") - F.col("lo.center"))

    def between(name: str) -> F.Column:
        lo, hi = F.col(f"lo.{name}"), F.col(f"hi.{name}")
        return F.when(F.col("lo").isNull(), hi).when(F.col("hi").isNull() | (F.col("lo.center") == F.col("hi.center")), lo).otherwise(lo + share * (hi - lo)).alias(name)

    return ends.select("qid", "config", between("lat"), between("rec"))


def lagrange(predicted: DataFrame, knob: float) -> DataFrame:
    """The config with the least work - knob * recall; ties to the smaller name."""
    order = Window.partitionBy("qid").orderBy(F.col("lat") - F.lit(float(knob)) * F.col("rec"), "config")
    return predicted.withColumn("_i", F.row_number().over(order)).where("_i = 1").select("qid", "config", "lat", "rec")


def threshold(predicted: DataFrame, tau: float) -> DataFrame:
    """The cheapest config with a predicted recall of tau, else the one with the highest."""
    good = F.col("rec") >= tau
    order = Window.partitionBy("qid").orderBy(good.desc(), F.when(good, F.col("lat")).otherwise(-F.col("rec")), "config")
    return predicted.withColumn("_i", F.row_number().over(order)).where("_i = 1").select("qid", "config", "lat", "rec")


def calibrate(predicted: DataFrame, target: float, grid: list[float] | None = None, rule: str = "lagrange") -> DataFrame:
    """(knob, recall, cost): the grid value of least mean work whose mean predicted recall reaches the target; else the last value with nulls."""
    if grid is None:
        grid = [10 ** (i / 10) for i in range(81)] if rule == "lagrange" else [i / 100 for i in range(50, 101)]
    knobs = F.broadcast(predicted.sparkSession.createDataFrame([(i, float(g)) for i, g in enumerate(grid)], "at int, knob double"))  # the grid's few values
    tried = predicted.join(knobs, how="cross")
    if rule == "lagrange":
        keys = [F.col("lat") - F.col("knob") * F.col("rec")]
    else:
        good = F.col("rec") >= F.col("knob")
        keys = [good.desc(), F.when(good, F.col("lat")).otherwise(-F.col("rec"))]
    order = Window.partitionBy("at", "qid").orderBy(*keys, "config")
    means = tried.withColumn("_i", F.row_number().over(order)).where("_i = 1").groupBy("at", "knob").agg(F.avg("rec").alias("recall"), F.avg("lat").alias("cost"))
    first = Window.orderBy((F.col("recall") >= target).desc(), F.when(F.col("recall") >= target, F.col("cost")), F.when(F.col("recall") >= target, F.col("at")).otherwise(-F.col("at")))
    chosen = means.withColumn("_i", F.row_number().over(first)).where("_i = 1")
    met = F.col("recall") >= target
    return chosen.select("knob", F.when(met, F.col("recall")).alias("recall"), F.when(met, F.col("cost")).alias("cost"))


def oracle(observations: DataFrame, share: float) -> DataFrame:
    """Per query that every config answered: the cheapest config that got share * possible of its neighbours, else the cheapest."""
    configs = observations.select("config").distinct().count()
    full = observations.groupBy("qid").agg(F.countDistinct("config").alias("n")).where(F.col("n") == configs).select("qid")
    good = F.col("hits") >= F.ceil(F.lit(share) * F.col("possible") - 1e-9)
    order = Window.partitionBy("qid").orderBy(good.desc(), "scored", "config")
    return observations.join(full, "qid", "left_semi").withColumn("_i", F.row_number().over(order)).where("_i = 1").select("qid", "config", "scored", "hits", "possible")


def misroutes(choices: DataFrame, observations: DataFrame, best: DataFrame) -> DataFrame:
    """One row: queries, choices that differ from the oracle's, that cost over twice as much, that miss 0.9 of their neighbours."""
    took = choices.select("qid", "config").join(observations, ["qid", "config"])
    both = took.join(best.select("qid", F.col("config").alias("oracle"), F.col("scored").alias("least")), "qid")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.agg(F.count(F.lit(1)).alias("queries"), one(F.col("config") != F.col("oracle")).alias("differs"), one(F.col("scored") > 2 * F.col("least")).alias("over_twice"), one(F.col("hits") < F.lit(0.9) * F.col("possible")).alias("below"))


def save(models: DataFrame, path: str) -> None:
    """Fitted models as JSON; bins of too few queries keep their nulls."""
    models.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load(spark, path: str) -> DataFrame:
    """Models that `save` wrote; NaN counts as null."""
    read = spark.read.schema("config string, ntags int, bin int, center double, lat double, rec double, n long").json(path)
    return read.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("lat", "rec")})


def plan_log(choices: DataFrame, observations: DataFrame) -> DataFrame:
    """(config, queries, predicted_cost, cost, predicted_recall, recall): what was chosen how often, and what came of it."""
    took = choices.join(observations.select("qid", "config", "hits", "possible", "scored"), ["qid", "config"])
    return took.groupBy("config").agg(F.count(F.lit(1)).alias("queries"), F.avg("lat").alias("predicted_cost"), F.avg("scored").alias("cost"), F.avg("rec").alias("predicted_recall"), (F.sum("hits") / F.sum("possible")).alias("recall"))
