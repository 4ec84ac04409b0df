"""Batches of queries through strategies: outcomes for evaluation and planning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.operators import search, stats
from spindrel.operators.blocks import want
from spindrel.operators.evaluate import hits
from spindrel.operators.search import Budget, Corpus


def strategy(corpus: Corpus, queries: DataFrame, k: int, name: str, params: dict[str, str]) -> DataFrame:
    """A strategy of the registry by its name and the parameters of a spec."""
    budget = Budget(ef=int(params.get("ef", 100)), nprobe=int(params.get("nprobe", 16)), safety=float(params.get("safety", 1.0)), max_fetch=int(params.get("maxfetch", 10_000)), threshold=int(params.get("threshold", 0)))
    if name in corpus.extra:
        return corpus.extra[name](corpus, queries, k, params)
    if name == "S0":
        return search.s0(corpus, queries, k)
    if name == "S1":
        return search.s1(corpus, queries, k, budget, stats.match_counts(corpus, queries), corpus.items.count())
    if name == "S2":
        return search.s2(corpus, queries, k, budget)
    if name == "S3":
        return search.s3(corpus, queries, k, budget)
    if name == "S5":  # corpus.extra['edges'] of a larger degree
        return search.s5(corpus, queries, k, budget)
    if name == "S4":
        return search.s4(corpus, queries, k, budget.nprobe)
    if name == "S4L":
        return search.s4_filter(corpus, queries, k, budget.nprobe)
    if name == "S6":
        return search.s6(corpus, queries, k, *corpus.extra["per_tag"], ef=int(params.get("ef", 5_000)), small=int(params.get("small", 20_000)))
    raise ValueError(f"no strategy {name!r}")


def config_name(name: str, params: dict[str, str]) -> str:
    return name + (":" + ",".join(f"{k}={v}" for k, v in params.items()) if params else "")


def work(corpus: Corpus, queries: DataFrame, name: str, params: dict[str, str]) -> DataFrame:
    """(qid, scored): rows that S0 or S4 score."""
    if name not in ("S0", "S4"):
        raise ValueError(f"the work of {name} is not defined by counts alone")
    own = queries.select("qid", want().alias("want"))
    if name == "S0":
        return own.join(stats.counted(corpus, queries), "want").select("qid", F.col("n").alias("scored"))
    probed = search.probes(corpus, queries, int(params.get("nprobe", 16))).select("qid", F.col("cell").cast("long").alias("at"))
    return own.join(probed, "qid").join(stats.counted(corpus, queries, cells=corpus.cells), ["want", "at"]).groupBy("qid").agg(F.sum("n").alias("scored"))


def observe(corpus: Corpus, queries: DataFrame, specs: list[tuple[str, dict[str, str]]], truth: DataFrame, k: int = 10) -> DataFrame:
    """(config, qid, hits, possible, scored, matches, ntags) for each spec and each query that the truth has rows of."""
    counts = stats.match_counts(corpus, queries)

    def one(name: str, params: dict[str, str]) -> DataFrame:
        found = hits(strategy(corpus, queries, k, name, params), truth, k)
        done = found.join(work(corpus, queries, name, params), "qid", "left").join(counts, "qid")
        return done.select(F.lit(config_name(name, params)).alias("config"), "qid", "hits", "possible", F.coalesce("scored", F.lit(0)).alias("scored"), "matches", "ntags")

    return reduce(DataFrame.unionByName, [one(*s) for s in specs])


def planned(corpus: Corpus, queries: DataFrame, choices: DataFrame, specs: list[tuple[str, dict[str, str]]], k: int) -> DataFrame:
    """Each query through the config chosen for it: a plan per config, united."""
    parts = []
    for name, params in specs:
        own = queries.join(choices.where(F.col("config") == config_name(name, params)).select("qid"), "qid", "left_semi")
        parts.append(strategy(corpus, own, k, name, params))
    return reduce(DataFrame.unionByName, parts)
