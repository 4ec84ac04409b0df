"""Statistics of tags, queries and range attributes: exact counts, estimates and index-pick quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrel.operators.cut import cut
from spindrel.functions.predicates import Range, decade, in_ranges, selectivity_bin
from spindrel.operators import blocks
from spindrel.operators.blocks import want
from spindrel.operators.search import Corpus


def cardinality(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("card"))


def histogram(tags: DataFrame) -> DataFrame:
    """Tags by the decade of their cardinality."""
    return cardinality(tags).groupBy(decade(F.col("card")).alias("decade")).agg(F.count(F.lit(1)).alias("tags"), F.sum("card").alias("entries"))


def counted(corpus: Corpus, queries: DataFrame, ranges: tuple[Range, ...] = (), cells: DataFrame | None = None) -> DataFrame:
    """(want, at, n): rows that pass each set of tags that is asked for, by the cell (row, cell) they are in; 0 without cells. Every live row passes the empty set."""
    inside = corpus.attrs.where(in_ranges(ranges)).select("row") if ranges else None
    within = lambda df: df if inside is None else df.join(inside, "row", "left_semi")
    placed = lambda df: df.withColumn("at", F.lit(0)) if cells is None else df.join(cells.select("row", F.col("cell").alias("at")), "row")
    wanted = queries.select(F.lit(0).alias("cell"), want().alias("want")).distinct()
    tagged = blocks.tally(placed(within(corpus.sets())).withColumn("cell", F.lit(0)), wanted.where(F.size("want") > 0)).select("want", "at", "n")
    free = placed(within(corpus.items.select("row"))).groupBy(F.col("at").cast("long").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return tagged.unionByName(wanted.where(F.size("want") == 0).join(free, how="cross").select("want", "at", "n"))


def match_counts(corpus: Corpus, queries: DataFrame, ranges: tuple[Range, ...] = ()) -> DataFrame:
    """(qid, ntags, matches), exact; queries without matches stay with 0."""
    found = counted(corpus, queries, ranges).select("want", F.col("n").alias("matches"))
    own = queries.select("qid", F.size(F.array_distinct("qtags")).alias("ntags"), want().alias("want"))
    return own.join(found, "want", "left").select("qid", "ntags", F.coalesce("matches", F.lit(0)).alias("matches"))


def selectivity(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(qid, ntags, matches, sel, bin)."""
    live = corpus.items.count()
    sel = F.col("matches") / F.lit(float(max(live, 1)))
    return match_counts(corpus, queries).withColumn("sel", sel).withColumn("bin", selectivity_bin(F.col("sel")))


def bins(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """Queries by selectivity bin and number of tags."""
    return selectivity(corpus, queries).groupBy("bin", "ntags").agg(F.count(F.lit(1)).alias("queries"), F.sum("matches").alias("matches"))


def pick(values: DataFrame, column: str, shares: dict[str, float], group: str | None = None) -> DataFrame:
    """Index-pick quantiles: the value at position trunc(share * (n - 1)) in order; over all rows, by ranges of the value, so that no task sorts them all."""
    if group is None:
        return _pick_all(values.select(column), column, shares)
    over = Window.partitionBy(group)
    ranked = values.withColumn("_i", F.row_number().over(over.orderBy(column)) - 1).withColumn("_n", F.count(F.lit(1)).over(over))
    picked = [F.max(F.when(F.col("_i") == F.floor(F.lit(s) * (F.col("_n") - 1)), F.col(column))).alias(name) for name, s in shares.items()]
    return ranked.groupBy(group).agg(*picked)


def _pick_all(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    spark = values.sparkSession
    ranged = cut(values.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))  # written once: the ranges come from a sample
    sizes = sorted(tuple(r) for r in ranged.groupBy("_part").count().collect())  # a row for each partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = F.broadcast(spark.createDataFrame(starts, "_part int, _before long"))
    at = {name: int(s * (total - 1)) for name, s in shares.items()} if total else {}
    wanted = [next((p for p, start in reversed(starts) if start <= i), -1) for i in at.values()]
    order = Window.partitionBy("_part").orderBy(column)
    ranked = ranged.where(F.col("_part").isin(wanted)).withColumn("_i", F.row_number().over(order) - 1).join(before, "_part")
    return ranked.agg(*[F.max(F.when(F.col("_before") + F.col("_i") == at.get(name, -1), F.col(column))).alias(name) for name in shares])


def top_tags(tags: DataFrame, n: int = 20) -> DataFrame:
    """(tag, card) of the n most frequent tags, ties to the smaller tag."""
    return cardinality(tags).orderBy(F.col("card").desc(), "tag").limit(n)


def item_stats(items: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: items, mean, median, 99th percentile and maximum of tags per item, items without a tag."""
    sizes = items.select("row").join(tags.groupBy("row").agg(F.count(F.lit(1)).alias("n")), "row", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    histogram_ = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c"))  # few rows, so that the quantiles need no sort of items
    order = Window.orderBy("n")
    upto = histogram_.withColumn("upto", F.sum("c").over(order)).withColumn("all", F.sum("c").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("n")))
    return upto.agg(F.sum("c").alias("items"), (F.sum(F.col("n") * F.col("c")) / F.sum("c")).alias("mean_tags"), at(F.floor(F.col("all") / 2)).alias("p50"), at(F.floor(F.col("all") * 0.99)).alias("p99"), F.max("n").alias("most"), F.sum(F.when(F.col("n") == 0, F.col("c")).otherwise(0)).alias("without"))


def query_stats(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """By number of tags: queries, those without a match, with fewer than ten, and selectivity quantiles."""
    found = selectivity(corpus, queries)
    counts = found.groupBy("ntags").agg(F.count(F.lit(1)).alias("queries"), F.sum(F.when(F.col("matches") == 0, 1).otherwise(0)).alias("empty"), F.sum(F.when(F.col("matches") < 10, 1).otherwise(0)).alias("under10"))
    return counts.join(pick(found, "sel", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, "ntags"), "ntags")


def range_counts(attrs: DataFrame, ranges: tuple[Range, ...]) -> DataFrame:
    """(clause, n) of each clause alone and of all together (clause -1), in one pass; inverted clauses count 0."""
    counts = [F.count(F.when(in_ranges((r,)), 1)).alias(f"c{i}") for i, r in enumerate(ranges)]
    both = attrs.agg(*counts, F.count(F.when(in_ranges(ranges), 1)).alias("all"))
    rows = F.array(*[F.struct(F.lit(i).alias("clause"), F.col(f"c{i}").alias("n")) for i in range(len(ranges))], F.struct(F.lit(-1).alias("clause"), F.col("all").alias("n")))
    return both.select(F.inline(rows))


def estimates(corpus: Corpus, queries: DataFrame, ranges: tuple[Range, ...]) -> DataFrame:
    """(qid, matches, estimate): exact matches with ranges, and tag matches times the product of the ranges' shares, rounded."""
    n = corpus.attrs.count()
    counts = {r["clause"]: r["n"] for r in range_counts(corpus.attrs, ranges).collect()}
    share = 1.0
    for i in range(len(ranges)):
        share *= counts[i] / float(max(n, 1))
    base = match_counts(corpus, queries).select("qid", F.col("matches").alias("base"))
    exact = match_counts(corpus, queries, ranges).select("qid", "matches")
    return exact.join(base, "qid").select("qid", "matches", F.floor(F.col("base") * share + 0.5).cast("long").alias("estimate"))


def log_errors(estimated: DataFrame) -> DataFrame:
    """Median and 90th percentile (index picks) of |ln(estimate / matches)| where both are positive."""
    errors = estimated.where("matches > 0 AND estimate > 0").select(F.abs(F.log(F.col("estimate") / F.col("matches"))).alias("err"))
    return pick(errors, "err", {"p50": 0.5, "p90": 0.9}).select("p50", "p90")


def range_quantiles(attrs: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    return pick(attrs.select(column), column, shares)


def rank_of(attrs: DataFrame, column: str, value: int) -> DataFrame:
    """Rows below a value: its rank."""
    return attrs.agg(F.count(F.when(F.col(column) < value, 1)).alias("rank"))


def stratified(corpus: Corpus, queries: DataFrame, per_bin: int, seed: int = 42) -> DataFrame:
    """(qid, bin): up to per_bin queries of each selectivity bin, the first by a hash of their id."""
    mixed = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("qid").cast("string")))
    order = Window.partitionBy("bin").orderBy(mixed, "qid")
    return selectivity(corpus, queries).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= per_bin).select("qid", "bin")


def pick_queries(queries: DataFrame, step: int, limit: int, truth: DataFrame | None = None) -> DataFrame:
    """Every step-th query in order of qid, `limit` at most; with a truth, only of the queries that have rows in it."""
    if truth is not None:
        queries = queries.join(truth.select("qid"), "qid", "left_semi")
    queries = queries.orderBy("qid").limit(step * limit)  # each task keeps as many at most, and so does the window's
    return queries.withColumn("_i", F.row_number().over(Window.orderBy("qid")) - 1).where((F.col("_i") % step == 0) & (F.col("_i") < step * limit)).drop("_i")


def slice_of(items: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n items, the first by a hash of their number and the seed; truths are computed anew on the slice."""
    mixed = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("row").cast("string")))
    return items.orderBy(mixed, "row").limit(n)
