"""Search strategies: batches of queries with predicates against items, as DataFrame plans.

Every strategy takes a `Corpus` and queries (qid, qv, qtags, ...) and returns (qid, rk, row, dist) with rk from 1, ordered by
(dist, row). A query without matches has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindrel.functions.predicates import Range, has_all, in_ranges
from spindrel.functions.vectors import l2_u8
from spindrel.operators import blocks
from spindrel.operators.blocks import want


@dataclass(frozen=True)
class Budget:
    ef: int = 100
    nprobe: int = 16
    safety: float = 1.0
    max_fetch: int = 10_000
    threshold: int = 0


@dataclass(frozen=True)
class Corpus:
    """items (row, u8), tags (row, tag) of live rows, attrs (row, ...) and, for the inverted files, cells (row, cell) and centroids (cell, c); nested is tags as sets (row, tags)."""

    items: DataFrame
    tags: DataFrame
    attrs: DataFrame | None = None
    cells: DataFrame | None = None
    centroids: DataFrame | None = None
    extra: dict = field(default_factory=dict)
    nested: DataFrame | None = None

    def sets(self) -> DataFrame:
        """(row, tags): a row's tags as a set, bounded. `nested` where it is given."""
        return self.tags.groupBy("row").agg(F.collect_set("tag").alias("tags")) if self.nested is None else self.nested


#: Queries that `scan_tags` compares with all rows together; a larger batch is answered in several scans.
SCAN_QUERIES = 4_096
#: Items of a task of s1: each keeps as many rows of a query as the query fetches.
S1_ITEMS = 65_536


def best(scored: DataFrame, k) -> DataFrame:
    """(qid, row, dist) -> the first k of each query (Spark limits each task's groups before the shuffle)."""
    order = Window.partitionBy("qid").orderBy("dist", "row")
    return scored.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("qid", "rk", "row", "dist")


def matching(corpus: Corpus, queries: DataFrame, ranges: tuple[Range, ...] = ()) -> DataFrame:
    """(qid, row) of live rows that pass each query's predicate: relational division over postings.

    Unknown tags match nothing; a query without tags matches every live row (tags of the corpus are of live rows; a
    live row without any tag must be in items only and passes as well).
    """
    asked = queries.select("qid", F.size(F.array_distinct("qtags")).alias("n"), F.explode_outer(F.array_distinct("qtags")).alias("tag"))
    tagged = asked.where("n > 0").join(corpus.tags, "tag").groupBy("qid", "row").agg(F.count(F.lit(1)).alias("found"), F.first("n").alias("n")).where("found = n").select("qid", "row")
    free = asked.where("n <= 0").select("qid")
    if not free.isEmpty():
        tagged = tagged.union(corpus.items.select("row").join(free, how="cross").select("qid", "row"))
    if ranges:
        tagged = tagged.join(corpus.attrs.where(in_ranges(ranges)).select("row"), "row", "left_semi").select("qid", "row")
    return tagged


def scored(corpus: Corpus, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, row) pairs with exact distances. For few pairs; whole match sets go through `blocks`."""
    joined = pairs.join(corpus.items.select("row", "u8"), "row").join(queries.select("qid", "qv"), "qid")
    return joined.select("qid", "row", l2_u8("u8", "qv").alias("dist"))


def held(corpus: Corpus, ranges: tuple[Range, ...] = ()) -> DataFrame:
    """(row, u8, tags) of the items inside the ranges."""
    items = corpus.items.select("row", "u8")
    if ranges:
        items = items.join(corpus.attrs.where(in_ranges(ranges)).select("row"), "row", "left_semi")
    return items.join(corpus.sets(), "row", "left")


def asked(queries: DataFrame) -> DataFrame:
    return queries.select("qid", "qv", want().alias("want"))


def one_cell(df: DataFrame) -> DataFrame:
    return df.withColumn("cell", F.lit(0))


def s0(corpus: Corpus, queries: DataFrame, k: int, ranges: tuple[Range, ...] = ()) -> DataFrame:
    """Pre-filter and score every match: exact. A query without tags is matched by every item."""
    return best(blocks.top(one_cell(held(corpus, ranges)), one_cell(asked(queries)), k), k)


def scan(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact unfiltered top k."""
    return best(blocks.top(one_cell(_untagged(items)), one_cell(_asks_nothing(queries)), k), k)


def _untagged(items: DataFrame) -> DataFrame:
    return items.select("row", "u8", F.lit(None).cast("array<bigint>").alias("tags"))


def _asks_nothing(queries: DataFrame, *more: str) -> DataFrame:
    return queries.select("qid", "qv", F.array().cast("array<bigint>").alias("want"), *more)


def scan_tags(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(qid, row) of rows with all of a query's tags: the nested column is read once for a block of about SCAN_QUERIES queries."""
    count, out = max(1, -(-queries.count() // SCAN_QUERIES)), None
    for block in range(count):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(count)) == block).select("qid", "qtags")
        found = corpus.sets().join(F.broadcast(part), has_all("tags", "qtags")).select("qid", "row")
        out = found if out is None else out.union(found)
    return out


def s1(corpus: Corpus, queries: DataFrame, k: int, budget: Budget, match_counts: DataFrame, live: int) -> DataFrame:
    """Post-filter: fetch ceil(k / selectivity * safety) unfiltered neighbours (within max(k, ef) and max_fetch), keep those that pass.

    match_counts: (qid, matches). Queries that nothing matches return nothing.
    """
    least = max(k, budget.ef)
    if least > budget.max_fetch:
        raise ValueError(f"max(k, ef) = {least} is above max_fetch = {budget.max_fetch}")
    fetch = F.least(F.greatest(F.ceil(F.lit(float(k * live)) / F.col("matches") * budget.safety), F.lit(least)), F.lit(budget.max_fetch))
    wanted = match_counts.where("matches > 0").select("qid", fetch.cast("long").alias("fetch"))
    fetched = _asks_nothing(queries.join(wanted, "qid"), "fetch")
    near = best(blocks.top(one_cell(_untagged(corpus.items)), one_cell(fetched), None, items=S1_ITEMS), int(budget.max_fetch))
    near = near.join(wanted, "qid").where(F.col("rk") <= F.col("fetch")).select("qid", "row", "dist")
    passing = near.join(queries.select("qid", want().alias("want")), "qid").join(corpus.sets(), "row", "left")
    passing = passing.where(has_all(F.coalesce("tags", F.array().cast("array<bigint>")), "want"))
    return best(passing.select("qid", "row", "dist"), k)


def probes(corpus: Corpus, queries: DataFrame, nprobe: int) -> DataFrame:
    """(qid, cell, order, cdist): each query's nearest cells, ties to the smaller cell. Centroids are as few as the index has cells."""
    near = queries.select("qid", "qv").join(F.broadcast(corpus.centroids), how="cross")
    square = F.aggregate(F.zip_with("qv", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = near.select("qid", "cell", square.alias("cdist"))
    order = Window.partitionBy("qid").orderBy("cdist", "cell")
    return near.withColumn("order", F.row_number().over(order)).where(F.col("order") <= max(1, nprobe))


def s4(corpus: Corpus, queries: DataFrame, k: int, nprobe: int, ranges: tuple[Range, ...] = ()) -> DataFrame:
    """Inverted file: a query meets the nprobe nearest cells only, and there it is s0."""
    return _in_cells(corpus, queries, k, nprobe, ranges, False)


def s4_filter(corpus: Corpus, queries: DataFrame, k: int, nprobe: int, ranges: tuple[Range, ...] = ()) -> DataFrame:
    """The same cells as a plain filter: members of the probed cells first, then tags on the nested column."""
    return _in_cells(corpus, queries, k, nprobe, ranges, True)


def _in_cells(corpus: Corpus, queries: DataFrame, k: int, nprobe: int, ranges: tuple[Range, ...], scan: bool) -> DataFrame:
    members = held(corpus, ranges).join(corpus.cells, "row")
    visits = asked(queries).join(probes(corpus, queries, nprobe).select("qid", "cell"), "qid")
    return best(blocks.top(members, visits, k, scan=scan), k)


def s6(corpus: Corpus, queries: DataFrame, k: int, tag_cells: DataFrame, tag_centroids: DataFrame, ef: int = 5_000, nprobe: int = 1 << 30, small: int = 20_000) -> DataFrame:
    """Per-tag inverted files: the rarest indexed tag's cells, nearest first, until enough matches are scored.

    tag_cells (tag, cell, row), tag_centroids (tag, cell, c). Queries without an indexed tag or with at most `small` matches of their
    rarest one go to s0. A cell is visited while the matches in the cells before it are fewer than max(k, ef), and its order is at most nprobe.
    """
    cards = corpus.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("card"))
    indexed = tag_centroids.select("tag").distinct()
    lead = queries.select("qid", F.explode("qtags").alias("tag")).join(cards, "tag").join(indexed, "tag", "left_semi")
    lead = lead.groupBy("qid").agg(F.min(F.struct("card", "tag")).alias("lead")).select("qid", "lead.card", "lead.tag").where(F.col("card") > small)
    led = queries.join(lead, "qid")
    rest = s0(corpus, queries.join(lead, "qid", "left_anti"), k)
    square = F.aggregate(F.zip_with("qv", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    cells = led.select("qid", want().alias("want"), "tag", "qv").join(tag_centroids, "tag").select("qid", "want", "tag", "cell", square.alias("cdist"))
    members = tag_cells.join(lead.select("tag").distinct(), "tag", "left_semi").join(corpus.sets(), "row")
    sizes = blocks.tally(members.select(F.col("tag").alias("cell"), "row", "tags", F.col("cell").alias("at")), led.select(F.col("tag").alias("cell"), want().alias("want")))
    sizes = sizes.select(F.col("cell").alias("tag"), "want", F.col("at").cast("int").alias("cell"), "n")
    order = Window.partitionBy("qid").orderBy("cdist", "cell")
    ranked = cells.join(sizes, ["tag", "want", "cell"], "left").withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("order", F.row_number().over(order))
    visited = ranked.where((F.col("before") < max(k, ef)) & (F.col("order") <= nprobe) & F.col("n").isNotNull()).select("qid", F.struct("tag", F.col("cell").cast("int").alias("cell")).alias("cell"))
    inside = members.join(corpus.items.select("row", "u8"), "row").select(F.struct("tag", F.col("cell").cast("int").alias("cell")).alias("cell"), "row", "u8", "tags")
    return best(blocks.top(inside, asked(led).join(visited, "qid"), k), k).union(rest)


def s2(corpus: Corpus, queries: DataFrame, k: int, budget: Budget, threshold: int = 0) -> DataFrame:
    """Filtered search of the neighbour graph, see `graph.beam`; match sets of at most max(k, ef) rows are scored exactly instead.

    budget.threshold, or `threshold` where that is 0: predicates that pass a smaller percentage of the rows also expand two hops.
    """
    from spindrel.operators.graph import beam

    return beam(corpus, queries, k, max(k, budget.ef), budget.threshold if budget.threshold > 0 else threshold)


def s3(corpus: Corpus, queries: DataFrame, k: int, budget: Budget) -> DataFrame:
    """s2 with a threshold of 60 percent if the budget names none."""
    return s2(corpus, queries, k, budget, threshold=60)


def s5(corpus: Corpus, queries: DataFrame, k: int, budget: Budget) -> DataFrame:
    """s2 over a denser graph, with a threshold of 100 percent if the budget names none."""
    return s2(corpus, queries, k, budget, threshold=100)


def two_way(corpus: Corpus, queries: DataFrame, k: int, mt: float, nprobe: int) -> DataFrame:
    """Independence rule: expected selectivity (the product of the tags' shares) below mt goes to s0, the rest to s4."""
    estimate = independence(corpus, queries)
    rare = estimate.where(F.col("estimate") < mt).select("qid")
    often = estimate.where(F.col("estimate") >= mt).select("qid")
    return s0(corpus, queries.join(rare, "qid", "left_semi"), k).union(s4(corpus, queries.join(often, "qid", "left_semi"), k, nprobe))


def independence(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(qid, estimate): product over the query's tags of cardinality / live rows, in order of tag; unknown tags make it 0."""
    live = corpus.items.count()
    cards = corpus.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("card"))
    shares = queries.select("qid", F.explode_outer(F.array_distinct("qtags")).alias("tag")).join(cards, "tag", "left")
    shares = shares.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("tag", F.lit(-1)).alias("tag"), F.when(F.col("tag").isNull(), 1.0).otherwise(F.coalesce("card", F.lit(0)) / F.lit(float(live))).alias("share")))).alias("all"))
    return shares.select("qid", F.aggregate("all", F.lit(1.0), lambda p, x: p * x["share"]).alias("estimate"))
