"""Registered queries of the search engine over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.engine import Engine
from spindrel.functions.predicates import Range
from spindrel.functions.vectors import quantise
from spindrel.operators import blocks, evaluate, graph, ivf, model, runner, search, stats
from spindrel.operators.blocks import want
from spindrel.operators.cut import cut
from spindrel.operators.search import Budget, Corpus
from spindrel.plans import planner
from spindrel.streaming import applier, workload

K = 10
RANGES = (Range("uniform", 100_000, 700_000), Range("proj", -2_000, 500))
SPECS = planner.parse("S0;S4:nprobe=1|2|4")
#: Least queries of a fitted bin here, where batches are small.
FEW = 5
KNOB, TAU, TARGET = 400.0, 0.8, 0.85


def batch(spark: SparkSession, sf_dir: str, files: bool = False) -> tuple[Corpus, DataFrame]:
    """Corpus and queries, each table read from what is written once. `files`: the labels' centroids too, where a plan reads them."""
    items, sets = model.items(spark, sf_dir), cut(model.item_sets(spark, sf_dir))
    cells, centroids = ivf.label_cells(items)
    corpus = Corpus(items, sets.select("row", F.explode("tags").alias("tag")), model.attributes(items), cells, cut(centroids) if files else centroids, nested=sets)
    return corpus, cut(model.queries(spark, sf_dir, sets))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The data model (see operators.model) in SQL; later tables build on it.
BASE = """n AS (SELECT count(*) AS n FROM embeddings),
items AS (SELECT vec_id AS row, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT)) AS u8, label FROM embeddings),
ev AS (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
item_tags AS (SELECT DISTINCT row, tag FROM (
  SELECT vec_id AS row, CAST(label AS BIGINT) AS tag FROM embeddings
  UNION ALL SELECT event_id % n.n, CAST(9 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS BIGINT) FROM ev, n
  UNION ALL SELECT event_id % n.n, 100 + (k * k) // 100 FROM ev, n)),
bounds AS (SELECT row, min(tag) AS lo, max(tag) AS hi FROM item_tags GROUP BY row),
queries AS (SELECT i.row AS qid, i.u8 AS qv, CASE (i.row // 10) % 3 WHEN 0 THEN [lo] WHEN 1 THEN [hi] ELSE list_distinct([lo, hi]) END AS qtags
  FROM items i CROSS JOIN n JOIN bounds b ON b.row = (i.row * 7 + 3) % n.n WHERE i.row % 10 = 0),
asked AS (SELECT qid, len(qtags) AS nt, unnest(qtags) AS tag FROM queries),
matching AS (SELECT qid, row FROM asked JOIN item_tags USING (tag) GROUP BY qid, row HAVING count(*) = any_value(nt)),
scored AS (SELECT m.qid, m.row, CAST(list_sum(list_transform(list_zip(i.u8, q.qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS dist
  FROM matching m JOIN items i ON i.row = m.row JOIN queries q ON q.qid = m.qid)"""

ATTRS = """attrs AS (SELECT row, (row * 7919) % 1000003 AS uniform,
  CAST(list_sum(list_transform(u8, lambda x, i: x * (((i - 1) * 37) % 17 - 8))) AS BIGINT) AS proj FROM items)"""
IN_RANGES = "uniform BETWEEN 100000 AND 700000 AND proj BETWEEN -2000 AND 500"

CELLS = """cells AS (SELECT row, label AS cell FROM items),
means AS (SELECT label AS cell, i, CAST(sum(x) AS DOUBLE) / count(*) AS m FROM (SELECT label, unnest(u8) AS x, unnest(range(len(u8))) AS i FROM items) GROUP BY label, i),
centroids AS (SELECT cell, list(m ORDER BY i) AS c FROM means GROUP BY cell),
cdists AS (SELECT qid, cell, list_sum(list_transform(list_zip(qv, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS cdist FROM queries, centroids),
probed AS (SELECT qid, cell, CAST(row_number() OVER (PARTITION BY qid ORDER BY cdist, cell) AS INTEGER) AS ord FROM cdists)"""

COUNTS = """counts AS (SELECT q.qid, CAST(len(q.qtags) AS INTEGER) AS ntags, count(m.row) AS matches FROM queries q LEFT JOIN matching m ON m.qid = q.qid GROUP BY q.qid, q.qtags),
sels AS (SELECT *, matches / CAST(n.n AS DOUBLE) AS sel, CASE WHEN matches / CAST(n.n AS DOUBLE) < 0.0001 THEN 0 WHEN matches / CAST(n.n AS DOUBLE) < 0.001 THEN 1
  WHEN matches / CAST(n.n AS DOUBLE) < 0.01 THEN 2 WHEN matches / CAST(n.n AS DOUBLE) < 0.1 THEN 3 ELSE 4 END AS bin FROM counts, n)"""

OBS = """configs AS (SELECT * FROM (VALUES ('S0', 1000000), ('S4:nprobe=1', 1), ('S4:nprobe=2', 2), ('S4:nprobe=4', 4)) t(config, np)),
ranked AS (SELECT config, s.qid, s.row, s.dist, row_number() OVER (PARTITION BY config, s.qid ORDER BY s.dist, s.row) AS rk
  FROM scored s JOIN cells c ON c.row = s.row JOIN probed p ON p.qid = s.qid AND p.cell = c.cell JOIN configs ON ord <= np),
truth AS (SELECT qid, rk, row, dist FROM ranked WHERE config = 'S0'),
good AS (SELECT t.qid, t.row FROM truth t LEFT JOIN (SELECT qid, dist AS edge FROM truth WHERE rk = 10) e ON e.qid = t.qid WHERE t.rk <= 10 OR (t.rk <= 12 AND abs(t.dist - edge) < 1e-6)),
possible AS (SELECT qid, count(*) AS possible FROM truth WHERE rk <= 10 GROUP BY qid),
got AS (SELECT config, r.qid, count(*) AS got FROM ranked r JOIN good g ON g.qid = r.qid AND g.row = r.row WHERE r.rk <= 10 GROUP BY config, r.qid),
work AS (SELECT config, qid, count(*) AS scored FROM ranked GROUP BY config, qid),
obs AS (SELECT f.config, p.qid, least(coalesce(got, 0), possible) AS hits, possible, coalesce(scored, 0) AS scored, matches, ntags
  FROM possible p CROSS JOIN configs f JOIN counts c ON c.qid = p.qid LEFT JOIN got g ON g.config = f.config AND g.qid = p.qid LEFT JOIN work w ON w.config = f.config AND w.qid = p.qid)"""

MODELS = """models AS (SELECT config, CASE WHEN ntags >= 2 THEN 2 ELSE 1 END AS ntags, CAST(least(28, floor(log10(greatest(matches, 1)) * 4)) AS INTEGER) AS bin,
  avg(scored) AS lat0, sum(hits) / CAST(sum(possible) AS DOUBLE) AS rec0, count(*) AS n FROM obs GROUP BY ALL),
fitted AS (SELECT config, ntags, bin, (bin + 0.5) / 4 AS center, CASE WHEN n >= 5 THEN lat0 END AS lat, CASE WHEN n >= 5 THEN rec0 END AS rec, n FROM models),
xs AS (SELECT qid, CASE WHEN ntags >= 2 THEN 2 ELSE 1 END AS ntags, log10(CAST(greatest(matches, 1) AS DOUBLE)) AS x FROM counts),
ends AS (SELECT qid, config, x,
    max(struct_pack(center := center, lat := lat, rec := rec)) FILTER (center <= x) AS lo,
    min(struct_pack(center := center, lat := lat, rec := rec)) FILTER (center >= x) AS hi
  FROM xs JOIN fitted USING (ntags) WHERE lat IS NOT NULL GROUP BY qid, config, x),
predicted AS (SELECT qid, config,
    CASE WHEN lo IS NULL THEN hi.lat WHEN hi IS NULL OR lo.center = hi.center THEN lo.lat ELSE lo.lat + (x - lo.center) / (hi.center - lo.center) * (hi.lat - lo.lat) END AS lat,
    CASE WHEN lo IS NULL THEN hi.rec WHEN hi IS NULL OR lo.center = hi.center THEN lo.rec ELSE lo.rec + (x - lo.center) / (hi.center - lo.center) * (hi.rec - lo.rec) END AS rec FROM ends)"""


def register(name: str, sql: str | None = None, *tables: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            glue = "" if sql.startswith(",") else "\n"
            ORACLE_SQL[name] = "WITH " + ",\n".join((BASE, *tables)) + glue + sql
        return f

    return add


@register("s0_topk", "SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, row) AS INTEGER) AS rk, row, dist FROM scored) WHERE rk <= 10")
def s0_topk(spark, d):
    return search.s0(*batch(spark, d), K)


@register("s0_range", f"SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, s.row) AS INTEGER) AS rk, s.row, dist FROM scored s JOIN attrs a ON a.row = s.row WHERE {IN_RANGES}) WHERE rk <= 10", ATTRS)
def s0_range(spark, d):
    return search.s0(*batch(spark, d), K, RANGES)


@register("s0_range_only", f"""SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, row) AS INTEGER) AS rk, row, dist FROM (
  SELECT q.qid, i.row, CAST(list_sum(list_transform(list_zip(i.u8, q.qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS dist FROM queries q, items i JOIN attrs a ON a.row = i.row WHERE {IN_RANGES})) WHERE rk <= 10""", ATTRS)
def s0_range_only(spark, d):
    corpus, queries = batch(spark, d)
    inside = corpus.attrs.where("uniform BETWEEN 100000 AND 700000 AND proj BETWEEN -2000 AND 500").select("row")
    return search.scan(corpus.items.join(inside, "row", "left_semi"), queries, K)


@register("unfiltered_topk", """SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, row) AS INTEGER) AS rk, row, dist FROM (
  SELECT q.qid, i.row, CAST(list_sum(list_transform(list_zip(i.u8, q.qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS dist FROM queries q, items i)) WHERE rk <= 10""")
def unfiltered_topk(spark, d):
    corpus, queries = batch(spark, d)
    return search.scan(corpus.items, queries, K)


@register("s1_post_filter", """, alld AS (SELECT q.qid, i.row, CAST(list_sum(list_transform(list_zip(i.u8, q.qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS dist FROM queries q, items i),
r AS (SELECT qid, row, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, row) AS rk FROM alld),
f AS (SELECT c.qid, least(greatest(ceil(CAST(10 * n.n AS DOUBLE) / c.matches * 1.0), 50), 10000) AS fetch FROM counts c, n WHERE c.matches > 0)
SELECT * FROM (SELECT r.qid, CAST(row_number() OVER (PARTITION BY r.qid ORDER BY r.dist, r.row) AS INTEGER) AS rk, r.row, r.dist FROM r JOIN f ON f.qid = r.qid AND r.rk <= f.fetch JOIN matching m ON m.qid = r.qid AND m.row = r.row) WHERE rk <= 10""", COUNTS)
def s1_post_filter(spark, d):
    corpus, queries = batch(spark, d)
    return search.s1(corpus, queries, K, Budget(ef=50), stats.match_counts(corpus, queries), corpus.items.count())


@register("ivf_probe", "SELECT qid, cell, ord FROM probed WHERE ord <= 3", CELLS)
def ivf_probe(spark, d):
    return search.probes(*batch(spark, d, True), 3).select("qid", "cell", F.col("order").alias("ord"))


_S4 = "SELECT * FROM (SELECT s.qid, CAST(row_number() OVER (PARTITION BY s.qid ORDER BY s.dist, s.row) AS INTEGER) AS rk, s.row, s.dist FROM scored s JOIN cells c ON c.row = s.row JOIN probed p ON p.qid = s.qid AND p.cell = c.cell AND ord <= 3{0}) WHERE rk <= 10"


@register("s4_label_ivf", _S4.format(""), CELLS)
def s4_label_ivf(spark, d):
    return search.s4(*batch(spark, d, True), K, 3)


@register("s4_range", _S4.format(f" JOIN attrs a ON a.row = s.row WHERE {IN_RANGES}"), CELLS, ATTRS)
def s4_range(spark, d):
    return search.s4(*batch(spark, d, True), K, 3, RANGES)


@register("s4l_cell_filter", _S4.format(""), CELLS)
def s4l_cell_filter(spark, d):
    return search.s4_filter(*batch(spark, d, True), K, 3)


_CARDS = "cards AS (SELECT tag, count(*) AS card FROM item_tags GROUP BY tag)"
_EST = "est AS (SELECT a.qid, CASE WHEN count(*) = 1 THEN min(coalesce(card, 0) / CAST(n.n AS DOUBLE)) ELSE (1.0::DOUBLE * min(coalesce(card, 0) / CAST(n.n AS DOUBLE))) * max(coalesce(card, 0) / CAST(n.n AS DOUBLE)) END AS estimate FROM asked a CROSS JOIN n LEFT JOIN cards c ON c.tag = a.tag GROUP BY a.qid)"


@register("independence_estimate", "SELECT qid, round(estimate, 12) AS estimate FROM est", _CARDS, _EST)
def independence_estimate(spark, d):
    return search.independence(*batch(spark, d)).select("qid", F.round("estimate", 12).alias("estimate"))


@register("two_way_rule", """SELECT * FROM (SELECT s.qid, CAST(row_number() OVER (PARTITION BY s.qid ORDER BY s.dist, s.row) AS INTEGER) AS rk, s.row, s.dist
FROM scored s JOIN est e ON e.qid = s.qid JOIN cells c ON c.row = s.row JOIN probed p ON p.qid = s.qid AND p.cell = c.cell WHERE e.estimate < 0.05 OR ord <= 2) WHERE rk <= 10""", CELLS, _CARDS, _EST)
def two_way_rule(spark, d):
    return search.two_way(*batch(spark, d, True), K, 0.05, 2)


@register("tag_cardinality", "SELECT * FROM cards", _CARDS)
def tag_cardinality(spark, d):
    return stats.cardinality(model.item_tags(spark, d))


@register("tag_histogram", "SELECT CASE WHEN card < 1 THEN 0 ELSE CAST(floor(log10(card)) AS INTEGER) + 1 END AS decade, count(*) AS tags, CAST(sum(card) AS BIGINT) AS entries FROM cards GROUP BY 1", _CARDS)
def tag_histogram(spark, d):
    return stats.histogram(model.item_tags(spark, d))


@register("match_counts", "SELECT qid, ntags, matches FROM counts", COUNTS)
def match_counts(spark, d):
    return stats.match_counts(*batch(spark, d))


@register("selectivity_bins", "SELECT bin, ntags, count(*) AS queries, CAST(sum(matches) AS BIGINT) AS matches FROM sels GROUP BY bin, ntags", COUNTS)
def selectivity_bins(spark, d):
    return stats.bins(*batch(spark, d))


@register("items_stats", """, sizes AS (SELECT i.row, count(t.tag) AS n FROM items i LEFT JOIN item_tags t ON t.row = i.row GROUP BY i.row),
o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM sizes)
SELECT count(*) AS items, sum(n) / CAST(count(*) AS DOUBLE) AS mean_tags, max(n) FILTER (i = c // 2) AS p50, max(n) FILTER (i = floor(c * 0.99)) AS p99, max(n) AS most, count(*) FILTER (n = 0) AS without FROM o""")
def items_stats(spark, d):
    return stats.item_stats(model.items(spark, d), model.item_tags(spark, d))


@register("query_stats", """, o AS (SELECT *, row_number() OVER (PARTITION BY ntags ORDER BY sel) - 1 AS i, count(*) OVER (PARTITION BY ntags) AS c FROM sels)
SELECT ntags, count(*) AS queries, count(*) FILTER (matches = 0) AS empty, count(*) FILTER (matches < 10) AS under10, max(sel) FILTER (i = floor(0.01 * (c - 1))) AS p01,
  max(sel) FILTER (i = floor(0.5 * (c - 1))) AS p50, max(sel) FILTER (i = floor(0.99 * (c - 1))) AS p99 FROM o GROUP BY ntags""", COUNTS)
def query_stats(spark, d):
    return stats.query_stats(*batch(spark, d))


@register("range_counts", f"""SELECT 0 AS clause, count(*) AS n FROM attrs WHERE uniform BETWEEN 100000 AND 700000 UNION ALL SELECT 1, count(*) FROM attrs WHERE proj BETWEEN -2000 AND 500
UNION ALL SELECT 2, 0 UNION ALL SELECT -1, 0""", ATTRS)
def range_counts(spark, d):
    return stats.range_counts(model.attributes(model.items(spark, d)), (*RANGES, Range("uniform", 9, 3)))


_SHARES = "shares AS (SELECT (count(*) FILTER (uniform BETWEEN 100000 AND 700000) / CAST(count(*) AS DOUBLE)) * (count(*) FILTER (proj BETWEEN -2000 AND 500) / CAST(count(*) AS DOUBLE)) AS share FROM attrs)"
_ESTIMATED = f"estimated AS (SELECT c.qid, (SELECT count(*) FROM matching m JOIN attrs a ON a.row = m.row WHERE m.qid = c.qid AND {IN_RANGES}) AS matches, CAST(floor(c.matches * share + 0.5) AS BIGINT) AS estimate FROM counts c, shares)"


@register("range_estimates", "SELECT * FROM estimated", COUNTS, ATTRS, _SHARES, _ESTIMATED)
def range_estimates(spark, d):
    return stats.estimates(*batch(spark, d), RANGES)


@register("estimate_log_error", """, e AS (SELECT abs(ln(estimate / CAST(matches AS DOUBLE))) AS err FROM estimated WHERE matches > 0 AND estimate > 0),
o AS (SELECT err, row_number() OVER (ORDER BY err) - 1 AS i, count(*) OVER () AS c FROM e)
SELECT round(max(err) FILTER (i = floor(0.5 * (c - 1))), 12) AS p50, round(max(err) FILTER (i = floor(0.9 * (c - 1))), 12) AS p90 FROM o""", COUNTS, ATTRS, _SHARES, _ESTIMATED)
def estimate_log_error(spark, d):
    return stats.log_errors(stats.estimates(*batch(spark, d), RANGES)).select(F.round("p50", 12).alias("p50"), F.round("p90", 12).alias("p90"))


@register("range_quantiles", """, o AS (SELECT proj, row_number() OVER (ORDER BY proj) - 1 AS i, count(*) OVER () AS c FROM attrs)
SELECT max(proj) FILTER (i = floor(0.1 * (c - 1))) AS q10, max(proj) FILTER (i = floor(0.5 * (c - 1))) AS q50, max(proj) FILTER (i = floor(0.9 * (c - 1))) AS q90, count(*) FILTER (proj < 0) AS rank0 FROM o""", ATTRS)
def range_quantiles(spark, d):
    attrs = model.attributes(model.items(spark, d))
    return stats.range_quantiles(attrs, "proj", {"q10": 0.1, "q50": 0.5, "q90": 0.9}).join(stats.rank_of(attrs, "proj", 0).withColumnRenamed("rank", "rank0"), how="cross")


@register("stratified_subset", "SELECT qid, bin FROM (SELECT qid, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('42:' || qid), qid) AS i FROM sels) WHERE i <= 8", COUNTS)
def stratified_subset(spark, d):
    return stats.stratified(*batch(spark, d), 8)


@register("query_pick", "SELECT qid FROM (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS i FROM queries) WHERE i % 3 = 0 AND i < 3 * 12")
def query_pick(spark, d):
    return stats.pick_queries(model.queries(spark, d), 3, 12).select("qid")


@register("filter_modes", "SELECT qid, count(*) AS terms, count(*) AS nested, count(*) AS state FROM matching GROUP BY qid")
def filter_modes(spark, d):
    """The three ways of filtering: postings, a scan of the nested column, the state table; all find the same rows. A set of tags that several queries ask for is looked up once."""
    corpus, queries = batch(spark, d)
    own = queries.select("qid", want().alias("want"))
    wanted = cut(own.select(F.xxhash64("want").alias("qid"), F.col("want").alias("qtags")).groupBy("qtags").agg(F.first("qid").alias("qid")))
    live = Corpus(corpus.items, corpus.tags.groupBy("row").agg(F.sort_array(F.collect_set("tag")).alias("tags")).select("row", F.explode("tags").alias("tag")))
    ways = {"terms": search.matching(corpus, wanted), "nested": search.scan_tags(corpus, wanted), "state": search.matching(live, wanted)}
    found = wanted.select("qid", F.col("qtags").alias("want"))
    for name, pairs in ways.items():
        found = found.join(pairs.groupBy("qid").agg(F.count(F.lit(1)).alias(name)), "qid")
    return own.join(found.drop("qid"), "want").select("qid", *ways)


def observed(spark, d) -> tuple[Corpus, DataFrame, DataFrame]:
    corpus, queries = batch(spark, d, True)
    truth = cut(search.s0(corpus, queries, K + 2))
    return corpus, queries, cut(runner.observe(corpus, queries, SPECS, truth, K))


@register("recall_ties", "SELECT config, qid, hits, possible, scored, matches, ntags FROM obs", CELLS, COUNTS, OBS)
def recall_ties(spark, d):
    return observed(spark, d)[2]


@register("recall_by_config", "SELECT config, count(*) AS queries, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(possible) AS BIGINT) AS possible, sum(hits) / CAST(sum(possible) AS DOUBLE) AS recall FROM obs GROUP BY config", CELLS, COUNTS, OBS)
def recall_by_config(spark, d):
    return evaluate.recall(observed(spark, d)[2], "config")


@register("recall_summary", """SELECT bin, obs.ntags, count(*) AS queries, sum(hits) / CAST(sum(possible) AS DOUBLE) AS recall, CAST(sum(scored) AS BIGINT) AS scored
FROM obs JOIN sels USING (qid) WHERE config = 'S4:nprobe=2' GROUP BY ROLLUP (bin, obs.ntags)""", CELLS, COUNTS, OBS)
def recall_summary(spark, d):
    corpus, queries, found = observed(spark, d)
    return evaluate.summary(found.where("config = 'S4:nprobe=2'").join(stats.selectivity(corpus, queries).select("qid", "bin"), "qid"))


@register("weighted_recall", """, r AS (SELECT bin, sum(hits) / CAST(sum(possible) AS DOUBLE) AS recall FROM obs JOIN sels USING (qid) WHERE config = 'S4:nprobe=2' GROUP BY bin),
w AS (SELECT bin, CAST(count(*) AS DOUBLE) AS w FROM sels GROUP BY bin) SELECT round(sum(w * recall) / sum(w), 12) AS recall FROM r JOIN w USING (bin)""", CELLS, COUNTS, OBS)
def weighted_recall(spark, d):
    corpus, queries, found = observed(spark, d)
    sels = stats.selectivity(corpus, queries)
    per = evaluate.recall(found.where("config = 'S4:nprobe=2'").join(sels.select("qid", "bin"), "qid"), "bin")
    return evaluate.weighted(per, sels.groupBy("bin").agg(F.count(F.lit(1)).cast("double").alias("w"))).select(F.round("recall", 12).alias("recall"))


_POINTS = "points AS (SELECT config, sum(hits) / CAST(sum(possible) AS DOUBLE) AS recall, avg(scored) AS cost FROM obs GROUP BY config)"


def points(found: DataFrame) -> DataFrame:
    return found.groupBy("config").agg((F.sum("hits") / F.sum("possible")).alias("recall"), F.avg("scored").alias("cost"))


@register("pareto", "SELECT config, recall, cost FROM points p WHERE NOT EXISTS (SELECT 1 FROM points o WHERE o.recall >= p.recall AND o.cost <= p.cost AND (o.recall > p.recall OR o.cost < p.cost OR o.config < p.config))", CELLS, COUNTS, OBS, _POINTS)
def pareto(spark, d):
    return evaluate.pareto(points(observed(spark, d)[2]))


@register("best_config", """, p AS (SELECT bin, config, sum(hits) / CAST(sum(possible) AS DOUBLE) AS recall, avg(scored) AS cost FROM obs JOIN sels USING (qid) GROUP BY bin, config)
SELECT bin, config, recall, cost FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY cost, config) AS i FROM p WHERE recall >= 0.9) WHERE i = 1""", CELLS, COUNTS, OBS)
def best_config(spark, d):
    corpus, queries, found = observed(spark, d)
    per = found.join(stats.selectivity(corpus, queries).select("qid", "bin"), "qid").groupBy("bin", "config").agg((F.sum("hits") / F.sum("possible")).alias("recall"), F.avg("scored").alias("cost"))
    return evaluate.cheapest(per, 0.9, "bin")


@register("truth_check", "SELECT count(DISTINCT qid) AS queries, CAST(count(DISTINCT qid) AS BIGINT) AS same, CAST(0 AS BIGINT) AS max_diff FROM truth WHERE rk <= 10", CELLS, COUNTS, OBS)
def truth_check(spark, d):
    corpus, queries = batch(spark, d, True)
    return evaluate.verify_truth(search.s4(corpus, queries, K, 10), search.s0(corpus, queries, K))


@register("cost_fit", "SELECT config, ntags, bin, center, lat, rec, n FROM fitted", CELLS, COUNTS, OBS, MODELS)
def cost_fit(spark, d):
    return planner.fit(observed(spark, d)[2], FEW)


def predicted(spark, d) -> tuple[Corpus, DataFrame, DataFrame, DataFrame]:
    corpus, queries, found = observed(spark, d)
    return corpus, queries, found, cut(planner.predict(planner.fit(found, FEW), stats.match_counts(corpus, queries)))


@register("cost_predict", "SELECT qid, config, round(lat, 9) AS lat, round(rec, 9) AS rec FROM predicted", CELLS, COUNTS, OBS, MODELS)
def cost_predict(spark, d):
    return predicted(spark, d)[3].select("qid", "config", F.round("lat", 9).alias("lat"), F.round("rec", 9).alias("rec"))


_LAGRANGE = f"chosen AS (SELECT qid, config, lat, rec FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lat - {KNOB}::DOUBLE * rec, config) AS i FROM predicted) WHERE i = 1)"


@register("planner_lagrange", "SELECT qid, config, round(lat, 9) AS lat, round(rec, 9) AS rec FROM chosen", CELLS, COUNTS, OBS, MODELS, _LAGRANGE)
def planner_lagrange(spark, d):
    return planner.lagrange(predicted(spark, d)[3], KNOB).select("qid", "config", F.round("lat", 9).alias("lat"), F.round("rec", 9).alias("rec"))


@register("planner_threshold", f"""SELECT qid, config, round(lat, 9) AS lat, round(rec, 9) AS rec FROM (SELECT *, row_number() OVER (PARTITION BY qid
ORDER BY rec >= {TAU} DESC, CASE WHEN rec >= {TAU} THEN lat ELSE -rec END, config) AS i FROM predicted) WHERE i = 1""", CELLS, COUNTS, OBS, MODELS)
def planner_threshold(spark, d):
    return planner.threshold(predicted(spark, d)[3], TAU).select("qid", "config", F.round("lat", 9).alias("lat"), F.round("rec", 9).alias("rec"))


@register("planner_calibrate", f"""SELECT round(knob, 9) AS knob, round(recall, 9) AS recall, round(cost, 6) AS cost FROM (SELECT k.i AS knob_at, k.i / 100.0::DOUBLE AS knob, avg(rec) AS recall, avg(lat) AS cost FROM (
  SELECT i, qid, rec, lat, row_number() OVER (PARTITION BY i, qid ORDER BY rec >= i / 100.0::DOUBLE DESC, CASE WHEN rec >= i / 100.0::DOUBLE THEN lat ELSE -rec END, config) AS o FROM predicted, range(50, 101) t(i)) k WHERE o = 1 GROUP BY k.i)
WHERE recall >= {TARGET} ORDER BY cost, knob_at LIMIT 1""", CELLS, COUNTS, OBS, MODELS)
def planner_calibrate(spark, d):
    found = planner.calibrate(predicted(spark, d)[3], TARGET, rule="threshold")
    return found.select(F.round("knob", 9).alias("knob"), F.round("recall", 9).alias("recall"), F.round("cost", 6).alias("cost"))


_ORACLE = "best AS (SELECT qid, config, scored, hits, possible FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits >= ceil(0.9 * possible - 1e-9) DESC, scored, config) AS i FROM obs) WHERE i = 1)"


@register("oracle_choice", "SELECT * FROM best", CELLS, COUNTS, OBS, _ORACLE)
def oracle_choice(spark, d):
    return planner.oracle(observed(spark, d)[2], 0.9)


@register("misroutes", """SELECT count(*) AS queries, count(*) FILTER (c.config <> b.config) AS differs, count(*) FILTER (o.scored > 2 * b.scored) AS over_twice, count(*) FILTER (o.hits < 0.9::DOUBLE * o.possible) AS below
FROM chosen c JOIN obs o ON o.qid = c.qid AND o.config = c.config JOIN best b ON b.qid = c.qid""", CELLS, COUNTS, OBS, MODELS, _LAGRANGE, _ORACLE)
def misroutes(spark, d):
    _, _, found, expected = predicted(spark, d)
    return planner.misroutes(planner.lagrange(expected, KNOB), found, planner.oracle(found, 0.9))


@register("planned_search", """SELECT r.qid, CAST(r.rk AS INTEGER) AS rk, r.row, r.dist FROM ranked r JOIN chosen c ON c.qid = r.qid AND c.config = r.config WHERE rk <= 10""", CELLS, COUNTS, OBS, MODELS, _LAGRANGE)
def planned_search(spark, d):
    corpus, queries, _, expected = predicted(spark, d)
    return runner.planned(corpus, queries, cut(planner.lagrange(expected, KNOB)), SPECS, K)


@register("applier_final_state", """, e AS (SELECT event_id + 1 AS seq, user_id AS id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'set_attrs' END AS op, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
v AS (SELECT seq, id, op, CASE WHEN op = 'delete' THEN []::BIGINT[] WHEN op = 'insert' THEN list_distinct([k % 7, k % 11]) WHEN event_type = 'view' THEN [k % 13] ELSE [k % 5] END AS adds,
  CASE WHEN op = 'set_attrs' AND event_type <> 'view' THEN [k % 7] ELSE []::BIGINT[] END AS removes FROM e),
h AS (SELECT id, max(seq) AS version, max(seq) FILTER (op <> 'set_attrs') AS since, coalesce(arg_max(op, seq) FILTER (op <> 'set_attrs'), 'delete') = 'insert' AS live FROM v GROUP BY id),
t AS (SELECT v.id, v.seq, unnest(adds) AS tag, 1 AS o FROM v JOIN h ON h.id = v.id WHERE live AND (v.seq = since OR (v.seq > since AND op = 'set_attrs'))
  UNION ALL SELECT v.id, v.seq, unnest(list_filter(removes, lambda x: NOT list_contains(adds, x))), 0 FROM v JOIN h ON h.id = v.id WHERE live AND v.seq > since AND op = 'set_attrs'),
l AS (SELECT id, tag, arg_max(o, seq) AS o FROM t GROUP BY id, tag)
SELECT h.id, version, live, coalesce((SELECT string_agg(CAST(tag AS VARCHAR), ',' ORDER BY tag) FROM l WHERE l.id = h.id AND o = 1), '') AS tags FROM h""")
def applier_final_state(spark, d):
    state = applier.final_state(model.catalog_events(spark, d))
    return state.select("id", "version", "live", F.concat_ws(",", F.transform("tags", lambda t: t.cast("string"))).alias("tags"))


@register("overlay_lookup", "SELECT row, CAST(list_sum(CASE WHEN row % 7 = 0 THEN list_transform(u8, lambda x: 255 - x) ELSE u8 END) AS BIGINT) AS total FROM items")
def overlay_lookup(spark, d):
    base = model.items(spark, d)
    new = base.where("row % 7 = 0").select("row", F.transform("u8", lambda x: 255 - x).alias("u8"))
    return applier.overlay(base, new).select("row", F.aggregate("u8", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@register("range_windows", """, o AS (SELECT row, proj, row_number() OVER (ORDER BY proj, row) - 1 AS i, count(*) OVER () AS c FROM attrs)
SELECT lo.proj AS lo, hi.proj AS hi, (SELECT count(*) FROM attrs a WHERE a.proj BETWEEN lo.proj AND hi.proj) AS n FROM o lo JOIN o hi ON lo.i = floor(0.45 * (lo.c - 1)) AND hi.i = floor(0.55 * (hi.c - 1))""", ATTRS)
def range_windows(spark, d):
    """A window of about a tenth of the rows around the median, as the range experiment builds them."""
    attrs = model.attributes(model.items(spark, d))
    ends = stats.range_quantiles(attrs, "proj", {"lo": 0.45, "hi": 0.55})
    return attrs.join(F.broadcast(ends), F.col("proj").between(F.col("lo"), F.col("hi"))).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))


@register("kmeans_s4")
def kmeans_s4(spark, d):
    corpus, queries = batch(spark, d)
    centroids = cut(ivf.train(corpus.items, 16))
    return search.s4(Corpus(corpus.items, corpus.tags, corpus.attrs, ivf.assign(corpus.items, centroids), centroids), queries, K, 4)


@register("s6_per_tag")
def s6_per_tag(spark, d):
    corpus, queries = batch(spark, d)
    cells, centroids = ivf.per_tag(corpus.items, corpus.tags, min_count=20, per_cell=16, max_cells=64)
    return search.s6(corpus, queries, K, cut(cells), centroids, ef=60, small=30)


@register("graph_s2")
def graph_s2(spark, d):
    corpus, queries = batch(spark, d)
    return search.s2(Corpus(corpus.items, corpus.tags, extra={"edges": cut(graph.build(corpus.items, 16))}), queries, K, Budget(ef=32))


@register("graph_s3")
def graph_s3(spark, d):
    corpus, queries = batch(spark, d)
    return search.s3(Corpus(corpus.items, corpus.tags, extra={"edges": cut(graph.build(corpus.items, 16))}), queries, K, Budget(ef=32))


@register("graph_s5")
def graph_s5(spark, d):
    corpus, queries = batch(spark, d)
    return search.s5(Corpus(corpus.items, corpus.tags, extra={"edges": cut(graph.build(corpus.items, 32))}), queries, K, Budget(ef=32))


@register("quantised_vectors", "SELECT row, CAST(list_sum(u8) AS BIGINT) AS total, CAST(list_min(u8) AS INTEGER) AS least, CAST(list_max(u8) AS INTEGER) AS most FROM items")
def quantised_vectors(spark, d):
    rows = model.read(spark, d, "embeddings").select(F.col("vec_id").alias("row"), quantise("embedding").alias("u8"))
    return rows.select("row", F.aggregate("u8", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.array_min("u8").alias("least"), F.array_max("u8").alias("most"))


@register("dataset_slice", """, part AS (SELECT row, u8 FROM items ORDER BY md5('42:' || row), row LIMIT 100),
d AS (SELECT q.qid, p.row, CAST(list_sum(list_transform(list_zip(p.u8, q.qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS dist FROM queries q, part p)
SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, row) AS INTEGER) AS rk, row, dist FROM d) WHERE rk <= 10""")
def dataset_slice(spark, d):
    """The truth of a seeded slice of 100 items."""
    corpus, queries = batch(spark, d)
    return search.scan(stats.slice_of(corpus.items, 100), queries, K)


@register("tombstone_drift", """, shares AS (SELECT unnest([0, 20, 60]) AS share),
live AS (SELECT share, row FROM shares, items WHERE (row * 7919) % 100 >= share),
t AS (SELECT l.share, s.qid, s.row, s.dist, row_number() OVER (PARTITION BY l.share, s.qid ORDER BY s.dist, s.row) AS rk FROM scored s JOIN live l ON l.row = s.row),
v AS (SELECT l.share, s.qid, s.row, row_number() OVER (PARTITION BY l.share, s.qid ORDER BY s.dist, s.row) AS rk FROM scored s JOIN live l ON l.row = s.row
  JOIN cells c ON c.row = s.row JOIN probed p ON p.qid = s.qid AND p.cell = c.cell AND p.ord <= 2),
h AS (SELECT t.share, t.qid, count(*) AS possible, count(v.row) AS hits FROM t LEFT JOIN v ON v.share = t.share AND v.qid = t.qid AND v.row = t.row AND v.rk <= 10 WHERE t.rk <= 10 GROUP BY t.share, t.qid)
SELECT share, count(*) AS queries, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(possible) AS BIGINT) AS possible, sum(hits) / CAST(sum(possible) AS DOUBLE) AS recall FROM h GROUP BY share""", CELLS)
def tombstone_drift(spark, d):
    return workload.tombstone_drift(*batch(spark, d, True), K, 2, (0, 20, 60))


@register("constructed_workload", """, w AS (
  SELECT i * 1000000 // 20 AS due_us, 'insert' AS op, i + n.n AS id, CAST(i % 1000 AS VARCHAR) AS adds, '' AS removes, 0 AS o, i FROM range(200) t(i), n
  UNION ALL SELECT i * 1000000 // 30, 'delete', (i * 7919) % n.n, '', '', 1, i FROM range(300) t(i), n
  UNION ALL SELECT i * 1000000 // 50, 'set_attrs', (i * 104729 + 13) % n.n, CASE WHEN i % 2 = 0 THEN CAST(i % 1000 AS VARCHAR) ELSE '' END,
    CASE WHEN i % 2 = 1 THEN CAST(((i * 104729 + 13) % n.n) % 10 AS VARCHAR) ELSE '' END, 2, i FROM range(500) t(i), n)
SELECT row_number() OVER (ORDER BY due_us, o, i) AS seq, due_us, op, id, adds, removes FROM w""")
def constructed_workload(spark, d):
    made = workload.constructed(spark, model.read(spark, d, "embeddings").count(), 10, {"insert": 20, "delete": 30, "set_attrs": 50})
    text = lambda c: F.concat_ws(",", F.transform(c, lambda t: t.cast("string")))
    return made.select("seq", "due_us", "op", "id", text("add_tags").alias("adds"), text("remove_tags").alias("removes"))


@register("event_counters", """, e AS (SELECT event_id + 1 AS seq, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'set_attrs' END AS op FROM events)
SELECT op, count(*) AS applied, count(*) FILTER (seq % 10 = 0) AS skipped, max(seq) AS last_seq FROM e GROUP BY op""")
def event_counters(spark, d):
    """Counters of a stream in which every tenth event comes twice."""
    events = model.catalog_events(spark, d).select("seq", "id", "op")
    return workload.counters(events.union(events.where("seq % 10 = 0")))


_S0 = "SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, row) AS INTEGER) AS rk, row, dist FROM scored) WHERE rk <= 10"


@register("kmeans_all_cells", _S0)
def kmeans_all_cells(spark, d):
    """Trained cells, all of them probed: every row must be in exactly one, so the result is that of s0."""
    corpus, queries = batch(spark, d)
    centroids = cut(ivf.train(corpus.items, 16))
    return search.s4(Corpus(corpus.items, corpus.tags, corpus.attrs, ivf.assign(corpus.items, centroids), centroids), queries, K, 16)


@register("s6_all_cells", _S0)
def s6_all_cells(spark, d):
    """Per-tag files with room for every match: the result is that of s0."""
    corpus, queries = batch(spark, d)
    cells, centroids = ivf.per_tag(corpus.items, corpus.tags, min_count=20, per_cell=16, max_cells=64)
    return search.s6(corpus, queries, K, cut(cells), centroids, ef=1 << 40, small=30)


@register("graph_recall", """SELECT s AS strategy, count(*) AS queries, CAST(sum(n) AS BIGINT) AS possible, true AS enough
FROM (SELECT qid, least(count(*), 10) AS n FROM scored GROUP BY qid), (SELECT unnest(['S2', 'S3', 'S5']) AS s) GROUP BY s""")
def graph_recall(spark, d):
    """Whether S2, S3 and S5 find at least 0.9 of what s0 finds."""
    corpus, queries = batch(spark, d)
    truth = cut(search.s0(corpus, queries, K + 2))
    parts = []
    for name, degree in (("S2", 16), ("S3", 16), ("S5", 32)):
        held = Corpus(corpus.items, corpus.tags, extra={"edges": cut(graph.build(corpus.items, degree))})
        found = evaluate.recall(evaluate.hits(runner.strategy(held, queries, K, name, {"ef": "32"}), truth, K))
        parts.append(found.select(F.lit(name).alias("strategy"), "queries", "possible", (F.col("recall") >= 0.9).alias("enough")))
    return parts[0].union(parts[1]).union(parts[2])


@register("s4l_range", _S4.format(f" JOIN attrs a ON a.row = s.row WHERE {IN_RANGES}"), CELLS, ATTRS)
def s4l_range(spark, d):
    return search.s4_filter(*batch(spark, d, True), K, 3, RANGES)


@register("s0_untagged", f"""SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, row) AS INTEGER) AS rk, row, dist FROM (
  SELECT q.qid, i.row, CAST(list_sum(list_transform(list_zip(i.u8, q.qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS dist FROM queries q, items i JOIN attrs a ON a.row = i.row WHERE q.qid % 20 = 0 AND {IN_RANGES}
  UNION ALL SELECT s.qid, s.row, s.dist FROM scored s JOIN attrs a ON a.row = s.row WHERE s.qid % 20 <> 0 AND {IN_RANGES})) WHERE rk <= 10""", ATTRS)
def s0_untagged(spark, d):
    """Ranges alone for half of the queries, tags and ranges for the rest."""
    corpus, queries = batch(spark, d)
    return search.s0(corpus, queries.withColumn("qtags", F.when(F.col("qid") % 20 == 0, F.array().cast("array<bigint>")).otherwise(F.col("qtags"))), K, RANGES)


@register("top_tags", "SELECT tag, card FROM cards ORDER BY card DESC, tag LIMIT 20", _CARDS)
def top_tags(spark, d):
    return stats.top_tags(model.item_tags(spark, d))


@register("query_pick_valid", "SELECT qid FROM (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS i FROM (SELECT DISTINCT qid FROM matching)) WHERE i % 3 = 0 AND i < 3 * 12")
def query_pick_valid(spark, d):
    corpus, queries = batch(spark, d)
    return stats.pick_queries(queries, 3, 12, stats.match_counts(corpus, queries).where("matches > 0")).select("qid")


@register("scored_latency", """, t AS (SELECT round(CAST(dist AS DOUBLE) / 1000, 3) AS v FROM scored), o AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM t)
SELECT count(*) AS count, round(avg(v), 6) AS mean, min(v) FILTER (i >= ceil(n * 0.5::DOUBLE)) AS p50, min(v) FILTER (i >= ceil(n * 0.9::DOUBLE)) AS p90, min(v) FILTER (i >= ceil(n * 0.99::DOUBLE)) AS p99,
  min(v) FILTER (i >= ceil(n * 0.999::DOUBLE)) AS p999, max(v) AS most FROM o""")
def scored_latency(spark, d):
    """The summary of latencies, over distances in thousands in place of milliseconds, which no two runs share."""
    corpus, queries = batch(spark, d)
    timed = blocks.spectrum(search.one_cell(search.held(corpus)), search.one_cell(search.asked(queries))).select((F.col("dist") / 1000).alias("ms"), "n")
    return evaluate.latencies(timed, weight="n").withColumn("mean", F.round("mean", 6))


@register("plan_log", """SELECT config, count(*) AS queries, round(avg(c.lat), 6) AS predicted_cost, round(avg(o.scored), 6) AS cost, round(avg(c.rec), 9) AS predicted_recall, round(sum(hits) / CAST(sum(possible) AS DOUBLE), 9) AS recall
FROM chosen c JOIN obs o USING (qid, config) GROUP BY config""", CELLS, COUNTS, OBS, MODELS, _LAGRANGE)
def plan_log(spark, d):
    _, _, found, expected = predicted(spark, d)
    log = planner.plan_log(planner.lagrange(expected, KNOB), found)
    return log.select("config", "queries", *[F.round(c, n).alias(c) for c, n in (("predicted_cost", 6), ("cost", 6), ("predicted_recall", 9), ("recall", 9))])


@register("late_counters", """, e AS (SELECT event_id + 1 AS seq, user_id AS id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'set_attrs' END AS op FROM events),
o AS (SELECT op, seq, seq > coalesce(max(seq) OVER (PARTITION BY id ORDER BY (seq * 7919) % 1000003 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM e)
SELECT op, count(*) FILTER (done) AS applied, count(*) FILTER (NOT done) AS skipped, max(seq) AS last_seq FROM o GROUP BY op""")
def late_counters(spark, d):
    """Counters of a stream that arrives out of order."""
    events = model.catalog_events(spark, d).select("seq", "id", "op")
    return workload.counters(events.withColumn("at", (F.col("seq") * 7919) % 1_000_003), "at")


@register("merge_recall", """, live AS (SELECT row, u8, label FROM items WHERE (row * 7919) % 100 >= 60),
means2 AS (SELECT label AS cell, i, CAST(sum(x) AS DOUBLE) / count(*) AS m FROM (SELECT label, unnest(u8) AS x, unnest(range(len(u8))) AS i FROM live) GROUP BY label, i),
cents2 AS (SELECT cell, list(m ORDER BY i) AS c FROM means2 GROUP BY cell),
cd2 AS (SELECT qid, cell, list_sum(list_transform(list_zip(qv, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS cdist FROM queries, cents2),
p2 AS (SELECT qid, cell, row_number() OVER (PARTITION BY qid ORDER BY cdist, cell) AS ord FROM cd2),
t AS (SELECT s.qid, s.row, row_number() OVER (PARTITION BY s.qid ORDER BY s.dist, s.row) AS rk FROM scored s JOIN live l ON l.row = s.row),
v AS (SELECT s.qid, s.row, row_number() OVER (PARTITION BY s.qid ORDER BY s.dist, s.row) AS rk FROM scored s JOIN live l ON l.row = s.row JOIN p2 ON p2.qid = s.qid AND p2.cell = l.label AND p2.ord <= 2),
h AS (SELECT t.qid, count(*) AS possible, count(v.row) AS hits FROM t LEFT JOIN v ON v.qid = t.qid AND v.row = t.row AND v.rk <= 10 WHERE t.rk <= 10 GROUP BY t.qid)
SELECT count(*) AS queries, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(possible) AS BIGINT) AS possible, sum(hits) / CAST(sum(possible) AS DOUBLE) AS recall FROM h""")
def merge_recall(spark, d):
    return workload.merge_recall(*batch(spark, d), K, 2, 60)


@register("engine_updates", """, w AS (SELECT 10 * j AS r FROM range(20) t(j)),
put AS (SELECT r + 5 AS row FROM w UNION ALL SELECT n.n + j FROM range(5) t(j), n),
items2 AS (SELECT row, u8 FROM items WHERE row NOT IN (SELECT r + 1 FROM w) AND row NOT IN (SELECT row FROM put)
  UNION ALL SELECT row, list_transform(range(64), lambda i: (row * 31 + i * 7) % 256) FROM put),
tags2 AS (SELECT DISTINCT row, tag FROM (
  SELECT row, tag FROM item_tags WHERE row NOT IN (SELECT r + 1 FROM w) AND row NOT IN (SELECT row FROM put) AND NOT (tag = 10 AND row IN (SELECT r + 7 FROM w))
  UNION ALL SELECT r + 7, 12 FROM w
  UNION ALL SELECT row, unnest([row % 10, 11]) FROM put)),
m2 AS (SELECT qid, row FROM asked JOIN tags2 USING (tag) GROUP BY qid, row HAVING count(*) = any_value(nt)),
s2 AS (SELECT m.qid, m.row, CAST(list_sum(list_transform(list_zip(i.u8, q.qv), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS dist FROM m2 m JOIN items2 i ON i.row = m.row JOIN queries q ON q.qid = m.qid)
SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, row) AS INTEGER) AS rk, row, dist FROM s2) WHERE rk <= 10""")
def engine_updates(spark, d):
    """The inverted file over all cells after deletes, upserts, new rows and attribute changes, half of them compacted: what s0 finds."""
    corpus, queries = batch(spark, d, True)
    n, length = corpus.items.count(), len(corpus.items.first()["u8"])
    engine = Engine(spark, corpus.items, corpus.tags, corpus.attrs, cells=corpus.cells, centroids=corpus.centroids)
    for r in [10 * j + 5 for j in range(20)] + [n + j for j in range(5)]:
        engine.upsert(r, [(r * 31 + i * 7) % 256 for i in range(length)], [r % 10, 11])
    engine.compact()
    for j in range(20):
        engine.delete(10 * j + 1)
        engine.set_attrs(10 * j + 7, [12], [10])
    return search.s4(engine.corpus(), queries, K, 1 << 20)
