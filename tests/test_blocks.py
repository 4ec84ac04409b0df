"""Exact searches, counts and distances in blocks against brute force: many small tasks, no table of pairs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.operators import blocks, ivf, runner, search, stats
from spindrel.operators.search import Budget, Corpus


@pytest.fixture(scope="module")
def crowd(spark):
    """300 vectors that tie often, with tags that overlap, and queries of which several ask for the same tags, for none or for unknown ones."""
    rng = np.random.default_rng(5)
    points, tags = rng.integers(0, 4, (300, 6)), [sorted({int(i % 3), *map(int, rng.integers(3, 9, 3))}) for i in range(300)]
    wanted = [[0], [3], [3, 0], [0, 3], [], [777], [5, 777], [1, 4, 5]]
    asked = [(q, rng.integers(0, 4, 6).tolist(), wanted[q % len(wanted)]) for q in range(40)]
    items = spark.createDataFrame([(i, p.tolist(), i % 5) for i, p in enumerate(points)], "row long, u8 array<int>, label int")
    long = spark.createDataFrame([(i, t) for i, ts in enumerate(tags) for t in ts], "row long, tag long")
    cells, centroids = ivf.label_cells(items)
    truth = {q: sorted((int(((points[i] - np.array(v)) ** 2).sum()), i) for i in range(300) if set(w) <= set(tags[i])) for q, v, w in asked}
    return Corpus(items, long, None, cells, centroids), spark.createDataFrame(asked, "qid long, qv array<int>, qtags array<long>"), truth


@pytest.fixture
def tiny(monkeypatch):
    """Many tasks; whoever pairs queries with all their matches fails."""
    for name, value in (("ITEMS", 40), ("QUERIES", 7), ("LEAST", 8), ("HELD", 64)):
        monkeypatch.setattr(blocks, name, value)

    def pairs(*_):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(search, "matching", pairs)
    monkeypatch.setattr(search, "scored", pairs)


def answer(df):
    out = {}
    for r in df.orderBy("qid", "rk").collect():
        out.setdefault(r["qid"], []).append((r["dist"], r["row"]))
    return out


def test_searches_pair_nothing(crowd, tiny):
    corpus, queries, truth = crowd
    want = {q: t[:10] for q, t in truth.items() if t}
    assert answer(search.s0(corpus, queries, 10)) == want
    assert answer(search.s4(corpus, queries, 10, 5)) == answer(search.s4_filter(corpus, queries, 10, 5)) == want
    cells, centroids = ivf.per_tag(corpus.items, corpus.tags, 30, 20, 4)
    assert answer(search.s6(corpus, queries, 10, cells, centroids, ef=10_000, small=0)) == want
    probed = {(r["qid"], r["cell"]) for r in search.probes(corpus, queries, 2).collect()}
    near = {q: [x for x in t if (q, x[1] % 5) in probed] for q, t in truth.items()}
    assert answer(search.s4(corpus, queries, 10, 2)) == {q: t[:10] for q, t in near.items() if t}
    scored = {r["qid"]: r["scored"] for r in runner.work(corpus, queries, "S4", {"nprobe": "2"}).collect()}
    assert scored == {q: len(t) for q, t in near.items() if t}


def test_post_filter_keeps_each_querys_own_fetch(crowd, tiny):
    corpus, queries, truth = crowd
    got = answer(search.s1(corpus, queries, 4, Budget(ef=20), stats.match_counts(corpus, queries), 300))
    everything = {r["qid"]: r["qv"] for r in queries.collect()}
    points = {r["row"]: r["u8"] for r in corpus.items.collect()}
    for q, t in truth.items():
        fetch = max(-(-4 * 300 // len(t)), 20) if t else 0
        first = sorted((sum((a - b) ** 2 for a, b in zip(p, everything[q])), i) for i, p in points.items())[:fetch]
        assert got.get(q, []) == [x for x in first if x in set(t)][:4]


def test_counts_and_distances(crowd, tiny):
    corpus, queries, truth = crowd
    assert {r["qid"]: r["matches"] for r in stats.match_counts(corpus, queries).collect()} == {q: len(t) for q, t in truth.items()}
    found = blocks.spectrum(search.one_cell(search.held(corpus)), search.one_cell(search.asked(queries)))
    assert {r["dist"]: r["n"] for r in found.collect()} == Counter(d for t in truth.values() for d, _ in t)


def test_lengths_must_agree(crowd):
    corpus, queries, _ = crowd
    with pytest.raises(Exception, match="components"):
        search.s0(corpus, queries.withColumn("qv", F.slice("qv", 1, 3)), 3).collect()
