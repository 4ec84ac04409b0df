"""File formats, the applier as stream and as algebra, replays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrel.engine import Engine
from spindrel.sources import formats, kafka
from spindrel.streaming import applier, workload

EVENT = "seq long, id long, op string, add_tags array<long>, remove_tags array<long>, produced_at timestamp"


def test_round_trips(spark, tmp_path):
    formats.register(spark)
    rng = np.random.default_rng(1)
    u8, f32 = rng.integers(0, 256, (25, 7)), rng.random((25, 7)).astype("f4")
    tags = [[1, 5], [], [0, 2, 9], *[[int(i)] for i in range(10)]]
    for kind, data in (("u8bin", u8.tolist()), ("fbin", f32.tolist()), ("spmat", tags)):
        path, kinds = str(tmp_path / f"x.{kind}"), {"u8bin": "v array<int>", "fbin": "v array<float>", "spmat": "tags array<int>"}
        df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"row long, {kinds[kind]}").repartitionByRange(3, "row").sortWithinPartitions("row")
        df.write.format(kind).option("columns", 10).mode("append").save(path)
        back = spark.read.format(kind).option("rows", 4).load(path).orderBy("row").collect()
        assert [r[0] for r in back] == list(range(len(data))) and [r[1] for r in back] == data
        assert spark.read.format(kind).option("limit", 3).load(path).count() == 3
    assert formats.peek(str(tmp_path / "x.u8bin")) == (25, 7)
    with open(tmp_path / "x.u8bin", "ab") as f:
        f.write(b"!")
    with pytest.raises(Exception, match="header"):
        spark.read.format("u8bin").load(str(tmp_path / "x.u8bin")).count()
    truth = spark.createDataFrame([(0, 1, 7, 1.0), (0, 2, 8, 2.0), (1, 1, 4, 0.5)], "qid long, rk int, row long, dist float")
    formats.write_ibin(truth, str(tmp_path / "t.ibin"), 3)
    assert sorted(map(tuple, spark.read.format("ibin").load(str(tmp_path / "t.ibin")).collect())) == sorted(map(tuple, truth.collect()))


def test_text_formats(spark, tmp_path):
    (tmp_path / "book.yaml").write_text("set:\n  max_pts: 9\n  1: {operation: insert, start: 0, end: 5}\n  2: {operation: delete, start: 1, end: 3}\n  3: {operation: search}\n  gt_url: none\n")
    most, steps = formats.read_runbook(str(tmp_path / "book.yaml"), "set")
    assert most == 9 and [s["operation"] for s in steps] == ["insert", "delete", "search"]
    items = spark.range(8).withColumnRenamed("id", "row")
    assert applier.replay(spark, steps, items, lambda df, i: df.agg(F.sum("row")).first()[0]) == [0 + 3 + 4]
    rows = spark.createDataFrame([(1, 9, 10, 12.5, 100, 50, 1)], formats.OUTCOMES)
    formats.write_outcomes(rows, str(tmp_path / "q.tsv"))
    assert formats.read_outcomes(spark, str(tmp_path / "q.tsv")).collect() == rows.collect()


def events_of(n, seed, ids=20):
    rng = random.Random(seed)
    out = []
    for seq in range(1, n + 1):
        op = rng.choice(["insert", "delete", "set_attrs", "set_attrs", "set_attrs"])
        tags = lambda: sorted({rng.randint(0, 9) for _ in range(rng.randint(0, 3))})
        out.append((seq, rng.randint(0, ids), op, tags() if op != "delete" else [], tags() if op == "set_attrs" else [], None))
    return out


def simulate(events, seed_ids=()):
    state = {i: (0, True, {3}) for i in seed_ids}

    class E:
        pass

    for seq, id_, op, add, remove, _ in events:
        e = E()
        e.seq, e.op, e.add_tags, e.remove_tags = seq, op, add, remove
        version, live, tags, _ = applier.apply_one(*state.get(id_, (-1, False, set())), e)
        state[id_] = (version, live, tags)
    return {i: (v, live, sorted(t)) for i, (v, live, t) in state.items()}


@pytest.mark.parametrize("seed", range(3))
def test_algebra_equals_simulation(spark, seed):
    events = events_of(150, seed)
    df = spark.createDataFrame(events + events[:20], EVENT)
    start = spark.createDataFrame([(i, [3]) for i in range(5)], "id long, tags array<long>")
    got = {r["id"]: (r["version"], r["live"], list(r["tags"])) for r in applier.final_state(df, start).collect()}
    assert got == simulate(events, range(5))
    union = applier.set_attrs(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(5)), F.array(F.lit(1), F.lit(2)))
    assert spark.range(1).select(union).first()[0] == [2, 5]


def test_stream_survives_restart_and_duplicates(spark, tmp_path):
    events = events_of(120, 9)
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    start = spark.createDataFrame([(i, [3]) for i in range(5)], "id long, tags array<long>")
    stream = lambda: spark.readStream.schema(EVENT).parquet(source)
    spark.createDataFrame(events[:60], EVENT).coalesce(1).write.mode("append").parquet(source)
    applier.run(stream(), out, check, start).awaitTermination()
    spark.createDataFrame(events[40:], EVENT).coalesce(1).write.mode("append").parquet(source)  # 40..60 come again
    applier.run(stream(), out, check, start).awaitTermination()
    rows = applier.snapshot(spark, out).collect()
    got = {r["id"]: (r["version"], r["live"], list(r["tags"])) for r in rows}
    want = simulate(events, range(5))
    assert got == {i: w for i, w in want.items() if i in got} and {e[1] for e in events} <= set(got)
    assert sum(r["skipped"] for r in rows) == 20


def test_engine_facade(spark):
    items = spark.createDataFrame([(i, [i, 2 * i]) for i in range(30)], "row long, u8 array<int>")
    tags = spark.createDataFrame([(i, i % 3) for i in range(30)], "row long, tag long")
    engine = Engine(spark, items, tags)
    hits = [r["row"] for r in engine.search([4, 8], tags=[1], k=2).collect()]
    assert hits == [4, 1] or hits == [4, 7]
    engine.upsert(100, [4, 9], [1])
    assert engine.search([4, 9], tags=[1], k=1).first()["row"] == 100
    engine.set_attrs(100, add=[2], remove=[1])
    assert engine.search([4, 9], tags=[2], k=1).first()["row"] == 100
    engine.delete(100)
    assert 100 not in [r["row"] for r in engine.search([4, 9], tags=[2], k=5).collect()]
    assert engine.stats(tags=[1]).first()["matches"] == 10
    with pytest.raises(ValueError):
        engine.search([1, 2], mode="S9")


def test_event_files_and_kafka_switch(spark, tmp_path):
    events = spark.createDataFrame([(1, 5, "insert", [1, 2], [], None)], EVENT)
    kafka.write(events, str(tmp_path / "events"))
    query = kafka.read(spark, str(tmp_path / "events")).writeStream.format("memory").queryName("read_back").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r)[:5] for r in spark.table("read_back").collect()] == [(1, 5, "insert", [1, 2], [])]
    assert kafka.decode(kafka.encode(events)).first()["add_tags"] == [1, 2]
    if not kafka.available(spark):
        with pytest.raises(RuntimeError):
            kafka.read(spark, "broker:9092", "catalog-events")


def test_workload_is_paced(spark):
    rows = workload.constructed(spark, 100, 2, {"insert": 5, "set_attrs": 10}).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 31)) and [r["due_us"] for r in rows] == sorted(r["due_us"] for r in rows)
    assert {r["id"] for r in rows if r["op"] == "insert"} == set(range(100, 110))
    assert workload.paced(spark, 5).isStreaming
    lags = applier.lag(spark.createDataFrame([(1, 1, "insert", [1], [])], "seq long, id long, op string, add_tags array<long>, remove_tags array<long>").withColumn("produced_at", F.current_timestamp()), F.current_timestamp() + F.expr("INTERVAL 2 SECONDS"))
    assert lags.first()["p50"] == 2000.0
