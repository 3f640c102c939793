"""Streams over several micro-batches: the answer must not depend on how rows fall into files."""

import random

import pytest
from pyspark.sql import functions as F

from watchtide.operators import graph_build, windows
from watchtide.sources import sinks
from watchtide.streaming import flows

DAY = 86_400
START = 19_000 * DAY  # a stream's watermark begins at 0, and rows not after it are late


def files(spark, folder, rows, schema, n, order):
    """``rows`` as ``n`` files, read one to a micro-batch."""
    rows = sorted(rows, key=order)
    step = -(-len(rows) // n)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], schema).coalesce(1).write.mode("append").parquet(str(folder))
    df = spark.read.parquet(str(folder))
    return sinks.topic_source(spark, str(folder), df.schema, files_per_trigger=1)


def status_of(rows, ttl):
    want, last = {}, {}
    for key, t in sorted(rows, key=lambda r: r[1]):
        new = key not in last or t - last[key] > ttl
        if new:
            last[key] = t
        a, d = want.get((key, t), (0, 0))
        want[key, t] = (a + new, d + (not new))
    return want


@pytest.mark.parametrize("n,shuffled", [(1, False), (4, False), (4, True)])
def test_arrivals_are_judged_by_time(spark, tmp_path, n, shuffled):
    rnd = random.Random(7)
    rows = [(f"k{rnd.randrange(12)}", rnd.randrange(60) * DAY // 2) for _ in range(150)] + [("hot", rnd.randrange(30 * DAY)) for _ in range(100)]
    rows += [("edge", 0), ("edge", 7 * DAY), ("edge", 7 * DAY + 1), ("edge", 14 * DAY + 1), ("edge", 14 * DAY + 2), ("edge", 0)]
    stream = files(spark, tmp_path / "in", rows, "event_id string, s long", n, (lambda r: random.Random(str(r)).random()) if shuffled else (lambda r: r[1]))
    env = stream.select("event_id", F.lit("t").alias("tenant_id"), F.lit("edr").alias("source"), F.lit("x").alias("timestamp"),
                        F.timestamp_seconds(F.col("s") + START).alias("received_at"), F.lit("{}").alias("payload"))
    flows.run_now(flows.label_arrivals(env, 7, "40 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = flows.arrival_status(spark.read.parquet(str(tmp_path / "out")))
    assert {(r.event_id, r.at_ms // 1000 - START): (r.accepted, r.duplicates) for r in got.collect()} == status_of(rows, 7 * DAY)


def test_expired_keys_leave_the_state(spark, tmp_path):
    rows = [("a", 0), ("a", DAY), ("b", 20 * DAY), ("a", 21 * DAY), ("c", 60 * DAY)]
    stream = files(spark, tmp_path / "in", rows, "event_id string, s long", 5, lambda r: r[1])
    env = stream.select("event_id", F.lit("t").alias("tenant_id"), F.lit("edr").alias("source"), F.lit("x").alias("timestamp"),
                        F.timestamp_seconds(F.col("s") + START).alias("received_at"), F.lit("{}").alias("payload"))
    flows.run_now(flows.label_arrivals(env, 7, "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = flows.arrival_status(spark.read.parquet(str(tmp_path / "out")))
    assert {(r.event_id, r.at_ms // 1000 - START): (r.accepted, r.duplicates) for r in got.collect()} == status_of(rows, 7 * DAY)
    state = spark.read.format("statestore").option("stateVarName", "arrivals").load(str(tmp_path / "cp"))
    assert {r.key.event_id for r in state.select("key").collect()} == {"c"}


@pytest.mark.parametrize("kind", ["threshold", "distinct_count"])
def test_correlation_is_corrected_by_late_rows(spark, tmp_path, kind):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.randrange(400) * windows.SECOND, f"h{rnd.randrange(5)}") for i in range(160)]
    rule = {"correlation": {"type": kind, "group_by": ["k"], "min_count": 4, "min_distinct": 3, "distinct_field": "h", "window_seconds": 30}}
    schema = "id int, k string, ts_us long, h string"
    stream = files(spark, tmp_path / "in", rows, schema, 4, lambda r: random.Random(r[0]).random())
    flows.correlate_stream(stream, rule, str(tmp_path / "out"), str(tmp_path / "cp"), late_seconds=1000).awaitTermination()
    got = {(r.id, r.window_value, r.correlated) for r in flows.correlated(spark, str(tmp_path / "out"), ["id"]).collect()}
    assert got == {(r.id, r.window_value, r.correlated) for r in windows.correlate(spark.createDataFrame(rows, schema), rule).collect()}
    assert spark.read.parquet(str(tmp_path / "out/late")).count() == 0


def edge_rows(spark, batch):
    rows = [(f"e{(batch * 3 + i) % 7}", "s", "t", "d", "t0", {"p": str(batch)}, batch * 10 + i, f"ev{batch}-{i}", "edr", 0.5 + batch / 100) for i in range(5)]
    return spark.createDataFrame(rows, "edge_id string, src_id string, edge_type string, dst_id string, tenant_id string, edge_props map<string,string>, "
                                       "ts int, event_id string, source string, source_confidence double")


def node_rows(spark, batch):
    return edge_rows(spark, batch).select(F.col("edge_id").alias("node_id"), F.lit("Host").alias("node_type"), "tenant_id", F.col("edge_props").alias("properties"),
                                          "ts", "event_id", "source", "source_confidence")


def test_generations_bound_what_is_read_and_survive_replays(spark, tmp_path, monkeypatch):
    at = {}
    monkeypatch.setattr(graph_build, "edge_rows", lambda ev: edge_rows(spark, at["batch"]))
    monkeypatch.setattr(graph_build, "node_rows", lambda ev: node_rows(spark, at["batch"]))
    monkeypatch.setattr(graph_build, "update_summary", lambda ev: ev)
    folder = str(tmp_path)
    write = sinks.graph_sink(folder, epoch=2)

    def send(batch):
        at["batch"] = batch
        write(spark.range(1), batch)

    def tables():
        return [sorted(str(r.asDict()) for r in df.collect()) for df in sinks.graph_tables(spark, folder)]

    def whole(batches):
        nodes = edges = None
        for b in batches:
            n, e = node_rows(spark, b), edge_rows(spark, b)
            nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
        want = [graph_build.upsert_nodes(nodes), graph_build.upsert_edges(edges)]
        return [sorted(str(r.asDict()) for r in w.select(df.columns).collect()) for w, df in zip(want, sinks.graph_tables(spark, folder))]

    for batch in range(5):
        send(batch)
        assert sinks.generation(spark, folder) == (batch + 1) // 2 - 1
        if batch in (0, 4):
            assert tables() == whole(range(batch + 1))
    pinned = sinks._merged(spark, folder, "edges", 1)
    assert all("epoch=1" in f or "epoch=2" in f for f in pinned.inputFiles())
    before = tables()
    for batch in (3, 4, 0):  # the last of an epoch, one not merged yet, one merged long ago
        send(batch)
    assert tables() == before
