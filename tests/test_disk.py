"""What steps leave on the disks while a query goes on: no shuffled rows, and stored columns instead of whole rows."""

import time

from pyspark.sql import functions as F

from watchtide.operators import detect, graph_query, landmarks, rules, windows
from watchtide.operators.running import running
from watchtide.session import stored

ENTITY = "array<struct<type:string,id:string,display_name:string,attributes:map<string,string>>>"


def shuffled(spark):
    """Shuffle files on the local disk; files of finished queries are given a moment to go."""
    def now():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.length())) if f.endswith(".data")}
    found = now()
    for _ in range(20):
        if not found:
            break
        time.sleep(0.1)
        found &= now()
    return found


def left_by(spark, step):
    before = shuffled(spark)
    kept = step()
    return shuffled(spark) - before, kept


def test_stored_rows_leave_no_shuffle(spark):
    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("k"))
    left, out = left_by(spark, lambda: stored(rows.groupBy("k").agg(F.sum("id").alias("s"), F.collect_list("id").alias("l"))))
    assert not left and out.count() == 51 and out.agg(F.sum("s")).first()[0] == 1999 * 1000
    assert out.schema["l"].dataType.simpleString() == "array<bigint>"
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_running_sums_leave_no_shuffle(spark):
    rows = spark.range(4000).select((F.col("id") % 3).alias("g"), "id")
    left, out = left_by(spark, lambda: running(rows, ["g"], [F.col("id")], {"s": F.lit(1)}, "n"))
    assert not left
    assert out.where("s <> n OR n <> id div 3 + 1").count() == 0 and out.count() == 4000


def test_degree_as_of_sorts_edges_without_counting_them_first(spark):
    edges = spark.createDataFrame([("a", "b", 10), ("a", "c", 20), ("a", "a", 20), ("b", "c", None)], "src_id string, dst_id string, first_us long")
    reads = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate([("a", 9), ("a", 10), ("a", 20), ("a", 20), ("b", 15), ("x", 5), (None, 5)])],
                                  "no int, node_id string, ts_us long")
    left, out = left_by(spark, lambda: graph_query.degree_as_of(reads, edges))
    assert not left and out.columns == ["no", "node_id", "ts_us", "degree_as_of"]
    assert {r.no: r.degree_as_of for r in out.collect()} == {0: 0, 1: 1, 2: 3, 3: 3, 4: 2, 5: 0, 6: 0}


def graph_of(spark):
    edges = [("a|x|b", "x", "a", "b", 10), ("b|x|c", "x", "b", "c", 20), ("c|y|d", "y", "c", "d", 30), ("c|y|c", "y", "c", "c", 30), ("e|x|f", "x", "e", "f", 5)]
    return spark.createDataFrame(edges, "edge_id string, edge_type string, src_id string, dst_id string, first_us long")


def test_an_index_without_edge_ids_has_the_same_distances(spark):
    edges = graph_of(spark)
    names, links = graph_query.numbered(edges)
    assert names.count() == 6 and names.select("no").distinct().count() == 6 and links.count() == 5
    index = landmarks.build(graph_query.adjacency(links, []), 4)
    assert not {"edge_id", "step"} & {*index.labels.columns, *index.leaves.columns}
    pairs = spark.createDataFrame([("a", "d"), ("d", "b"), ("a", "e"), ("f", "e"), ("a", "nowhere")], "src string, dst string")
    asked = graph_query.numbered_pairs(pairs, names, [])
    no = {r.no: r.node_id for r in names.collect()}
    got = {(no[r.src], no[r.dst]): r.length for r in landmarks.distances(index, asked).collect()}
    assert got == {("a", "d"): 3, ("d", "b"): 2, ("f", "e"): 1}


def test_graph_features_leave_no_shuffle(spark):
    from watchtide.functions.core import entity_id
    host, domain = (spark.range(1).select(entity_id(k, F.lit(v), F.lit("t0"))).first()[0] for k, v in (("Host", "h"), ("Domain", "bad.example")))
    edges = spark.createDataFrame([(f"{host}|x|n", "x", host, "n", 10), (f"n|x|{domain}", "x", "n", domain, 20), ("n|y|m", "y", "n", "m", 30)],
                                  "edge_id string, edge_type string, src_id string, dst_id string, first_us long")
    rows = [(i, "t0", intel, t, [("Host", node, node, {})] if node else []) for i, intel, t, node in [
        ("e1", ["bad.example"], 15, host), ("e2", ["bad.example", "BAD.example"], 25, host), ("e2", ["bad.example"], 25, host),
        ("e3", [], 40, "n"), ("e4", ["bad.example"], 40, domain), ("e5", ["bad.example"], 40, "outside"), ("e6", [], 40, None)]]
    events = spark.createDataFrame(rows, f"event_id string, tenant_id string, intel_matches array<string>, ts_us long, entities {ENTITY}")
    left, out = left_by(spark, lambda: graph_query.snapshot_features(events, edges))
    assert not left
    got = sorted((r.event_id, r.degree, r.neighbor_count, r.path_length) for r in out.collect())
    assert got == [("e1", 1, 2, 2), ("e2", 1, 2, 2), ("e2", 1, 2, 2), ("e3", 3, 4, None), ("e4", 1, 2, 0), ("e5", 0, None, None), ("e6", 0, None, None)]
    left, out = left_by(spark, lambda: graph_query.features_as_of(events.where("event_id <> 'e2'"), edges))
    assert not left
    got = sorted((r.event_id, r.degree, r.neighbor_count, r.path_length) for r in out.collect())
    assert got == [("e1", 1, 2, None), ("e3", 3, 4, None), ("e4", 1, 2, 0), ("e5", 0, None, None), ("e6", 0, None, None)]


def test_distinct_values_are_dealt_out_twice_only(spark):
    rows = spark.range(100).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("v"), (F.col("id") * windows.SECOND).alias("ts_us"))
    out = windows.sliding_distinct(rows, ["g"], "v", "ts_us", 5)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = {r.id: r.n_distinct for r in out.collect()}
    assert got == {i: len({j % 7 for j in range(max(0, i - 5), i + 1) if j % 2 == i % 2}) for i in range(100)}
    left, out = left_by(spark, lambda: windows.temporal_features(rows.select(
        "id", "ts_us", F.col("g").cast("string").alias("host"), F.lit(None).cast("string").alias("user"), F.col("v").cast("string").alias("event_type"),
        F.array(F.col("v").cast("string")).alias("technique_ids")), seconds=5))
    assert not left
    assert {r.id: (r.event_count_window, r.distinct_event_types_window, r.distinct_techniques_window) for r in out.collect()} == {
        i: (min(i // 2, 2) + 1, n, n) for i, n in got.items()}


def test_detection_reads_only_the_columns_it_needs(spark):
    """Raw texts stay in the stored events, nothing shuffled is left, and rows that come twice stay two."""
    rows = [(f"e{i % 30}", f"t{i % 2}", i, "logon" if i % 3 else "process_create") for i in range(40)]
    events = spark.createDataFrame(rows, "event_id string, tenant_id string, i int, event_type string").select(
        "event_id", "tenant_id", "event_type", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs="i")).alias("ts"), F.lit("s").alias("source"),
        F.lit("high").alias("severity"), F.lit(0.9).alias("source_confidence"), F.lit("powershell -enc x").alias("command_line"), F.lit(1).alias("dst_port"),
        F.concat(F.lit("H"), F.col("i") % 4).alias("host"), F.lit("u").alias("user"), F.lit("C:\\powershell.exe").alias("process"),
        *[F.lit(None).cast("string").alias(c) for c in ("parent_process", "file_path", "url", "domain")],
        F.array().cast("array<string>").alias("tags"), F.array(F.lit("T1")).alias("technique_ids"), F.lit(0.9).alias("asset_criticality"),
        F.array(F.lit("bad.example")).alias("intel_matches"), F.array(F.struct(F.lit("bad.example").alias("matched_value"), F.lit(0.7).alias("confidence"))).alias("intel_hits"),
        F.array(*[F.struct(F.lit(k).alias("type"), F.concat(F.lit(k), F.col("i") % 4).alias("id"), F.lit(k).alias("display_name"),
                           F.create_map().cast("map<string,string>").alias("attributes")) for k in ("Host", "User")]).alias("entities"),
        F.lit('{"note": "x"}').alias("raw"), F.lit(1).alias("enrichment"), F.lit(1).alias("provenance")).withColumn("body", F.parse_json("raw"))
    left, (scored, _, alerts) = left_by(spark, lambda: detect.detect(events, rules.shipped_rules()))
    assert not left
    plan = scored.select("event_id", "calibrated_score")._jdf.queryExecution().executedPlan().toString()
    assert "raw#" not in plan and "entities#" not in plan
    assert scored.count() == 40 and alerts.count() == 40 and {"raw", "body", "entities", "matches", "degree", "heuristic_score"} <= {*scored.columns}
    assert "_row" not in scored.columns and scored.where("body IS NULL").count() == 0
