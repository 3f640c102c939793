import math
import random

import pytest
from pyspark.sql import functions as F

from watchtide.operators import cluster, graph_build, graph_query, scoring
from watchtide.session import cut_lineage


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_severity_thresholds_and_ensemble_bounds(spark):
    got = [value(spark, scoring.severity_of(F.lit(x))) for x in (0.95, 0.65, 0.4, 0.2, 0.1)]
    assert got == ["critical", "high", "medium", "low", "informational"]
    e = value(spark, scoring.ensemble_score(*[F.lit(x) for x in (0.9, 0.5, 0.7, 0.8, 0.6)], F.lit(False)))
    assert e == pytest.approx(0.35 * 0.9 + 0.15 * 0.5 + 0.2 * 0.7 + 0.15 * 0.8 + 0.15 * 0.6, abs=1e-4)
    assert value(spark, scoring.calibrate(F.lit(0.5))) == 0.5
    damped = value(spark, scoring.ensemble_score(*[F.lit(x) for x in (1.0, 1.0, 1.0, 0.0, 1.0)], F.lit(True)))
    assert damped == 0.35


def test_rule_and_intel_scores(spark):
    names = lambda *x: F.array(*[F.lit(n) for n in x]).cast("array<string>")
    assert value(spark, scoring.rule_score(names("low", "critical"))) == 1.0
    assert value(spark, scoring.rule_score(names())) == 0.0
    conf = F.array(F.lit(0.9), F.lit(None).cast("double"), F.lit(0.2))
    assert value(spark, scoring.intel_score(conf)) == 1.0
    assert value(spark, scoring.intel_score(F.array(F.lit(None).cast("double")))) == 0.5


def test_heuristic_reasons(spark):
    df = spark.createDataFrame(
        [("powershell -enc x", "2024-05-01 23:00:00", 0.9, "high", ["1.1.1.1"], []),
         ("monthly-patch via sccm -enc x", "2024-05-01 12:00:00", 0.1, "low", [], [])],
        "command_line string, ts string, asset_criticality double, severity string, intel_matches array<string>, tags array<string>").withColumn("ts", F.to_timestamp("ts"))
    for c in ("file_path", "url", "user", "parent_process", "process"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    a, b = scoring.heuristic(df.withColumn("body", F.parse_json(F.lit("{}")))).collect()
    assert a.heuristic_score == 1.0 and len(a.heuristic_reasons) == 5 and not a.benign_context
    assert b.heuristic_score == 0.0 and b.heuristic_reasons[-1] == "benign_admin_context:sccm,monthly-patch"


def test_neighborhood_score_without_neighbors(spark):
    got = value(spark, scoring.neighborhood_score(F.array(*[F.lit(0.5)] * 7)))
    z = 0.5 * 4.9 + 0.3 * 3.2 - 1.2
    assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


# --- graph ----------------------------------------------------------------------------------------

def edges_frame(spark, pairs):
    return spark.createDataFrame([(f"{a}|t|{b}", a, "t", b) for a, b in pairs], "edge_id string, src_id string, edge_type string, dst_id string")


def bfs(pairs, start):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, ring = {start: 0}, [start]
    while ring:
        ring = [n for x in ring for n in sorted(near.get(x, ())) if n not in dist and not dist.update({n: dist[x] + 1})]
    return dist


def random_graph(n=60, m=75, seed=1):
    rnd = random.Random(seed)
    return sorted({(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)})


def test_paths_and_distances_match_breadth_first_search(spark):
    pairs = random_graph()
    edges = edges_frame(spark, pairs)
    ends = [("n1", f"n{i}") for i in range(0, 60, 3)] + [("n1", "n1"), ("n2", "missing")]
    frame = spark.createDataFrame(ends, "src string, dst string")
    for r in graph_query.attack_paths(edges, frame).collect():
        d = bfs(pairs, r.src).get(r.dst)
        assert (r.found, r.length) == ((True, d) if d is not None and d <= 6 else (False, -1)), (r, d)
        at = r.src
        for e in r.path:                                   # the path really leads from src to dst
            a, _, b = e.split("|")
            assert at in (a, b)
            at = b if at == a else a
        assert not r.found or at == r.dst
    bad = spark.createDataFrame([("n5",), ("n9",)], "node_id string")
    got = {r.node_id: r.path_length for r in graph_query.distance_to_bad(edges, bad, 4).collect()}
    d5, d9 = bfs(pairs, "n5"), bfs(pairs, "n9")
    want = {n: min(d5.get(n, 99), d9.get(n, 99)) for n in {*d5, *d9}}
    assert got == {n: d for n, d in want.items() if d <= 4}


def test_neighborhood_lists_each_edge_once(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "a")]
    nodes, edges = graph_query.neighborhood(edges_frame(spark, pairs), spark.createDataFrame([("a",)], "node_id string"), 2, None)
    assert {r.node_id: r.dist for r in nodes.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert sorted(r.edge_id for r in edges.collect()) == ["a|t|a", "a|t|b", "b|t|c", "c|t|a", "c|t|d"]


def test_self_loop_counts_once(spark):
    got = {r.node_id: r.degree for r in graph_query.degrees(edges_frame(spark, [("a", "a"), ("a", "b")])).collect()}
    assert got == {"a": 2, "b": 1}


def test_degree_as_of(spark):
    edges = edges_frame(spark, [("a", "b"), ("a", "c"), ("d", "a")]).withColumn("first_us", F.expr("CASE dst_id WHEN 'b' THEN 5 WHEN 'c' THEN 250 ELSE 1000 END").cast("long"))
    reads = spark.createDataFrame([(0, "a"), (5, "a"), (249, "a"), (250, "a"), (5000, "a"), (10, "zz")], "ts_us long, node_id string")
    got = {(r.ts_us, r.node_id): r.degree_as_of for r in graph_query.degree_as_of(reads, edges).collect()}
    assert got == {(0, "a"): 0, (5, "a"): 1, (249, "a"): 1, (250, "a"): 2, (5000, "a"): 3, (10, "zz"): 0}


def test_upsert_keeps_first_confidence_and_latest_properties(spark):
    rows = spark.createDataFrame(
        [("n", "Host", "t", {"x": "old"}, 1, "e1", "edr", 0.9), ("n", "Host", "t", {"x": "new"}, 3, "e3", "dns", 0.7), ("n", "Host", "t", {"x": "mid"}, 2, "e2", "edr", 0.5)],
        "node_id string, node_type string, tenant_id string, properties map<string,string>, ts int, event_id string, source string, source_confidence double")
    r = graph_build.upsert_nodes(rows).first()
    assert (r.first_seen, r.last_seen, r["count"], r.confidence, r.sources, r.properties) == (1, 3, 3, 0.9, ["dns", "edr"], {"x": "new"})
    parts = [graph_build.upsert_nodes(rows.where(F.col("ts") == i)) for i in (1, 2, 3)]
    merged = graph_build.merge_upserts(parts[0], parts[1].unionByName(parts[2]), ["node_id"]).first()
    assert (merged.first_seen, merged.last_seen, merged["count"], merged.sources, merged.properties) == (1, 3, 3, ["dns", "edr"], {"x": "new"})


def test_only_latest_observations_are_kept(spark):
    rows = spark.createDataFrame([("n", i, f"e{i:03d}", "x", "edr", "low") for i in range(60)], "node_id string, ts int, event_id string, event_type string, source string, severity string")
    obs = graph_build.observation_lists(rows, "node_id", 25).first().observations
    assert [o.ts for o in obs] == list(range(35, 60))


# --- clustering -----------------------------------------------------------------------------------

def random_alerts(n, sizes, seed, items=14, span=30_000):
    rnd = random.Random(seed)
    return [("t%d" % rnd.randrange(2), f"a{i:04d}", rnd.randrange(span) * 1_000_000, sorted(rnd.sample([f"i{j}" for j in range(items)], rnd.choice(sizes)))) for i in range(n)]


@pytest.mark.parametrize("sizes,threshold,items", [([2, 3], 0.15, 30), ([3, 5, 7], 0.4, 16), ([1, 4, 8], 0.15, 40)])
def test_components_equal_closure_of_all_pairs(spark, sizes, threshold, items):
    alerts = random_alerts(90, sizes, len(sizes) + items, items)
    parent = {a[1]: a[1] for a in alerts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (t1, a, u, s) in enumerate(alerts):
        for t2, b, v, r in alerts[:i]:
            if t1 == t2 and abs(u - v) <= cluster.WINDOW and len({*s} & {*r}) / len({*s} | {*r}) >= threshold:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    df = spark.createDataFrame(alerts, "tenant_id string, alert_id string, ts_us long, items array<string>")
    got = {r.alert_id: r.cluster_id for r in cluster.overlap_components(df, threshold=threshold).collect()}
    assert got == {a: find(a) for a in parent}


def greedy_replay(alerts):
    out, open_ = {}, {}
    for tenant, a, t, items in sorted(alerts, key=lambda x: (x[2], x[1])):
        best, score = None, 0.0
        for cid, (ten, last, have) in open_.items():
            if ten != tenant or t - last > cluster.WINDOW:
                continue
            j = len(have & {*items}) / len(have | {*items})
            if j >= 0.15 and j > score:
                best, score = cid, j
        if best is None:
            best = a
            open_[a] = (tenant, t, set())
        open_[best] = (tenant, t, open_[best][2] | {*items})
        out[a] = best
    return out


def test_greedy_clusters_match_a_replay(spark):
    alerts = random_alerts(200, [2, 3, 5], 4, 40, 200_000)
    df = spark.createDataFrame(alerts, "tenant_id string, alert_id string, ts_us long, items array<string>")
    assert {r.alert_id: r.cluster_id for r in cluster.greedy_clusters(df).collect()} == greedy_replay(alerts)


def test_greedy_decision_is_kept_while_nothing_changes(monkeypatch):
    """Alerts with the items of earlier ones are not compared with the open clusters again, unless one of these changed."""
    looked = []
    best = cluster.OpenClusters._best
    monkeypatch.setattr(cluster.OpenClusters, "_best", lambda self, mine: looked.append(mine) or best(self, mine))
    open_ = cluster.OpenClusters(0.15, 100)
    sets = [["a", "b"], ["c", "d"], ["e"]]
    got = [open_.assign(f"x{t}", t, sets[t % 3]) for t in range(300)]
    assert got == ["x0", "x1", "x2"] * 100 and len(looked) == 3
    assert open_.assign("y", 401, ["a", "b"]) == "y" and len(looked) == 4  # the others were idle and closed
    # times may go back between the files of a stream: a cluster closes by the time of its last alert
    assert open_.assign("z", 350, ["a", "b"]) == "y" and open_.assign("w", 451, ["a", "b"]) == "w"


def test_greedy_stream_equals_batch(spark, tmp_path):
    from watchtide.streaming import flows
    alerts = sorted(random_alerts(120, [2, 3], 8, 30, 100_000), key=lambda x: (x[2], x[1]))
    schema = "tenant_id string, alert_id string, t long, items array<string>"
    for i in range(3):                                      # three files, in time order, one per micro-batch
        spark.createDataFrame(alerts[i * 40:(i + 1) * 40], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flows.run_now(flows.cluster_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.alert_id: r.cluster_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == greedy_replay(alerts)


def test_greedy_stream_takes_a_table_in_bounded_parts_in_order(spark, tmp_path, monkeypatch):
    """One large file is no longer one micro-batch, and the parts give what the whole gives."""
    from watchtide.plans import queries_cases, queries_stream
    start = 1_704_067_200_000_000
    rows = [(i, start + (i * 7919 % 300 // 3) * 400_000_000, i % 7, "click" if i % 4 else "view", 1.0, f'{{"k": {i % 90}}}') for i in range(300)]  # equal times
    spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.timestamp_micros("us")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries_stream, "IN_ORDER_ROWS", 60, raising=False)
    out = queries_stream.stream_greedy_clusters(spark, str(tmp_path))
    batches = out.groupBy(F.regexp_extract(F.input_file_name(), r"batch_id=(\d+)", 1)).count().collect()
    assert len(batches) == 5 and max(r["count"] for r in batches) < 150
    want = {(r.tenant_id, r.alert_id): r.cluster_id for r in queries_cases.cluster_greedy(spark, str(tmp_path)).collect()}
    assert {(r.tenant_id, r.alert_id): r.cluster_id for r in out.collect()} == want and len(want) == 300
    assert len(set(want.values())) > 5


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(300)], "a string, b string")
    nodes = spark.createDataFrame([(f"{i:04d}",) for i in range(302)], "id string")
    got = {r.id: r.component for r in cluster.components(cut_lineage(nodes), links).collect()}
    assert got == {**{f"{i:04d}": "0000" for i in range(301)}, "0301": "0301"}


def test_upserts_merge_properties_key_by_key(spark):
    rows = spark.createDataFrame(
        [("n", "Process", "t", {"display_name": "a", "process_id": "7"}, 1, "e1"), ("n", "Process", "t", {"display_name": "b", "host": "H"}, 2, "e2"),
         ("n", "Process", "t", {"host": "old"}, 0, "e0")],
        "node_id string, node_type string, tenant_id string, properties map<string,string>, ts int, event_id string").withColumn(
        "source", F.lit("s")).withColumn("source_confidence", F.col("ts") / 10)
    whole = graph_build.upsert_nodes(rows).first()
    assert whole.properties == {"display_name": "b", "process_id": "7", "host": "H"} and whole.confidence == 0.0
    parts = [graph_build.upsert_nodes(rows.where(w)) for w in ("ts = 2", "ts = 0", "ts = 1")]
    deltas = parts[0].unionByName(parts[1]).unionByName(parts[2])
    merged = graph_build.merge_upserts(deltas.limit(0), deltas, ["node_id"]).first()
    assert merged.properties == whole.properties and merged["count"] == 3


def test_path_length_is_to_the_own_indicator(spark):
    near = [("u1", "h1"), ("h1", "bad1"), ("u2", "h2")]
    adj = graph_query.adjacency(edges_frame(spark, near))
    pairs = spark.createDataFrame([("u1", "bad1"), ("u2", "bad1"), ("bad1", "bad1")], "src string, dst string")
    got = {(r.src, r.dst): r.length for r in graph_query.path_lengths(adj, pairs, 4).collect()}
    assert got == {("u1", "bad1"): 2, ("bad1", "bad1"): 0}


def test_alerts_without_items_stay_alone(spark):
    rows = spark.createDataFrame([("t", "a1", 0, []), ("t", "a2", 1, []), ("t", "a3", 2, ["x"]), ("t", "a4", 3, ["x"])],
                                 "tenant_id string, alert_id string, ts_us long, items array<string>")
    got = {r.alert_id: r.cluster_id for r in cluster.overlap_components(rows).collect()}
    assert got == {"a1": "a1", "a2": "a2", "a3": "a3", "a4": "a3"}


def test_components_of_a_crowd_need_few_links(spark):
    """Alerts that all share an item: links grow with the alerts, not with their pairs."""
    rows = [("t", i, i // 100, ["all", f"own{i}"], (i // 100) * cluster.WINDOW, (i // 100) * cluster.WINDOW) for i in range(300)]
    sigs = spark.createDataFrame(rows, "tenant_id string, sig long, bucket long, items array<string>, lo long, hi long")
    owners, links = cluster.spanning_links(sigs)
    assert owners.count() == 300 and links.count() < 900
    comp = cluster.components(owners.select(F.col("node").alias("id")), links)
    assert [r[0] for r in comp.select("component").distinct().collect()] == [0]


def test_pairs_of_overlap_links_are_not_shuffled(spark):
    import __spark_entry__ as entry
    plan = entry.queries()["cluster_overlap_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Join")]


def test_entities_are_worked_out_once(spark):
    """No filter below the explode repeats what the projection computes."""
    from watchtide.plans import stages
    ev = stages.enriched(spark, "/root/testdata/sf0.001")
    for rows in (graph_build.node_rows(ev), graph_build.edge_rows(ev)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "sha2(" in plan and not [line for line in plan.splitlines() if "Filter" in line and "sha2(" in line]


def test_enrichment_reads_each_text_once_and_in_generated_code(spark):
    """The text of an event is not put together for every keyword, nor are arrays argued about row by row."""
    from watchtide.plans import stages
    plan = stages.enriched(spark, "/root/testdata/sf0.001").select("event_id", "entities")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(concat_ws( , event_type") == 1 and "filter(array(" not in plan
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_rules_and_edges_are_chosen_in_generated_code(spark):
    from watchtide.operators import rules
    from watchtide.plans import stages
    ev = stages.enriched(spark, "/root/testdata/sf0.001")
    for rows in (graph_build.edge_rows(ev), rules.gate(ev, rules.shipped_rules()), scoring.heuristic(ev).select("heuristic_reasons")):
        assert "filter(array(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rules.gate(ev, []).dtypes[-1][0] == "matches"


def test_spread_bounds_the_size_of_a_task(spark):
    from watchtide.session import spread
    rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")  # 11 MB in one row group
    assert spread(rows, task_mb=1).rdd.getNumPartitions() >= 8 and spread(rows, task_mb=100).rdd.getNumPartitions() == 4


def test_overlap_links_of_many_items_against_all_pairs(spark):
    rng = random.Random(9)
    rows = [("t", f"s{i}", 0, sorted(rng.sample([f"i{k}" for k in range(60)], rng.randrange(15, 26)) + ["everywhere"]), 0, 0) for i in range(60)]
    sigs = spark.createDataFrame(rows, "tenant_id string, sig string, bucket long, items array<string>, lo long, hi long")
    for threshold in (0.15, 0.3, 0.5):
        got = {(r.a, r.b): r.jaccard for r in cluster.overlap_links(sigs, threshold).collect()}
        want = {}
        for a in rows:
            for b in rows:
                x, y = set(a[3]), set(b[3])
                if a[1] < b[1] and len(x & y) / len(x | y) >= threshold:
                    want[a[1], b[1]] = pytest.approx(len(x & y) / len(x | y))
        assert got == want
