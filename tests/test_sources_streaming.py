import os
import subprocess
import sys
import json

import pytest
from pyspark.sql import functions as F

from watchtide.plans import registry
from watchtide.operators import evaluate, ingest, metrics, rules
from watchtide.session import checkpoint_root, spread
from watchtide.sources import readers, sinks
from watchtide.streaming import flows

SCENARIO = {
    "scenario_id": "s1", "name": "n", "title": "T", "description": "d", "expected_severity": "high", "expected_techniques": ["T1059.001", "T1027"],
    "expected_min_risk": 0.5, "is_attack": True,
    "events": [
        {"source": "sysmon", "timestamp": "2024-05-01T10:05:00Z", "raw": {"EventID": 1, "Image": "C:\\powershell.exe", "CommandLine": "powershell -enc AAA"}},
        {"source": "email", "timestamp": "2024-05-01T10:00:00Z", "raw": {"to": "a@b.example", "spf": "pass"}},
        {"source": "email", "timestamp": "2024-05-01T10:00:00Z", "raw": {"to": "a@b.example", "spf": "pass"}}]}


@pytest.fixture
def scenario_dir(tmp_path):
    folder = tmp_path / "scenarios"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps(SCENARIO, indent=1))
    (folder / "two.json").write_text(json.dumps({"events": []}))
    return str(folder)


def test_scenarios_catalog_and_replay(spark, scenario_dir):
    docs = readers.scenarios(spark, scenario_dir)
    got = {r.scenario_id: (r.title, r.event_count, r.file) for r in readers.scenario_catalog(docs).collect()}
    assert got == {"s1": ("T", 3, "one.json"), "two": ("two", 0, "two.json")}
    events = readers.scenario_events(docs)
    assert json.loads(events.where("position = 0").first().raw)["EventID"] == 1
    env = readers.to_envelopes(events).drop("scenario_id", "position")
    assert readers.replay_summary(ingest.route(env, validate=False)).first().asDict() == {"events_published": 2, "duplicates_skipped": 1}
    assert ingest.batch_summary(ingest.route(env)).first().asDict() == {"accepted": 1, "duplicates": 1, "dead_lettered": 1}
    pool = {r.scenario_id: r.pool for r in readers.scenario_pools(docs).collect()}
    assert pool["s1"][0] == "s1-evt-000" and len(pool["s1"]) == 3


def test_scenario_evaluation(spark, scenario_dir):
    from watchtide.operators import flatten
    docs = readers.scenarios(spark, scenario_dir).where("scenario_id IS NOT NULL")
    flat = flatten.flatten(readers.scenario_events(docs), ["scenario_id"])
    fired = evaluate.fired(rules.gate(flat, rules.shipped_rules(), "evaluator"), "scenario_id")
    labels = docs.select("scenario_id", F.col("expected_techniques").alias("expected"), "is_attack")
    r = evaluate.scenario_scores(labels, fired).first()
    assert (r.precision, r.recall, r.f1, r.note) == (1.0, 1.0, 1.0, "")


def test_set_scores_of_empty_sets(spark):
    none = F.array().cast("array<string>")
    r = spark.range(1).select(evaluate.set_scores(none, none).alias("a"), evaluate.set_scores(F.array(F.lit("x")), none).alias("b")).first()
    assert tuple(r.a) == (1.0, 1.0, 1.0) and tuple(r.b) == (0.0, 0.0, 0.0)


def test_reference_lists(spark, tmp_path):
    (tmp_path / "ioc.json").write_text(json.dumps({"feed_name": "f", "indicators": [{"value": "A.example", "confidence": 0.1}, {"value": "a.EXAMPLE", "confidence": 0.8}]}))
    from watchtide.operators.enrich import latest_indicators
    feed = readers.ioc_feed(spark, str(tmp_path / "ioc.json"))
    assert [(r.ioc_key, r.ioc.confidence) for r in latest_indicators(feed).collect()] == [("a.example", 0.8)]
    assert readers.find_indicator(feed, "A.EXAMPLE").count() == 2
    (tmp_path / "kev.json").write_text(json.dumps({"catalog_version": "1", "vulnerabilities": [{"cve_id": "CVE-1", "cvss_v3": 9.8}, {"cve_id": "CVE-1", "cvss_v3": 5.0}]}))
    assert [(r.cve_id, r.cvss_v3) for r in readers.exploited_vulnerabilities(spark, str(tmp_path / "kev.json")).collect()] == [("CVE-1", 5.0)]
    (tmp_path / "assets.json").write_text(json.dumps({"hosts": {"DC": {"criticality": 1.0, "role": "dc"}}, "users": {"u": {"criticality": 0.2}}, "default_host_criticality": 0.4}))
    hosts, users, defaults = readers.asset_inventory(spark, str(tmp_path / "assets.json"))
    assert (hosts.first().name, users.first().criticality, tuple(defaults.first())) == ("DC", 0.2, (0.4, 0.3))
    (tmp_path / "tech.json").write_text(json.dumps({"T1": {"name": "N", "tactic": "impact"}}))
    assert tuple(readers.technique_catalog(spark, str(tmp_path / "tech.json")).first()) == ("T1", "N", "impact")
    assert readers.technique_catalog(spark).count() == 25
    (tmp_path / "ep.json").write_text(json.dumps([{"risk_score": 0.1, "asset_criticality": 0.2, "objective": "recon", "action_class": "enrich", "reward": 1}]))
    assert readers.feedback_episodes(spark, str(tmp_path / "ep.json")).first().reward == 1.0


def test_json_lines_and_reports(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source": "edr", "timestamp": "t", "event": {"host": "h"}}\n\n{"source": "dns", "raw": {"query": "q"}, "tenant_id": "x"}\n')
    rows = readers.raw_lines(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r.source, r.tenant_id, json.loads(r.raw)) for r in rows] == [("edr", "default", {"host": "h"}), ("dns", "x", {"query": "q"})]
    (tmp_path / "r.json").write_text(json.dumps({"scenario_id": "s", "evidence_pool": {"e1": {}}, "report": {
        "report_id": "r", "evidence_cited": ["e1", "e9"], "attack_mapping": [{"technique_id": "T1"}], "groundedness_score": 0.9}}))
    from watchtide.operators.grounding import score_reports
    r = score_reports(readers.triage_reports(spark, str(tmp_path / "r.json")).withColumn("expected", F.array(F.lit("T1")))).first()
    assert (r.hallucinated_citations, r.evidence_validity_rate, r.mapping_precision, r.computed_groundedness, r.groundedness_delta) == (["e9"], 0.5, 1.0, 0.75, 0.15)


def test_rule_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "b.yml").write_text("id: R2\ntitle: two\nlevel: low\ndetection:\n  selection:\n    host|startswith: W\n  condition: selection\n")
    (tmp_path / "a.yml").write_text("id: [broken\n")
    docs = readers.rule_documents(spark, str(tmp_path))
    assert [d["id"] for d in docs] == ["R2"]
    hit = rules.gate(spark.createDataFrame([("wks",)], "host string"), docs).first().matches
    assert [m.rule_id for m in hit] == ["R2"]
    assert rules.catalog(spark, docs).first().title == "two"


def test_lag_and_latest_rows(spark):
    topic = spark.createDataFrame([("a",)] * 5 + [("b",)], "topic string")
    offsets = spark.createDataFrame([("a", "g", 3), ("b", "g", 9), ("c", "g", 0)], "topic string, group string, offset long")
    assert {r.topic: r.lag for r in readers.consumer_lag(topic, offsets).collect()} == {"a": 2, "b": 0, "c": 0}
    df = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "key string, v int, s string")
    assert sinks.latest_by_key(df, ["key"], "v").first().s == "y"
    assert json.loads(sinks.topic_records(df, "key").first().value)["key"] == "k"


def test_counter_restart(spark):
    df = spark.createDataFrame([("c", i * 60, v) for i, v in enumerate([10, 15, 3, 4, 9, 1])], "c string, s int, n long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.increase for r in metrics.counter_increase(df, "c", "n").collect()) == [1, 14]


def test_stream_routes_to_tables(spark, tmp_path):
    rows = [("a", "t", "sysmon", "2024-05-01T00:00:00Z", "2024-05-01 00:00:00", '{"EventID": 1}'), ("a", "t", "sysmon", "2024-05-01T00:00:00Z", "2024-05-01 00:00:01", '{"EventID": 1}'),
            ("b", "t", "sysmon", "2024-05-01T00:00:00Z", "2024-05-01 00:00:00", "{}")]
    from watchtide.schema import ENVELOPE
    df = spark.createDataFrame(rows, "event_id string, tenant_id string, source string, timestamp string, received_at string, payload string").withColumn(
        "received_at", F.to_timestamp("received_at")).select(*ENVELOPE.fieldNames())
    df.write.parquet(str(tmp_path / "topic"))
    stream = flows.ingest_stream(sinks.topic_source(spark, str(tmp_path / "topic")))
    flows.run_now(stream, "", str(tmp_path / "cp"), sinks.split_routes(str(tmp_path / "out")))
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "out/accepted")).collect()] == ["a"]
    dead = spark.read.parquet(str(tmp_path / "out/dead_letter")).collect()
    assert [(r.event_id, r.error) for r in dead] == [("b", "empty_payload")]


def test_correlation_stream_sees_earlier_batches(spark, tmp_path):
    from watchtide.operators import windows
    rows = [("k", i * 10 * windows.SECOND, i) for i in range(12)]
    for f in range(3):
        spark.createDataFrame(rows[f * 4:f * 4 + 4], "k string, ts_us long, id long").coalesce(1).write.parquet(str(tmp_path / "in" / str(f)))
    stream = spark.readStream.schema("k string, ts_us long, id long").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rule = {"correlation": {"type": "threshold", "group_by": ["k"], "min_count": 4, "window_seconds": 30}}
    flows.correlate_stream(stream, rule, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.window_value for r in spark.read.parquet(str(tmp_path / "out/result")).collect()}
    assert got == {i: min(i + 1, 4) for i in range(12)}


def test_checkpoints_use_the_cluster_folder(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 4


# a sample of the registered queries against their oracle on the smallest data
SAMPLE = ["ingest_route", "normalize_email", "enrich_intel", "rules_service_hits", "corr_distinct", "detect_scores", "graph_edges",
          "graph_attack_path", "case_upsert", "grounding_score", "policy_linucb_fit", "approval_state", "audit_append", "eval_auc"]


@pytest.mark.parametrize("name", SAMPLE)
def test_registered_query_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    del duckdb
    import __spark_entry__ as entry
    import compare
    sf = "/root/testdata/sf0.001"
    status, note, _ = compare.check(spark, compare.connect(sf), name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert status == "ok", note


def test_workers_outside_the_repository_find_the_package(tmp_path):
    """Workers whose folder and path know nothing of the repository get the package from the session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from watchtide.operators import cluster
from watchtide.session import build_session
spark = build_session('outside', 'local[2]', **{{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'}})
rows = spark.createDataFrame([('t', 'a', 0, ['x']), ('t', 'b', 1, ['x'])], 'tenant_id string, alert_id string, ts_us long, items array<string>')
print(sorted(tuple(r) for r in cluster.greedy_clusters(rows).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != 'PYTHONPATH'}
    done = subprocess.run([sys.executable, '-c', code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "[('t', 'a', 'a'), ('t', 'b', 'a')]" in done.stdout, done.stderr[-2000:]


def test_every_query_has_a_unique_name_and_most_have_an_oracle():
    import __spark_entry__ as entry
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    own, own_oracles = registry.load()  # without the optional corpus queries
    assert len(own) - len(own_oracles) <= 12


def test_the_latest_catalog_names_a_vulnerability(spark, tmp_path):
    from watchtide.sources import readers
    for version, products in (("2024.02", ["new", "newest"]), ("2024.01", ["old"])):
        found = [{"cve_id": "CVE-1", "product": p} for p in products]
        (tmp_path / f"{version}.json").write_text(json.dumps({"catalog_version": version, "vulnerabilities": found}))
    row = readers.exploited_vulnerabilities(spark, str(tmp_path)).collect()
    assert [(r.cve_id, r.catalog_version, r["product"]) for r in row] == [("CVE-1", "2024.02", "newest")]


def test_scenarios_do_not_take_a_file_each(spark):
    from watchtide.plans import queries_sources
    docs = queries_sources._scenario_files(spark, "/root/testdata/sf0.01")
    assert docs.count() == 157 and len(docs.inputFiles()) == 1  # 10,000 events
