"""Queries for file sources: documents are written out of the given tables and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.operators import rules
from watchtide.plans import telemetry as tel
from watchtide.plans.queries_stream import _stream
from watchtide.plans.registry import query
from watchtide.session import checkpoint_root
from watchtide.sources import readers, sinks

_EVENTS = f"base AS ({tel.sql_base()})"


def _folder(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/source-{name}-{uuid.uuid4().hex}"


def _written(rows: DataFrame, name: str, block: str, doc: Column, per_file: int | None = None) -> str:
    """Folder with one document for each value of ``block``; blocks bound the rows of a document.

    A file holds one document, or with ``per_file`` an array of the documents of so many blocks.
    """
    folder = _folder(rows.sparkSession, name)
    docs = rows.groupBy(F.expr(block).alias("block")).agg(doc.alias("value"))
    if per_file:
        docs = docs.groupBy(F.floor(F.col("block") / per_file).alias("block")).agg(
            F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    docs.write.partitionBy("block").text(folder)
    return folder


def _listed(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*[F.expr(f) for f in fields])))


@query("source_raw_lines", f"WITH {_EVENTS} SELECT event_type AS source, ts_us::VARCHAR AS timestamp, CASE WHEN user_id % 3 = 0 THEN 'default' ELSE concat('t', user_id % 3) END AS tenant_id, k FROM base")
def source_raw_lines(spark, sf):
    """Lines with and without a tenant, payloads under both names, blank lines between them."""
    line = F.expr("""concat('{"source":"', event_type, '","timestamp":"', unix_micros(ts), '"',
        CASE WHEN user_id % 3 > 0 THEN concat(',"tenant_id":"t', user_id % 3, '"') ELSE '' END,
        CASE WHEN k % 2 = 0 THEN ',"raw":' ELSE ',"event":' END, props, '}')""")
    folder = _folder(spark, "lines")
    rows = tel.event_rows(spark, sf).select(F.explode(F.array(line, F.lit(""))).alias("value"))
    rows.write.text(folder)
    return readers.raw_lines(spark, folder).select(
        "source", "timestamp", "tenant_id", F.get_json_object("raw", "$.k").cast("int").alias("k"))


def _scenario_files(spark, sf) -> DataFrame:
    """One scenario for each 64 events, 500 to a file; every third has no title, every fourth no description."""
    events = F.transform(_listed("event_id", "event_type AS source", "cast(unix_micros(ts) AS string) AS timestamp", "struct(k) AS raw"),
                         lambda e: F.struct(e["source"].alias("source"), e["timestamp"].alias("timestamp"), e["raw"].alias("raw")))
    number = F.min(F.expr("event_id div 64"))
    doc = F.to_json(F.struct(
        F.concat(F.lit("s"), number).alias("scenario_id"), F.when(number % 3 > 0, F.concat(F.lit("Scenario "), number)).alias("title"),
        F.when(number % 4 > 0, F.lit("of 64 events")).alias("description"), F.lit("case").alias("expected_outcome"), events.alias("events")))
    return readers.scenarios(spark, _written(tel.event_rows(spark, sf), "scenarios", "event_id div 64", doc, per_file=500))


@query("source_scenario_events", f"WITH {_EVENTS} SELECT concat('s', event_id // 64) AS scenario_id, row_number() OVER (PARTITION BY event_id // 64 ORDER BY event_id) - 1 AS position, event_type AS source, ts_us::VARCHAR AS timestamp, k FROM base")
def source_scenario_events(spark, sf):
    return readers.scenario_events(_scenario_files(spark, sf)).select(
        "scenario_id", F.col("position").cast("long").alias("position"), "source", "timestamp", F.get_json_object("raw", "$.k").cast("int").alias("k"))


@query("source_scenario_catalog", """SELECT concat('s', n) AS scenario_id, n % 3 > 0 AS titled, CASE WHEN n % 4 > 0 THEN 'of 64 events' ELSE '' END AS description, 'case' AS expected_outcome, count(*) AS event_count
FROM (SELECT event_id // 64 AS n FROM events) GROUP BY n""")
def source_scenario_catalog(spark, sf):
    """A scenario without a title is named after its file."""
    return readers.scenario_catalog(_scenario_files(spark, sf)).select(
        "scenario_id", F.col("title").startswith("Scenario ").alias("titled"), "description", "expected_outcome", F.col("event_count").cast("long").alias("event_count"))


@query("source_indicator_feed", "SELECT concat('feed', p_partkey // 500) AS feed_name, concat('ioc-', p_partkey) AS indicator_id, concat('bad', p_partkey, '.example') AS value, (p_partkey % 100) / 100.0::DOUBLE AS confidence FROM part")
def source_indicator_feed(spark, sf):
    found = _listed("concat('ioc-', p_partkey) AS indicator_id", "'domain' AS type", "concat('bad', p_partkey, '.example') AS value", "(p_partkey % 100) / 100.0D AS confidence")
    doc = F.to_json(F.struct(F.concat(F.lit("feed"), F.min(F.expr("p_partkey div 500"))).alias("feed_name"), found.alias("indicators")))
    feed = readers.ioc_feed(spark, _written(tel.read(spark, sf, "part"), "feed", "p_partkey div 500", doc))
    return feed.select("feed_name", "indicator_id", "value", "confidence")


@query("source_exploited_vulnerabilities", """SELECT concat('CVE-2024-', p_partkey % 1500) AS cve_id, max(v)::VARCHAR AS catalog_version, arg_max(p_brand, p_partkey) AS product, arg_max(p_partkey % 2 = 0, p_partkey) AS known_ransomware_use
FROM (SELECT *, 1000000 + p_partkey // 500 AS v FROM part) GROUP BY p_partkey % 1500""")
def source_exploited_vulnerabilities(spark, sf):
    """Several catalogs name the same entry; that of the latest catalog holds."""
    found = F.transform(_listed("p_partkey", "concat('CVE-2024-', p_partkey % 1500) AS cve_id", "p_brand AS product", "p_partkey % 2 = 0 AS known_ransomware_use"),
                        lambda v: v.dropFields("p_partkey"))
    doc = F.to_json(F.struct((F.min(F.expr("p_partkey div 500")) + 1_000_000).cast("string").alias("catalog_version"), found.alias("vulnerabilities")))
    return readers.exploited_vulnerabilities(spark, _written(tel.read(spark, sf, "part"), "kev", "p_partkey div 500", doc)).select(
        "cve_id", "catalog_version", "product", "known_ransomware_use")


@query("source_asset_inventory", """SELECT 'host' AS kind, concat('WKS', p_partkey) AS name, (p_partkey % 10) / 10.0::DOUBLE AS criticality, p_brand AS role FROM part
UNION ALL SELECT 'user', concat('user', p_partkey), (p_partkey % 7) / 10.0::DOUBLE, NULL FROM part""")
def source_asset_inventory(spark, sf):
    def named(prefix: str, *fields: str) -> Column:
        return F.map_from_entries(_listed(f"concat('{prefix}', p_partkey) AS name", f"struct({', '.join(fields)}) AS asset"))
    doc = F.to_json(F.struct(named("WKS", "(p_partkey % 10) / 10.0D AS criticality", "p_brand AS role").alias("hosts"),
                             named("user", "(p_partkey % 7) / 10.0D AS criticality").alias("users")))
    hosts, users, _ = readers.asset_inventory(spark, _written(tel.read(spark, sf, "part"), "assets", "p_partkey div 500", doc))
    return hosts.select(F.lit("host").alias("kind"), "name", "criticality", "role").unionByName(
        users.select(F.lit("user").alias("kind"), "name", "criticality", "role"))


@query("source_technique_catalog", "SELECT concat('T', p_partkey) AS technique_id, p_name AS name, p_brand AS tactic FROM part")
def source_technique_catalog(spark, sf):
    doc = F.to_json(F.map_from_entries(_listed("concat('T', p_partkey) AS id", "struct(p_name AS name, p_brand AS tactic) AS v")))
    return readers.technique_catalog(spark, _written(tel.read(spark, sf, "part"), "techniques", "p_partkey div 500", doc))


@query("source_feedback_episodes", "SELECT (event_id % 100) / 100.0::DOUBLE AS risk_score, event_type AS objective, concat('a', user_id) AS action_class, (event_id % 4) / 4.0::DOUBLE AS reward FROM events")
def source_feedback_episodes(spark, sf):
    doc = F.to_json(_listed("(event_id % 100) / 100.0D AS risk_score", "event_type AS objective", "concat('a', user_id) AS action_class", "(event_id % 4) / 4.0D AS reward"))
    return readers.feedback_episodes(spark, _written(tel.event_rows(spark, sf), "episodes", "event_id div 500", doc)).select(
        "risk_score", "objective", "action_class", "reward")


@query("source_triage_reports", """SELECT concat('r', o_orderkey) AS report_id, concat('s', o_custkey) AS scenario_id, concat('ev', o_orderkey % 9) AS evidence_cited,
 CASE WHEN o_orderkey % 5 = 0 THEN 'claim' ELSE '' END AS unsupported_claims, concat('T', o_orderkey % 7) AS predicted, concat('ev', o_orderkey % 9) AS pool,
 (o_orderkey % 10) / 10.0::DOUBLE AS self_reported FROM orders""")
def source_triage_reports(spark, sf):
    """Reports with and without claims of their own."""
    report = """struct(concat('r', o_orderkey) AS report_id, array(concat('ev', o_orderkey % 9)) AS evidence_cited,
        CASE WHEN o_orderkey % 5 = 0 THEN array('claim') END AS unsupported_claims,
        array(struct(concat('T', o_orderkey % 7) AS technique_id)) AS attack_mapping, (o_orderkey % 10) / 10.0D AS groundedness_score) AS report"""
    doc = F.to_json(F.collect_list(F.struct(F.expr("concat('s', o_custkey) AS scenario_id"), F.expr("map(concat('ev', o_orderkey % 9), 'text') AS evidence_pool"), F.expr(report))))
    out = readers.triage_reports(spark, _written(tel.read(spark, sf, "orders"), "reports", "o_orderkey div 500", doc))
    return out.select("report_id", "scenario_id", *[F.array_join(c, ",").alias(c) for c in ("evidence_cited", "unsupported_claims", "predicted", "pool")], "self_reported")


@query("source_rule_files", "SELECT concat('R-', event_type) AS rule_id, count(*) AS hits FROM events WHERE value >= 10 GROUP BY 1")
def source_rule_files(spark, sf):
    """A rule file for each event type, and one that is no YAML; the rules are run over all events."""
    events = tel.event_rows(spark, sf)
    kinds = events.select("event_type").distinct()
    good = kinds.select("event_type", F.expr(r"""concat('id: R-', event_type, '\ntitle: large ', event_type, '\nlevel: high\ndetection:\n  selection:\n    event_type: ',
        event_type, '\n    value|gte: 10\n  condition: selection\n')""").alias("value"))
    folder = _folder(spark, "rules")
    bad = kinds.select(F.lit("broken").alias("event_type"), F.lit("id: [").alias("value")).distinct()
    files = spark._jvm.org.apache.hadoop.fs
    for name, text in good.unionByName(bad).collect():  # rules are configuration: a file for each event type
        path = files.Path(f"{folder}/{name}.yml")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(text.encode())
        out.close()
    found = readers.rule_documents(spark, folder)
    hits = rules.gate(events.select("event_id", "event_type", "value"), found, "evaluator")
    return hits.select(F.explode("matches.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("hits"))


@query("sink_topic_records", f"WITH {_EVENTS} SELECT event_id::VARCHAR AS key, event_type, k FROM base")
def sink_topic_records(spark, sf):
    """All events published to a topic of files as keyed JSON, and read from it."""
    folder = _folder(spark, "topic")
    sinks.write_topic(sinks.topic_records(_stream(spark, sf)), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "key", F.get_json_object("value", "$.event_type").alias("event_type"), F.get_json_object("value", "$.k").cast("int").alias("k"))
