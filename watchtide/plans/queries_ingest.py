"""Queries for sources, ingest, normalization and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from watchtide import fixed
from watchtide.functions.core import joined, micros
from watchtide.operators import enrich, flatten, ingest, normalize
from watchtide.plans import stages, telemetry as tel
from watchtide.plans.registry import query
from watchtide.sources import readers
from watchtide.session import spread

# --- envelopes for ingest: every tenth record is sent twice, some lack a type or a payload ------
_PAYLOAD = ("CASE WHEN k % 10 = 7 THEN '{}' WHEN k % 10 = 3 THEN concat('{\"k\":', k, '}') "
            "ELSE concat('{\"event_type\":\"', event_type, '\",\"k\":', k, '}') END")
_SOURCE = "CASE event_type WHEN 'signup' THEN 'ad_auth' WHEN 'error' THEN 'network_firewall' WHEN 'click' THEN 'sysmon' WHEN 'view' THEN 'windows_security' ELSE 'vendorx' END"
_RESOLVED = "CASE event_type WHEN 'signup' THEN 'active_directory' WHEN 'error' THEN 'firewall' WHEN 'click' THEN 'sysmon' WHEN 'view' THEN 'windows' ELSE 'synthetic' END"


def ingest_envelopes(spark, sf) -> DataFrame:
    rows = spread(tel.event_rows(spark, sf)).selectExpr(
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('e', event_id) END AS event_id", "concat('t', user_id % 3) AS tenant_id",
        f"{_SOURCE} AS source", "cast(unix_micros(ts) AS string) AS timestamp", "ts AS received_at",
        f"{_PAYLOAD} AS payload", "event_id AS n")
    again = rows.where("n % 10 = 0").withColumn("received_at", F.expr("received_at + INTERVAL 60 SECONDS"))
    out = rows.unionByName(again).drop("n")
    return out.withColumn("source", ingest.resolve_source(F.col("source")))


_BASE = f"""base AS ({tel.sql_base()}),
env AS (SELECT CASE WHEN event_id % 4 = 0 THEN concat({_RESOLVED}, '-', substr(sha256(concat_ws(':', concat('t', user_id % 3), {_RESOLVED}, ts_us, {_PAYLOAD})), 1, 32))
  ELSE concat('e', event_id) END AS event_id, {_RESOLVED} AS source, {_PAYLOAD} AS payload, k, event_id AS n, concat('t', user_id % 3) AS tenant_id FROM base),
routed AS (SELECT event_id, source, tenant_id, CASE WHEN k % 10 IN (3, 7) THEN 'dead_lettered' ELSE 'accepted' END AS status,
  CASE WHEN k % 10 = 7 THEN 'empty_payload' WHEN k % 10 = 3 THEN 'missing_event_type_discriminator' END AS reason,
  CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END AS duplicates, payload FROM env)"""


@query("ingest_source_alias", f"""WITH base AS ({tel.sql_base()})
SELECT {_SOURCE} AS raw_source, {_RESOLVED} AS source, count(*) AS events FROM base GROUP BY 1, 2""")
def ingest_source_alias(spark, sf):
    rows = tel.event_rows(spark, sf).selectExpr(f"{_SOURCE} AS raw_source")
    return rows.withColumn("source", ingest.resolve_source(F.col("raw_source"))).groupBy("raw_source", "source").agg(F.count("*").alias("events"))


@query("ingest_event_id", f"WITH {_BASE} SELECT event_id, source, count(*) + max(CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END) AS copies FROM env GROUP BY 1, 2")
def ingest_event_id(spark, sf):
    return ingest.with_event_id(ingest_envelopes(spark, sf)).groupBy("event_id", "source").agg(F.count("*").alias("copies"))


@query("ingest_route", f"""WITH {_BASE}
SELECT event_id, status, CASE WHEN status = 'accepted' THEN 'raw.events' ELSE 'raw.dead_letter' END AS topic, reason, 1 AS records FROM routed
UNION ALL SELECT event_id, 'duplicate', NULL, 'already_ingested', duplicates FROM routed WHERE duplicates > 0""")
def ingest_route(spark, sf):
    return ingest.ingest_results(ingest.route(ingest_envelopes(spark, sf)))


@query("ingest_dead_letter", f"""WITH {_BASE}
SELECT event_id, 'raw.events' AS original_topic, reason AS error FROM routed WHERE status = 'dead_lettered'""")
def ingest_dead_letter(spark, sf):
    return ingest.dead_letters(ingest.route(ingest_envelopes(spark, sf))).drop("payload")


@query("ingest_batch_summary", f"""WITH {_BASE}
SELECT count(*) FILTER (status = 'accepted') AS accepted, CAST(sum(duplicates) AS BIGINT) AS duplicates, count(*) FILTER (status = 'dead_lettered') AS dead_lettered FROM routed""")
def ingest_batch_summary(spark, sf):
    return ingest.batch_summary(ingest.route(ingest_envelopes(spark, sf)))


@query("ingest_replay", f"""WITH {_BASE}
SELECT count(*) AS events_published, CAST(sum(duplicates) AS BIGINT) AS duplicates_skipped FROM routed""")
def ingest_replay(spark, sf):
    return readers.replay_summary(ingest.route(ingest_envelopes(spark, sf), validate=False))


@query("ingest_ttl_expiry", f"""WITH base AS ({tel.sql_base()}), edge AS (SELECT max(ts_us) - 7 * 86400000000 AS cut FROM base)
SELECT count(*) FILTER (ts_us < cut) AS expired, count(*) FILTER (ts_us >= cut) AS kept FROM base, edge""")
def ingest_ttl_expiry(spark, sf):
    seen = tel.event_rows(spark, sf).select("event_id", F.col("ts").alias("seen_at"))
    now = seen.agg(F.max("seen_at")).scalar()
    kept, expired = ingest.expire_keys(seen, now)
    return expired.agg(F.count("*").alias("expired"), F.lit(None).cast("long").alias("kept")).unionByName(
        kept.agg(F.lit(None).cast("long").alias("expired"), F.count("*").alias("kept"))).agg(
        F.max("expired").alias("expired"), F.max("kept").alias("kept"))


@query("ingest_stage_counters", f"""WITH {_BASE}
SELECT 'ingestion' AS service, 'ingest' AS stage, status AS outcome, count(*) AS events FROM routed GROUP BY 3
UNION ALL SELECT 'normalization', 'normalize', 'normalized', (SELECT count(*) FROM base)""")
def ingest_stage_counters(spark, sf):
    routed = ingest.route(ingest_envelopes(spark, sf)).withColumnRenamed("status", "outcome")
    norm = normalize.normalize(tel.envelopes(spark, sf)).select(
        F.when(F.col("error").isNull(), "normalized").otherwise("error").alias("outcome"))
    return ingest.stage_counters(("ingestion", "ingest", routed), ("normalization", "normalize", norm))


@query("ingest_consumer_lag", """SELECT topic, 'g1' AS "group", greatest(count(*) - 500, 0) AS lag FROM (SELECT event_type AS topic FROM events) GROUP BY 1""")
def ingest_consumer_lag(spark, sf):
    rows = tel.event_rows(spark, sf).select(F.col("event_type").alias("topic"))
    offsets = rows.distinct().select("topic", F.lit("g1").alias("group"), F.lit(500).cast("long").alias("offset"))
    return readers.consumer_lag(rows, offsets)


# --- normalization -----------------------------------------------------------------------------
_TEXTS = ["host", "user", "process", "parent_process", "command_line", "file_path", "file_hash", "src_ip", "dst_ip", "domain", "url",
          "email_from", "email_to", "email_subject", "cloud_resource", "k8s_namespace", "k8s_pod", "registry_key"]
_CANON_SQL = ", ".join(f'"{c}"' for c in _TEXTS)


def _normalize_query(source: str, oracle_source: str):
    @query(f"normalize_{source}", f"""WITH base AS ({tel.sql_base()}), canon AS ({tel.sql_canon()})
SELECT event_id, tenant_id, ts_us, source, event_type, severity, {_CANON_SQL}, CAST(process_id AS INT) AS process_id,
 CAST(parent_process_id AS INT) AS parent_process_id, CAST(dst_port AS INT) AS dst_port, coalesce(tag, '') AS tags, coalesce(given_technique, '') AS techniques
FROM canon WHERE source = '{oracle_source}'""")
    def run(spark, sf, source=source):
        return stages.normalized(spark, sf).where(F.col("source") == source).select(
            "event_id", "tenant_id", micros(F.col("ts")).alias("ts_us"), "source", "event_type", "severity", *_TEXTS,
            "process_id", "parent_process_id", "dst_port", joined(F.col("tags")).alias("tags"), joined(F.col("technique_ids")).alias("techniques"))
    return run


for _s in dict.fromkeys(tel.VARIANTS):
    _normalize_query(_s, _s)

_CONF = "CASE source " + " ".join(f"WHEN '{s}' THEN {c}::DOUBLE" for s, c in fixed.SOURCE_CONFIDENCE.items()) + " END"


@query("normalize_generic", f"""WITH base AS ({tel.sql_base()})
SELECT CASE WHEN event_type = 'view' THEN 'windows' WHEN event_type = 'click' THEN 'threat_intel' ELSE 'synthetic' END AS source,
 CASE WHEN event_type = 'view' THEN 'windows_event' WHEN event_type = 'click' THEN 'threat_intel_event' ELSE event_type END AS event_type,
 concat('H', k % 40) AS host, count(*) AS events, max(CASE WHEN event_type = 'view' THEN 0.85::DOUBLE WHEN event_type = 'click' THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END) AS source_confidence FROM base GROUP BY 1, 2, 3""")
def normalize_generic(spark, sf):
    env = tel.event_rows(spark, sf).selectExpr(
        "concat('g', event_id) AS event_id", "'default' AS tenant_id",
        "CASE WHEN event_type = 'view' THEN 'windows_security' WHEN event_type = 'click' THEN 'threat_intel' ELSE 'unheard-of' END AS source",
        "cast(ts AS string) AS timestamp", "ts AS received_at",
        "CASE WHEN event_type IN ('view', 'click') THEN to_json(struct(concat('H', k % 40) AS host)) ELSE to_json(struct(event_type, concat('H', k % 40) AS host)) END AS payload")
    return normalize.normalize(spread(env)).groupBy("source", "event_type", "host").agg(
        F.count("*").alias("events"), F.max("source_confidence").alias("source_confidence"))


@query("normalize_dispatch", f"""WITH base AS ({tel.sql_base()}), canon AS ({tel.sql_canon()})
SELECT source, event_type, severity, count(*) AS events, max({_CONF}) AS source_confidence FROM canon GROUP BY 1, 2, 3""")
def normalize_dispatch(spark, sf):
    return stages.normalized(spark, sf).groupBy("source", "event_type", "severity").agg(
        F.count("*").alias("events"), F.max("source_confidence").alias("source_confidence"))


@query("normalize_timestamp", f"""WITH base AS ({tel.sql_base()})
SELECT concat('e', event_id) AS event_id, CASE WHEN k % 5 = 4 THEN ts_us ELSE ts_us - ts_us % 1000000 END AS ts_us FROM base""")
def normalize_timestamp(spark, sf):
    rows = tel.event_rows(spark, sf).withColumn("text", F.expr(
        "CASE k % 5 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') "
        "WHEN 2 THEN concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00') WHEN 3 THEN date_format(ts, \"d MMM yyyy HH:mm:ss 'GMT'\") "
        "ELSE 'not a time' END"))
    return rows.select(F.concat(F.lit("e"), F.col("event_id")).alias("event_id"),
                       micros(normalize.parse_time(F.col("text"), F.col("ts"))).alias("ts_us"))


@query("normalize_error_split", f"""WITH base AS ({tel.sql_base()})
SELECT coalesce(error, 'ok') AS outcome, count(*) AS events FROM (SELECT CASE WHEN k % 10 = 1 THEN 'missing_source' WHEN k % 10 = 2 THEN 'parser_error: payload is not JSON' END AS error FROM base) GROUP BY 1""")
def normalize_error_split(spark, sf):
    env = tel.event_rows(spark, sf).selectExpr(
        "concat('g', event_id) AS event_id", "'default' AS tenant_id", "CASE WHEN k % 10 = 1 THEN NULL ELSE 'sysmon' END AS source",
        "cast(ts AS string) AS timestamp", "ts AS received_at", "CASE WHEN k % 10 = 2 THEN '{broken' ELSE '{\"EventID\": 1}' END AS payload")
    good, bad = normalize.split_errors(normalize.normalize(env))
    return good.groupBy(F.lit("ok").alias("outcome")).agg(F.count("*").alias("events")).unionByName(
        bad.groupBy(F.col("error").alias("outcome")).agg(F.count("*").alias("events")))


@query("normalize_provenance", f"""WITH base AS ({tel.sql_base()}), canon AS ({tel.sql_canon(['source'])})
SELECT event_id, event_id AS raw_event_id, 'raw.events' AS topic, source, ts_us AS ingested_us FROM canon""")
def normalize_provenance(spark, sf):
    return stages.normalized(spark, sf).select("event_id", "provenance.raw_event_id", "provenance.topic", "provenance.source",
                                               micros(F.col("provenance.ingested_at")).alias("ingested_us"))


_KIND = "k % 12"


@query("normalize_evaluator_flatten", f"""WITH base AS ({tel.sql_base()}), canon AS ({tel.sql_canon()})
SELECT event_id AS record_id, source AS canonical_source,
 CASE {_KIND} WHEN 0 THEN '1' WHEN 1 THEN CAST({tel.FILE_CODE.replace('event_type', 'etype')} AS VARCHAR) WHEN 5 THEN CAST({tel.LOGON_CODE.replace('event_type', 'etype')} AS VARCHAR) END AS event_id,
 CASE WHEN {_KIND} IN (0, 1, 5, 8) THEN host END AS host, CASE WHEN {_KIND} IN (0, 1, 8) THEN process END AS image,
 CASE WHEN {_KIND} IN (0, 8) THEN file_hash END AS sha256, CASE WHEN {_KIND} IN (2, 10) THEN domain END AS dns_query,
 CASE WHEN {_KIND} IN (2, 10) THEN length(domain) END AS dns_query_length, CASE WHEN {_KIND} IN (2, 10) THEN 'dns' WHEN {_KIND} = 3 THEN 'conn' END AS zeek_log_type,
 CASE WHEN {_KIND} = 6 THEN CASE WHEN n % 2 = 0 THEN 'No' ELSE 'Yes' END END AS mfa_used,
 CASE WHEN {_KIND} = 7 THEN file_path END AS attachment_name, CASE WHEN {_KIND} = 4 THEN tag END AS alert_category,
 CASE WHEN {_KIND} = 8 THEN given_technique ELSE '' END AS mitre_techniques
FROM canon""")
def normalize_evaluator_flatten(spark, sf):
    env = tel.envelopes(spark, sf).withColumnRenamed("event_id", "record_id").withColumn("raw", F.col("payload"))
    flat = flatten.flatten(env, ["record_id"])
    return flat.select("record_id", ingest.resolve_source(F.col("source")).alias("canonical_source"), "event_id", "host", "image", "sha256",
                       "dns_query", F.col("dns_query_length").cast("bigint").alias("dns_query_length"), "zeek_log_type", "mfa_used", "attachment_name", "alert_category",
                       F.coalesce(joined(F.col("mitre_techniques")), F.lit("")).alias("mitre_techniques"))


# --- enrichment --------------------------------------------------------------------------------
_ENR = stages.sql_enriched()


@query("enrich_identity", f"""WITH base AS ({tel.sql_base()}) SELECT raw_user, CASE raw_user WHEN 'CORP' || chr(92) || 'John.Doe ' THEN 'jdoe' WHEN 'alice.smith' THEN 'asmith' ELSE lower(raw_user) END AS "user",
 raw_host, upper(trim(raw_host)) AS host, count(*) AS events FROM (SELECT CASE k % 4 WHEN 0 THEN 'CORP' || chr(92) || 'John.Doe ' WHEN 1 THEN 'alice.smith' ELSE concat('User', user_id) END AS raw_user, concat(' wks', k % 40) AS raw_host FROM base) GROUP BY 1, 2, 3, 4""")
def enrich_identity(spark, sf):
    rows = tel.event_rows(spark, sf).selectExpr(
        "CASE k % 4 WHEN 0 THEN concat('CORP', chr(92), 'John.Doe ') WHEN 1 THEN 'alice.smith' ELSE concat('User', user_id) END AS raw_user", "concat(' wks', k % 40) AS raw_host")
    return rows.select("raw_user", enrich.resolve_user(F.col("raw_user")).alias("user"), "raw_host", enrich.resolve_host(F.col("raw_host")).alias("host")).groupBy(
        "raw_user", "user", "raw_host", "host").agg(F.count("*").alias("events"))


_DOC_TAGS = ", ".join(f"CASE WHEN {stages.sql_any('lower(text)', words)} THEN '{t}' END" for t, words in sorted(fixed.KEYWORD_TECHNIQUES.items()))


@query("enrich_keyword_techniques", f"SELECT doc_id, array_to_string([x FOR x IN [{_DOC_TAGS}] IF x IS NOT NULL], ',') AS techniques FROM documents")
def enrich_keyword_techniques(spark, sf):
    return spread(tel.read(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", joined(enrich.infer_techniques(F.lower("text"))).alias("techniques"))


_NAMES = "CASE x " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, (n, _) in fixed.TECHNIQUE_CATALOG.items()) + " ELSE x END"


@query("enrich_techniques", f"WITH {_ENR} SELECT event_id, array_to_string(techs, ',') AS techniques, array_to_string([{_NAMES} FOR x IN techs], '|') AS names FROM enr")
def enrich_techniques(spark, sf):
    return stages.enriched(spark, sf).select("event_id", joined(F.col("technique_ids")).alias("techniques"),
                                             joined(F.col("enrichment.technique_names"), "|").alias("names"))


@query("enrich_criticality", f"WITH {_ENR} SELECT event_id, host, \"user\", crit AS asset_criticality FROM enr")
def enrich_criticality(spark, sf):
    return stages.enriched(spark, sf).select("event_id", "host", "user", "asset_criticality")


@query("enrich_intel", f"WITH {_ENR} SELECT event_id, array_to_string(intel, ',') AS intel_matches, array_to_string(confs, ',') AS confidences FROM enr")
def enrich_intel(spark, sf):
    return stages.enriched(spark, sf).select("event_id", joined(F.col("intel_matches")).alias("intel_matches"), F.array_join(
        F.transform("intel_hits", lambda h: h["confidence"].cast("string")), ",").alias("confidences"))


# every part is loaded three times, ten days apart: with changing confidence, and taken away by the last for every third
_VERSIONS = """ver AS (SELECT lower(CASE WHEN p_partkey % 5 > 0 THEN concat('unseen', p_partkey, '.example') WHEN p_partkey % 2 = 0 THEN concat('DOM', p_partkey % 97, '.example') ELSE concat('203.0.113.', p_partkey % 120) END) AS ioc_key,
 TIMESTAMP '2024-01-01' + to_days(CAST(10 * v + p_partkey % 7 AS INT)) AS since, CASE WHEN v < 2 OR p_partkey % 3 > 0 THEN (50 + (p_partkey + 13 * v) % 50) / 100.0::DOUBLE END AS confidence, p_partkey AS load_order
 FROM part, (VALUES (0), (1), (2)) AS vs(v)),
lst AS (SELECT ioc_key, since, arg_max(coalesce(confidence, -1), load_order) AS conf FROM ver GROUP BY 1, 2)"""
_AT = " UNION ALL ".join(f"SELECT event_id, ts, {i} AS place, {f} AS v FROM canon WHERE {f} IS NOT NULL" for i, f in enumerate(enrich.INTEL_FIELDS))


@query("enrich_list_versions", f"""WITH {_ENR}, {_VERSIONS}, look AS ({_AT}),
hit AS (SELECT event_id, place, v, conf FROM look ASOF JOIN lst ON lst.ioc_key = lower(look.v) AND look.ts >= lst.since)
SELECT event_id, string_agg(v, ',' ORDER BY place) AS intel_matches, string_agg(CAST(conf AS VARCHAR), ',' ORDER BY place) AS confidences FROM hit WHERE conf >= 0 GROUP BY 1""")
def enrich_list_versions(spark, sf):
    """Each event meets the list as it was at its own time."""
    feed = tel.indicators(spark, sf).withColumn("v", F.explode(F.array(*map(F.lit, range(3))))).selectExpr(
        "value", "load_order", "indicator_id", "CAST(TIMESTAMP_NTZ'2024-01-01' + make_interval(0, 0, 0, CAST(10 * v + load_order % 7 AS INT)) AS TIMESTAMP) AS since",
        "CASE WHEN v < 2 OR load_order % 3 > 0 THEN (50 + (load_order + 13 * v) % 50) / 100.0D END AS confidence")
    events = stages.normalized(spark, sf)
    out = enrich.match_indicators_as_of(events, enrich.indicator_versions(feed, "since"), "ts").where(F.size("intel_hits") > 0)
    return out.select("event_id", joined(F.col("intel_matches")).alias("intel_matches"), joined(F.col("intel_hits.confidence").cast("array<string>")).alias("confidences"))


@query("enrich_ioc_lookup", f"WITH {_ENR} SELECT ioc_key, conf AS confidence, ind AS indicator_id FROM ioc")
def enrich_ioc_lookup(spark, sf):
    return enrich.latest_indicators(tel.indicators(spark, sf)).select("ioc_key", "ioc.confidence", "ioc.indicator_id")


@query("enrich_entities", f"WITH {_ENR}, {stages.sql_entities()} SELECT event_id, len(ids) AS entity_count, array_to_string(ids, ',') AS entity_ids FROM ents")
def enrich_entities(spark, sf):
    return stages.enriched(spark, sf).select("event_id", F.size("entities").cast("long").alias("entity_count"),
                                             joined(F.transform("entities", lambda e: e["id"])).alias("entity_ids"))


@query("enrich_event", f"""WITH {_ENR}, {stages.sql_entities()} SELECT tenant_id, source, count(*) AS events, CAST(sum(len(techs)) AS BIGINT) AS techniques,
 CAST(sum(len(intel)) AS BIGINT) AS intel_hits, CAST(sum(len(ids)) AS BIGINT) AS entities, round(max(crit), 3) AS max_criticality FROM ents GROUP BY 1, 2""")
def enrich_event(spark, sf):
    return stages.enriched(spark, sf).groupBy("tenant_id", "source").agg(
        F.count("*").alias("events"), F.sum(F.size("technique_ids")).alias("techniques"), F.sum(F.size("enrichment.intel_hits")).alias("intel_hits"),
        F.sum(F.col("enrichment.entity_count")).alias("entities"), F.round(F.max("asset_criticality"), 3).alias("max_criticality"))


@query("normalize_time_problems", f"""WITH base AS ({tel.sql_base()}) SELECT {tel.SOURCE} AS source, count(*) AS records, count(*) FILTER (event_id % 20 IN (3, 4)) AS without_time, count(*) FILTER (event_id % 20 = 7) AS unreadable FROM base GROUP BY 1""")
def normalize_time_problems(spark, sf):
    """Some records lose their time, some get one that no format reads, some other known formats."""
    number = F.regexp_extract("event_id", r"(\d+)$", 1).cast("long") % 20
    broken = tel.envelopes(spark, sf).withColumn("timestamp", F.when(number == 3, F.lit(" ")).when(number == 4, F.lit(None)).when(number == 7, F.lit("yesterday, 5-ish"))
                                                 .when(number == 8, F.lit("Mon, 1 Jan 2024 10:00:00 +0100")).when(number == 9, F.lit("01/31/2024 10:00:00")).otherwise(F.col("timestamp")))
    return normalize.time_problems(broken)
