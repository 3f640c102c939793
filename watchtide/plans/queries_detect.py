"""Queries for rules, windowed correlation and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide import fixed
from watchtide.functions.core import joined, micros
from watchtide.operators import detect, flatten, rules, scoring, windows
from watchtide.plans import stages, telemetry as tel
from watchtide.plans.registry import query
from watchtide.session import cut_lineage, spread

_ENR = stages.sql_enriched()
_GAT = stages.sql_gated()
_BASE = f"base AS ({tel.sql_base()})"


def _events(spark, sf):
    """Events with the light columns the window queries group by."""
    return tel.event_rows(spark, sf).selectExpr(
        "event_id", "unix_micros(ts) AS ts_us", "ts", "concat('t', user_id % 3) AS tenant_id", "concat('U', user_id % 10) AS user",
        "concat('H', k % 40) AS host", "event_type", "k", "value")


# --- value modifiers ---------------------------------------------------------------------------

def _modifier_rules() -> list[dict]:
    def one(rid, block):
        return {"id": rid, "title": rid, "level": "low", "detection": {"selection": block, "condition": "selection"}}
    return [
        one("contains", {"text|contains": ["INVOICE", "the ", "über"]}),
        one("startswith", {"text|startswith": ["the", "a"]}),
        one("endswith", {"text|endswith": [".", "!"]}),
        one("gt", {"n_chars|gt": 2000}), one("lte", {"n_chars|lte": "500"}), one("bad_number", {"text|gt": 3}),
        one("equals", {"lang": ["EN", "de"]}), one("two_fields", {"lang": "fr", "n_chars|gte": 1000}),
    ]


@query("rules_modifiers", """SELECT rule_id, count(*) AS hits FROM (
SELECT unnest([x FOR x IN [
 CASE WHEN contains(lower(text), 'invoice') OR contains(lower(text), 'the ') OR contains(lower(text), 'über') THEN 'contains' END,
 CASE WHEN starts_with(lower(text), 'the') OR starts_with(lower(text), 'a') THEN 'startswith' END,
 CASE WHEN ends_with(text, '.') OR ends_with(text, '!') THEN 'endswith' END,
 CASE WHEN n_chars > 2000 THEN 'gt' END, CASE WHEN n_chars <= 500 THEN 'lte' END,
 CASE WHEN lower(lang) IN ('en', 'de') THEN 'equals' END, CASE WHEN lang = 'fr' AND n_chars >= 1000 THEN 'two_fields' END] IF x IS NOT NULL]) AS rule_id FROM documents) GROUP BY 1""")
def rules_modifiers(spark, sf):
    docs = spread(tel.read(spark, sf, "documents"))
    hits = rules.gate(docs, _modifier_rules()).select(F.explode("matches.rule_id").alias("rule_id"))
    return hits.groupBy("rule_id").agg(F.count("*").alias("hits"))


@query("rules_list_matching", """WITH w AS (SELECT page_id, string_split(url, '/') AS parts FROM pages)
SELECT rule_id, count(*) AS hits FROM (SELECT unnest([x FOR x IN [
 CASE WHEN list_contains([lower(p) FOR p IN parts], 'en') THEN 'member' END,
 CASE WHEN len([p FOR p IN parts IF contains(lower(p), 'exam')]) > 0 THEN 'any_contains' END,
 CASE WHEN len([p FOR p IN parts IF starts_with(lower(p), 'm.')]) > 0 THEN 'any_starts' END,
 'present'] IF x IS NOT NULL]) AS rule_id FROM w) GROUP BY 1""")
def rules_list_matching(spark, sf):
    pages = tel.read(spark, sf, "pages").select("page_id", F.split("url", "/").alias("parts"))
    def one(rid, block):
        return {"id": rid, "detection": {"selection": block, "condition": "selection"}}
    service = rules.gate(pages, [one("member", {"parts|contains": ["EN"]})])
    evaluator = rules.gate(pages, [one("any_contains", {"parts|contains": "exam"}), one("any_starts", {"parts|startswith": "M."}),
                                   one("present", {"parts|exists": True}), one("absent", {"parts|not_exists": True})], mode="evaluator")
    both = service.select("matches.rule_id").unionByName(evaluator.select("matches.rule_id"))
    return both.select(F.explode("rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("hits"))


@query("rules_condition", f"""WITH {_BASE}
SELECT rule_id, count(*) AS hits FROM (SELECT unnest([x FOR x IN [
 CASE WHEN event_type = 'click' OR (value > 100 AND NOT (user_id % 2 = 0)) THEN 'mixed' END,
 CASE WHEN NOT (event_type = 'click') THEN 'negated' END,
 CASE WHEN event_type = 'click' AND value > 100 THEN 'unreadable' END] IF x IS NOT NULL]) AS rule_id FROM base) GROUP BY 1""")
def rules_condition(spark, sf):
    rows = tel.event_rows(spark, sf).withColumn("even", F.col("user_id") % 2 == 0)
    blocks = {"selection": {"event_type": "click"}, "big": {"value|gt": 100}, "filter_even": {"even": True}}
    def one(rid, cond):
        return {"id": rid, "detection": {**blocks, "condition": cond}}
    out = rules.gate(rows, [one("mixed", "selection or (big and not filter_even)"), one("negated", "not selection"),
                            one("unreadable", "1 of selection*")])
    return out.select(F.explode("matches.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("hits"))


_CATALOG = ", ".join(
    f"('{r['id']}', '{r['title']}', '{r['level']}', '{','.join(r['technique_ids'])}', '{r['detection']['condition']}', {bool(r.get('correlation'))})"
    for r in rules.shipped_rules())


@query("rules_catalog", f"""WITH {_ENR}, {_GAT}, h AS (SELECT rule_id, count(*) AS hits FROM (SELECT unnest(rule_ids) AS rule_id FROM gat) GROUP BY 1)
SELECT c.*, coalesce(hits, 0) AS hits FROM (VALUES {_CATALOG}) c(rule_id, title, level, technique_ids, condition, correlated) LEFT JOIN h USING (rule_id)""")
def rules_catalog(spark, sf):
    """Rule list with the number of events each matches."""
    hits = stages.gated(spark, sf).select(F.explode("matches.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return rules.catalog(spark, rules.shipped_rules()).join(hits, "rule_id", "left").fillna(0, ["hits"]).select(
        "rule_id", "title", "level", joined(F.col("technique_ids")).alias("technique_ids"), "condition", "correlated", "hits")


@query("rules_service_hits", f"WITH {_ENR}, {_GAT} SELECT event_id, array_to_string(rule_ids, ',') AS rule_ids FROM gat WHERE len(rule_ids) > 0")
def rules_service_hits(spark, sf):
    return stages.gated(spark, sf).where(F.size("matches") > 0).select("event_id", joined(F.col("matches.rule_id")).alias("rule_ids"))


_EV = stages.sql_rules() | {
    "DR-0006": "(k % 12) = 5 AND etype = 'signup' AND n % 2 = 0",
    "DR-0011": f"(k % 12) = 6 AND command_line IN ('ConsoleLogin', 'CreateAccessKey', 'AttachUserPolicy') AND n % 2 = 0",
    "DR-0013": "(k % 12) IN (2, 10) AND length(domain) > 40",
    "DR-0018": "(k % 12) = 5 AND etype = 'view'",
    "DR-0020": "(k % 12) = 5 AND etype = 'click'",
}


@query("rules_evaluator_hits", f"""WITH base AS ({tel.sql_base()}), enr AS ({tel.sql_canon()})
SELECT record_id, rule_ids FROM (SELECT event_id AS record_id, array_to_string({stages.sql_compact([f"CASE WHEN {p} THEN '{r}' END" for r, p in _EV.items()])}, ',') AS rule_ids FROM enr) WHERE rule_ids <> ''""")
def rules_evaluator_hits(spark, sf):
    env = tel.envelopes(spark, sf).withColumnRenamed("event_id", "record_id").withColumn("raw", F.col("payload"))
    out = rules.gate(flatten.flatten(env, ["record_id"]), rules.shipped_rules(), mode="evaluator")
    return out.where(F.size("matches") > 0).select("record_id", joined(F.col("matches.rule_id")).alias("rule_ids"))


@query("rules_evidence", f"""WITH {_ENR}
SELECT event_id, process AS image, parent_process AS parent_image FROM enr WHERE {stages.sql_rules()['DR-0002']}""")
def rules_evidence(spark, sf):
    rule = [r for r in rules.shipped_rules() if r["id"] == "DR-0002"]
    out = rules.gate(stages.enriched(spark, sf), rule, evidence=True).where(F.size("matches") > 0)
    ev = F.element_at("matches", 1)["evidence"]
    return out.select("event_id", ev["selection.image"].alias("image"), ev["selection.parent_image"].alias("parent_image"))


@query("detect_hits", f"""WITH {_ENR}, {_GAT} SELECT concat(event_id, '#', r) AS detection_id, event_id, r AS rule_id, tenant_id,
 CASE r {' '.join(f"WHEN '{x['id']}' THEN '{x['level']}'" for x in rules.shipped_rules())} END AS severity,
 CASE r {' '.join(f"WHEN '{x['id']}' THEN {fixed.SEVERITY_WEIGHT[x['level']]}::DOUBLE" for x in rules.shipped_rules())} END AS score
FROM (SELECT event_id, tenant_id, unnest(rule_ids) AS r FROM gat)""")
def detect_hits(spark, sf):
    return scoring.detections(stages.gated(spark, sf)).select("detection_id", "event_id", "rule_id", "tenant_id", "severity", "score")


# --- windows -----------------------------------------------------------------------------------

def _threshold_rule(keys, count, seconds):
    return {"id": "c1", "correlation": {"type": "threshold", "group_by": keys, "min_count": count, "window_seconds": seconds}}


def _distinct_rule(keys, field, count, seconds):
    return {"id": "c2", "correlation": {"type": "distinct_count", "group_by": keys, "distinct_field": field, "min_distinct": count, "window_seconds": seconds}}


_LIGHT = ("SELECT event_id, epoch_us(ts) AS ts_us, ts, concat('t', user_id % 3) AS tenant_id, concat('U', user_id % 10) AS \"user\", "
          "concat('H', CAST(json_extract_string(props, '$.k') AS INT) % 40) AS host, event_type FROM events")


def _over(keys: str, seconds: int) -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)"


@query("corr_threshold", f"""WITH e AS ({_LIGHT}) SELECT event_id, window_value, window_value >= 5 AS correlated, ts_us - 3600000000 AS window_start FROM (
SELECT *, count(*) {_over('tenant_id, event_type', 3600)} AS window_value FROM e)""")
def corr_threshold(spark, sf):
    out = windows.correlate(_events(spark, sf), _threshold_rule(["tenant_id", "event_type"], 5, 3600))
    return out.select("event_id", "window_value", "correlated", "window_start")


@query("corr_distinct", f"""WITH e AS ({_LIGHT}) SELECT event_id, window_value, window_value >= 3 AS correlated FROM (
SELECT *, count(DISTINCT host) {_over('"user"', 3600)} AS window_value FROM e)""")
def corr_distinct(spark, sf):
    out = windows.correlate(_events(spark, sf), _distinct_rule(["user"], "host", 3, 3600))
    return out.select("event_id", "window_value", "correlated")


@query("corr_value_spans", f"""WITH e AS ({_LIGHT}), g AS (SELECT "user", host, ts_us, CASE WHEN ts_us - lag(ts_us) OVER w <= 3600000000 THEN 0 ELSE 1 END AS brk FROM e WHERE host IS NOT NULL WINDOW w AS (PARTITION BY "user", host ORDER BY ts_us)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY "user", host ORDER BY ts_us) AS nr FROM g) SELECT "user", host, min(ts_us) AS present_from, max(ts_us) + 3600000000 AS present_until FROM s GROUP BY "user", host, nr""")
def corr_value_spans(spark, sf):
    return windows.value_spans(_events(spark, sf), ["user"], "host", "ts_us", 3600)


@query("corr_hit_values", f"""WITH e AS ({_LIGHT}), c AS (SELECT DISTINCT a.event_id, a."user", b.host FROM e a JOIN e b ON a."user" IS NOT DISTINCT FROM b."user" AND b.ts_us BETWEEN a.ts_us - 86400000000 AND a.ts_us WHERE b.host IS NOT NULL)
SELECT event_id, "user", host FROM (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM c) WHERE n >= 3""")
def corr_hit_values(spark, sf):
    """The distinct hosts of every hit of a rule: three hosts of one user in a day."""
    events = _events(spark, sf)
    hits = windows.correlate(events, _distinct_rule(["user"], "host", 3, 86_400)).where("correlated")
    return windows.hit_values(hits, windows.value_spans(events, ["user"], "host", "ts_us", 86_400), ["user"], "host", "ts_us", 86_400)


@query("corr_shipped_rule", f"""WITH {_ENR} SELECT event_id, window_value FROM (
SELECT event_id, count(DISTINCT host) OVER (PARTITION BY "user" ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW) AS window_value FROM enr) WHERE window_value >= 2""")
def corr_shipped_rule(spark, sf):
    rule = next(r for r in rules.shipped_rules() if r.get("correlation"))
    events = cut_lineage(stages.enriched(spark, sf).select("event_id", "user", "host", micros(F.col("ts")).alias("ts_us")))
    return windows.correlate(events, rule).where("window_value >= 2").select("event_id", "window_value")


@query("corr_evidence", f"""WITH e AS ({_LIGHT}), c AS (SELECT *, count(*) {_over('tenant_id, event_type', 3600)} >= 5 AS hit FROM e),
n AS (SELECT *, min(CASE WHEN hit THEN ts_us END) OVER (PARTITION BY tenant_id, event_type ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 3600 SECONDS FOLLOWING) AS next_hit FROM c)
SELECT event_id, tenant_id, event_type, next_hit FROM n WHERE next_hit IS NOT NULL""")
def corr_evidence(spark, sf):
    keys = ["tenant_id", "event_type"]
    out = windows.correlate(_events(spark, sf), _threshold_rule(keys, 5, 3600))
    return windows.evidence_members(out, keys, "ts_us", 3600).select("event_id", *keys, "next_hit")


@query("corr_temporal_features", f"""WITH {_ENR}, f AS (SELECT *, coalesce(host, "user", 'unknown') AS entity FROM enr),
t AS (SELECT entity, ts, unnest(techs) AS tech FROM f),
d AS (SELECT f.event_id, count(DISTINCT tech) AS nt FROM f LEFT JOIN t ON t.entity = f.entity AND t.ts BETWEEN f.ts - INTERVAL 300 SECONDS AND f.ts GROUP BY 1)
SELECT f.event_id, entity, count(*) OVER w AS event_count_window, count(DISTINCT event_type) OVER w AS distinct_event_types_window, nt AS distinct_techniques_window,
 round((ts_us - min(ts_us) OVER (PARTITION BY entity)) / 1000000, 3) AS seconds_since_first_seen
FROM f JOIN d USING (event_id) WINDOW w AS (PARTITION BY entity ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW)""")
def corr_temporal_features(spark, sf):
    ev = cut_lineage(stages.enriched(spark, sf).select("event_id", micros(F.col("ts")).alias("ts_us"), "host", "user", "event_type", "technique_ids"))
    return windows.temporal_features(ev).select(
        "event_id", "entity", "event_count_window", "distinct_event_types_window", "distinct_techniques_window",
        F.round("seconds_since_first_seen", 3).alias("seconds_since_first_seen"))


@query("corr_inactivity_sessions", f"""WITH e AS ({_LIGHT}), g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY tenant_id, host ORDER BY ts_us, event_id) <= 2700000000 THEN 0 ELSE 1 END AS brk FROM e),
s AS (SELECT *, sum(brk) OVER (PARTITION BY tenant_id, host ORDER BY ts_us, event_id) AS sid FROM g)
SELECT tenant_id, host, min(ts_us) AS session_start, max(ts_us) AS session_end, count(*) AS events FROM s GROUP BY tenant_id, host, sid""")
def corr_inactivity_sessions(spark, sf):
    rows = windows.sessionize(_events(spark, sf), ["tenant_id", "host"], "ts_us", fixed.CLUSTER_WINDOW_SECONDS)
    return rows.groupBy("tenant_id", "host", "session_start").agg(F.max("ts_us").alias("session_end"), F.count("*").alias("events"))


@query("corr_late_events", f"""WITH {_BASE} SELECT tenant_id, count(*) FILTER (lateness <= 2700) AS in_time, count(*) FILTER (lateness > 2700) AS late FROM (
SELECT concat('t', user_id % 3) AS tenant_id, k * 60 AS lateness FROM base) GROUP BY 1""")
def corr_late_events(spark, sf):
    rows = _events(spark, sf).withColumn("arrived_us", F.col("ts_us") + F.col("k").cast("long") * 60 * windows.SECOND)
    good, late = windows.drop_late(rows, "ts_us", "arrived_us", fixed.CLUSTER_WINDOW_SECONDS)
    a = good.groupBy("tenant_id").agg(F.count("*").alias("in_time"))
    return a.join(late.groupBy("tenant_id").agg(F.count("*").alias("late")), "tenant_id")


@query("rate_limit")
def rate_limit(spark, sf):
    """Greedy limiter, 3 requests per 30 minutes and user; checked against a replay in the tests."""
    out = windows.rate_limit(_events(spark, sf), "user", "ts_us", "event_id", 3, 1800)
    return out.select(F.col("o").alias("event_id"), F.col("k").alias("user"), "allowed", "remaining", F.round("retry_after", 4).alias("retry_after"))


# --- scoring -----------------------------------------------------------------------------------
_LIGHT_SCORE = f"""base AS ({tel.sql_base()}),
f AS (SELECT *, (k % 10) / 10.0::DOUBLE AS crit, k % 4 AS nintel, k % 25 AS deg, (k % 7) / 7.0::DOUBLE AS rarity, CASE WHEN k % 6 < 5 THEN k % 6 END AS path, user_id % 6 AS ntech, user_id % 30 AS nev FROM base)"""


def _features(spark, sf):
    return tel.event_rows(spark, sf).selectExpr(
        "*", "(k % 10) / 10.0D AS crit", "k % 4 AS nintel", "k % 25 AS deg", "(k % 7) / 7.0D AS rarity",
        "CASE WHEN k % 6 < 5 THEN k % 6 END AS path", "user_id % 6 AS ntech", "user_id % 30 AS nev")


_HAY = "lower(concat_ws(' ', command_line, file_path, url, \"user\", parent_process, process, tag, CASE WHEN (k % 12) = 0 THEN parent_process END))"
_HEUR = f"""heur0 AS (SELECT *, {_HAY} AS htext, hour(ts) < 6 OR hour(ts) >= 22 AS off FROM gat),
heur1 AS (SELECT *, {stages.sql_any('htext', fixed.SUSPICIOUS_HINTS)} AS susp, [x FOR x IN [{', '.join(f"CASE WHEN contains(htext, '{h}') THEN '{h}' END" for h in fixed.BENIGN_HINTS)}] IF x IS NOT NULL] AS benign FROM heur0),
heur2 AS (SELECT *, len(benign) > 0 AND len(intel) = 0 AS damped, (CASE WHEN off THEN 0.15 ELSE 0 END)::DOUBLE + (CASE WHEN susp THEN 0.35 ELSE 0 END)::DOUBLE + (CASE WHEN crit >= 0.8 THEN 0.2 ELSE 0 END)::DOUBLE
  + (CASE WHEN severity IN ('high', 'critical') THEN 0.25 ELSE 0 END)::DOUBLE + 0.05::DOUBLE * len(intel) AS total FROM heur1),
heur AS (SELECT *, round(least(CASE WHEN damped THEN greatest(0::DOUBLE, total - 0.45::DOUBLE) ELSE total END, 1::DOUBLE), 3) AS heuristic_score,
  array_to_string([x FOR x IN [CASE WHEN off THEN 'off_hours_activity' END, CASE WHEN susp THEN 'suspicious_command_pattern' END, CASE WHEN crit >= 0.8 THEN 'high_criticality_asset' END,
   CASE WHEN severity IN ('high', 'critical') THEN concat('native_severity_', severity) END, CASE WHEN len(intel) > 0 THEN 'threat_intel_corroboration' END,
   CASE WHEN damped THEN concat('benign_admin_context:', array_to_string(benign[1:3], ',')) END] IF x IS NOT NULL], ';') AS reasons FROM heur2)"""


@query("score_heuristic", f"WITH {_ENR}, {_GAT}, {_HEUR} SELECT event_id, heuristic_score, reasons FROM heur")
def score_heuristic(spark, sf):
    return scoring.heuristic(stages.gated(spark, sf)).select("event_id", "heuristic_score", joined(F.col("heuristic_reasons"), ";").alias("reasons"))


@query("score_rule", f"WITH {_ENR}, {_GAT} SELECT event_id, round(coalesce(list_max(rule_weights), 0), 3)::DOUBLE AS rule_score FROM gat")
def score_rule(spark, sf):
    return stages.gated(spark, sf).select("event_id", scoring.rule_score(F.transform("matches", lambda m: m["severity"])).alias("rule_score"))


@query("score_intel", f"""WITH {_ENR} SELECT event_id, CASE WHEN len(confs) > 0 THEN round(least(1::DOUBLE, list_max(confs) + 0.05::DOUBLE * (len(confs) - 1)), 3) ELSE 0::DOUBLE END AS intel_score FROM enr""")
def score_intel(spark, sf):
    return stages.enriched(spark, sf).select("event_id", scoring.intel_score(F.transform("intel_hits", lambda h: h["confidence"])).alias("intel_score"))


_PATHN = "CASE WHEN path IS NULL THEN 0::DOUBLE ELSE greatest(0::DOUBLE, 1::DOUBLE - path / 4::DOUBLE) END"
_DEGN = "least(deg / 20::DOUBLE, 1::DOUBLE)"
_VEC = f"[crit, {_DEGN}, rarity, {_PATHN}, least(nintel / 3::DOUBLE, 1::DOUBLE), least(ntech / 5::DOUBLE, 1::DOUBLE), least(nev / 20::DOUBLE, 1::DOUBLE)]"


@query("score_graph", f"WITH {_LIGHT_SCORE} SELECT event_id, round(0.4::DOUBLE * {_DEGN} + 0.3::DOUBLE * rarity + 0.3::DOUBLE * {_PATHN}, 4) AS graph_score FROM f")
def score_graph(spark, sf):
    return _features(spark, sf).select("event_id", scoring.graph_score(F.col("deg"), F.col("rarity"), F.col("path")).alias("graph_score"))


def _vector():
    return scoring.feature_vector(*[F.col(c) for c in ("crit", "deg", "rarity", "path", "nintel", "ntech", "nev")])


@query("score_features", f"WITH {_LIGHT_SCORE}, v AS (SELECT event_id, {_VEC} AS v FROM f) SELECT event_id, " + ", ".join(f"round(v[{i}], 4) AS f{i}" for i in range(1, 8)) + " FROM v")
def score_features(spark, sf):
    rows = _features(spark, sf).withColumn("v", _vector())
    return rows.select("event_id", *[F.round(F.element_at("v", i), 4).alias(f"f{i}") for i in range(1, 8)])


_Z = " + ".join(f"{w}::DOUBLE * v[{i + 1}]" for i, w in enumerate(fixed.SELF_WEIGHTS))
_ZN = " + ".join(f"{w}::DOUBLE * (v[{i + 1}] * 0.6::DOUBLE)" for i, w in enumerate(fixed.NEIGHBOR_WEIGHTS))


@query("score_neighborhood_self", f"WITH {_LIGHT_SCORE}, v AS (SELECT event_id, {_VEC} AS v FROM f) SELECT event_id, round(1 / (1 + exp(-(({_Z}) + ({_ZN}) + -1.2::DOUBLE))), 4) AS ml_score FROM v")
def score_neighborhood_self(spark, sf):
    return _features(spark, sf).withColumn("v", _vector()).select("event_id", scoring.neighborhood_score(F.col("v")).alias("ml_score"))


def _every_seventh(first: int):
    chosen = F.filter("embedding", lambda x, i: i % 7 == first)
    return F.aggregate(chosen, F.lit(0.0), lambda total, x: total + x.cast("double"))


@query("score_neighborhood_mean", """WITH v AS (SELECT vec_id, [list_sum([CAST(x AS DOUBLE) FOR x, i IN embedding IF i % 7 = f % 7]) FOR f IN [1, 2, 3, 4, 5, 6, 7]] AS embedding FROM embeddings), e AS (SELECT vec_id AS src, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS dst FROM embeddings),
adj AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)),
n AS (SELECT src AS vec_id, """ + ", ".join(f"avg(embedding[{i}]::DOUBLE) AS n{i}" for i in range(1, 8)) + """ FROM adj JOIN v ON adj.dst = v.vec_id GROUP BY 1)
SELECT v.vec_id, round(1 / (1 + exp(-(""" + " + ".join(f"{w}::DOUBLE * embedding[{i + 1}]::DOUBLE" for i, w in enumerate(fixed.SELF_WEIGHTS)) + " + " + " + ".join(
    f"{w}::DOUBLE * coalesce(n{i + 1}, embedding[{i + 1}]::DOUBLE * 0.6)" for i, w in enumerate(fixed.NEIGHBOR_WEIGHTS)) + " - 1.2))), 4) AS score FROM v LEFT JOIN n USING (vec_id)")
def score_neighborhood_mean(spark, sf):
    vec = tel.read(spark, sf, "embeddings").select("vec_id", F.array(*[
        # every component counts: feature f is the sum of the components f, f + 7, f + 14, ...
        _every_seventh(f) for f in range(7)]).alias("v"))
    n = vec.count()
    edges = vec.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % n).alias("dst"))
    means = scoring.neighbor_means(edges, vec.withColumnRenamed("vec_id", "id"), 7)
    out = vec.join(means, vec["vec_id"] == means["id"], "left")
    return out.select("vec_id", scoring.neighborhood_score(F.col("v"), F.col("n")).alias("score"))


_ENS = """raw AS (SELECT event_id, 0.35::DOUBLE * crit + 0.15::DOUBLE * (k % 3 / 3::DOUBLE) + 0.2::DOUBLE * rarity + 0.15::DOUBLE * (nintel / 4::DOUBLE) + 0.15::DOUBLE * (nev / 30::DOUBLE) AS total, nintel / 4::DOUBLE AS intel, user_id % 2 = 0 AS benign FROM f),
ens AS (SELECT event_id, floor(least(CASE WHEN benign AND intel < 0.1 THEN least(total * 0.45::DOUBLE, 0.35::DOUBLE) ELSE total END, 1::DOUBLE) * 10000 + 0.5::DOUBLE) / 10000::DOUBLE AS ensemble_score FROM raw),
cal AS (SELECT *, round(1 / (1 + exp(-6::DOUBLE * (ensemble_score - 0.5::DOUBLE))), 4) AS calibrated_score FROM ens)"""


def _ensemble(spark, sf):
    c = F.col
    rows = _features(spark, sf).withColumn("ensemble_score", scoring.ensemble_score(
        c("crit"), c("k") % 3 / F.lit(3.0), c("rarity"), c("nintel") / F.lit(4.0), c("nev") / F.lit(30.0), c("user_id") % 2 == 0))
    return rows.withColumn("calibrated_score", scoring.calibrate(c("ensemble_score")))


@query("score_ensemble", f"WITH {_LIGHT_SCORE}, {_ENS} SELECT event_id, ensemble_score FROM cal")
def score_ensemble(spark, sf):
    return _ensemble(spark, sf).select("event_id", "ensemble_score")


@query("score_calibration", f"WITH {_LIGHT_SCORE}, {_ENS} SELECT event_id, calibrated_score, {stages.SQL_SEVERITY.format('calibrated_score')} AS severity FROM cal")
def score_calibration(spark, sf):
    return _ensemble(spark, sf).select("event_id", "calibrated_score", scoring.severity_of(F.col("calibrated_score")).alias("severity"))


# --- the whole flow ----------------------------------------------------------------------------


def sql_edges() -> str:
    """Oracle CTE ``erow``: one row per derived relation of an event, on top of ``ent``."""
    logon = "event_type IN ('logon', 'logon_failure', 'special_privileges_assigned')"
    net = "event_type IN ('network_connection', 'network_alert', 'zeek_conn', 'firewall_connection')"
    ips = "[x FOR x IN [e_src, e_dst] IF x IS NOT NULL]"
    proc1 = "coalesce(e_proc, e_parent)"
    proc2 = "CASE WHEN e_proc IS NOT NULL THEN e_parent END"
    rel = [
        ("e_user", "'authenticated_to'", "e_host", logon), ("e_user", "'logged_in_to'", "e_host", "TRUE"),
        (proc2, "'spawned'", proc1, "TRUE"), ("e_host", "'executed'", proc1, f"{proc2} IS NULL"),
        (f"{ips}[1]", "'connected_to'", f"{ips}[2]", f"len({ips}) = 2"), ("e_host", "'connected_to'", f"{ips}[1]", f"len({ips}) = 1 AND {net}"),
        ("e_domain", "'resolved_to'", f"{ips}[len({ips})]", f"len({ips}) > 0"),
        (f"coalesce({proc1}, e_user, e_host)", f"CASE WHEN {proc1} IS NOT NULL THEN 'downloaded' ELSE 'accessed' END", "e_url", "TRUE"),
        (proc1, "'modified'", "e_reg", "TRUE"), ("e_email", "'emailed'", "e_user", "TRUE"), (proc1, "'created'", "e_hash", "TRUE"),
        (proc1, "'accessed'", "e_file", "event_type = 'process_access'"),
        (f"coalesce({proc1}, e_host)", "'created'", "e_file", "event_type = 'file_create'"),
        (f"coalesce({proc1}, e_host)", "'modified'", "e_file", "event_type IN ('file_modify', 'file_delete')"),
    ]
    cols = "event_id, n, ts_us, source, event_type, severity, tenant_id"
    parts = [f"SELECT {cols}, {s} AS src_id, {t} AS edge_type, {d} AS dst_id FROM ent WHERE ({w})" for s, t, d, w in rel]
    parts.append(f"SELECT {cols}, coalesce({proc1}, e_host, e_user) AS src_id, 'mapped_to_technique' AS edge_type, unnest(e_tech) AS dst_id FROM ent")
    return ("erow AS (SELECT *, concat(src_id, '|', edge_type, '|', dst_id) AS edge_id FROM (" + " UNION ALL ".join(parts)
            + ") WHERE src_id IS NOT NULL AND dst_id IS NOT NULL),\n"
            "edge AS (SELECT edge_id, src_id, edge_type, dst_id, tenant_id, count(*) AS cnt, min(ts_us) AS first_us, max(ts_us) AS last_us, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM erow GROUP BY 1, 2, 3, 4, 5)")


SQL_PRIMARY = "coalesce(e_proc, e_parent, e_host, e_user, ids[1])"
SQL_FEATURES = f"""deg AS (SELECT node_id, count(*) AS degree FROM (SELECT src_id AS node_id FROM edge UNION ALL SELECT dst_id FROM edge WHERE dst_id <> src_id) GROUP BY 1),
rar AS (SELECT edge_type, round(greatest(0::DOUBLE, 1 - count(*) / (sum(count(*)) OVER ())::DOUBLE * count(*) OVER ()), 3) AS r FROM edge GROUP BY 1),
adj AS (SELECT edge_id, edge_type, src_id AS node, dst_id AS other, first_us FROM edge UNION ALL SELECT edge_id, edge_type, dst_id, src_id, first_us FROM edge WHERE src_id <> dst_id),
inc AS (SELECT node AS node_id, ((2 * sum(CAST(round(r * 1000) AS BIGINT)) + count(*)) // (2 * count(*))) / 1000::DOUBLE AS rare, count(DISTINCT CASE WHEN other <> node THEN other END) + 1 AS neighbors FROM adj JOIN rar USING (edge_type) GROUP BY 1),
badv AS (SELECT event_id, tenant_id, {SQL_PRIMARY} AS src, unnest(intel) AS v FROM ents),
want AS (SELECT DISTINCT event_id, src, concat(tenant_id, CASE WHEN regexp_matches(v, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN ':IP:' WHEN regexp_matches(v, '^[a-f0-9]{{32,64}}$') THEN ':Hash:' ELSE ':Domain:' END, substr(sha256(trim(lower(v))), 1, 32)) AS dst FROM badv),
bad AS (SELECT DISTINCT dst AS node FROM want),
nb AS (SELECT DISTINCT node, other FROM adj),
pr AS (SELECT DISTINCT src, dst FROM want WHERE src IS NOT NULL),
h0 AS (SELECT src AS o, dst AS t, src AS node, 0 AS d FROM pr),
h1 AS (SELECT o, t, node, min(d) AS d FROM (SELECT * FROM h0 UNION ALL SELECT o, t, nb.other, 1 FROM h0 JOIN nb USING (node)) GROUP BY 1, 2, 3),
h2 AS (SELECT o, t, node, min(d) AS d FROM (SELECT * FROM h1 UNION ALL SELECT o, t, nb.other, 2 FROM h1 JOIN nb USING (node) WHERE d = 1) GROUP BY 1, 2, 3),
g1 AS (SELECT src, dst, node, min(d) AS d FROM (SELECT src, dst, dst AS node, 0 AS d FROM pr UNION ALL SELECT src, dst, nb.other, 1 FROM pr JOIN nb ON nb.node = dst) GROUP BY 1, 2, 3),
g2 AS (SELECT src, dst, node, min(d) AS d FROM (SELECT * FROM g1 UNION ALL SELECT src, dst, nb.other, 2 FROM g1 JOIN nb USING (node) WHERE d = 1) GROUP BY 1, 2, 3),
pl AS (SELECT src, dst, min(h2.d + g2.d) AS len FROM h2 JOIN g2 ON g2.src = h2.o AND g2.dst = h2.t AND g2.node = h2.node GROUP BY 1, 2),
d4 AS (SELECT event_id, min(len) AS d FROM want JOIN pl USING (src, dst) GROUP BY 1),
feat AS (SELECT ents.event_id, {SQL_PRIMARY} AS node_id, coalesce(degree, 0) AS degree, coalesce(rare, 0.5) AS rare, neighbors, d4.d AS path
 FROM ents LEFT JOIN deg ON deg.node_id = {SQL_PRIMARY} LEFT JOIN inc ON inc.node_id = {SQL_PRIMARY} LEFT JOIN d4 ON d4.event_id = ents.event_id)"""
_ENT = stages.sql_entities()
SQL_SCORED = f"""{_ENR}, {_ENT}, {sql_edges()}, {SQL_FEATURES}, {stages.sql_gated(correlated=True)}, {_HEUR},
tk AS (SELECT *, coalesce(host, "user", 'unknown') AS entity FROM enr),
tt AS (SELECT entity, ts, unnest(techs) AS tech FROM tk),
td AS (SELECT tk.event_id, count(DISTINCT tech) AS nt FROM tk LEFT JOIN tt ON tt.entity = tk.entity AND tt.ts BETWEEN tk.ts - INTERVAL 300 SECONDS AND tk.ts GROUP BY 1),
tc AS (SELECT event_id, count(*) OVER (PARTITION BY entity ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW) AS ne FROM tk),
s0 AS (SELECT h.*, f.node_id, f.degree, f.rare, f.path, td.nt, tc.ne, round(coalesce(list_max(rule_weights), 0), 3)::DOUBLE AS rule_score,
 CASE WHEN len(confs) > 0 THEN round(least(1::DOUBLE, list_max(confs) + 0.05::DOUBLE * (len(confs) - 1)), 3) ELSE 0::DOUBLE END AS intel_score,
 least(f.degree / 20::DOUBLE, 1::DOUBLE) AS degn, CASE WHEN f.path IS NULL THEN 0::DOUBLE ELSE greatest(0::DOUBLE, 1 - f.path / 4::DOUBLE) END AS pathn
 FROM heur h JOIN feat f USING (event_id) JOIN td USING (event_id) JOIN tc USING (event_id)),
s1 AS (SELECT *, round(0.4::DOUBLE * degn + 0.3::DOUBLE * rare + 0.3::DOUBLE * pathn, 4) AS graph_score, [crit, degn, rare, pathn, least(len(intel) / 3::DOUBLE, 1::DOUBLE), least(nt / 5::DOUBLE, 1::DOUBLE), least(ne / 20::DOUBLE, 1::DOUBLE)] AS v FROM s0),
s2 AS (SELECT *, round(1 / (1 + exp(-(({_Z}) + ({_ZN}) + -1.2::DOUBLE))), 4) AS ml_score FROM s1),
s3 AS (SELECT *, 0.35::DOUBLE * rule_score + 0.15::DOUBLE * heuristic_score + 0.2::DOUBLE * graph_score + 0.15::DOUBLE * intel_score + 0.15::DOUBLE * ml_score AS total_score FROM s2),
s4 AS (SELECT *, floor(least(CASE WHEN damped AND intel_score < 0.1 THEN least(total_score * 0.45::DOUBLE, 0.35::DOUBLE) ELSE total_score END, 1::DOUBLE) * 10000 + 0.5::DOUBLE) / 10000::DOUBLE AS ensemble_score FROM s3),
scored AS (SELECT *, round(1 / (1 + exp(-6::DOUBLE * (ensemble_score - 0.5::DOUBLE))), 4) AS calibrated_score FROM s4)"""


@query("detect_scores", f"WITH {SQL_SCORED} SELECT event_id, rule_score, heuristic_score, graph_score, intel_score, ml_score, ensemble_score, calibrated_score, {stages.SQL_SEVERITY.format('calibrated_score')} AS risk_severity FROM scored")
def detect_scores(spark, sf):
    return stages.scored(spark, sf).select("event_id", "rule_score", "heuristic_score", "graph_score", "intel_score", "ml_score", "ensemble_score", "calibrated_score", "risk_severity")


@query("detect_alerts", f"""WITH {SQL_SCORED} SELECT concat('alert-', event_id) AS alert_id, {stages.SQL_SEVERITY.format('calibrated_score')} AS severity, calibrated_score,
 CASE WHEN len(rule_ids) > 0 THEN rule_ids[1] ELSE coalesce(host, "user", 'None') END AS lead, len(rule_ids) AS detections, CAST(floor(calibrated_score * 100) AS INT) AS priority,
 array_to_string(list_sort(list_concat([source], rule_ids)), ',') AS tags FROM scored WHERE len(rule_ids) > 0 OR calibrated_score >= 0.3""")
def detect_alerts(spark, sf):
    out = scoring.alerts(stages.scored(spark, sf))
    lead = F.when(F.size("detection_ids") > 0, F.element_at(F.split(F.element_at("detection_ids", 1), "#"), 2)).otherwise(
        F.regexp_replace("title", "^Anomalous activity on ", ""))
    return out.select("alert_id", "severity", "risk.calibrated_score", lead.alias("lead"), F.size("detection_ids").cast("long").alias("detections"), "priority", joined(F.col("tags")).alias("tags"))


@query("detect_alerts_by_host", f"""WITH {SQL_SCORED} SELECT tenant_id, coalesce(host, 'none') AS host, {stages.SQL_SEVERITY.format('calibrated_score')} AS severity, count(*) AS alerts,
 max(calibrated_score) AS top_score, CAST(sum(len(rule_ids)) AS BIGINT) AS hits FROM scored WHERE len(rule_ids) > 0 OR calibrated_score >= 0.3 GROUP BY 1, 2, 3""")
def detect_alerts_by_host(spark, sf):
    rows = stages.scored(spark, sf).where((F.size("matches") > 0) | (F.col("calibrated_score") >= fixed.MIN_ALERT_SCORE))
    return rows.groupBy("tenant_id", F.coalesce("host", F.lit("none")).alias("host"), F.col("risk_severity").alias("severity")).agg(
        F.count("*").alias("alerts"), F.max("calibrated_score").alias("top_score"), F.sum(F.size("matches")).alias("hits"))


@query("detect_correlated_hits", f"""WITH {_ENR}, {_GAT}, w AS (SELECT event_id, count(DISTINCT host) OVER (PARTITION BY "user" ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW) AS seen FROM enr)
SELECT event_id, array_to_string(CASE WHEN seen >= 2 THEN list_append(rule_ids, 'DR-0021') ELSE rule_ids END, ',') AS rule_ids FROM gat JOIN w USING (event_id) WHERE len(rule_ids) > 0 OR seen >= 2""")
def detect_correlated_hits(spark, sf):
    """All shipped rules; the correlation rule asks for two hosts, so that the given data can meet it."""
    shipped = [{**r, "correlation": {**r["correlation"], "min_distinct": 2}} if r.get("correlation") else r for r in rules.shipped_rules()]
    gated = rules.gate(stages.enriched(spark, sf), shipped).select("event_id", micros(F.col("ts")).alias("ts_us"), "user", "host", "matches")
    out = detect.resolve_correlations(cut_lineage(gated), shipped).where(F.size("matches") > 0)
    return out.select("event_id", joined(F.col("matches.rule_id")).alias("rule_ids"))


@query("detect_stats", f"""WITH {_ENR}, {_GAT} SELECT count(*) AS events, CAST(sum(len(rule_ids)) AS BIGINT) AS hits, max(ts_us) AS newest_us, {len(rules.SHIPPED)} AS rules_loaded,
 (SELECT count(DISTINCT event_type) FROM events) AS open_clusters FROM gat""")
def detect_stats(spark, sf):
    clusters = tel.event_rows(spark, sf).select(F.col("event_type").alias("cluster_id"))
    out = scoring.detection_stats(stages.gated(spark, sf), rules.shipped_rules(), clusters)
    return out.select("events", "hits", micros(F.col("newest")).alias("newest_us"), "rules_loaded", "open_clusters")
