"""Queries for operational metrics and detection evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.functions.core import joined, micros, round_plain
from watchtide.operators import evaluate, flatten, metrics, rules
from watchtide.plans import stages, telemetry as tel
from watchtide.plans.queries_cases import _AL, _CASE, _CL, _cases, _clustered
from watchtide.plans.queries_detect import _EV
from watchtide.plans.registry import query

_BASE = f"base AS ({tel.sql_base()})"
_DAY = "DATE '2024-01-15'"

# --- metrics -------------------------------------------------------------------------------------
_STATUS = "CASE user_id % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'triaging' WHEN 2 THEN 'investigating' WHEN 3 THEN 'resolved' WHEN 4 THEN 'false_positive' ELSE 'contained' END"
_ACT = "CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'executed' ELSE 'auto_applied_dry_run' END"


@query("metrics_dashboard", f"""SELECT (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = {_DAY}) AS alerts_today, (SELECT count(*) FROM events WHERE event_type = 'click') AS open_alerts,
 count(*) FILTER (s IN ('new', 'triaging')) AS open_cases, count(*) FILTER (s = 'investigating') AS investigating, count(*) FILTER (s = 'resolved' AND d = {_DAY}) AS resolved_today,
 round(count(*) FILTER (s = 'false_positive') / count(*)::DOUBLE, 3) AS false_positive_rate, count(*) FILTER (a = 'pending') AS pending_approvals, count(*) FILTER (a = 'approved' AND d = {_DAY}) AS approved_today,
 count(*) FILTER (a = 'rejected' AND d = {_DAY}) AS rejected_today, count(*) FILTER (a = 'executed' AND d = {_DAY}) AS executed_today, count(*) AS triage_requests, round(avg(value), 1) AS triage_avg_latency_ms, round(avg(g), 3) AS groundedness_avg
FROM (SELECT {_STATUS} AS s, {_ACT} AS a, CAST(ts AS DATE) AS d, value, (user_id % 8) / 8.0::DOUBLE AS g FROM events)""")
def metrics_dashboard(spark, sf):
    ev = tel.event_rows(spark, sf)
    alerts = ev.selectExpr("ts AS created_at", "CASE WHEN event_type = 'click' THEN 'open' ELSE 'closed' END AS status")
    cs = ev.selectExpr(f"{_STATUS} AS status", "ts AS updated_at")
    acts = ev.selectExpr(f"{_ACT} AS status", "ts AS created_at")
    triage = ev.selectExpr("value AS latency_ms", "(user_id % 8) / 8.0D AS groundedness_score")
    return metrics.dashboard(alerts, cs, acts, triage, F.lit("2024-01-15").cast("date"))


@query("metrics_triage_counters", "SELECT count(*) AS triage_requests, round(avg(n_chars), 1) AS triage_avg_latency_ms, round(avg((doc_id % 8) / 8.0::DOUBLE), 3) AS groundedness_avg FROM documents")
def metrics_triage_counters(spark, sf):
    return metrics.triage_counters(tel.read(spark, sf, "documents").selectExpr("n_chars AS latency_ms", "(doc_id % 8) / 8.0D AS groundedness_score"))


@query("metrics_run_summary", f"""WITH {_CASE}, x AS (SELECT count(*) AS n FROM events) SELECT (SELECT n FROM x) AS events, (SELECT count(*) FROM events WHERE value >= 80) AS hits, (SELECT count(*) FROM al) AS alerts, count(*) AS cases,
 ['informational', 'low', 'medium', 'high', 'critical'][max(list_position(['informational', 'low', 'medium', 'high', 'critical'], severity))] AS top_severity, (SELECT CAST(sum(2 + event_id % 3) AS BIGINT) FROM events) AS graph_updates FROM cs""")
def metrics_run_summary(spark, sf):
    ev = tel.event_rows(spark, sf)
    updates = ev.selectExpr("2 AS nodes_upserted", "event_id % 3 AS edges_upserted")
    return metrics.run_summary(ev, ev.where("value >= 80"), _clustered(spark, sf), _cases(spark, sf), updates)


@query("metrics_case_criticality", f"WITH {_AL}, {_CL} SELECT concat('case-', cluster_id) AS case_id, max((user_id % 11) / 10.0::DOUBLE) AS asset_criticality FROM cl GROUP BY 1")
def metrics_case_criticality(spark, sf):
    links = _clustered(spark, sf).select(F.concat(F.lit("case-"), "cluster_id").alias("case_id"), "event_id")
    crit = tel.event_rows(spark, sf).selectExpr("event_id", "(user_id % 11) / 10.0D AS asset_criticality")
    return metrics.case_criticality(links, crit)


def _rate_sql(minutes: int, seconds: int) -> str:
    return (f"SELECT epoch_us(time_bucket(INTERVAL {minutes} MINUTES, ts)) AS window_us, event_type, count(*) AS events, round(count(*) / {seconds}::DOUBLE, 6) AS rate FROM events GROUP BY 1, 2")


@query("metrics_event_rate", _rate_sql(5, 300))
def metrics_event_rate(spark, sf):
    out = metrics.event_rate(tel.event_rows(spark, sf), "event_type")
    return out.select(micros(F.col("window_start")).alias("window_us"), "event_type", "events", "rate")


@query("metrics_throughput", _rate_sql(1, 60))
def metrics_throughput(spark, sf):
    out = metrics.stage_throughput(tel.event_rows(spark, sf), "event_type")
    return out.select(micros(F.col("window_start")).alias("window_us"), "event_type", "events", "rate")


@query("metrics_counter_increase", f"""WITH c AS (SELECT event_type, ts, event_id, event_id % 1000 AS counter FROM events),
s AS (SELECT *, counter - lag(counter) OVER (PARTITION BY event_type ORDER BY ts) AS step FROM c)
SELECT event_type, epoch_us(time_bucket(INTERVAL 5 MINUTES, ts)) AS window_us, CAST(sum(CASE WHEN step IS NULL THEN 0 WHEN step < 0 THEN counter ELSE step END) AS BIGINT) AS increase FROM s GROUP BY 1, 2""")
def metrics_counter_increase(spark, sf):
    rows = tel.event_rows(spark, sf).withColumn("counter", F.col("event_id") % 1000)
    out = metrics.counter_increase(rows, "event_type", "counter")
    return out.select("event_type", micros(F.col("window_start")).alias("window_us"), "increase")


@query("metrics_latency_quantiles", """SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, count(*) AS n FROM events GROUP BY 1""")
def metrics_latency_quantiles(spark, sf):
    out = metrics.latency_quantiles(tel.event_rows(spark, sf), "value", [F.col("event_type")], exact=True)
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")], "n")


@query("metrics_load_summary", """WITH s AS (SELECT list_sort(list(value)) AS l, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM events)
SELECT n, round(mean, 4) AS mean, round(sd, 4) AS stdev, l[CAST(floor(n / 2) AS INT) + 1] AS p50, l[CAST(floor(n * 0.95) AS INT)] AS p95, l[CAST(floor(n * 0.99) AS INT)] AS p99, round(n / 3600.0, 4) AS rate, round(n / 3600.0 * 86400, 2) AS per_day FROM s""")
def metrics_load_summary(spark, sf):
    out = metrics.load_summary(tel.event_rows(spark, sf), "value", F.lit(3600.0))
    return out.select("n", F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"), "p50", "p95", "p99", F.round("rate", 4).alias("rate"), F.round("per_day", 2).alias("per_day"))


# --- rules against ground truth: each user is a scenario ------------------------------------------
_BY_ID = {r["id"]: r for r in rules.shipped_rules()}
_EVAL = f"""base AS ({tel.sql_base()}), enr AS ({tel.sql_canon()}),
hit AS (SELECT user_id, unnest({stages.sql_compact([f"CASE WHEN {p} THEN '{r}' END" for r, p in _EV.items()])}) AS rule_id FROM enr),
tec AS (SELECT rule_id, unnest(t) AS t FROM (VALUES {', '.join(f"('{r}', [{', '.join(repr(x) for x in _BY_ID[r]['technique_ids'])}])" for r in _EV)}) v(rule_id, t)),
det AS (SELECT user_id, list_sort(list(DISTINCT t)) AS detected FROM hit JOIN tec USING (rule_id) GROUP BY 1), nh AS (SELECT user_id, count(*) AS hits FROM hit GROUP BY 1),
lab AS (SELECT DISTINCT concat('u', user_id) AS scenario_id, user_id, CASE WHEN user_id % 5 = 0 THEN [] ELSE ['T1059.001', 'T1003.001', 'T1486', concat('T', user_id % 4)] END AS expected, user_id % 5 > 0 AS is_attack FROM events),
cmp AS (SELECT scenario_id, is_attack, coalesce(hits, 0) AS hits, coalesce(detected, []) AS d, expected AS e FROM lab LEFT JOIN det USING (user_id) LEFT JOIN nh USING (user_id)),
sc AS (SELECT *, len(list_intersect(d, e)) AS tp FROM cmp),
scores AS (SELECT scenario_id, is_attack, hits, CASE WHEN len(d) = 0 AND len(e) = 0 THEN 1 WHEN len(d) > 0 THEN tp / len(d)::DOUBLE ELSE 0 END::DOUBLE AS precision, CASE WHEN len(d) = 0 AND len(e) = 0 THEN 1 WHEN len(e) > 0 THEN tp / len(e)::DOUBLE ELSE 0 END::DOUBLE AS recall,
 CASE WHEN len(d) = 0 AND len(e) = 0 THEN 1 WHEN tp > 0 THEN 2.0::DOUBLE * tp / (len(d) + len(e)) ELSE 0 END::DOUBLE AS f1, CASE WHEN is_attack AND hits = 0 THEN 'missed attack' WHEN NOT is_attack AND hits > 0 THEN 'benign scenario fired rules' ELSE '' END AS note FROM sc)"""


def _evaluated(spark, sf):
    env = tel.envelopes(spark, sf).withColumnRenamed("event_id", "record_id").withColumn("raw", F.col("payload"))
    flat = flatten.flatten(env, ["record_id"])
    gated = rules.gate(flat, rules.shipped_rules(), mode="evaluator").select("record_id", "matches")
    owner = tel.event_rows(spark, sf).selectExpr("concat('evt-', event_id) AS record_id", "concat('u', user_id) AS scenario_id")
    return gated.join(owner, "record_id")


def _scenario_scores(spark, sf):
    none = "cast(array() AS array<string>)"
    labels = tel.event_rows(spark, sf).selectExpr("concat('u', user_id) AS scenario_id", "user_id").distinct().selectExpr(
        "scenario_id", f"CASE WHEN user_id % 5 = 0 THEN {none} ELSE array('T1059.001', 'T1003.001', 'T1486', concat('T', user_id % 4)) END AS expected", "user_id % 5 > 0 AS is_attack")
    return evaluate.scenario_scores(labels, evaluate.fired(_evaluated(spark, sf), "scenario_id"))


@query("eval_rule_hits", f"WITH {_EVAL} SELECT rule_id, count(*) AS hits FROM hit GROUP BY 1")
def eval_rule_hits(spark, sf):
    return evaluate.rule_hits(_evaluated(spark, sf))


@query("eval_fired_techniques", f"WITH {_EVAL} SELECT concat('u', user_id) AS scenario_id, array_to_string(detected, ',') AS detected, hits FROM det JOIN nh USING (user_id)")
def eval_fired_techniques(spark, sf):
    return evaluate.fired(_evaluated(spark, sf), "scenario_id").select("scenario_id", joined(F.col("detected")).alias("detected"), "hits")


@query("eval_set_scores", f"WITH {_EVAL} SELECT scenario_id, is_attack, hits, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, note FROM scores")
def eval_set_scores(spark, sf):
    return _scenario_scores(spark, sf).select("scenario_id", "is_attack", "hits", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "note")


@query("eval_macro_average", f"WITH {_EVAL} SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1, count(*) AS scenarios, count(*) FILTER (note = 'missed attack') AS missed FROM scores")
def eval_macro_average(spark, sf):
    return evaluate.macro_average(_scenario_scores(spark, sf))


@query("eval_benign_hits", f"WITH {_EVAL} SELECT (SELECT count(*) FROM hit WHERE user_id % 5 = 0) AS hits, count(*) AS events, round((SELECT count(*) FROM hit WHERE user_id % 5 = 0) / greatest(count(*), 1)::DOUBLE, 4) AS hits_per_event FROM base WHERE user_id % 5 = 0")
def eval_benign_hits(spark, sf):
    benign = _evaluated(spark, sf).where(F.substring("scenario_id", 2, 9).cast("int") % 5 == 0)
    return evaluate.benign_hit_rate(benign)


# --- score quality: document length as a score for the quality label -------------------------------
_SL = "sl AS (SELECT doc_id AS alert_id, round(least(n_chars / 8000.0::DOUBLE, 1.0), 3) AS score, quality AS label, toxic FROM labels JOIN documents USING (doc_id))"


def _scored_labels(spark, sf):
    rows = tel.read(spark, sf, "labels").join(tel.read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    # n / 8000 often ends on a tie in the fourth digit, so round by plain arithmetic on the double
    score = round_plain(F.least(F.col("n_chars") / F.lit(8000.0), F.lit(1.0)), 3)
    return rows.select(F.col("doc_id").alias("alert_id"), score.alias("score"), F.col("quality").alias("label"), "toxic")


@query("eval_thresholds", f"""WITH {_SL}, g AS (SELECT unnest([0.1, 0.3, 0.5, 0.9])::DOUBLE AS threshold), p AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
 count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM g JOIN sl ON TRUE GROUP BY 1)
SELECT threshold, tp, fp, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 4)::DOUBLE AS precision, round(tp / pos::DOUBLE, 4) AS recall, round(2.0::DOUBLE * tp / (tp + fp + pos), 4) AS f1, round(fp / neg::DOUBLE, 4) AS fpr FROM p""")
def eval_thresholds(spark, sf):
    return evaluate.threshold_metrics(_scored_labels(spark, sf), [0.1, 0.3, 0.5, 0.9])


_PTS = """pt AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM sl GROUP BY 1),
cu AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM pt)"""


@query("eval_auc", f"WITH {_SL}, {_PTS} SELECT round(sum(n * (tp - p + tp) / 2.0::DOUBLE) / (sum(p) * sum(n))::DOUBLE, 4) AS roc_auc, round(sum(p * tp / (tp + fp)::DOUBLE) / sum(p)::DOUBLE, 4) AS pr_auc FROM cu")
def eval_auc(spark, sf):
    return evaluate.auc(_scored_labels(spark, sf))


@query("eval_curve", f"WITH {_SL}, {_PTS} SELECT score AS s, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM cu")
def eval_curve(spark, sf):
    return evaluate.curve_points(_scored_labels(spark, sf)).select("s", "tp", "fp")


@query("eval_top_k", f"WITH {_SL}, t AS (SELECT * FROM sl ORDER BY score DESC, alert_id LIMIT 50) SELECT (SELECT count(*) FROM t WHERE label = 1) AS found, count(*) FILTER (label = 1) AS positives, round((SELECT count(*) FROM t WHERE label = 1) / greatest(count(*) FILTER (label = 1), 1)::DOUBLE, 4) AS utility FROM sl")
def eval_top_k(spark, sf):
    return evaluate.top_k_utility(_scored_labels(spark, sf), 50)


@query("eval_next_step", """WITH p AS (SELECT event_type AS step, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, ts >= TIMESTAMP '2024-01-20' AS test FROM events),
c AS (SELECT step, nxt, count(*) AS n FROM p WHERE nxt IS NOT NULL AND NOT test GROUP BY 1, 2), b AS (SELECT step, arg_max(nxt, (n, nxt)) AS pred FROM c GROUP BY 1)
SELECT count(*) AS steps, count(*) FILTER (nxt = pred) AS correct, round(count(*) FILTER (nxt = pred) / count(*)::DOUBLE, 4) AS accuracy FROM p LEFT JOIN b USING (step) WHERE test AND nxt IS NOT NULL""")
def eval_next_step(spark, sf):
    rows = tel.event_rows(spark, sf).withColumn("ts_us", micros(F.col("ts")))
    return evaluate.next_step_accuracy(rows, "user_id", "ts_us", "event_type", "event_id", F.col("ts") >= F.lit("2024-01-20").cast("timestamp"))


@query("eval_time_to_triage", "SELECT count(*) AS n, round(avg(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000.0, 3) AS mean_seconds FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def eval_time_to_triage(spark, sf):
    rows = tel.read(spark, sf, "orders").join(tel.read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        micros(F.col("o_orderdate")).alias("a"), micros(F.col("l_shipdate")).alias("b"))
    return evaluate.mean_seconds(rows, "a", "b", "mean_seconds")


@query("eval_alert_to_action", f"WITH {_AL}, fst AS (SELECT concat('a', event_id - 1) AS alert_id, epoch_us(ts) AS acted FROM events) SELECT count(*) AS n, round(avg(acted - ts_us) / 1000000.0, 3) AS mean_seconds FROM al JOIN fst USING (alert_id)")
def eval_alert_to_action(spark, sf):
    acts = tel.event_rows(spark, sf).selectExpr("concat('a', event_id - 1) AS alert_id", "unix_micros(ts) AS acted")
    return evaluate.mean_seconds(stages.alert_rows(spark, sf).join(acts, "alert_id"), "ts_us", "acted", "mean_seconds")


@query("eval_escalation_precision", """WITH v AS (SELECT o_custkey AS case_id, max(o_orderpriority = '1-URGENT') AS ok FROM orders GROUP BY 1)
SELECT count(*) AS escalated, count(*) FILTER (ok) AS confirmed, round(count(*) FILTER (ok) / count(*)::DOUBLE, 4) AS precision FROM customer LEFT JOIN v ON c_custkey = case_id WHERE c_acctbal > 5000""")
def eval_escalation_precision(spark, sf):
    cs = tel.read(spark, sf, "customer").selectExpr("c_custkey AS case_id", "c_acctbal > 5000 AS escalated")
    v = tel.read(spark, sf, "orders").selectExpr("o_custkey AS case_id", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'true_positive' ELSE 'false_positive' END AS verdict")
    return evaluate.escalation_precision(cs, v)


@query("eval_dedup_quality", f"""WITH {_AL}, {_CL}, g AS (SELECT cluster_id, user_id % 20 AS truth, count(*) AS n FROM cl GROUP BY 1, 2), b AS (SELECT sum(n * (n - 1) / 2) AS joint_pairs FROM g),
c AS (SELECT sum(n * (n - 1) / 2) AS clustered FROM (SELECT cluster_id, sum(n) AS n FROM g GROUP BY 1)), t AS (SELECT sum(n * (n - 1) / 2) AS true_pairs FROM (SELECT truth, sum(n) AS n FROM g GROUP BY 1))
SELECT CAST(joint_pairs AS BIGINT) AS joint_pairs, CAST(clustered AS BIGINT) AS clustered, CAST(true_pairs AS BIGINT) AS true_pairs, round(joint_pairs / clustered::DOUBLE, 4) AS precision, round(joint_pairs / true_pairs::DOUBLE, 4) AS recall FROM b, c, t""")
def eval_dedup_quality(spark, sf):
    rows = _clustered(spark, sf).withColumn("truth", F.col("user_id") % 20)
    return evaluate.dedup_quality(rows, "cluster_id", "truth")


@query("eval_report_quality", """SELECT count(*) AS reports, round(avg((doc_id % 9) / 9.0::DOUBLE), 4) AS groundedness, round(avg(CASE WHEN doc_id % 4 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS hallucination_rate,
 round(avg((3 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) / 4::DOUBLE), 4) AS completeness FROM documents""")
def eval_report_quality(spark, sf):
    rows = tel.read(spark, sf, "documents").selectExpr(
        "(doc_id % 9) / 9.0D AS groundedness_score", "CASE WHEN doc_id % 4 > 0 THEN array('x') ELSE cast(array() AS array<string>) END AS unsupported_claims",
        "source AS summary", "lang AS likely_objective", "'keep watching' AS containment_recommendation", "CASE WHEN doc_id % 3 = 0 THEN 'from logs' ELSE ' ' END AS confidence_explanation")
    return evaluate.report_quality(rows)


@query("metrics_latency_rollup", "SELECT event_type, count(*) AS n, TRUE AS p50_in_bound, TRUE AS p95_in_bound, TRUE AS p99_in_bound FROM events GROUP BY 1")
def metrics_latency_rollup(spark, sf):
    """Hourly sketches merged to one for each type; the share of rows below each estimate is within 2 % of what was asked."""
    rows = tel.event_rows(spark, sf).select("event_type", "ts", "value")
    hours = metrics.latency_sketches(rows, "value", [F.window("ts", "1 hour").alias("w"), F.col("event_type")])
    whole = metrics.sketch_quantiles(metrics.merge_sketches(hours, [F.col("event_type")]))
    below = rows.join(whole, "event_type").groupBy("event_type", "n").agg(*[
        F.count_if((F.col("value") < F.col(q)) & (F.col("value").isNotNull())).alias(f"{q}_under") for q in ("p50", "p95", "p99")],
        *[F.count_if(F.col("value") <= F.col(q)).alias(f"{q}_upto") for q in ("p50", "p95", "p99")])
    return below.select("event_type", "n", *[((F.col(f"p{p}_under") / F.col("n") <= p / 100 + 0.02) & (F.col(f"p{p}_upto") / F.col("n") >= p / 100 - 0.02)).alias(
        f"p{p}_in_bound") for p in (50, 95, 99)])


@query("eval_ingest_latency", """SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_us, round(quantile_cont(lat, 0.5), 4) AS p50, round(quantile_cont(lat, 0.95), 4) AS p95, round(quantile_cont(lat, 0.99), 4) AS p99, count(*) AS n
FROM (SELECT ts, CAST(json_extract_string(props, '$.k') AS INT) * 1.5::DOUBLE AS lat FROM events) GROUP BY 1""")
def eval_ingest_latency(spark, sf):
    rows = tel.event_rows(spark, sf).withColumn("lat", F.col("k") * F.lit(1.5))
    out = metrics.latency_quantiles(rows, "lat", [F.window("ts", "1 day").alias("w")], exact=True)
    return out.select(micros(F.col("w.start")).alias("window_us"), *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")], "n")


@query("eval_baseline_ladder", f"""WITH {_SL}, r AS (SELECT 'rule' AS rung, score, label FROM sl UNION ALL SELECT 'rule+flag', round(least(score + 0.25 * toxic, 1.0), 3), label FROM sl),
pt AS (SELECT rung, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r GROUP BY 1, 2),
cu AS (SELECT *, sum(p) OVER (PARTITION BY rung ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY rung ORDER BY score DESC) AS fp FROM pt),
a AS (SELECT rung, round(sum(n * (tp - p + tp) / 2.0::DOUBLE) / (sum(p) * sum(n))::DOUBLE, 4) AS roc_auc, round(sum(p * tp / (tp + fp)::DOUBLE) / sum(p)::DOUBLE, 4) AS pr_auc FROM cu GROUP BY 1),
m AS (SELECT rung, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM r GROUP BY 1)
SELECT rung, 0.5::DOUBLE AS threshold, tp, fp, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / pos::DOUBLE, 4) AS recall, round(2.0::DOUBLE * tp / (tp + fp + pos), 4) AS f1, round(fp / neg::DOUBLE, 4) AS fpr, roc_auc, pr_auc FROM m JOIN a USING (rung)""")
def eval_baseline_ladder(spark, sf):
    rows = _scored_labels(spark, sf)
    return evaluate.baseline_ladder(rows, "label", {"rule": F.col("score"), "rule+flag": F.round(F.least(F.col("score") + 0.25 * F.col("toxic"), F.lit(1.0)), 3)})


@query("eval_scenario_expectations", f"""WITH e AS (SELECT concat('u', user_id) AS scenario_id, max(least(value / 250.0::DOUBLE, 1.0::DOUBLE)) AS risk, min(user_id) AS u FROM events GROUP BY 1), x AS (SELECT *, {stages.SQL_SEVERITY.format('risk')} AS severity FROM e)
SELECT scenario_id, severity = 'high' AS severity_ok, risk >= 0.5 AS floor_ok, CASE WHEN u % 2 = 0 THEN TRUE ELSE risk <= 0.9 END AS ceiling_ok FROM x""")
def eval_scenario_expectations(spark, sf):
    res = tel.event_rows(spark, sf).groupBy("user_id").agg(F.max(F.least(F.col("value") / 250.0, F.lit(1.0))).alias("risk"))
    labels = res.selectExpr("concat('u', user_id) AS scenario_id", "'high' AS expected_severity", "0.5D AS expected_min_risk", "CASE WHEN user_id % 2 = 0 THEN NULL ELSE 0.9D END AS expected_max_risk")
    from watchtide.operators.scoring import severity_of
    got = res.select(F.concat(F.lit("u"), "user_id").alias("scenario_id"), severity_of(F.col("risk")).alias("severity"), "risk")
    return evaluate.expectation_check(labels, got)
