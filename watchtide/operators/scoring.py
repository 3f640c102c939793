"""Risk scoring: heuristic, rule, intel, graph and neighborhood scores, their ensemble, and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide import fixed
from watchtide.functions.core import chosen, contains_any, joined, literal_map, lookup, one_row, round_plain, sorted_union


def heuristic_text() -> Column:
    """Lower-cased text the hints are searched in, including two raw payload notes."""
    raw = [F.try_variant_get("body", f"$.{k}", "string") for k in ("note", "ParentImage")]
    return F.lower(F.concat_ws(
        " ", "command_line", "file_path", "url", "user", "parent_process", "process", joined(F.col("tags"), " "), *raw))


def heuristic(events: DataFrame, text: Column | None = None) -> DataFrame:
    """Add ``heuristic_score``, ``heuristic_reasons`` and ``benign_context``."""
    c = F.col
    hour = F.hour(c("ts"))
    off_hours = (hour < 6) | (hour >= 22)
    suspicious = contains_any(c("_text"), fixed.SUSPICIOUS_HINTS)
    critical = c("asset_criticality") >= 0.8
    native = c("severity").isin("high", "critical")
    intel = F.size("intel_matches")
    benign = chosen(*[(F.contains(c("_text"), F.lit(h)), F.lit(h)) for h in fixed.BENIGN_HINTS])

    def points(cond: Column, value: float) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))

    total = (points(off_hours, 0.15) + points(suspicious, 0.35) + points(critical, 0.2) + points(native, 0.25)
             + F.lit(0.05) * intel)
    damped = (F.size("_benign") > 0) & (intel == 0)
    score = F.when(damped, F.greatest(F.lit(0.0), total - 0.45)).otherwise(total)
    reasons = chosen(
        (off_hours, F.lit("off_hours_activity")),
        (suspicious, F.lit("suspicious_command_pattern")),
        (critical, F.lit("high_criticality_asset")),
        (native, F.concat(F.lit("native_severity_"), c("severity"))),
        (intel > 0, F.lit("threat_intel_corroboration")),
        (damped, F.concat(F.lit("benign_admin_context:"), joined(F.col("_benign")))),
    )
    out = events.withColumn("_text", heuristic_text() if text is None else text).withColumn("_benign", benign)
    return (out.withColumn("heuristic_score", F.round(F.least(score, F.lit(1.0)), 3))
            .withColumn("heuristic_reasons", reasons).withColumn("benign_context", damped).drop("_text", "_benign"))


def rule_score(severities: Column) -> Column:
    """Highest severity weight among matched rules, 0 without a match."""
    weights = F.transform(severities, lambda s: F.try_element_at(literal_map(fixed.SEVERITY_WEIGHT), s))
    return F.round(F.coalesce(F.array_max(weights), F.lit(0.0)), 3)


def intel_score(confidences: Column) -> Column:
    """Best confidence (0.5 when unstated) plus 0.05 per further hit, at most 1."""
    known = F.transform(confidences, lambda x: F.coalesce(x, F.lit(0.5)))
    n = F.size(known)
    return F.when(n > 0, F.round(F.least(F.lit(1.0), F.array_max(known) + 0.05 * (n - 1)), 3)).otherwise(F.lit(0.0))


def degree_norm(degree: Column) -> Column:
    return F.least(F.coalesce(degree, F.lit(0)) / F.lit(20.0), F.lit(1.0))


def path_norm(path: Column) -> Column:
    return F.when(path.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - path / F.lit(4.0)))


def graph_score(degree: Column, rarity: Column, path: Column) -> Column:
    return F.round(0.4 * degree_norm(degree) + 0.3 * F.coalesce(rarity, F.lit(0.5)) + 0.3 * path_norm(path), 4)


def feature_vector(criticality: Column, degree: Column, rarity: Column, path: Column, intel_hits: Column,
                   techniques: Column, event_count: Column) -> Column:
    return F.array(
        criticality, degree_norm(degree), rarity, path_norm(path), F.least(intel_hits / 3.0, F.lit(1.0)),
        F.least(techniques / 5.0, F.lit(1.0)), F.least(event_count / 20.0, F.lit(1.0)))


def dot(weights: list[float], vector: Column) -> Column:
    """Weighted sum over a fixed-length array column, spelled out so it stays in generated code."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.lit(float(w)) * F.element_at(vector, i + 1)
    return total


def neighborhood_score(vector: Column, neighbors: Column | None = None,
                       self_weights: list[float] = fixed.SELF_WEIGHTS,
                       neighbor_weights: list[float] = fixed.NEIGHBOR_WEIGHTS,
                       bias: float = fixed.NEIGHBOR_BIAS) -> Column:
    """sigmoid(Ws.x + Wn.n + b); without neighbor features n is 0.6 x."""
    scaled = F.transform(vector, lambda x: x * 0.6)
    n = scaled if neighbors is None else F.coalesce(neighbors, scaled)
    z = dot(self_weights, vector) + dot(neighbor_weights, n) + F.lit(bias)
    return F.round(1.0 / (1.0 + F.exp(-z)), 4)


def neighbor_means(edges: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """Mean feature vector over each node's neighbors.

    ``edges`` (src, dst) and ``vectors`` (id, v).  Averages run per dimension as plain aggregates with a
    map-side combine, so a hub's neighbors are never gathered in one place.
    """
    adj = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    joined_ = adj.distinct().join(vectors.select(F.col("id").alias("dst"), "v"), "dst")
    means = [F.avg(F.element_at("v", i + 1)) for i in range(dims)]
    return joined_.groupBy(F.col("src").alias("id")).agg(F.array(*means).alias("n"))


def ensemble_score(rule: Column, heuristic_: Column, graph: Column, intel: Column, ml: Column, benign: Column,
                   weights: dict[str, float] = fixed.ENSEMBLE_WEIGHTS) -> Column:
    total = (weights["rule"] * rule + weights["heuristic"] * heuristic_ + weights["graph"] * graph
             + weights["intel"] * intel + weights["ml"] * ml)
    damped = F.when(benign & (intel < 0.1), F.least(total * 0.45, F.lit(0.35))).otherwise(total)
    # a weighted sum of rounded scores often ends on a tie, so round by plain arithmetic on the double
    return round_plain(F.least(damped, F.lit(1.0)), 4)


def calibrate(score: Column) -> Column:
    return F.round(1.0 / (1.0 + F.exp(-6.0 * (score - 0.5))), 4)


def severity_of(score: Column) -> Column:
    return (F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.4, "medium")
            .when(score >= 0.2, "low").otherwise("informational"))


def detections(gated: DataFrame) -> DataFrame:
    """One row per (event, matched rule)."""
    hits = gated.withColumn("m", F.explode("matches"))
    return hits.select(
        F.concat_ws("#", "event_id", "m.rule_id").alias("detection_id"), "tenant_id", "event_id", "ts",
        "m.rule_id", "m.rule_name", "m.severity", "m.technique_ids", "m.description",
        F.coalesce(lookup(fixed.SEVERITY_WEIGHT, F.col("m.severity")), F.lit(0.5)).alias("score"),
        F.transform("entities", lambda e: e["id"]).alias("entity_ids"))


def score(events: DataFrame, weights: dict[str, float] = fixed.ENSEMBLE_WEIGHTS) -> DataFrame:
    """Add every score to gated events that carry graph and temporal feature columns; a heuristic score already there stays."""
    out = events if "heuristic_score" in events.columns else heuristic(events)
    out = out.withColumn("rule_score", rule_score(F.transform("matches", lambda m: m["severity"])))
    out = out.withColumn("intel_score", intel_score(F.transform("intel_hits", lambda h: h["confidence"])))
    out = out.withColumn("graph_score", graph_score(F.col("degree"), F.col("rare_edge_score"), F.col("path_length")))
    out = out.withColumn("features", feature_vector(
        F.col("asset_criticality"), F.col("degree"), F.col("rare_edge_score"), F.col("path_length"),
        F.size("intel_matches"), F.col("distinct_techniques_window"), F.col("event_count_window")))
    out = out.withColumn("ml_score", neighborhood_score(F.col("features")))
    out = out.withColumn("ensemble_score", ensemble_score(
        F.col("rule_score"), F.col("heuristic_score"), F.col("graph_score"), F.col("intel_score"),
        F.col("ml_score"), F.col("benign_context"), weights))
    out = out.withColumn("calibrated_score", calibrate(F.col("ensemble_score")))
    return out.withColumn("risk_severity", severity_of(F.col("calibrated_score")))


def alerts(scored: DataFrame, min_score: float = fixed.MIN_ALERT_SCORE) -> DataFrame:
    """Events worth an alert: any rule matched, or calibrated score at least ``min_score``."""
    fired = F.size("matches") > 0
    rule_techniques = F.flatten(F.transform("matches", lambda m: m["technique_ids"]))
    graph_text = F.concat(
        F.lit("graph_features=degree:"), F.coalesce(F.col("degree").cast("string"), F.lit("0")), F.lit(",path:"),
        F.coalesce(F.col("path_length").cast("string"), F.lit("none")), F.lit(",rarity:"), F.col("rare_edge_score").cast("string"))
    title = F.when(fired, F.element_at(F.col("matches.rule_name"), 1)).otherwise(
        F.concat(F.lit("Anomalous activity on "), F.coalesce("host", "user", F.lit("None"))))
    return scored.where(fired | (F.col("calibrated_score") >= min_score)).select(
        F.concat(F.lit("alert-"), F.col("event_id")).alias("alert_id"), "tenant_id", "event_id", "ts", "source",
        title.alias("title"),
        F.concat_ws("; ", F.transform("matches", lambda m: m["description"]), "heuristic_reasons", graph_text).alias("description"),
        F.col("risk_severity").alias("severity"),
        sorted_union(F.col("technique_ids"), rule_techniques).alias("technique_ids"),
        F.transform("entities", lambda e: e["id"]).alias("entity_ids"),
        F.transform("matches", lambda m: F.concat_ws("#", F.col("event_id"), m["rule_id"])).alias("detection_ids"),
        F.struct("rule_score", "heuristic_score", "graph_score", "intel_score", "ml_score", "ensemble_score",
                 "calibrated_score").alias("risk"),
        F.floor(F.col("calibrated_score") * 100).cast("int").alias("priority"),
        F.array_sort(F.array_distinct(F.concat(F.array("source"), F.transform("matches", lambda m: m["rule_id"])))).alias("tags"),
        F.lit("open").alias("status"))


def detection_stats(scored: DataFrame, rules: list[dict], open_clusters: DataFrame) -> DataFrame:
    """Lag between newest and oldest unprocessed event, rules loaded, open clusters."""
    a = scored.agg(F.count("*").alias("events"), F.sum(F.size("matches")).alias("hits"), F.max("ts").alias("newest"))
    b = open_clusters.agg(F.countDistinct("cluster_id").alias("open_clusters"))
    return one_row(a.withColumn("rules_loaded", F.lit(len(rules))), b)
