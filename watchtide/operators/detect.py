"""Detection end to end: gate, correlation, temporal and graph features, scores, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from watchtide.functions.core import micros
from watchtide.operators import graph_build, graph_query, rules as rule_ops, scoring, windows
from watchtide.session import stored


def resolve_correlations(gated: DataFrame, rules: list[dict], t: str = "ts_us") -> DataFrame:
    """Keep a correlation rule among ``matches`` only where its window condition holds."""
    found = None
    for rule in rules:
        if not rule.get("correlation"):
            continue
        passed = gated.where(F.array_contains(F.col("matches.rule_id"), rule["id"]))
        corr = rule["correlation"]
        needed = {"event_id", t, *corr.get("group_by", []), *([corr["distinct_field"]] if corr.get("distinct_field") else [])}
        hits = windows.correlate(passed.select(*sorted(needed)), rule, t).where("correlated").select(
            "event_id", F.lit(rule["id"]).alias("rule_id"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return gated
    held = found.groupBy("event_id").agg(F.collect_set("rule_id").alias("_held"))  # at most one entry per rule
    keep = F.filter("matches", lambda m: ~m["correlated"] | F.coalesce(F.array_contains("_held", m["rule_id"]), F.lit(False)))
    # only events that passed the gate of a correlation rule travel to its hits
    asked = F.coalesce(F.exists("matches", lambda m: m["correlated"]), F.lit(False))
    decided = gated.where(asked).join(held, "event_id", "left").withColumn("matches", keep).drop("_held")
    return gated.where(~asked).unionByName(decided)


def detect(events: DataFrame, rules: list[dict], min_score: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored events, detections, alerts) of enriched events.

    The gated events are stored once, with a number for each row: windows, graph and scores read the columns they need, and
    what they find comes back by the row's number, so whole events travel once.  Properties of edges are no feature.
    """
    slim = rule_ops.gate(events, rules).withColumn("ts_us", micros(F.col("ts"))).drop("enrichment", "provenance")
    slim = scoring.heuristic(slim.withColumn("body", F.try_parse_json("raw"))).drop("body")
    gated = stored(slim.withColumn("_row", F.monotonically_increasing_id()), "gated")
    windowed = windows.temporal_features(gated.select("_row", "ts_us", "host", "user", "event_type", "technique_ids"))
    windowed = stored(windowed.select("_row", *[c for c in windowed.columns if c not in gated.columns]), "windowed")
    edges = graph_build.upsert_edges(graph_build.edge_rows(gated).drop("edge_props"))
    placed = graph_query.snapshot_features(gated.select("_row", "event_id", "tenant_id", "entities", "intel_matches"), edges)
    placed = stored(placed.select("_row", *[c for c in placed.columns if c not in gated.columns]), "placed")
    ready = resolve_correlations(gated, rules).join(windowed, "_row").join(placed, "_row").drop("_row")
    scored = scoring.score(ready.withColumn("body", F.try_parse_json("raw")))
    alerts = scoring.alerts(scored) if min_score is None else scoring.alerts(scored, min_score)
    return scored, scoring.detections(scored), alerts
