"""The whole batch flow: raw envelopes to recommendations, one DataFrame per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from watchtide import fixed
from watchtide.functions.core import micros
from watchtide.operators import (
    cases, cluster, detect, enrich, evidence, graph_build, grounding, ingest, metrics, normalize, policy)
from watchtide.session import cut_lineage


def run(envelopes: DataFrame, indicators: DataFrame, hosts: DataFrame, users: DataFrame, rules: list[dict],
        episodes: DataFrame | None = None, validate: bool = False) -> dict[str, DataFrame]:
    """Stage tables of one run.

    ``indicators``, ``hosts`` and ``users`` hold one row per key.  ``episodes`` trains the response
    policy.  ``validate`` applies the ingest payload check, which rejects sources without a type code.
    """
    spark = envelopes.sparkSession
    routed = ingest.route(envelopes.withColumn("source", ingest.resolve_source(F.col("source"))), validate=validate)
    accepted = routed.where("status = 'accepted'")
    events, errors = normalize.split_errors(normalize.normalize(accepted))
    enriched = cut_lineage(enrich.enrich(events, indicators, hosts, users).drop("body")).withColumn("body", F.try_parse_json("raw"))
    scored, hits, alerts = detect.detect(enriched, rules)
    alerts = cut_lineage(alerts.withColumn("ts_us", micros(F.col("ts"))).withColumn("calibrated_score", F.col("risk.calibrated_score")))
    items = alerts.withColumn("items", F.array_union("entity_ids", "technique_ids"))
    clustered = cut_lineage(cluster.overlap_components(items))

    case_rows = cases.cases_from_alerts(clustered)
    links = cases.case_alert_links(clustered)
    entities = cases.case_entity_links(clustered)
    observations = graph_build.node_rows(enriched)
    edges = graph_build.upsert_edges(graph_build.edge_rows(enriched))
    digests = entities.join(evidence.neighborhood_digest(edges, first=fixed.DIGEST_EDGES), "entity_id")
    found = evidence.finish_items(
        evidence.case_items(case_rows), evidence.alert_items(cases.alerts_of_case(links, clustered.drop("cluster_id"))),
        evidence.event_items(evidence.last_events(entities, observations, events=fixed.EVENTS_PER_ENTITY)), evidence.node_items(digests))
    ranked = cut_lineage(evidence.rank_items(found))
    reports = grounding.assemble_reports(
        grounding.validate_reports(evidence.template_report(ranked, quotes=3), ranked.select("case_id", "evidence_id")), links)

    event_of = clustered.select(cases.case_id(F.col("cluster_id")).alias("case_id"), "event_id")
    asked = case_rows.select("case_id", "risk_score").join(metrics.case_criticality(event_of, scored), "case_id").join(
        reports.select("case_id", "likely_objective"), "case_id")
    fit = policy.fit(episodes if episodes is not None else spark.createDataFrame(
        [], "risk_score double, asset_criticality double, objective string, action_class string, reward double"))
    return {
        "routed": routed, "errors": errors, "events": enriched, "scored": scored, "hits": hits, "alerts": clustered,
        "nodes": graph_build.upsert_nodes(graph_build.node_rows(enriched)), "edges": edges,
        "cases": case_rows, "case_alerts": links, "case_entities": entities, "evidence": ranked, "reports": reports,
        "recommendations": policy.recommend(asked, policy.arms(spark, fit)),
        "summary": metrics.run_summary(enriched, hits, clustered, case_rows, graph_build.update_summary(enriched)),
    }
