"""Evidence items of all cases at once: projection, sanitizing, ranking and the template report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide import fixed
from watchtide.functions.core import any_of, first_match, joined, stable_hash
from watchtide.functions.text import sanitize

COLUMNS = ["case_id", "kind", "pos", "summary", "source", "payload", "t", "technique_ids", "score"]


def _item(df: DataFrame, kind: str, summary: Column, source: Column, payload: Column, pos: Column, t: Column | None = None,
          techniques: Column | None = None, score: Column | None = None) -> DataFrame:
    return df.select(
        "case_id", F.lit(kind).alias("kind"), pos.cast("string").alias("pos"), summary.alias("summary"),
        source.cast("string").alias("source"), payload.alias("payload"),
        (t if t is not None else F.lit(None)).cast("long").alias("t"),
        (techniques if techniques is not None else F.array()).cast("array<string>").alias("technique_ids"),
        (score if score is not None else F.lit(None)).cast("double").alias("score"))


def _show(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _list(c: str) -> Column:
    return F.concat(F.lit("["), joined(F.transform(c, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def case_items(cases: DataFrame) -> DataFrame:
    summary = F.concat(F.lit("Case '"), _show("title"), F.lit("' status="), _show("status"), F.lit(" severity="), _show("severity"),
                       F.lit(" risk_score="), _show("risk_score"), F.lit(" techniques="), _list("technique_ids"))
    payload = F.to_json(F.struct("case_id", "technique_ids"))
    return _item(cases, "case", summary, F.lit("case_management"), payload, F.col("case_id"), techniques=F.col("technique_ids"))


def alert_items(case_alerts: DataFrame) -> DataFrame:
    """``case_alerts``: case_id plus alert columns."""
    summary = F.concat(F.lit("Alert '"), _show("title"), F.lit("' severity="), _show("severity"), F.lit(" calibrated_score="),
                       _show("calibrated_score"), F.lit(" description="), F.coalesce("description", F.lit("")))
    payload = F.to_json(F.struct("alert_id", "calibrated_score", "technique_ids"))
    return _item(case_alerts, "alert", summary, F.lit("detection"), payload, F.col("alert_id"),
                 techniques=F.col("technique_ids"), score=F.col("calibrated_score"))


def last_events(case_entities: DataFrame, observations: DataFrame, events: int, entities: int | None = None) -> DataFrame:
    """Newest ``events`` observations of every entity of each case, or of its first ``entities``."""
    w = Window.partitionBy("case_id").orderBy("entity_id")
    first = case_entities.withColumn("entity_rank", F.row_number().over(w))
    if entities is not None:
        first = first.where(F.col("entity_rank") <= entities)
    recent = Window.partitionBy("node_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = observations.withColumn("event_rank", F.row_number().over(recent)).where(F.col("event_rank") <= events)
    return first.join(last, first["entity_id"] == last["node_id"]).drop("node_id")


def event_items(events: DataFrame) -> DataFrame:
    summary = F.concat(F.lit("["), F.col("entity_id"), F.lit("] "), F.coalesce("event_type", F.lit("observation")), F.lit(" at "),
                       _show("ts"), F.lit(" source="), _show("source"), F.lit(" severity="), _show("severity"))
    payload = F.to_json(F.struct("event_id", "event_type", "source", "severity"))
    # as wide as a long can be, so that positions sort as their numbers do
    pos = F.concat_ws("/", F.lpad(F.col("entity_rank").cast("string"), 18, "0"),
                      F.lpad((F.lit(10 ** 18 - 1) - F.col("event_rank")).cast("string"), 18, "0"), "event_id")
    return _item(events, "event", summary, F.col("source"), payload, pos, t=F.unix_micros("ts"))


def node_items(digests: DataFrame) -> DataFrame:
    """``digests``: case_id, entity_id, digest, edge_count (see :func:`neighborhood_digest`)."""
    summary = F.concat(F.lit("Graph neighborhood of "), F.col("entity_id"), F.lit(": "), F.col("digest"))
    payload = F.to_json(F.struct("entity_id", "edge_count"))
    return _item(digests.where("digest <> ''"), "node", summary, F.lit("graph_builder"), payload, F.col("entity_id"))


def neighborhood_digest(edges: DataFrame, first: int) -> DataFrame:
    """Per node ``type->other end`` of its ``first`` edges, and its whole edge count.

    ``row_number <= first`` is applied inside each task before the shuffle, so hubs stay cheap.
    """
    from watchtide.operators.graph_query import adjacency
    adj = adjacency(edges)
    counts = adj.groupBy("node").agg(F.count("*").alias("edge_count"))
    w = Window.partitionBy("node").orderBy("edge_id", "other")
    top = adj.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first)
    label = F.concat(F.col("edge_type"), F.lit("->"), F.col("other"))
    text = top.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("_r", label.alias("s")))).alias("l"))
    return text.select(F.col("node").alias("entity_id"), joined(F.transform("l", lambda x: x["s"]), ", ").alias("digest")).join(
        counts.withColumnRenamed("node", "entity_id"), "entity_id")


def finish_items(*parts: DataFrame) -> DataFrame:
    """Union of item projections, sanitized, with stable evidence ids."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("s", sanitize(F.col("summary")))
    out = out.withColumn("summary", F.col("s.clean")).withColumn("flagged", F.col("s.flagged")).drop("s")
    return out.withColumn("evidence_id", F.concat(
        F.col("kind"), F.lit("-"), stable_hash(F.concat("summary", "payload"))))


def rank_items(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items per case by kind, then position; with ``limit`` the first ones, and how many the case left out."""
    kind = F.array_position(F.array(*[F.lit(k) for k in fixed.EVIDENCE_KINDS]), F.col("kind"))
    prio = F.when(kind > 0, kind - 1).otherwise(F.lit(9))
    w = Window.partitionBy("case_id").orderBy(prio, "pos", "evidence_id")
    ranked = items.withColumn("rank", F.row_number().over(w))
    if limit is None:
        return ranked
    sizes = items.groupBy("case_id").agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("left_out"))
    return ranked.where(F.col("rank") <= limit).join(sizes, "case_id")


def injection_flags(items: DataFrame) -> DataFrame:
    return items.groupBy("case_id").agg(F.count_if("flagged").alias("injection_flags"))


def likely_objective(techniques: Column, score: Column, has_alerts: Column) -> Column:
    """Most advanced attack stage among the techniques; below the benign bound it is only resembled."""
    low = score < fixed.LIKELY_BENIGN_BELOW
    pairs = []
    for prefix, objective in fixed.TECHNIQUE_OBJECTIVES:
        hit = F.exists(techniques, lambda t: F.startswith(t, F.lit(prefix)))
        pairs.append((hit, F.when(low, F.lit(f"likely_benign_activity_resembling_{objective}")).otherwise(F.lit(objective))))
    rest = F.when(low, F.lit("likely_benign_activity")).otherwise(F.lit("suspicious_activity_requires_review"))
    return F.when(~has_alerts, F.lit("insufficient_evidence")).otherwise(first_match(pairs, rest))


def template_report(ranked: DataFrame, quotes: int) -> DataFrame:
    """Grounded report per case from its ranked evidence.

    It quotes the case, the first ``quotes`` alerts and as many events; all items are counted in it.
    """
    is_ = lambda k: F.col("kind") == k
    kind_rank = Window.partitionBy("case_id", "kind").orderBy("rank")
    rows = ranked.withColumn("kr", F.row_number().over(kind_rank))
    quoted = any_of([is_("case") & (F.col("kr") <= 1), (is_("alert") | is_("event")) & (F.col("kr") <= quotes)])
    cite = F.concat(F.col("summary"), F.lit(" ["), F.col("evidence_id"), F.lit("]"))
    tech = rows.select("case_id", "rank", "evidence_id", F.posexplode("technique_ids").alias("p", "technique_id")).groupBy(
        "case_id", "technique_id").agg(F.min_by(F.struct("rank", "p", "evidence_id"), F.struct("rank", "p")).alias("m"))
    mapping = tech.groupBy("case_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("m.rank", "m.p", "technique_id", "m.evidence_id"))),
        lambda x: F.struct(x["technique_id"].alias("technique_id"), x["evidence_id"].alias("evidence_id"))).alias("attack_mapping"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    base = rows.groupBy("case_id").agg(
        joined(ordered(F.when(quoted, F.struct("rank", cite.alias("v")))), " ").alias("summary"),
        F.count("*").alias("items"), F.count_if(is_("case")).alias("n_case"), F.count_if(is_("alert")).alias("n_alert"),
        F.count_if(is_("event")).alias("n_event"), F.count_if(is_("node")).alias("n_node"),
        F.coalesce(F.max(F.when(is_("alert"), F.col("score"))), F.lit(0.0)).alias("top_score"),
        F.min(F.when(is_("event"), F.struct("rank", "evidence_id"))).alias("e1"),
        F.min(F.when(is_("node"), F.struct("rank", "evidence_id"))).alias("n1"),
        ordered(F.when(is_("alert") & (F.col("kr") <= quotes), F.struct("rank", F.col("evidence_id").alias("v")))).alias("alert_refs"))
    out = base.join(mapping, "case_id", "left")
    techniques = F.coalesce(F.transform("attack_mapping", lambda m: m["technique_id"]), F.array().cast("array<string>"))
    asks = F.array_compact(F.array(
        F.when(F.col("e1").isNotNull(), F.concat(F.lit("Pull the process and network timeline behind "), F.col("e1.evidence_id"))),
        F.when(F.col("n1").isNotNull(), F.concat(F.lit("Expand to depth 2 the neighborhood behind "), F.col("n1.evidence_id")))))
    containment = F.when(F.col("n_alert") == 0, F.lit("No alert supports containment; keep monitoring.")).otherwise(F.concat(
        F.lit("Calibrated risk "), F.format_string("%.2f", F.col("top_score")), F.lit(" over "), F.col("n_alert").cast("string"),
        F.lit(" alert(s) ["), joined(F.col("alert_refs"), ", "), F.lit("]: an analyst should review host isolation or account suspension.")))
    return out.select(
        "case_id", F.when(F.col("summary") == "", F.lit("No evidence was retrieved for this case.")).otherwise(F.col("summary")).alias("summary"),
        likely_objective(techniques, F.col("top_score"), F.col("n_alert") > 0).alias("likely_objective"),
        F.coalesce("attack_mapping", F.array().cast("array<struct<technique_id:string,evidence_id:string>>")).alias("attack_mapping"),
        F.when(F.size(asks) > 0, asks).otherwise(F.array(F.lit("Collect more host and user telemetry; evidence is thin"))).alias("investigation_queries"),
        containment.alias("containment_recommendation"),
        F.concat(F.lit("Derived from "), F.col("items").cast("string"), F.lit(" evidence item(s): "), F.col("n_case").cast("string"), F.lit(" case, "),
                 F.col("n_alert").cast("string"), F.lit(" alert, "), F.col("n_event").cast("string"), F.lit(" event, "),
                 F.col("n_node").cast("string"), F.lit(" graph")).alias("confidence_explanation"))
