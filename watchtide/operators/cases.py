"""Cases: roll-up of alert clusters, status log folding, search, timelines and the alert queue.

A case's alerts and entities can be unbounded, so they are link tables; the case row keeps counts and
the bounded technique and tag sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.operators.windows import position_in_time
from watchtide.schema import severity_name, severity_rank


def land_alerts(arrivals: DataFrame, order: str = "arrived_us") -> DataFrame:
    """Latest payload per alert id, with first arrival time."""
    rest = [c for c in arrivals.columns if c not in ("alert_id", order)]
    out = arrivals.groupBy("alert_id").agg(
        F.max(F.struct(order, *rest)).alias("m"), F.min(order).alias("created_us"), F.count("*").alias("versions"))
    return out.select("alert_id", "m.*", "created_us", "versions").withColumnRenamed(order, "updated_us")


def case_id(cluster: Column) -> Column:
    return F.concat(F.lit("case-"), cluster)


def cases_from_alerts(alerts: DataFrame, t: str = "ts_us") -> DataFrame:
    """One case per cluster: first title, highest score and severity, technique and tag unions."""
    alerts = alerts.where("cluster_id IS NOT NULL")
    base = alerts.groupBy("cluster_id").agg(
        F.min("tenant_id").alias("tenant_id"),
        F.concat(F.lit("Auto-case: "), F.min_by("title", F.struct(t, "alert_id"))).alias("title"),
        F.max("calibrated_score").alias("risk_score"),
        severity_name(F.max(severity_rank(F.coalesce("severity", F.lit("medium"))))).alias("severity"),
        F.count_distinct("alert_id").alias("alerts"), F.min(t).alias("created_us"), F.max(t).alias("updated_us"))
    def union(name: str) -> DataFrame:
        return alerts.select("cluster_id", F.explode(name).alias("x")).groupBy("cluster_id").agg(
            F.array_sort(F.collect_set("x")).alias(name))
    out = base.join(union("technique_ids"), "cluster_id", "left").join(union("tags"), "cluster_id", "left")
    return out.withColumn("case_id", case_id(F.col("cluster_id"))).withColumn("status", F.lit("new"))


def case_alert_links(alerts: DataFrame) -> DataFrame:
    return alerts.where("cluster_id IS NOT NULL").select(case_id(F.col("cluster_id")).alias("case_id"), "alert_id").distinct()


def case_entity_links(alerts: DataFrame) -> DataFrame:
    return alerts.where("cluster_id IS NOT NULL").select(
        case_id(F.col("cluster_id")).alias("case_id"), F.explode("entity_ids").alias("entity_id")).distinct()


def alert_timeline(alerts: DataFrame, t: str = "ts_us") -> DataFrame:
    """Timeline entries a case gets from its alerts: created by the first, merged for the others."""
    firsts = alerts.groupBy("cluster_id").agg(F.min(F.struct(t, "alert_id")).alias("m"))
    rows = alerts.join(firsts, "cluster_id").withColumn("is_first", F.col("alert_id") == F.col("m.alert_id"))
    return rows.select(
        case_id(F.col("cluster_id")).alias("case_id"), F.col(t).alias("t"),
        F.when(F.col("is_first"), F.lit("auto_case_created")).otherwise(F.lit("alert_merged")).alias("kind"),
        F.when(F.col("is_first"), F.concat(F.lit("Case auto-created from alert cluster "), F.col("cluster_id"))).otherwise(
            F.concat(F.lit("Alert "), F.col("alert_id"), F.lit(" merged into case"))).alias("summary"),
        F.col("alert_id").alias("ref"))


def manual_case(requests: DataFrame, t: str = "t") -> tuple[DataFrame, DataFrame]:
    """Case rows and their opening timeline entries for analyst requests (case_id, tenant_id, title, severity, t)."""
    rows = requests.withColumn("status", F.lit("new")).withColumn("risk_score", F.lit(0.0))
    entries = requests.select(
        "case_id", F.col(t).alias("t"), F.lit("case_created").alias("kind"),
        F.concat(F.lit("Case created: "), F.col("title")).alias("summary"), F.lit(None).cast("string").alias("ref"))
    return rows, entries


def event_entries(log: DataFrame, t: str = "t") -> DataFrame:
    """Timeline entries of a case event log: kind is status_change, assignment or analyst_feedback."""
    summary = (F.when(F.col("kind") == "status_change", F.coalesce("note", F.concat(F.lit("Status changed to "), F.col("value"))))
               .when(F.col("kind") == "assignment", F.concat(F.lit("Assigned to "), F.col("value")))
               .otherwise(F.concat(F.col("actor"), F.lit(" marked as "), F.col("value"))))
    return log.select("case_id", F.col(t).alias("t"), "kind", summary.alias("summary"), F.col("value").alias("ref"))


def fold_case_log(cases: DataFrame, log: DataFrame, t: str = "t") -> DataFrame:
    """Current status, assignee and update time; a false_positive verdict sets the status too."""
    order = F.struct(t, "seq")
    status = F.when(F.col("kind") == "status_change", F.col("value")).when(
        (F.col("kind") == "analyst_feedback") & (F.col("value") == "false_positive"), F.lit("false_positive"))
    folded = log.withColumn("_status", status).groupBy("case_id").agg(
        F.max_by("_status", F.when(F.col("_status").isNotNull(), order)).alias("new_status"),
        F.max_by("value", F.when(F.col("kind") == "assignment", order)).alias("assignee"),
        F.max(t).alias("last_event"), F.count_if(F.col("kind") == "analyst_feedback").alias("feedback"))
    out = cases.join(folded, "case_id", "left")
    return (out.withColumn("status", F.coalesce("new_status", "status"))
            .withColumn("updated_us", F.greatest("updated_us", "last_event")).drop("new_status", "last_event"))


def search_cases(cases: DataFrame, tenant_id: str | None = None, status: str | None = None, severity: str | None = None,
                 assignee: str | None = None, text: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    out = cases
    for name, value in (("tenant_id", tenant_id), ("status", status), ("severity", severity), ("assignee", assignee)):
        if value:
            out = out.where(F.col(name) == value)
    if text:
        story = F.col("attack_story") if "attack_story" in cases.columns else F.lit(None).cast("string")
        like = f"%{text}%"
        out = out.where(F.coalesce(F.col("title").ilike(like), F.lit(False)) | F.coalesce(story.ilike(like), F.lit(False)))
    return out.orderBy(F.col("updated_us").desc(), "case_id").offset(offset).limit(limit)


def timeline_view(entries: DataFrame) -> DataFrame:
    """Entries in time order per case, numbered and titled for display."""
    out = position_in_time(entries, ["case_id"], "t", [F.col("kind"), F.col("ref").asc_nulls_first()])
    return out.select(
        F.concat_ws("-tl-", "case_id", F.col("position").cast("string")).alias("event_id"), "case_id", "position", "t",
        F.initcap(F.regexp_replace("kind", "_", " ")).alias("title"), F.col("summary").alias("description"),
        F.col("kind").alias("category"))


def alerts_of_case(links: DataFrame, alerts: DataFrame, wanted: str | None = None) -> DataFrame:
    chosen = links if wanted is None else links.where(F.col("case_id") == wanted)
    return alerts.join(chosen, "alert_id")


def find_case(cases: DataFrame, case: str | None = None, cluster: str | None = None) -> DataFrame:
    return cases.where(F.col("case_id") == case) if case else cases.where(F.col("cluster_id") == cluster)


def alert_queue(alerts: DataFrame, links: DataFrame, severity: str | None = None, status: str | None = None,
                q: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of alerts with their case, newest first, plus the total before paging."""
    out = alerts.join(links.groupBy("alert_id").agg(F.max("case_id").alias("case_id")), "alert_id", "left")
    if severity:
        out = out.where(F.col("severity") == severity)
    if status:
        out = out.where(F.col("status") == status)
    if q:
        text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
        out = out.where(F.contains(text, F.lit(q.lower())))
    # the total travels as a scalar subquery, so paging stays a top-k and nothing is cross joined
    page = out.orderBy(F.col("updated_us").desc(), "alert_id").offset(offset).limit(limit)
    total = out.agg(F.count("*").alias("total")).scalar()
    return page.withColumn("total", total)


def queue_order(key: str = "risk") -> list[Column]:
    """Sort keys of the alert queue: risk, severity or time."""
    if key == "risk":
        return [F.coalesce("calibrated_score", "ensemble_score", F.lit(0.0)).desc(), F.col("alert_id")]
    if key == "severity":
        return [severity_rank(F.col("severity")).desc_nulls_last(), F.col("alert_id")]
    return [F.col("created_us").desc(), F.col("alert_id")]


VALID_STATUSES = ["new", "triaging", "investigating", "contained", "resolved", "false_positive"]
