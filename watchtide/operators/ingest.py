"""Ingest: source aliases, event identity, first-arrival de-duplication, validation and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchtide import fixed
from watchtide.functions.core import lookup, stable_hash

RAW_TOPIC = "raw.events"
DEAD_LETTER_TOPIC = "raw.dead_letter"


def resolve_source(source: Column) -> Column:
    """Canonical source name; unknown names become the fallback source."""
    name = F.coalesce(lookup(fixed.SOURCE_ALIASES, source), source)
    return F.when(name.isin(list(fixed.SOURCE_CONFIDENCE)), name).otherwise(F.lit(fixed.FALLBACK_SOURCE))


def canonical_payload(payload: Column) -> Column:
    """Payload JSON with sorted keys and no spacing, so equal payloads hash equally."""
    return F.to_json(F.try_parse_json(payload))


def with_event_id(envelopes: DataFrame) -> DataFrame:
    """Keep a supplied event id, otherwise derive one from tenant, source, time and payload."""
    basis = F.concat_ws(
        ":", "tenant_id", "source", F.coalesce(F.col("timestamp").cast("string"), F.lit("None")),
        F.coalesce(canonical_payload(F.col("payload")), F.lit("")),
    )
    derived = F.concat(F.col("source"), F.lit("-"), stable_hash(basis))
    return envelopes.withColumn("event_id", F.coalesce(F.when(F.col("event_id") != "", F.col("event_id")), derived))


def rejection_reason(payload: Column) -> Column:
    """Null when the payload is acceptable, else why it is dead-lettered."""
    v = F.try_parse_json(payload)
    empty = payload.isNull() | v.isNull() | F.regexp_like(payload, F.lit(r"^\s*(\{\s*\}|null)\s*$"))
    has_type = (F.try_variant_get(v, "$.event_type", "string").isNotNull()
                | F.try_variant_get(v, "$.EventID", "string").isNotNull()
                | F.regexp_like(payload, F.lit(r'"(event_type|EventID)"\s*:\s*null')))
    return F.when(empty, F.lit("empty_payload")).when(
        ~has_type, F.lit("missing_event_type_discriminator"))


def first_arrivals(envelopes: DataFrame, order: list[str] = ["received_at"]) -> DataFrame:
    """One row per event id: its first arrival, plus how many later arrivals were duplicates.

    This is one aggregate with a map-side combine: an id (or an exact copy) that makes up a third of
    all rows leaves each map task as a single row, and no window or join sees the hot key.
    """
    rest = [c for c in envelopes.columns if c not in order and c != "event_id"]
    out = envelopes.groupBy("event_id").agg(
        F.min(F.struct(*order, *rest)).alias("first"), (F.count("*") - 1).alias("duplicates"))
    return out.select("event_id", "first.*", "duplicates")


def route(envelopes: DataFrame, order: list[str] = ["received_at"], validate: bool = True) -> DataFrame:
    """Status, topic and reason per event id; duplicates are recognised before validation, so a
    resend of a rejected record counts as a duplicate and not as a second rejection."""
    rows = first_arrivals(with_event_id(envelopes), order)
    bad = rejection_reason(F.col("payload")) if validate else F.lit(None).cast("string")
    return (
        rows.withColumn("reason", bad)
        .withColumn("status", F.when(F.col("reason").isNotNull(), F.lit("dead_lettered")).otherwise(F.lit("accepted")))
        .withColumn("topic", F.when(F.col("status") == "accepted", F.lit(RAW_TOPIC)).otherwise(F.lit(DEAD_LETTER_TOPIC)))
    )


def ingest_results(routed: DataFrame) -> DataFrame:
    """Result rows (event id, status, topic, reason, records); equal duplicate results are one row."""
    def row(status: Column, topic: Column, reason: Column, records: Column) -> Column:
        return F.struct(status.alias("status"), topic.alias("topic"), reason.alias("reason"), records.cast("long").alias("records"))
    first = row(F.col("status"), F.col("topic"), F.col("reason"), F.lit(1))
    again = row(F.lit("duplicate"), F.lit(None).cast("string"), F.lit("already_ingested"), F.col("duplicates"))
    return routed.select("event_id", F.inline(F.array_compact(F.array(first, F.when(F.col("duplicates") > 0, again)))))


def dead_letters(routed: DataFrame) -> DataFrame:
    """Dead-letter records: where they were headed, what they held, why they failed."""
    payload = F.to_json(F.struct("event_id", "tenant_id", "source", "timestamp", "payload"))
    return routed.where("status = 'dead_lettered'").select(
        "event_id", F.lit(RAW_TOPIC).alias("original_topic"), payload.alias("payload"), F.col("reason").alias("error"))


def batch_summary(routed: DataFrame) -> DataFrame:
    return routed.agg(
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("status") == "dead_lettered").alias("dead_lettered"),
    )


def stage_counters(*stages: tuple[str, str, DataFrame]) -> DataFrame:
    """Processed events by service, stage and outcome; each stage frame has an ``outcome`` column."""
    out = None
    for service, stage, df in stages:
        part = df.groupBy("outcome").agg(F.count("*").alias("events")).select(
            F.lit(service).alias("service"), F.lit(stage).alias("stage"), "outcome", "events")
        out = part if out is None else out.unionByName(part)
    return out


def expire_keys(seen: DataFrame, now: Column, ttl_days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Split seen keys into (kept, expired) by age of ``seen_at``."""
    old = F.col("seen_at") < now - F.expr(f"INTERVAL {ttl_days} DAYS")
    return seen.where(~old), seen.where(old)
