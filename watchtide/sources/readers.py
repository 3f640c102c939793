"""Readers for telemetry, scenarios, reference lists, rules and exported reports."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, functions as F

from watchtide import fixed, schema

log = logging.getLogger(__name__)

try:
    import yaml
except ImportError:  # rule files need a YAML parser; shipped rules do not
    yaml = None


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines telemetry; blank lines are skipped.  ``raw`` is the payload text."""
    df = spark.read.schema(schema.RAW_LINE).json(path)
    return df.select("source", "timestamp", F.coalesce("tenant_id", F.lit("default")).alias("tenant_id"),
                     F.coalesce("raw", "event").alias("raw"))


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Labelled scenario documents, one row each; a file holds one document or an array of them."""
    return spark.read.schema(schema.SCENARIO).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def scenario_events(docs: DataFrame) -> DataFrame:
    """Events of scenario documents in time order positions; files need not be sorted."""
    return docs.select("scenario_id", F.posexplode("events").alias("position", "e")).select(
        "scenario_id", "position", "e.source", "e.timestamp", "e.raw")


def scenario_catalog(docs: DataFrame) -> DataFrame:
    stem = F.regexp_replace("file", r"\.json$", "")
    return docs.select(F.coalesce("scenario_id", stem).alias("scenario_id"), F.coalesce("title", stem).alias("title"),
                       F.coalesce("description", F.lit("")).alias("description"), "expected_outcome",
                       F.coalesce(F.size("events"), F.lit(0)).alias("event_count"), "file")


def to_envelopes(events: DataFrame, tenant: str = "default") -> DataFrame:
    """Raw events as ingest envelopes; arrival time is the event's own time."""
    keep = [c for c in ("scenario_id", "position") if c in events.columns]
    tenant_col = F.col("tenant_id") if "tenant_id" in events.columns else F.lit(tenant)
    return events.select(
        F.lit(None).cast("string").alias("event_id"), tenant_col.alias("tenant_id"), "source", "timestamp",
        F.try_to_timestamp("timestamp").alias("received_at"), F.col("raw").alias("payload"), *keep)


def replay_summary(routed: DataFrame) -> DataFrame:
    """Published and skipped counts of a replay."""
    return routed.agg(F.count_if(F.col("status") == "accepted").alias("events_published"),
                      F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates_skipped"))


def rule_documents(spark: SparkSession, path: str) -> list[dict]:
    """Rule documents of a directory of YAML files; unreadable files are skipped with a warning.

    Rules are configuration (a few kilobytes each) and are compiled into the plan on the driver.
    """
    if yaml is None:
        raise RuntimeError("reading rule files needs PyYAML")
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.y*ml").select("value", F.col("_metadata.file_name").alias("file"))
    rules = []
    for row in sorted(files.collect(), key=lambda r: r["file"]):
        try:
            doc = yaml.safe_load(row["value"])
        except yaml.YAMLError as exc:
            log.warning("skipped rule file %s: %s", row["file"], exc)
            continue
        if isinstance(doc, dict) and doc:
            rules.append({**doc, "_file": row["file"]})
    return rules


def ioc_feed(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of a feed, with ``load_order`` so the last one per value can win."""
    feed = spark.read.schema(schema.IOC_FEED).option("multiLine", True).json(path)
    return feed.select("feed_name", F.col("_metadata.file_name").alias("_file"), F.posexplode("indicators").alias("_pos", "i")).select(
        "i.*", "feed_name", F.struct("_file", "_pos").alias("load_order"))


def find_indicator(indicators: DataFrame, value: str) -> DataFrame:
    return indicators.where(F.lower("value") == value.lower())


def exploited_vulnerabilities(spark: SparkSession, path: str) -> DataFrame:
    """Entries of catalogs, one per id: the last one of the latest catalog version (then of the last file)."""
    feed = spark.read.schema(schema.KEV_FEED).option("multiLine", True).json(path)
    rows = feed.select("catalog_version", F.col("_metadata.file_path").alias("_file"), F.posexplode("vulnerabilities").alias("_pos", "v"))
    return rows.groupBy(F.col("v.cve_id").alias("cve_id")).agg(F.max_by(F.struct("catalog_version", "v"), F.struct("catalog_version", "_file", "_pos")).alias("m")).select(
        "m.catalog_version", "m.v.*")


def asset_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hosts, users, defaults); host and user rows carry name, criticality and their other fields."""
    doc = spark.read.schema(schema.INVENTORY).option("multiLine", True).json(path)
    def rows(name: str) -> DataFrame:
        return doc.select(F.explode(name).alias("name", "a")).select("name", "a.*")
    defaults = doc.select(F.coalesce("default_host_criticality", F.lit(fixed.DEFAULT_CRITICALITY)).alias("host"),
                          F.coalesce("default_user_criticality", F.lit(fixed.DEFAULT_CRITICALITY)).alias("user"))
    return rows("hosts"), rows("users"), defaults


def technique_catalog(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Technique id, name and tactic, from a JSON map file or the shipped catalog."""
    if path is None:
        return spark.createDataFrame([(t, n, x) for t, (n, x) in fixed.TECHNIQUE_CATALOG.items()], "technique_id string, name string, tactic string")
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", "map<string, struct<name:string, tactic:string>>").alias("m"))
    return doc.select(F.explode("m").alias("technique_id", "v")).select("technique_id", "v.*")


def feedback_episodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.EPISODE).option("multiLine", True).json(path)


def triage_reports(spark: SparkSession, path: str) -> DataFrame:
    """Exported reports in the shape report scoring needs (without expected techniques)."""
    docs = spark.read.schema(schema.REPORT_FILE).option("multiLine", True).json(path)
    none = F.array().cast("array<string>")
    return docs.select(
        "report.report_id", "scenario_id", F.col("report.summary").alias("summary"),
        F.coalesce("report.evidence_cited", none).alias("evidence_cited"),
        F.coalesce("report.unsupported_claims", none).alias("unsupported_claims"),
        F.coalesce(F.transform("report.attack_mapping", lambda m: m["technique_id"]), none).alias("predicted"),
        F.coalesce(F.map_keys("evidence_pool"), none).alias("pool"), F.col("report.groundedness_score").alias("self_reported"))


def scenario_pools(docs: DataFrame) -> DataFrame:
    """Per scenario the evidence ids its events provide, and its expected techniques."""
    ids = F.transform(F.sequence(F.lit(0), F.size("events") - 1), lambda i: F.concat(
        F.col("scenario_id"), F.lit("-evt-"), F.lpad(i.cast("string"), 3, "0")))
    return docs.select("scenario_id", F.when(F.size("events") > 0, ids).otherwise(F.array().cast("array<string>")).alias("pool"),
                       F.coalesce("expected_techniques", F.array().cast("array<string>")).alias("expected"))


def consumer_lag(totals: DataFrame, offsets: DataFrame) -> DataFrame:
    """Records per topic and group not read yet: max(0, total - offset)."""
    counts = totals.groupBy("topic").agg(F.count("*").alias("total"))
    return offsets.join(counts, "topic", "left").select(
        "topic", "group", F.greatest(F.coalesce("total", F.lit(0)) - F.col("offset"), F.lit(0)).alias("lag"))
