"""Streaming twins: the same computations as Structured Streaming queries over the events file.

Each run drives an ``availableNow`` stream into tables below the checkpoint folder and returns the
table.  Results must equal the batch query, so they share its oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from watchtide.functions.core import joined, micros
from watchtide.operators import enrich, rules
from watchtide.plans import stages, telemetry as tel
from watchtide.plans.queries_detect import _LIGHT, _over, sql_edges
from watchtide.plans.registry import query
from watchtide.session import checkpoint_root
from watchtide.sources import sinks
from watchtide.streaming import flows


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream with the columns of :func:`telemetry.event_rows`."""
    schema = tel.read(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
                      F.get_json_object("props", "$.k").cast("int").alias("k"))


def _drive(spark, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    root = _folder(spark, name)
    flows.run_now(df, f"{root}/out", f"{root}/checkpoint", mode=mode)
    return spark.read.parquet(f"{root}/out")


@query("stream_dedup", "SELECT concat('d', event_id % 2000) AS event_id, count(*) > 0 AS seen FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    """Ids repeat five times; the stream keeps one row per id."""
    rows = _stream(spark, sf).selectExpr("concat('d', event_id % 2000) AS event_id", "concat('t', user_id % 3) AS tenant_id", "'sysmon' AS source",
                                         "cast(ts AS string) AS timestamp", "ts AS received_at", "'{\"EventID\":1}' AS payload")
    out = _drive(spark, flows.ingest_stream(rows, "60 days"), "dedup")
    return out.groupBy("event_id").agg((F.count("*") == 1).alias("seen"))


def _shuffled(spark, sf, files: int = 5) -> DataFrame:
    """The events as a stream of several files, one to a micro-batch; each holds a part of every day, in no order."""
    topic = _folder(spark, "shuffled")
    rows = tel.event_rows(spark, sf).select("event_id", "ts", "user_id", "event_type", "value", "k")
    for i in range(files):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(files)) == i).orderBy(F.xxhash64("event_id", F.lit(1))).coalesce(1).write.mode("append").parquet(topic)
    return sinks.topic_source(spark, topic, rows.schema, files_per_trigger=1)


# acceptance by time, an id again after seven days without one
_CHAIN = """a AS (SELECT concat('d', event_id % 2000) AS event_id, epoch_us(ts) // 1000 AS at_ms, count(*) AS records FROM events GROUP BY 1, 2),
acc(event_id, at_ms) AS (SELECT event_id, min(at_ms) FROM a GROUP BY 1
 UNION ALL SELECT acc.event_id, min(a.at_ms) FROM acc JOIN a ON a.event_id = acc.event_id AND a.at_ms - acc.at_ms > 604800000 GROUP BY acc.event_id, acc.at_ms)"""


@query("stream_arrival_status", f"""WITH RECURSIVE {_CHAIN} SELECT a.event_id, a.at_ms, CASE WHEN acc.at_ms IS NULL THEN 0 ELSE 1 END::BIGINT AS accepted,
 records - CASE WHEN acc.at_ms IS NULL THEN 0 ELSE 1 END AS duplicates FROM a LEFT JOIN acc ON acc.event_id = a.event_id AND acc.at_ms = a.at_ms""")
def stream_arrival_status(spark, sf):
    """Copies days apart, in files of no order: accepted again once the time to live of seven days is over."""
    rows = _shuffled(spark, sf).selectExpr("concat('d', event_id % 2000) AS event_id", "'t0' AS tenant_id", "'sysmon' AS source",
                                           "cast(ts AS string) AS timestamp", "ts AS received_at", "'{\"EventID\":1}' AS payload")
    return flows.arrival_status(_drive(spark, flows.label_arrivals(rows, 7, "32 days"), "arrivals"))


@query("stream_event_rate", "SELECT epoch_us(time_bucket(INTERVAL 5 MINUTES, ts)) AS window_us, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def stream_event_rate(spark, sf):
    out = _drive(spark, flows.rate_stream(_stream(spark, sf), "event_type"), "rate", "update")
    latest = sinks.latest_by_key(out.select("window_start", "event_type", "batch_id", "events"), ["window_start", "event_type"], "batch_id")
    return latest.select(micros(F.col("window_start")).alias("window_us"), "event_type", "events")


@query("stream_correlation", f"""WITH e AS ({_LIGHT}) SELECT event_id, window_value, window_value >= 5 AS correlated FROM (SELECT *, count(*) {_over('tenant_id, event_type', 3600)} AS window_value FROM e)""")
def stream_correlation(spark, sf):
    """Files of no order: what an earlier batch wrote is corrected by rows that come later."""
    rows = _shuffled(spark, sf).selectExpr("event_id", "unix_micros(ts) AS ts_us", "concat('t', user_id % 3) AS tenant_id", "event_type")
    rule = {"id": "c1", "correlation": {"type": "threshold", "group_by": ["tenant_id", "event_type"], "min_count": 5, "window_seconds": 3600}}
    root = _folder(spark, "correlation")
    flows.correlate_stream(rows, rule, root, f"{root}/checkpoint", late_seconds=32 * 86_400).awaitTermination()
    return flows.correlated(spark, root, ["event_id"]).select("event_id", "window_value", "correlated")


@query("stream_correlation_late", f"""WITH b AS (SELECT event_id, ts, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS batch FROM events), w AS (SELECT max(ts) - INTERVAL 10 DAYS AS mark FROM b WHERE batch = 0)
SELECT event_id FROM b, w WHERE batch = 1 AND ts < mark""")
def stream_correlation_late(spark, sf):
    """Rows of the second file that come more than ten days behind the newest of the first: in their own table."""
    topic = _folder(spark, "late")
    rows = tel.event_rows(spark, sf).selectExpr("event_id", "unix_micros(ts) AS ts_us", "event_type")
    for late in (False, True):
        rows.where((F.col("event_id") % 5 == 0) == late).coalesce(1).write.mode("append").parquet(topic)
    root = _folder(spark, "correlation")
    rule = {"id": "c2", "correlation": {"type": "threshold", "group_by": ["event_type"], "min_count": 5, "window_seconds": 3600}}
    flows.correlate_stream(sinks.topic_source(spark, topic, rows.schema, 1), rule, root, f"{root}/checkpoint", late_seconds=10 * 86_400).awaitTermination()
    return spark.read.parquet(f"{root}/late").select("event_id")


def _stream_envelopes(spark, sf) -> DataFrame:
    """Batch envelopes written once as a topic folder in no order, then read back in five micro-batches.

    A micro-batch takes a file for each core, because a file of one row group is the work of one task.
    """
    topic, cores = _folder(spark, "topic"), spark.sparkContext.defaultParallelism
    tel.envelopes(spark, sf).repartition(5 * cores, F.xxhash64("event_id")).write.parquet(topic)
    return sinks.topic_source(spark, topic, spark.read.parquet(topic).schema, files_per_trigger=cores)


@query("stream_detect", f"WITH {stages.sql_enriched()}, {stages.sql_gated()} SELECT event_id, array_to_string(rule_ids, ',') AS rule_ids, array_to_string(techs, ',') AS techniques FROM gat WHERE len(rule_ids) > 0")
def stream_detect(spark, sf):
    single = [r for r in rules.shipped_rules() if not r.get("correlation")]
    hits = flows.detect_stream(_stream_envelopes(spark, sf), enrich.latest_indicators(tel.indicators(spark, sf)),
                               tel.host_assets(spark, sf), tel.user_assets(spark, sf), single)
    out = _drive(spark, hits.select("event_id", "matches", "technique_ids"), "detect").where(F.size("matches") > 0)
    return out.select("event_id", joined(F.col("matches.rule_id")).alias("rule_ids"), joined(F.col("technique_ids")).alias("techniques"))


@query("stream_graph", f"WITH {stages.sql_enriched()}, {stages.sql_entities()}, {sql_edges()} SELECT edge_id, cnt, first_us, last_us, sources FROM edge")
def stream_graph(spark, sf):
    """Graph deltas of five micro-batches; those of every two are merged into a generation, the last is merged on read."""
    events = flows.detect_stream(_stream_envelopes(spark, sf), enrich.latest_indicators(tel.indicators(spark, sf)),
                                 tel.host_assets(spark, sf), tel.user_assets(spark, sf), [])
    root = _folder(spark, "graph")
    flows.run_now(events.drop("enrichment", "provenance", "matches"), root, f"{root}/checkpoint", sinks.graph_sink(root, epoch=2))
    _, edges = sinks.graph_tables(spark, root)
    return edges.select("edge_id", F.col("count").alias("cnt"), micros(F.col("first_seen")).alias("first_us"), micros(F.col("last_seen")).alias("last_us"),
                        joined(F.col("sources")).alias("sources"))


IN_ORDER_ROWS = 1_000_000  # rows in a file of events in order, about


def _in_order(spark, sf, drive) -> None:
    """The events as a topic whose files follow each other in the order of time and id; ``drive`` takes the stream up after each.

    A file holds about IN_ORDER_ROWS however large the table is.  Resuming after every file makes it a micro-batch of
    its own and keeps the order also in stores whose files carry no exact times.
    """
    kept, topic = _folder(spark, "slices"), _folder(spark, "in-order")
    rows = tel.event_rows(spark, sf).drop("props")
    slices = max(1, -(-rows.count() // IN_ORDER_ROWS))
    sliced = rows.repartitionByRange(slices, "ts", F.col("event_id").cast("string")).withColumn("slice", F.spark_partition_id())
    sliced.write.partitionBy("slice").parquet(kept)
    for i in range(slices):
        spark.read.schema(sliced.schema).parquet(kept).where(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(topic)
        drive(sinks.topic_source(spark, topic, rows.schema, files_per_trigger=1))


@query("stream_greedy_clusters")
def stream_greedy_clusters(spark, sf):
    """Greedy clustering with keyed state; the tests compare it with the batch operator."""
    root = _folder(spark, "greedy")

    def drive(stream: DataFrame) -> None:
        rows = stream.selectExpr(
            "concat('t', user_id % 3) AS tenant_id", "concat('a', event_id) AS alert_id", "unix_micros(ts) AS t",
            "array(concat('H', k % 40), concat('U', user_id % 60), concat('T', event_type)) AS items")
        flows.run_now(flows.cluster_stream(rows), f"{root}/out", f"{root}/checkpoint")

    _in_order(spark, sf, drive)
    return spark.read.parquet(f"{root}/out").select("tenant_id", "alert_id", "cluster_id")
