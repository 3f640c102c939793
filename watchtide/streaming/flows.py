"""Streaming flows: the batch transforms as bodies of Structured Streaming queries."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from watchtide import fixed
from watchtide.operators import enrich as enrich_ops, ingest, normalize as norm, rules as rule_ops, windows
from watchtide.operators.cluster import WINDOW, OpenClusters
from watchtide.sources.sinks import each_batch, latest_by_key, read_batches, save_batch


def dedup(envelopes: DataFrame, ttl: str = "7 days") -> DataFrame:
    """First arrival per event id within the time to live; later copies vanish."""
    return ingest.with_event_id(envelopes).withWatermark("received_at", ttl).dropDuplicatesWithinWatermark(["event_id"])


def ingest_stream(envelopes: DataFrame, ttl: str = "7 days") -> DataFrame:
    """De-duplicated envelopes with status, topic and reason."""
    rows = dedup(envelopes, ttl)
    reason = ingest.rejection_reason(F.col("payload"))
    return rows.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNotNull(), F.lit("dead_lettered")).otherwise(F.lit("accepted"))).withColumn(
        "topic", F.when(F.col("status") == "accepted", F.lit(ingest.RAW_TOPIC)).otherwise(F.lit(ingest.DEAD_LETTER_TOPIC)))


class _Arrivals(StatefulProcessor):
    """Arrival times of one event id that can still change, and the last acceptance before them.

    An arrival is accepted if none was accepted within the time to live before it, in the order of arrival times and not
    of files.  So a row that comes out of order can change the status of later ones: these are reported again, with a
    higher revision.  Times before the watermark are final; only the last acceptance among them is kept, until it expires.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "arrivals", "base bigint, revision bigint, times array<bigint>, records array<bigint>, kept array<boolean>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        base, revision, times, records, kept = self.state.get() if self.state.exists() else (None, 0, [], [], [])
        known = {t: (n, k) for t, n, k in zip(times, records, kept)}
        changed = set()
        for row in rows:
            t = row.at_ms
            n, k = known.get(t, (0, None))
            known[t] = (n + 1, k)
            changed.add(t)
        last = base
        for t in sorted(known):
            n, old = known[t]
            new = last is None or t - last > self.ttl
            if new:
                last = t
            if new != old:
                known[t] = (n, new)
                changed.add(t)
        for t in sorted(changed):
            yield Row(event_id=key[0], at_ms=t, records=known[t][0], accepted=known[t][1], revision=revision + 1)
        self._keep(base, revision + 1, known, timerValues.getCurrentWatermarkInMs())
        self.handle.registerTimer(max(known) + self.ttl + 1)

    def _keep(self, base, revision, known, final) -> None:
        done = [t for t in known if t < final]
        base = max([t for t in done if known[t][1]], default=base)
        left = sorted(t for t in known if t >= final)
        if not left and (base is None or final - base > self.ttl):
            self.state.clear()
        else:
            self.state.update((base, revision, left, [known[t][0] for t in left], [known[t][1] for t in left]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            base, revision, times, records, kept = self.state.get()
            self._keep(base, revision, {t: (n, k) for t, n, k in zip(times, records, kept)}, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def label_arrivals(envelopes: DataFrame, ttl_days: int = 7, late: str = "1 day") -> DataFrame:
    """(event_id, at_ms, records, accepted, revision): arrivals by time, whether one of them was the first in its time to live.

    The newest revision of an (event_id, at_ms) counts, see :func:`arrival_status`.  ``late`` is how far behind the newest
    arrival a row may come; the state holds times that far back, and one time for ids whose key has not expired.
    """
    rows = ingest.with_event_id(envelopes).where("received_at IS NOT NULL").select("event_id", "received_at").withWatermark("received_at", late)
    rows = rows.withColumn("at_ms", F.unix_millis("received_at"))
    return rows.groupBy("event_id").transformWithState(
        _Arrivals(ttl_days * 86_400_000), "event_id string, at_ms bigint, records bigint, accepted boolean, revision bigint", "Append", "EventTime")


def arrival_status(labels: DataFrame) -> DataFrame:
    """(event_id, at_ms, accepted, duplicates): newest revision of every arrival time."""
    newest = labels.groupBy("event_id", "at_ms").agg(F.max(F.struct("revision", "records", "accepted")).alias("m"))
    accepted = F.col("m.accepted").cast("long")
    return newest.select("event_id", "at_ms", accepted.alias("accepted"), (F.col("m.records") - accepted).alias("duplicates"))


def detect_stream(envelopes: DataFrame, indicators: DataFrame, hosts: DataFrame, users: DataFrame, rules: list[dict]) -> DataFrame:
    """Normalize, enrich and match in one stateless pass over the stream.

    The lists are static sides: Spark reads them again for every micro-batch, so refreshed files
    count from the next batch on.
    """
    events, _ = norm.split_errors(norm.normalize(envelopes))
    return rule_ops.gate(enrich_ops.enrich(events, indicators, hosts, users), rules)


def rate_stream(events: DataFrame, label: str, late: str = "1 hour", window: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """Event rate per label and window; state is one counter per open window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), label).agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("window_start"), label, "events", F.round(F.col("events") / seconds, 6).alias("rate"))


def correlate_stream(events: DataFrame, rule: dict, folder: str, checkpoint: str, t: str = "ts_us", late_seconds: int = 86_400) -> StreamingQuery:
    """Correlate a stream with the batch operator; rows that come out of order correct what was written before.

    A micro-batch can change the windows of rows up to one window after its own, and needs rows from one window before
    them; only the days of that reach are read from the history table in ``folder``.  Rows that saw a new row in their window are
    written again, with the batch as their version; :func:`correlated` reads the newest.  Rows further than ``late_seconds``
    behind the newest one of earlier batches go to the table ``late``: they bound the reach.  A replayed batch sees the
    same history and overwrites its own output.
    """
    keys, seconds = list(rule["correlation"].get("group_by", [])), int(rule["correlation"].get("window_seconds", 300))
    width, day = seconds * windows.SECOND, 86_400 * windows.SECOND

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        save_batch(batch.withColumn("day", F.floor(F.col(t) / day)), f"{folder}/arrived", batch_id)
        arrived = spark.read.parquet(f"{folder}/arrived/batch_id={batch_id}")
        newest = read_batches(spark, f"{folder}/progress", "newest long, batch_id int").where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        in_time = F.lit(True) if newest is None else F.col(t) >= newest - late_seconds * windows.SECOND
        save_batch(arrived.where(~in_time).drop("day"), f"{folder}/late", batch_id)
        fresh = arrived.where(in_time)
        save_batch(fresh, f"{folder}/history", batch_id, ["day"])
        first, last = fresh.agg(F.min(t), F.max(t)).first()
        if first is None:
            return
        rows = read_batches(spark, f"{folder}/history", None).where((F.col("batch_id") <= batch_id) & F.col("day").between(
            (first - width) // day, (last + width) // day) & F.col(t).between(first - width, last + width)).drop("day")
        new = rows.where(F.col("batch_id") == batch_id).select(*keys, t, F.lit(1).alias("_new"))
        out = windows.sliding_distinct(windows.correlate(rows, rule, t), keys, "_new", t, seconds, "_touched", new)
        save_batch(out.where("_touched > 0").drop("_touched", "batch_id"), f"{folder}/result", batch_id)
        save_batch(spark.range(1).select(F.lit(max(last, newest or last)).alias("newest")), f"{folder}/progress", batch_id)

    return each_batch(events, run, checkpoint)


def correlated(spark: SparkSession, folder: str, key: list[str]) -> DataFrame:
    """Newest version of every correlated row."""
    return latest_by_key(spark.read.parquet(f"{folder}/result"), key, "batch_id").drop("batch_id")


def _in_columns(batches: Iterator[pd.DataFrame]) -> tuple[pa.Table, list[tuple]]:
    """(t, alert_id, place of the item set) in the order of t and alert_id, and the distinct item sets, which come as JSON."""
    sets: dict[str, int] = {}
    parts = [pa.table({"t": pa.array(pdf["t"], pa.int64()), "alert_id": pa.array(pdf["alert_id"], pa.large_string()),
                       "items": pa.array([sets.setdefault(i, len(sets)) for i in pdf["items"]], pa.int32())}) for pdf in batches]
    return pa.concat_tables(parts).sort_by([("t", "ascending"), ("alert_id", "ascending")]), [tuple(json.loads(i)) for i in sets]


def cluster_stream(alerts: DataFrame, threshold: float = fixed.OVERLAP_THRESHOLD) -> DataFrame:
    """Greedy clustering of an alert stream (tenant_id, alert_id, t, items).

    State per tenant is its open clusters only; idle ones leave it.  Alerts are ordered inside a
    micro-batch, whose size the source bounds; of a tenant's part a task holds columns and each item set once.
    """
    def assign(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = OpenClusters.from_json(state.get[0], threshold, WINDOW) if state.exists else OpenClusters(threshold, WINDOW)
        rows, sets = _in_columns(batches)
        for part in rows.to_batches(max_chunksize=20_000):
            ids = [open_.assign(a, t, sets[n]) for t, a, n in zip(*(c.to_pylist() for c in part.columns))]
            yield pd.DataFrame({"tenant_id": [key[0]] * len(ids), "alert_id": part.column("alert_id").to_pandas(), "cluster_id": ids})
        state.update((open_.to_json(),))

    return alerts.select("tenant_id", "alert_id", "t", F.to_json("items").alias("items")).groupBy("tenant_id").applyInPandasWithState(
        assign, "tenant_id string, alert_id string, cluster_id string", "doc string", "append", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_now(df: DataFrame, folder: str, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None,
            mode: str = "append") -> None:
    """Drive a stream over all data that is there now and wait for it."""
    fn = write or (lambda batch, batch_id: save_batch(batch, folder, batch_id))
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keyed state with timers needs it
    q = df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
