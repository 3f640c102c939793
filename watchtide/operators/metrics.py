"""Operational metrics and read models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide.functions.core import one_row
from watchtide.schema import severity_name, severity_rank


def dashboard(alerts: DataFrame, cases: DataFrame, actions: DataFrame, triage: DataFrame, today: Column) -> DataFrame:
    """One-row snapshot.  Tables need status and created/updated dates; triage latency and score."""
    def on(c: str) -> Column:
        return F.to_date(c) == today
    a = alerts.agg(F.count_if(on("created_at")).alias("alerts_today"), F.count_if(F.col("status") == "open").alias("open_alerts"))
    c = cases.agg(
        F.count_if(F.col("status").isin("new", "triaging")).alias("open_cases"),
        F.count_if(F.col("status") == "investigating").alias("investigating"),
        F.count_if((F.col("status") == "resolved") & on("updated_at")).alias("resolved_today"),
        F.coalesce(F.round(F.try_divide(F.count_if(F.col("status") == "false_positive"), F.count("*")), 3), F.lit(0.0)).alias("false_positive_rate"))
    x = actions.agg(
        F.count_if(F.col("status") == "pending").alias("pending_approvals"),
        *[F.count_if((F.col("status") == s) & on("created_at")).alias(f"{s}_today") for s in ("approved", "rejected", "executed")])
    return one_row(a, c, x, triage_counters(triage))


def triage_counters(triage: DataFrame) -> DataFrame:
    return triage.agg(F.count("*").alias("triage_requests"),
                      F.coalesce(F.round(F.avg("latency_ms"), 1), F.lit(0.0)).alias("triage_avg_latency_ms"),
                      F.coalesce(F.round(F.avg("groundedness_score"), 3), F.lit(0.0)).alias("groundedness_avg"))


def run_summary(events: DataFrame, hits: DataFrame, alerts: DataFrame, cases: DataFrame, graph_updates: DataFrame) -> DataFrame:
    """Counts over the stage tables of one run and the top case severity."""
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))
    top = cases.agg(severity_name(F.max(severity_rank(F.col("severity")))).alias("top_severity"))
    updates = graph_updates.agg((F.sum("nodes_upserted") + F.sum("edges_upserted")).alias("graph_updates"))
    return one_row(n(events, "events"), n(hits, "hits"), n(alerts, "alerts"), n(cases, "cases"), top, updates)


def case_criticality(case_alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Highest asset criticality among the events behind a case's alerts."""
    return case_alerts.join(events.select("event_id", "asset_criticality"), "event_id").groupBy("case_id").agg(
        F.max("asset_criticality").alias("asset_criticality"))


def event_rate(events: DataFrame, label: str, ts: str = "ts", window: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """Events per second by label in tumbling windows."""
    w = F.window(ts, window)
    return events.groupBy(w.alias("w"), label).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), label, "events", F.round(F.col("events") / seconds, 6).alias("rate"))


def counter_increase(samples: DataFrame, key: str, value: str, ts: str = "ts", window: str = "5 minutes") -> DataFrame:
    """Increase of a cumulative counter per window; a drop counts as a restart from zero.

    Per window and key only first, last and restart-corrected growth are needed; growth inside a window
    is ordered per (key, window), and windows are linked through their last sample.
    """
    base = samples.withColumn("_w", F.window(ts, window)["start"])
    inside = Window.partitionBy(key, "_w").orderBy(ts)
    step = F.col(value) - F.lag(value).over(inside)
    rows = base.withColumn("_step", F.when(step < 0, F.col(value)).otherwise(F.coalesce(step, F.lit(0))))
    per = rows.groupBy(key, "_w").agg(F.sum("_step").alias("_grow"), F.min_by(value, ts).alias("_first"), F.max_by(value, ts).alias("_last"))
    across = Window.partitionBy(key).orderBy("_w")
    jump = F.col("_first") - F.lag("_last").over(across)
    return per.select(key, F.col("_w").alias("window_start"), (F.col("_grow") + F.when(jump < 0, F.col("_first")).otherwise(
        F.coalesce(jump, F.lit(0)))).alias("increase"))


def latency_quantiles(samples: DataFrame, value: str, group: list[Column], exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """p50, p95, p99 per group.  The default sketch has bounded state; ``exact`` keeps a value histogram."""
    def q(p: float) -> Column:
        return F.percentile(value, F.lit(p)) if exact else F.percentile_approx(value, p, accuracy)
    return samples.groupBy(*group).agg(*[q(p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], F.count("*").alias("n"))


def latency_sketches(samples: DataFrame, value: str, group: list[Column], k: int = 400) -> DataFrame:
    """One KLL sketch and count per group: a few kB, whatever the number of rows, and it can be merged later."""
    return samples.groupBy(*group).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"), F.count(value).alias("n"))


def merge_sketches(sketches: DataFrame, group: list[Column], k: int = 400) -> DataFrame:
    """Coarser groups from finer ones, without the rows: hours to days, hosts to tenants."""
    return sketches.groupBy(*group).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame) -> DataFrame:
    """p50, p95, p99 of each sketch; ranks are off by about 2.3 / k at most, with 99 % certainty."""
    q = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *q)


def stage_throughput(events: DataFrame, stage: str, ts: str = "ts", window: str = "1 minute", seconds: int = 60) -> DataFrame:
    return event_rate(events, stage, ts, window, seconds)


def load_summary(latencies: DataFrame, value: str, elapsed: Column) -> DataFrame:
    """Count, rate, quantiles by list index, mean, population deviation and daily volume.

    Index quantiles are read from a histogram of distinct values, so no global sort of all rows.
    """
    hist = latencies.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    running = hist.withColumn("band", F.floor(F.log2(F.greatest(F.col("v"), F.lit(1e-9))) * 4))
    bands = running.groupBy("band").agg(F.sum("c").alias("bc"))
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = bands.withColumn("base", F.coalesce(F.sum("bc").over(before), F.lit(0))).select("band", "base")
    inside = Window.partitionBy("band").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = running.join(starts, "band").withColumn("upto", F.col("base") + F.sum("c").over(inside))
    n = latencies.agg(F.count("*").alias("n")).scalar()
    def at(index: Column, name: str) -> Column:
        return F.min(F.when(F.col("upto") > index, F.col("v"))).alias(name)
    q = cum.agg(at(F.floor(n / 2), "p50"), at(F.floor(n * 0.95) - 1, "p95"), at(F.floor(n * 0.99) - 1, "p99"))
    m = latencies.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"), elapsed.alias("elapsed"))
    out = one_row(m, q)
    return out.withColumn("rate", F.col("n") / F.col("elapsed")).withColumn("per_day", F.col("rate") * 86400)
