"""Sliding-window detection that stays exact and parallel under hot keys.

Time is cut into buckets as wide as the window.  A row is then visible only in its own bucket and in
the next one, so work is partitioned by (key, bucket) instead of by key, and a key that holds a third
of all rows spreads over as many tasks as it has buckets.  Inside a bucket a sorted running sum over
+1 / -1 marks replaces the sliding frame: cost grows with rows, never with rows times window size.

All times are epoch microseconds.  Both window ends are inclusive and rows with equal times see
each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide import fixed
from watchtide.session import stored

SECOND = 1_000_000


def _running(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running sum of ``delta`` at read rows, per (keys, bucket), ordered by time then mark order."""
    w = (Window.partitionBy(*keys, "_b").orderBy("_t", "_o").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(value, F.sum("_d").over(w))


def sliding_count(events: DataFrame, keys: list[str], t: str, seconds: int, name: str = "n") -> DataFrame:
    """Per event: how many events of the same keys lie in [t - seconds, t].

    Each row leaves two marks: its own (+1) and its departure (-1) just after t + seconds, which falls
    into the next bucket.  Every row a bucket inherits has exactly one departure mark there, so the
    bucket's opening count is the number of its departure marks.  One scan and one shuffle; departure
    marks carry no other columns.
    """
    width = seconds * SECOND
    bucket = F.floor(F.col(t) / width).cast("long")

    def mark(read: bool, b: Column, at: Column, order: int, delta: int) -> Column:
        return F.struct(F.lit(read).alias("read"), b.alias("b"), at.alias("t"), F.lit(order).alias("o"), F.lit(delta).cast("long").alias("d"))

    marks = F.array(mark(True, bucket, F.col(t), 1, 1), mark(False, bucket + 1, F.col(t) + width, 2, -1))
    rows = events.withColumn("_m", F.explode(marks)).select(
        *[F.col(c) if c in keys else F.when(F.col("_m.read"), F.col(c)).alias(c) for c in events.columns],
        F.col("_m.read").alias("_read"), F.col("_m.b").alias("_b"), F.col("_m.t").alias("_t"),
        F.col("_m.o").alias("_o"), F.col("_m.d").alias("_d"))
    opening = F.sum(F.when(F.col("_read"), 0).otherwise(1)).over(Window.partitionBy(*keys, "_b"))
    out = _running(rows.withColumn("_open", opening), keys, name)
    return out.withColumn(name, F.col(name) + F.col("_open")).where("_read").drop("_b", "_t", "_o", "_d", "_read", "_open")


def sliding_distinct(events: DataFrame, keys: list[str], field: str, t: str, seconds: int,
                     name: str = "n_distinct", values: DataFrame | None = None) -> DataFrame:
    """Per event: how many distinct non-null ``field`` values the window [t - seconds, t] holds.

    A value seen at least once in a bucket is present from its first sighting to the bucket's end and,
    in the next bucket, until its last sighting plus the window.  So one (first, last) pair per
    (keys, value, bucket) - a plain aggregate with map-side combine - carries all that is needed.
    ``values`` may hold the (keys, t, field) sightings when they differ from ``events`` rows.
    """
    width = seconds * SECOND
    seen = (values if values is not None else events).where(F.col(field).isNotNull())
    bucket, none = F.floor(F.col(t) / width).cast("long"), F.lit(None).cast("long")
    sides = F.array(F.struct(bucket.alias("_b"), F.col(t).alias("_first"), none.alias("_old")),
                    F.struct((bucket + 1).alias("_b"), none.alias("_first"), F.col(t).alias("_old")))
    both = seen.select(*keys, field, F.inline(sides)).groupBy(*keys, field, "_b").agg(
        F.min("_first").alias("_first"), F.max("_old").alias("_old"))
    start, gone = F.col("_b") * width, F.col("_old") + width
    bridged = F.col("_first") <= gone
    def mark(when: Column, time: Column, order: int, delta: int) -> Column:
        return F.when(when, F.struct(time.alias("t"), F.lit(order).alias("o"), F.lit(delta).cast("long").alias("d")))
    marks = F.array_compact(F.array(
        mark(F.col("_old").isNotNull(), start, 0, 1),
        mark(F.col("_old").isNotNull() & F.coalesce(~bridged, F.lit(True)), gone, 2, -1),
        mark(F.col("_first").isNotNull() & F.coalesce(~bridged, F.lit(True)), F.col("_first"), 0, 1)))
    deltas = both.select(*keys, "_b", F.inline(marks).alias("_t", "_o", "_d"))
    reads = events.withColumn("_b", F.floor(F.col(t) / width).cast("long")).withColumn("_t", F.col(t)) \
        .withColumn("_o", F.lit(1)).withColumn("_d", F.lit(0).cast("long")).withColumn("_read", F.lit(True))
    rows = reads.unionByName(deltas, allowMissingColumns=True)
    return _running(rows, keys, name).where("_read").drop("_b", "_t", "_o", "_d", "_read")


def correlate(events: DataFrame, rule: dict, t: str = "ts_us") -> DataFrame:
    """Evaluate a rule's correlation block over events that passed its gate.

    Adds ``window_value`` (count or distinct count), ``correlated`` and the inclusive window bounds
    ``window_start`` / ``window_end``.  The bounds and the group key identify every contributing event,
    so evidence is carried as a range and listed by :func:`evidence_members`.
    """
    corr = rule["correlation"]
    keys = list(corr.get("group_by", []))
    seconds = int(corr.get("window_seconds", 300))
    kind = corr.get("type")
    if kind == "threshold":
        out = sliding_count(events, keys, t, seconds, "window_value")
        hit = F.col("window_value") >= F.lit(int(corr.get("min_count", 1)))
    elif kind == "distinct_count":
        out = sliding_distinct(events, keys, corr["distinct_field"], t, seconds, "window_value")
        hit = F.col("window_value") >= F.lit(int(corr.get("min_distinct", 1)))
    else:
        out = events.withColumn("window_value", F.lit(0).cast("long"))
        hit = F.lit(False)
    return (out.withColumn("correlated", hit)
            .withColumn("window_start", F.col(t) - seconds * SECOND).withColumn("window_end", F.col(t)))


def sessionize(rows: DataFrame, keys: list[str], t: str, gap_seconds: int, name: str = "session_start") -> DataFrame:
    """Session start per row: a new session begins after more than ``gap_seconds`` without a row.

    Rows first shrink to one (first, last) pair per (keys, bucket of gap width).  Only those pairs -
    at most one per gap length per key - are ordered per key; rows then look their session up by bucket.
    A bucket is no wider than the gap, so no session ever ends and restarts inside one.
    """
    width = gap_seconds * SECOND
    bucket = F.floor(F.col(t) / width).cast("long")
    spans = rows.groupBy(*keys, bucket.alias("_b")).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_b")
    breaks = F.coalesce(F.col("_first") - F.lag("_last").over(w) > width, F.lit(True))
    starts = spans.withColumn("_start", F.when(breaks, F.col("_first"))) \
        .withColumn(name, F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))) \
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_sb"), name)
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = rows.withColumn("_b", bucket).join(starts, [*cond, F.col("_b") == F.col("_sb")], "left")
    return out.drop("_b", "_sb", *[f"_k{i}" for i in range(len(keys))])


def evidence_members(correlated: DataFrame, keys: list[str], t: str, seconds: int) -> DataFrame:
    """Events that contributed to a correlation hit, each once, with the first hit they count for.

    An event contributes when the next hit of its group comes no later than one window after it.  The
    output is linear in the events; the full list of one hit is the members inside its bounds.
    """
    width = seconds * SECOND
    bucket = F.floor(F.col(t) / width).cast("long")
    hits = correlated.where("correlated")
    # next hit at or after each event: running minimum inside (key, bucket), else first of next bucket
    rows = correlated.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(F.col(t).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_own", F.min(F.when(F.col("correlated"), F.col(t))).over(w))
    firsts = hits.groupBy(*keys, bucket.alias("_b")).agg(F.min(t).alias("_next")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_b") - 1).alias("_nb"), "_next")
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = rows.join(firsts, [*cond, F.col("_b") == F.col("_nb")], "left").drop("_nb", *[f"_k{i}" for i in range(len(keys))])
    rows = rows.withColumn("next_hit", F.coalesce("_own", "_next")).drop("_own", "_next", "_b")
    return rows.where(F.col("next_hit") - F.col(t) <= width)


def value_spans(events: DataFrame, keys: list[str], field: str, t: str, seconds: int) -> DataFrame:
    """(keys, field, present_from, present_until): the windows that hold a value are those that end in one of its spans.

    A span runs from a sighting until one window after the last of those that follow each other within a window.
    There are never more spans than sightings, whatever the number of windows that hold a value; null values have none.
    """
    seen = events.where(F.col(field).isNotNull()).select(*keys, field, t)
    spans = sessionize(seen, [*keys, field], t, seconds, "present_from")
    return spans.groupBy(*keys, field, "present_from").agg((F.max(t) + seconds * SECOND).alias("present_until"))


def hit_values(hits: DataFrame, spans: DataFrame, keys: list[str], field: str, t: str, seconds: int, hit: str = "event_id") -> DataFrame:
    """(hit, keys, field): the distinct values in the window of each given hit, one row a value.

    A span lies in as many buckets of the window's width as its sightings touch, so the joined rows are those of the
    result and its neighbors.  Null keys are a group like any other.
    """
    width = seconds * SECOND
    first, last = (F.floor(F.col(c) / width).cast("long") for c in ("present_from", "present_until"))
    placed = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(field).alias("_value"), "present_from", "present_until",
                          F.explode(F.sequence(first, last)).alias("_sb"))
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    asked = hits.select(hit, *keys, t, F.floor(F.col(t) / width).cast("long").alias("_b"))
    out = asked.join(placed, [*cond, F.col("_b") == F.col("_sb"), F.col(t).between(F.col("present_from"), F.col("present_until"))])
    return out.select(hit, *keys, F.col("_value").alias(field))


def temporal_features(events: DataFrame, t: str = "ts_us", seconds: int = fixed.FEATURE_WINDOW_SECONDS) -> DataFrame:
    """Activity of an event's entity (host, else user, else 'unknown') in its trailing window."""
    keyed = events.withColumn("entity", F.coalesce("host", "user", F.lit("unknown")))
    # one window at a time, so that only its own rows lie on the disks
    out = stored(sliding_count(keyed, ["entity"], t, seconds, "event_count_window"), "counted")
    out = stored(sliding_distinct(out, ["entity"], "event_type", t, seconds, "distinct_event_types_window"), "counted")
    techniques = keyed.select("entity", t, F.explode("technique_ids").alias("_tech"))
    out = sliding_distinct(out, ["entity"], "_tech", t, seconds, "distinct_techniques_window", techniques)
    first = keyed.groupBy("entity").agg(F.min(t).alias("_first_seen"))
    out = out.join(first, "entity")
    return out.withColumn("seconds_since_first_seen", (F.col(t) - F.col("_first_seen")) / SECOND).drop("_first_seen")


def drop_late(events: DataFrame, t: str, arrival: str, tolerance_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(in time, late): an event is late when it arrives more than the tolerance after its own time."""
    late = F.col(arrival) - F.col(t) > tolerance_seconds * SECOND
    return events.where(~late), events.where(late)


def next_in_time(rows: DataFrame, keys: list[str], t: str, tie: str, value: str, name: str, width: int = 86_400 * SECOND) -> DataFrame:
    """Add the ``value`` of the key's next row in (t, tie) order.

    Rows are ordered inside (keys, day); the last row of a day looks up the first row of the key's
    next active day, so a hot key is spread over its days.
    """
    base = rows.withColumn("_b", F.floor(F.col(t) / width).cast("long"))
    inside = Window.partitionBy(*keys, "_b").orderBy(t, tie)
    base = base.withColumn("_next", F.lead(F.struct(F.col(value).alias("v"))).over(inside))
    days = rows.groupBy(*keys, F.floor(F.col(t) / width).cast("long").alias("_b")).agg(
        F.min_by(F.struct(F.col(value).alias("v")), F.struct(t, tie)).alias("_first"))
    following = days.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_b"))).select(*keys, "_b", "_after")
    out = base.join(following, [*keys, "_b"], "left")
    return out.withColumn(name, F.coalesce("_next", "_after")["v"]).drop("_b", "_next", "_after")


def position_in_time(rows: DataFrame, keys: list[str], t: str, ties: list[Column], name: str = "position",
                     width: int = 30 * 86_400 * SECOND) -> DataFrame:
    """Add the zero-based position of each row among its key's rows in (t, ties) order.

    Rows are ranked inside (keys, time slice) and shifted by the key's earlier slices, which are counted
    as one row per slice; no task sorts a whole hot key.
    """
    sliced = rows.withColumn("_b", F.floor(F.col(t) / width).cast("long"))
    counts = sliced.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.col(t), *ties)
    ranked = sliced.withColumn("_r", F.row_number().over(inside)).join(shift, [*keys, "_b"])
    return ranked.withColumn(name, F.col("_s") + F.col("_r") - 1).drop("_b", "_s", "_r")


def rate_limit(hits: DataFrame, key: str, t: str, order: str, max_requests: int, seconds: int) -> DataFrame:
    """Replay a sliding-window limiter over a request log: allowed, remaining, retry_after seconds.

    A rejected request does not count against later ones, so the decision depends on earlier decisions
    of the same key.  Work is split wherever a key pauses for longer than the window; inside such a
    burst rows are streamed in order and only the accepted times of one window are held.
    """
    from collections import deque

    import pandas as pd

    window = seconds * SECOND

    def run(batches):
        current, accepted = None, deque()
        for pdf in batches:
            allowed, remaining, retry = [], [], []
            for k, burst, now in zip(pdf["k"], pdf["burst"], pdf["t"]):
                if (k, burst) != current:
                    current, accepted = (k, burst), deque()
                while accepted and accepted[0] < now - window:
                    accepted.popleft()
                ok = len(accepted) < max_requests
                if ok:
                    accepted.append(now)
                allowed.append(ok)
                remaining.append(max_requests - len(accepted) if ok else 0)
                retry.append(0.0 if ok else max(0.0, (window - (now - accepted[0])) / SECOND))
            yield pd.DataFrame({"k": pdf["k"], "o": pdf["o"], "t": pdf["t"], "allowed": allowed, "remaining": remaining, "retry_after": retry})

    rows = hits.select(F.col(key).cast("string").alias("k"), F.col(order).cast("string").alias("o"), F.col(t).alias("t"))
    rows = sessionize(rows, ["k"], "t", seconds, "burst")
    ordered = rows.repartition("k", "burst").sortWithinPartitions("k", "burst", "t", "o")
    return ordered.mapInPandas(run, "k string, o string, t long, allowed boolean, remaining int, retry_after double")
