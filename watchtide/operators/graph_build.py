"""Entity graph: nodes and edges from enriched events, with observation history.

Upserts are aggregates keyed by node id or edge key: partial results are combined on the map side,
so a hub entity leaves each task as one row.  Unbounded lists (events, provenance) stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide import fixed
from watchtide.functions.core import chosen, edge_key, fence


def _of(kind: str) -> Column:
    return F.filter("entities", lambda e: e["type"] == kind)


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))["id"]


def primary_entity() -> Column:
    """Id of the first process, else host, else user, else any entity."""
    return F.coalesce(_first(_of("Process")), _first(_of("Host")), _first(_of("User")), _first(F.col("entities")))


def observation() -> Column:
    return F.struct("event_id", "event_type", "ts", "source", "severity")


def node_rows(events: DataFrame) -> DataFrame:
    """One row per (event, entity)."""
    return events.select(
        "tenant_id", "ts", "event_id", "event_type", "source", "severity", "source_confidence",
        F.explode("entities").alias("e")).select(
        F.col("e.id").alias("node_id"), F.col("e.type").alias("node_type"), "tenant_id",
        F.map_concat(F.create_map(F.lit("display_name"), F.col("e.display_name")), F.col("e.attributes")).alias("properties"),
        "ts", "event_id", "event_type", "source", "severity", "source_confidence")


def edge_rows(events: DataFrame) -> DataFrame:
    """One row per (event, derived relation)."""
    base = events.select(
        "tenant_id", "ts", "event_id", "event_type", "source", "severity", "source_confidence", "command_line", "dst_port",
        (F.try_variant_get("body", "$.LogonType", "string") if "body" in events.columns
         else F.lit(None).cast("string")).alias("logon_type"),
        _first(_of("User")).alias("user"), _first(_of("Host")).alias("host"),
        F.transform(_of("Process"), lambda e: e["id"]).alias("procs"),
        F.transform(_of("IP"), lambda e: e["id"]).alias("ips"),
        F.transform(_of("File"), lambda e: e["id"]).alias("files"),
        _first(_of("Domain")).alias("domain"), _first(_of("URL")).alias("url"), _first(_of("RegistryKey")).alias("registry"),
        _first(_of("Email")).alias("email"), _first(_of("Hash")).alias("hash"),
        F.transform(_of("AttackTechnique"), lambda e: e["id"]).alias("techniques"))
    proc = F.try_element_at("procs", F.lit(1))
    parent = F.try_element_at("procs", F.lit(2))
    ip1, ip2 = F.try_element_at("ips", F.lit(1)), F.try_element_at("ips", F.lit(2))
    c = F.col
    none = F.lit(None).cast("string")

    def edge(src: Column, kind: str | Column, dst: Column, when: Column, prop: str | None = None, value: Column = none) -> tuple[Column, Column]:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        props = F.create_map().cast("map<string,string>") if prop is None else F.when(
            value.isNotNull(), F.create_map(F.lit(prop), value)).otherwise(F.create_map().cast("map<string,string>"))
        return when & src.isNotNull() & dst.isNotNull(), F.struct(
            src.alias("src_id"), kind.alias("edge_type"), dst.alias("dst_id"), props.alias("edge_props"))

    def fan(arr: str, src: Column, kind: str, when: Column) -> Column:
        made = F.transform(c(arr), lambda d: F.struct(
            src.alias("src_id"), F.lit(kind).alias("edge_type"), d.alias("dst_id"),
            F.create_map().cast("map<string,string>").alias("edge_props")))
        return F.when(when & src.isNotNull(), made).otherwise(F.slice(made, 1, 0))

    always = F.lit(True)
    n_ips = F.size("ips")
    actor = F.coalesce(proc, c("host"))
    port = c("dst_port").cast("string")
    singles = chosen(
        edge(c("user"), "authenticated_to", c("host"), c("event_type").isin(fixed.LOGON_TYPES), "logon_type", c("logon_type")),
        edge(c("user"), "logged_in_to", c("host"), always),
        edge(parent, "spawned", proc, F.size("procs") >= 2, "command_line", c("command_line")),
        edge(c("host"), "executed", proc, F.size("procs") == 1),
        edge(ip1, "connected_to", ip2, n_ips == 2, "dst_port", port),
        edge(c("host"), "connected_to", ip1, (n_ips == 1) & c("event_type").isin(fixed.NETWORK_TYPES), "dst_port", port),
        edge(c("domain"), "resolved_to", F.try_element_at("ips", n_ips), n_ips > 0),
        edge(F.coalesce(proc, c("user"), c("host")),
             F.when(proc.isNotNull(), F.lit("downloaded")).otherwise(F.lit("accessed")), c("url"), always),
        edge(proc, "modified", c("registry"), always),
        edge(c("email"), "emailed", c("user"), always),
        edge(proc, "created", c("hash"), always),
    )
    all_edges = F.concat(
        singles,
        fan("files", proc, "accessed", c("event_type") == "process_access"),
        fan("files", actor, "created", c("event_type") == "file_create"),
        fan("files", actor, "modified", c("event_type").isin("file_modify", "file_delete")),
        fan("techniques", F.coalesce(proc, c("host"), c("user")), "mapped_to_technique", always))
    return base.select(
        "tenant_id", "ts", "event_id", "event_type", "source", "severity", "source_confidence", fence(all_edges).alias("_edges")
    ).select("tenant_id", "ts", "event_id", "event_type", "source", "severity", "source_confidence", F.inline("_edges")).withColumn("edge_id", edge_key(F.col("src_id"), F.col("edge_type"), F.col("dst_id")))


def _fold_properties(rows: DataFrame, key: list[str], entries: Column, at: Column, whole: dict[str, Column], merge: dict) -> DataFrame:
    """Aggregate ``rows`` per key, with the latest value of each property, in one pass over the rows.

    ``entries`` is an array of (name, latest), where ``latest`` is (at, value); ``whole`` are the aggregates of the
    rows themselves and ``merge`` how their partial results combine.  Rows are combined per (key, name) first, where
    a null name stands for the row as such, and the few results per key afterwards.
    """
    self = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.struct(at.alias("at"), F.lit(None).cast("string").alias("value")).alias("latest")))
    each = rows.withColumn("_p", F.explode(F.concat(self, entries))).withColumn("_name", F.col("_p.name"))
    parts = each.groupBy(*key, "_name").agg(F.max("_p.latest").alias("_latest"), *[c.alias(n) for n, c in whole.items()])
    own = F.col("_name").isNull()
    named = F.when(~own, F.struct(F.col("_name").alias("n"), F.col("_latest").alias("l")))
    out = parts.groupBy(*key).agg(F.array_sort(F.collect_list(named)).alias("_pairs"), *[f(F.when(own, F.col(n))).alias(n) for n, f in merge.items()])
    return out.withColumn("properties", F.map_from_entries(F.transform("_pairs", lambda x: F.struct(x["n"], x["l"]["value"])))).withColumn(
        "property_seen", F.map_from_entries(F.transform("_pairs", lambda x: F.struct(x["n"], x["l"]["at"])))).drop("_pairs")


def _upsert(rows: DataFrame, key: list[str], props: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    whole = {"first_seen": F.min("ts"), "last_seen": F.max("ts"), "count": F.count("*"), "confidence": F.min_by("source_confidence", order),
             "sources": F.array_sort(F.collect_set("source"))}
    if props not in rows.columns:
        return rows.groupBy(*key).agg(*[c.alias(n) for n, c in whole.items()])
    entries = F.transform(F.map_entries(F.coalesce(props, F.create_map().cast("map<string,string>"))), lambda e: F.struct(
        e["key"].alias("name"), F.struct(order.alias("at"), e["value"].alias("value")).alias("latest")))
    return _fold_properties(rows, key, entries, order, whole, {n: F.max for n in whole})


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """Current node table: first/last seen, count, first confidence, source set, latest value of each property."""
    return _upsert(rows, ["node_id", "node_type", "tenant_id"], "properties").withColumn("labels", F.array("node_type"))


def upsert_edges(rows: DataFrame) -> DataFrame:
    """Current edge table like :func:`upsert_nodes`; rows without ``edge_props`` give edges without properties."""
    return _upsert(rows, ["edge_id", "src_id", "edge_type", "dst_id", "tenant_id"], "edge_props")


def merge_upserts(current: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Combine two upserted tables of the same kind (used by the streaming sink)."""
    both = current.unionByName(delta)
    rest = [c for c in current.columns if c not in {
        *key, "first_seen", "last_seen", "count", "confidence", "sources", "properties", "property_seen"}]
    entries = F.transform(F.map_entries("properties"), lambda e: F.struct(
        e["key"].alias("name"), F.struct(F.col("property_seen")[e["key"]].alias("at"), e["value"].alias("value")).alias("latest")))
    nothing = F.lit(None).cast(current.schema["property_seen"].dataType.valueType)
    whole = {"first_seen": F.min("first_seen"), "last_seen": F.max("last_seen"), "count": F.sum("count"),
             "confidence": F.min_by("confidence", "first_seen"),
             "sources": F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))), **{c: F.first(c) for c in rest}}
    return _fold_properties(both, key, entries, nothing, whole, {n: F.max for n in whole}).select(*current.columns)


def recent_observations(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Latest ``limit`` observations per node or edge; ``rows`` itself is the whole history.

    ``row_number <= limit`` lets Spark keep only ``limit`` rows per key in each task before the
    shuffle, so a hub never sends its whole history anywhere.
    """
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def observation_lists(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Per key the latest observations, oldest first."""
    recent = recent_observations(rows, key, limit)
    return recent.groupBy(key).agg(F.reverse(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("rank"), observation().alias("o")))), lambda x: x["o"])).alias("observations"))


def update_summary(events: DataFrame) -> DataFrame:
    """Nodes and edges upserted per event."""
    nodes = events.select("event_id", F.size("entities").alias("nodes_upserted"))
    edges = edge_rows(events).groupBy("event_id").agg(F.count("*").alias("edges_upserted"))
    return nodes.join(edges, "event_id", "left").fillna(0, ["edges_upserted"])
