"""Graph queries as bounded loops of equi-joins.

Neighborhoods and distances to known-bad nodes spread hop by hop: one join of the frontier with the edge list and one
aggregate that keeps the shortest distance per node, checkpointed to keep plans short and survive executor loss.  Paths
and distances between given nodes come from landmark labels.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide.functions.core import entity_id, lookup
from watchtide.operators import landmarks
from watchtide.operators.graph_build import primary_entity
from watchtide.operators.running import running
from watchtide.session import cut_lineage, stored


def adjacency(edges: DataFrame, columns: Sequence[str] = ("edge_id", "edge_type")) -> DataFrame:
    """Undirected view: every stored edge in both directions, self-loops once, with ``columns`` of the edge."""
    fwd = edges.select(*columns, F.col("src_id").alias("node"), F.col("dst_id").alias("other"))
    back = edges.where("src_id <> dst_id").select(*columns, F.col("dst_id").alias("node"), F.col("src_id").alias("other"))
    return fwd.unionByName(back)


def numbered(edges: DataFrame, columns: Sequence[str] = ("edge_type",)) -> tuple[DataFrame, DataFrame]:
    """(names, links): a number for each node (node_id, no), and the edges between numbers, with ``columns`` of them.

    Ids are long hashes that do not compress; searches pass nodes on many times, so they pass on numbers.
    """
    ends = edges.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).where("node_id IS NOT NULL").distinct()
    names = stored(ends.withColumn("no", F.monotonically_increasing_id()), "names")
    links = edges.select("src_id", "dst_id", *columns)
    for end in ("src_id", "dst_id"):
        links = links.join(names.select(F.col("node_id").alias(end), F.col("no").alias(f"_{end}")), end, "left").drop(end)
    return names, stored(links.withColumnsRenamed({"_src_id": "src_id", "_dst_id": "dst_id"}), "links")


def node_lookup(nodes: DataFrame, node_id: str | Column) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.agg(F.count("*").alias("n")).select(F.lit("node_count").alias("metric"), "n")
    b = edges.agg(F.count("*").alias("n")).select(F.lit("edge_count").alias("metric"), "n")
    return a.unionByName(b)


def degrees(edges: DataFrame) -> DataFrame:
    """Number of stored edges at each node; a self-loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count("*").alias("degree"))


def edge_rarity(edges: DataFrame, k: int | None = None) -> DataFrame:
    """Per edge type: max(0, 1 - share * number of types); ``k`` replaces the number of types."""
    counts = edges.groupBy("edge_type").agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # at most one row per edge type
    factor = F.count("*").over(everything) if k is None else F.lit(k)
    share = F.col("n") / F.sum("n").over(everything)
    return counts.select("edge_type", "n", F.round(F.greatest(F.lit(0.0), 1.0 - share * factor), 3).alias("rare_edge_score"))


def _spread(state: DataFrame, adj: DataFrame, hop: int) -> DataFrame:
    """One more hop: state (origin, node, dist) grown by the neighbors of its outermost ring."""
    ring = state.where(F.col("dist") == hop - 1)
    reached = ring.join(adj, "node").select("origin", F.col("other").alias("node"), F.lit(hop).alias("dist")).distinct()
    grown = state.unionByName(reached).groupBy("origin", "node").agg(F.min("dist").alias("dist"))
    return cut_lineage(grown)


def hop_distances(edges: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """(origin, node, dist) for every node within ``depth`` undirected hops of each origin."""
    adj = adjacency(edges).select("node", "other").distinct()
    state = origins.select(F.col("node_id").alias("origin"), F.col("node_id").alias("node"), F.lit(0).alias("dist")).distinct()
    for hop in range(1, depth + 1):
        state = _spread(state, adj, hop)
    return state


def neighborhood(edges: DataFrame, roots: DataFrame, depth: int = 1, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within ``depth`` hops of each root, each stored edge once.

    All of them, or with ``limit`` the first edges per root by (hop, edge id).
    """
    state = hop_distances(edges, roots, depth)
    nodes = state.select(F.col("origin").alias("root"), F.col("node").alias("node_id"), "dist")
    inner = state.where(F.col("dist") < depth)
    found = inner.join(adjacency(edges), "node").groupBy(F.col("origin").alias("root"), "edge_id").agg(
        F.min(F.col("dist") + 1).alias("hop"))
    if limit is not None:
        w = Window.partitionBy("root").orderBy("hop", "edge_id")
        found = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    return nodes, found


def attack_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 6) -> DataFrame:
    """Shortest undirected path per (src, dst): found, length (-1 when none) and edge ids in order."""
    found = landmarks.paths(landmarks.build(adjacency(edges), max_depth), pairs)
    out = pairs.select("src", "dst").distinct().join(found, ["src", "dst"], "left")
    return out.select("src", "dst", F.col("length").isNotNull().alias("found"), F.coalesce("length", F.lit(-1)).alias("length"),
                      F.coalesce("path", F.array().cast("array<string>")).alias("path"))


def distance_to_bad(edges: DataFrame, bad: DataFrame, max_depth: int = 4) -> DataFrame:
    """Per node the hops to the nearest known-bad node, for nodes within ``max_depth``.

    One search from all bad nodes at once: state is one row per node, whatever their number.
    """
    adj = adjacency(edges).select("node", "other").distinct()
    state = bad.select(F.lit(0).alias("origin"), F.col("node_id").alias("node"), F.lit(0).alias("dist")).distinct()
    for hop in range(1, max_depth + 1):
        state = _spread(state, adj, hop)
    return state.select(F.col("node").alias("node_id"), F.col("dist").alias("path_length"))


def indicator_node(value: Column, tenant: Column) -> Column:
    """Graph id of an indicator: address, file hash, else domain (a URL takes a domain id too)."""
    kind = (F.when(value.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), F.lit("IP"))
            .when(value.rlike(r"^[a-f0-9]{32,64}$"), F.lit("Hash")).otherwise(F.lit("Domain")))
    return entity_id(kind, value, tenant)


def entity_timeline(node_obs: DataFrame, edge_obs: DataFrame, limit: int | None = None) -> DataFrame:
    """Observations of each node and of the edges at it; with ``limit`` the newest ones, ranked."""
    cols = ["ts", "event_id", "event_type", "source", "severity"]
    none = F.lit(None).cast("string")
    own = node_obs.select("node_id", *cols, none.alias("edge_id"))
    at = edge_obs.select(F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("node_id"), *cols, "edge_id")
    if limit is None:
        return own.unionByName(at)
    w = Window.partitionBy("node_id").orderBy(F.col("ts").desc(), F.col("event_id").desc(), F.col("edge_id").desc_nulls_last())
    return own.unionByName(at).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def incident_rarity(edges: DataFrame, adj: DataFrame | None = None) -> DataFrame:
    """Per node: mean rarity over all its edges and the number of nodes in its neighborhood, itself included."""
    rarity = {r.edge_type: r.rare_edge_score for r in stored(edge_rarity(edges), "rarity").collect() if r.edge_type is not None}  # one for each type
    # scores have three decimals: the mean is rounded in whole thousandths, half up, whatever the order of the sum
    thousandths = F.round((lookup(rarity, F.col("edge_type")) if rarity else F.lit(0.0)) * 1000).cast("long")
    both = (adjacency(edges) if adj is None else adj).where("edge_type IS NOT NULL")
    ends = both.groupBy("node", "other").agg(F.sum(thousandths).alias("s"), F.count("*").alias("n"))
    return ends.groupBy(F.col("node").alias("node_id")).agg(
        (F.expr("(2 * sum(s) + sum(n)) div (2 * sum(n))") / 1000.0).alias("rare_edge_score"),
        (F.count_if(F.col("other") != F.col("node")) + 1).alias("neighbor_count"))


def snapshot_features(events: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """Add graph features of each event's primary entity, as the finished graph shows them.

    ``path_length`` is filled for events with intel matches: the distance from the primary entity to
    the nearest node that one of the event's own indicators points at, within ``max_depth``.
    """
    names, links = numbered(stored(edges.select("src_id", "dst_id", "edge_type"), "edges"))
    adj = adjacency(links, ["edge_type"])
    keyed = events.withColumn("node_id", primary_entity())
    # one row per node, so that the hot ones are joined once
    facts = degrees(links).join(incident_rarity(links, adj), "node_id", "left")
    facts = stored(names.join(facts.withColumnRenamed("node_id", "no"), "no").drop("no"), "facts")
    wanted = numbered_pairs(indicator_pairs(keyed), names, ["event_id"])
    lengths = path_lengths(adj, wanted.select("src", "dst").distinct(), max_depth)
    found = wanted.join(lengths, ["src", "dst"]).select("event_id", "length").unionByName(
        indicator_pairs(keyed).where("src = dst").select("event_id", F.lit(0).alias("length")))
    own = stored(found.groupBy("event_id").agg(F.min("length").alias("path_length")), "lengths")
    out = keyed.join(facts, "node_id", "left").join(own, "event_id", "left")
    return (out.withColumn("degree", F.coalesce("degree", F.lit(0)))
            .withColumn("rare_edge_score", F.coalesce("rare_edge_score", F.lit(0.5))))


def path_lengths(adj: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """(src, dst, length) of the pairs that are connected within ``max_depth`` undirected hops."""
    return landmarks.distances(landmarks.build(adj, max_depth), pairs)


def degree_as_of(reads: DataFrame, edges: DataFrame, t: str = "ts_us") -> DataFrame:
    """Add ``degree_as_of``: edges first seen at the node up to and including each read's time.

    ``reads`` needs ``node_id`` and ``t``; ``edges`` needs ``first_us``.  Both lie on one time line for each node, and
    the counts run along it; a hub's day is spread over as many slices as its rows need.
    """
    ends = edges.select(F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("node_id"), F.col("first_us").alias(t))
    # an edge has order 0; reads come after the edges of their time, and the hash only spreads reads of one moment
    asks = reads.withColumn("_o", (F.lit(1) + F.pmod(F.xxhash64(*reads.columns), F.lit(1 << 14))).cast("int"))
    rows = asks.unionByName(ends.withColumn("_o", F.lit(0)), allowMissingColumns=True)
    out = running(rows, ["node_id"], [F.col(t), F.col("_o")], {"degree_as_of": F.when(F.col("_o") == 0, 1)})
    return out.where("_o > 0").drop("_o")


def indicator_pairs(keyed: DataFrame, columns: Sequence[str] = ("event_id",)) -> DataFrame:
    """(event_id, src, dst): primary entity of each event and the nodes its own indicators point at; ``columns`` come along."""
    return keyed.where("node_id IS NOT NULL").select(*columns, "node_id", "tenant_id", F.explode(F.array_distinct("intel_matches")).alias("v")).select(
        *columns, F.col("node_id").alias("src"), indicator_node(F.col("v"), F.col("tenant_id")).alias("dst"))


def numbered_pairs(pairs: DataFrame, names: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs of different nodes of the graph with the nodes' numbers; a pair with a node outside has no way and is left out."""
    out = pairs.where("src <> dst")
    for end in ("src", "dst"):
        out = out.join(names.select(F.col("node_id").alias(end), F.col("no").alias(f"_{end}")), end).drop(end)
    return stored(out.select(*columns, F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct(), "pairs")


def features_as_of(events: DataFrame, edges: DataFrame, max_depth: int = 4, t: str = "ts_us") -> DataFrame:
    """(event_id, node_id, degree, rare_edge_score, neighbor_count, path_length) as the graph was at each event's time.

    ``events`` needs event_id, tenant_id, entities, intel_matches and ``t``; ``edges`` needs ``first_us``, when they were first
    seen.  An event sees the edges first seen up to and including its own time, so its own edges too.  Counts for each
    edge type run along the time line of the node and that of the whole graph; a path counts from the time its last edge
    is there.  Events without an entity get the defaults.
    """
    keyed = stored(events.select("event_id", "tenant_id", "intel_matches", F.col(t).alias("_t"), primary_entity().alias("node_id")), "keyed")
    names, links = numbered(stored(edges.select("edge_type", "src_id", "dst_id", F.col("first_us").alias("_t")), "edges"), ["edge_type", "_t"])
    types = sorted(r[0] for r in stored(links.select("edge_type").distinct(), "types").collect())  # a checked domain of fifteen
    # the hash only spreads events of one moment
    placed = keyed.join(names, "node_id").select("event_id", F.col("no").alias("node_id"), "_t", F.lit(1).alias("_o"),
                                                 F.pmod(F.xxhash64("event_id"), F.lit(1 << 14)).cast("int").alias("_h"))
    ends = adjacency(links, ["edge_type", "_t"]).withColumnRenamed("node", "node_id")
    near = ends.where("other <> node_id").groupBy("node_id", "other").agg(F.min("_t").alias("_t")).select("node_id", "_t", F.lit(1).alias("near"))
    at = ends.groupBy("node_id", "edge_type", "_t").agg(F.count("*").alias("n")).select("node_id", "edge_type", "_t", "n", F.lit(0).alias("near"))
    counts = {f"_n{i}": F.when(F.col("edge_type") == ty, F.col("n")) for i, ty in enumerate(types)}
    line = at.unionByName(near, allowMissingColumns=True).withColumn("_o", F.lit(0)).unionByName(placed, allowMissingColumns=True)
    local = running(line, ["node_id"], [F.col("_t"), F.col("_o"), F.col("_h")], {**counts, "neighbors": F.col("near")}).where("_o = 1")
    local = stored(local.select("event_id", "_t", "neighbors", *counts), "local")
    whole = links.groupBy("edge_type", "_t").agg(F.count("*").alias("n")).withColumn("_o", F.lit(0)).unionByName(
        keyed.select("_t", F.lit(1).alias("_o")).distinct(), allowMissingColumns=True)
    world = running(whole, [], [F.col("_t"), F.col("_o"), F.col("edge_type")], {f"_w{i}": c for i, c in enumerate(counts.values())}).where("_o = 1")
    world = stored(world.select("_t", *[f"_w{i}" for i in range(len(types))]), "world")
    facts = local.join(world, "_t")

    def added(cols: list[Column]) -> Column:
        return functools.reduce(lambda a, b: a + b, cols, F.lit(0).cast("long"))
    all_, kinds = added([F.col(f"_w{i}") for i in range(len(types))]), added([(F.col(f"_w{i}") > 0).cast("long") for i in range(len(types))])
    rare = [F.round(F.round(F.greatest(F.lit(0.0), 1.0 - F.col(f"_w{i}") / all_ * kinds), 3) * 1000).cast("long") for i in range(len(types))]
    degree = added([F.col(c) for c in counts])
    s = added([F.when(F.col(c) > 0, F.col(c) * r).otherwise(0) for c, r in zip(counts, rare)])
    facts = facts.select("event_id", degree.alias("degree"), (F.col("neighbors") + 1).alias("neighbor_count"), s.alias("s")).where("degree > 0").select(
        "event_id", "degree", (F.expr("(2 * s + degree) div (2 * degree)") / 1000.0).alias("rare_edge_score"), "neighbor_count")
    facts = stored(facts, "facts")
    pairs = indicator_pairs(keyed, ["event_id", "_t"])
    wanted = numbered_pairs(pairs, names, ["event_id", "_t"])
    index = landmarks.build(adjacency(links, ["_t"]), max_depth, since="_t")
    ways = landmarks.distances_over_time(index, wanted.select("src", "dst").distinct())
    found = wanted.join(ways, ["src", "dst"]).where(F.col("since").isNull() | (F.col("since") <= F.col("_t"))).select("event_id", "length").unionByName(
        pairs.where("src = dst").select("event_id", F.lit(0).alias("length")))
    own = stored(found.groupBy("event_id").agg(F.min("length").alias("path_length")), "lengths")
    out = keyed.select("event_id", "node_id").join(facts, "event_id", "left").join(own, "event_id", "left")
    return out.select("event_id", "node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("rare_edge_score", F.lit(0.5)).alias("rare_edge_score"),
                      "neighbor_count", "path_length")


def case_subgraph(case_entities: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 1,
                  per_case: int | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Union of the neighborhoods of each case's entities, without repeats.

    ``per_case`` keeps the first entities of a case, ``limit`` the first edges of an entity.
    """
    first = case_entities
    if per_case is not None:
        w = Window.partitionBy("case_id").orderBy("entity_id")
        first = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_case).drop("_r")
    roots = first.select(F.col("entity_id").alias("node_id")).distinct()
    near, at = neighborhood(edges, roots, depth, limit)
    display = F.coalesce(F.try_element_at("properties", F.lit("display_name")), F.try_element_at("properties", F.lit("name")), F.col("node_id"))
    case_nodes = first.join(near, first["entity_id"] == near["root"]).select("case_id", "node_id").distinct().join(
        nodes.select("node_id", "node_type", display.alias("display_name")), "node_id")
    case_edges = first.join(at, first["entity_id"] == at["root"]).select("case_id", "edge_id").distinct()
    return case_nodes, case_edges
