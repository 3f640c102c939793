"""Queries for graph building and graph search."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide import fixed
from watchtide.functions.core import edge_key, joined, micros
from watchtide.operators import graph_build, graph_query
from watchtide.plans import stages, telemetry as tel
from watchtide.plans.queries_detect import SQL_FEATURES, SQL_PRIMARY, sql_edges
from watchtide.plans.registry import query
from watchtide.session import cut_lineage, stored

_ENR = stages.sql_enriched()
_ENT = stages.sql_entities()
_G = f"{_ENR}, {_ENT}, {sql_edges()}"
_NODE = "nrow AS (SELECT tenant_id, n, event_id, ts_us, source, unnest(ids) AS node_id FROM ents)"


@query("graph_nodes", f"""WITH {_ENR}, {_ENT}, {_NODE}
SELECT node_id, split_part(node_id, ':', 2) AS node_type, tenant_id, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS cnt, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM nrow GROUP BY 1, 2, 3""")
def graph_nodes(spark, sf):
    out = graph_build.upsert_nodes(graph_build.node_rows(stages.enriched(spark, sf)))
    return out.select("node_id", "node_type", "tenant_id", micros(F.col("first_seen")).alias("first_us"), micros(F.col("last_seen")).alias("last_us"),
                      F.col("count").alias("cnt"), joined(F.col("sources")).alias("sources"))


@query("graph_edges", f"WITH {_G} SELECT edge_id, src_id, edge_type, dst_id, cnt, first_us, last_us, sources FROM edge")
def graph_edges(spark, sf):
    out = graph_build.upsert_edges(graph_build.edge_rows(stages.enriched(spark, sf)))
    return out.select("edge_id", "src_id", "edge_type", "dst_id", F.col("count").alias("cnt"), micros(F.col("first_seen")).alias("first_us"),
                      micros(F.col("last_seen")).alias("last_us"), joined(F.col("sources")).alias("sources"))


@query("graph_edge_types", f"WITH {_G} SELECT edge_type, source, event_type, count(*) AS edges FROM erow GROUP BY 1, 2, 3")
def graph_edge_types(spark, sf):
    return graph_build.edge_rows(stages.enriched(spark, sf)).groupBy("edge_type", "source", "event_type").agg(F.count("*").alias("edges"))


@query("graph_update_summary", f"WITH {_G} SELECT event_id, len(ids) AS nodes_upserted, coalesce(c, 0) AS edges_upserted FROM ents LEFT JOIN (SELECT event_id, count(*) AS c FROM erow GROUP BY 1) USING (event_id)")
def graph_update_summary(spark, sf):
    return graph_build.update_summary(stages.enriched(spark, sf)).withColumn("nodes_upserted", F.col("nodes_upserted").cast("long"))


@query("graph_observations", f"""WITH {_ENR}, {_ENT}, {_NODE}, r AS (SELECT node_id, event_id, row_number() OVER (PARTITION BY node_id ORDER BY ts_us DESC, event_id DESC) AS rank FROM nrow)
SELECT node_id, event_id, rank FROM r WHERE rank <= {fixed.MAX_OBSERVATIONS}""")
def graph_observations(spark, sf):
    rows = graph_build.node_rows(stages.enriched(spark, sf))
    return graph_build.recent_observations(rows, "node_id", fixed.MAX_OBSERVATIONS).select("node_id", "event_id", "rank")


# what edges and the features of an event's entity are made of; properties of edges are no feature
_GRAPH_COLUMNS = ["event_id", "tenant_id", "ts", "event_type", "source", "severity", "source_confidence", "command_line", "dst_port",
                  "entities", "intel_matches"]


@query("graph_primary_features", f"WITH {_G}, {SQL_FEATURES} SELECT event_id, node_id, degree, rare AS rare_edge_score, neighbors AS neighbor_count, path AS path_length FROM feat")
def graph_primary_features(spark, sf):
    ev = stored(stages.enriched(spark, sf).select(*_GRAPH_COLUMNS), "events")
    edges = graph_build.upsert_edges(graph_build.edge_rows(ev).drop("edge_props"))
    return graph_query.snapshot_features(ev, edges).select("event_id", "node_id", "degree", "rare_edge_score", "neighbor_count", "path_length")


@query("graph_indicator_ids", f"""WITH {_G}, {SQL_FEATURES} SELECT node FROM bad""")
def graph_indicator_ids(spark, sf):
    ev = stages.enriched(spark, sf).select("tenant_id", F.explode("intel_matches").alias("v")).distinct()
    return ev.select(graph_query.indicator_node(F.col("v"), F.col("tenant_id")).alias("node")).distinct()


@query("graph_timeline", f"""WITH {_G}, {_NODE},
allobs AS (SELECT node_id, event_id, ts_us FROM nrow UNION ALL SELECT src_id, event_id, ts_us FROM erow UNION ALL SELECT dst_id, event_id, ts_us FROM erow WHERE dst_id <> src_id)
SELECT node_id, count(*) AS entries, min(ts_us) AS oldest_us, max(ts_us) AS newest_us FROM allobs GROUP BY 1""")
def graph_timeline(spark, sf):
    ev = cut_lineage(stages.enriched(spark, sf).drop("enrichment", "provenance", "body"))
    out = graph_query.entity_timeline(graph_build.node_rows(ev), graph_build.edge_rows(ev))
    return out.groupBy("node_id").agg(F.count("*").alias("entries"), micros(F.min("ts")).alias("oldest_us"), micros(F.max("ts")).alias("newest_us"))


# every event sees the edges first seen up to its own time
_AS_OF = f"""adj AS (SELECT edge_id, edge_type, src_id AS node, dst_id AS other, first_us AS t FROM edge UNION ALL SELECT edge_id, edge_type, dst_id, src_id, first_us FROM edge WHERE src_id <> dst_id),
ask AS (SELECT event_id, ts_us, {SQL_PRIMARY} AS node FROM ents),
cum AS (SELECT edge_type, first_us, sum(count(*)) OVER (PARTITION BY edge_type ORDER BY first_us) AS upto FROM edge GROUP BY 1, 2),
grid AS (SELECT DISTINCT ts_us, edge_type FROM (SELECT DISTINCT ts_us FROM ask) CROSS JOIN (SELECT DISTINCT edge_type FROM edge)),
tc AS (SELECT ts_us, grid.edge_type, upto FROM grid ASOF JOIN cum ON grid.edge_type = cum.edge_type AND grid.ts_us >= cum.first_us),
rar AS (SELECT ts_us, edge_type, round(greatest(0::DOUBLE, 1 - upto / (sum(upto) OVER (PARTITION BY ts_us))::DOUBLE * count(*) OVER (PARTITION BY ts_us)), 3) AS r FROM tc),
inc AS (SELECT event_id, ask.ts_us, edge_type, count(*) AS n FROM ask JOIN adj ON adj.node = ask.node AND adj.t <= ask.ts_us GROUP BY 1, 2, 3),
mean AS (SELECT event_id, CAST(sum(n) AS BIGINT) AS degree, ((2 * sum(n * CAST(round(r * 1000) AS BIGINT)) + sum(n)) // (2 * sum(n))) / 1000::DOUBLE AS rare FROM inc JOIN rar USING (ts_us, edge_type) GROUP BY 1),
pair AS (SELECT node, other, min(t) AS t FROM adj GROUP BY 1, 2),
nbr AS (SELECT event_id, count(*) FILTER (other <> ask.node) + 1 AS neighbors FROM ask JOIN pair ON pair.node = ask.node AND pair.t <= ask.ts_us GROUP BY 1),
badv AS (SELECT event_id, ts_us, tenant_id, {SQL_PRIMARY} AS src, unnest(intel) AS v FROM ents),
want AS (SELECT DISTINCT event_id, ts_us, src, concat(tenant_id, CASE WHEN regexp_matches(v, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN ':IP:' WHEN regexp_matches(v, '^[a-f0-9]{{32,64}}$') THEN ':Hash:' ELSE ':Domain:' END, substr(sha256(trim(lower(v))), 1, 32)) AS dst FROM badv WHERE src IS NOT NULL),
s0 AS (SELECT DISTINCT src AS o, src AS node, 0 AS d, 0::BIGINT AS t FROM want),
s1 AS (SELECT o, other AS node, 1 AS d, min(greatest(s0.t, pair.t)) AS t FROM s0 JOIN pair USING (node) GROUP BY 1, 2),
s2 AS (SELECT o, other AS node, 2 AS d, min(greatest(s1.t, pair.t)) AS t FROM s1 JOIN pair USING (node) GROUP BY 1, 2),
e0 AS (SELECT DISTINCT dst AS o, dst AS node, 0 AS d, 0::BIGINT AS t FROM want),
e1 AS (SELECT o, other AS node, 1 AS d, min(greatest(e0.t, pair.t)) AS t FROM e0 JOIN pair USING (node) GROUP BY 1, 2),
e2 AS (SELECT o, other AS node, 2 AS d, min(greatest(e1.t, pair.t)) AS t FROM e1 JOIN pair USING (node) GROUP BY 1, 2),
sa AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2), ea AS (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2),
pr AS (SELECT DISTINCT src, dst FROM want),
way AS (SELECT src, dst, sa.d + ea.d AS len, min(greatest(sa.t, ea.t)) AS t FROM pr JOIN sa ON sa.o = src JOIN ea ON ea.o = dst AND ea.node = sa.node GROUP BY 1, 2, 3),
own AS (SELECT event_id, min(len) AS path FROM want JOIN way USING (src, dst) WHERE way.t <= want.ts_us GROUP BY 1)"""


@query("graph_features_as_of", f"""WITH {_G}, {_AS_OF} SELECT ask.event_id, ask.node AS node_id, coalesce(degree, 0) AS degree, coalesce(rare, 0.5) AS rare_edge_score,
 neighbors AS neighbor_count, path AS path_length FROM ask LEFT JOIN mean USING (event_id) LEFT JOIN nbr USING (event_id) LEFT JOIN own USING (event_id)""")
def graph_features_as_of(spark, sf):
    ev = stored(stages.enriched(spark, sf).select(*_GRAPH_COLUMNS).withColumn("ts_us", micros(F.col("ts"))), "events")
    edges = graph_build.upsert_edges(graph_build.edge_rows(ev).drop("edge_props")).withColumn("first_us", micros(F.col("first_seen")))
    return graph_query.features_as_of(ev, edges)


# --- supplier / part graph from lineitem: large, with hubs ---------------------------------------
_SP = ("spe AS (SELECT concat('S', l_suppkey, '|ships_', l_returnflag, '|P', l_partkey) AS edge_id, concat('S', l_suppkey) AS src_id, concat('ships_', l_returnflag) AS edge_type, "
       "concat('P', l_partkey) AS dst_id, count(*) AS cnt, min(epoch_us(l_shipdate)) AS first_us FROM lineitem GROUP BY 1, 2, 3, 4)")


def _supply_edges(spark, sf):
    rows = tel.read(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("src_id"), F.concat(F.lit("ships_"), F.col("l_returnflag")).alias("edge_type"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("dst_id"), micros(F.col("l_shipdate")).alias("t"))
    out = rows.groupBy("src_id", "edge_type", "dst_id").agg(F.count("*").alias("cnt"), F.min("t").alias("first_us"))
    return out.withColumn("edge_id", edge_key(F.col("src_id"), F.col("edge_type"), F.col("dst_id")))


@query("graph_degree", f"WITH {_SP} SELECT node_id, count(*) AS degree FROM (SELECT src_id AS node_id FROM spe UNION ALL SELECT dst_id FROM spe) GROUP BY 1")
def graph_degree(spark, sf):
    return graph_query.degrees(_supply_edges(spark, sf))


@query("graph_rare_edges", f"WITH {_SP} SELECT edge_type, count(*) AS n, round(greatest(0::DOUBLE, 1 - count(*) / (sum(count(*)) OVER ())::DOUBLE * count(*) OVER ()), 3) AS rare_edge_score FROM spe GROUP BY 1")
def graph_rare_edges(spark, sf):
    return graph_query.edge_rarity(_supply_edges(spark, sf))


@query("graph_stats", f"WITH {_SP} SELECT 'edge_count' AS metric, count(*) AS n FROM spe UNION ALL SELECT 'node_count', count(DISTINCT x) FROM (SELECT src_id AS x FROM spe UNION ALL SELECT dst_id FROM spe)")
def graph_stats(spark, sf):
    edges = _supply_edges(spark, sf)
    return graph_query.graph_stats(graph_query.degrees(edges), edges)


@query("graph_adjacency", f"WITH {_SP} SELECT node, count(*) AS neighbors, CAST(sum(cnt) AS BIGINT) AS events FROM (SELECT src_id AS node, cnt FROM spe UNION ALL SELECT dst_id, cnt FROM spe) GROUP BY 1")
def graph_adjacency(spark, sf):
    edges = _supply_edges(spark, sf)
    adj = graph_query.adjacency(edges).join(edges.select("edge_id", "cnt"), "edge_id")
    return adj.groupBy("node").agg(F.count("*").alias("neighbors"), F.sum("cnt").alias("events"))


@query("graph_degree_as_of", f"""WITH {_SP}, inc AS (SELECT src_id AS node_id, first_us FROM spe UNION ALL SELECT dst_id, first_us FROM spe),
rd AS (SELECT l_orderkey, l_linenumber, concat('P', l_partkey) AS node_id, epoch_us(l_shipdate) AS t FROM lineitem),
ic AS (SELECT node_id, first_us, sum(count(*)) OVER (PARTITION BY node_id ORDER BY first_us) AS upto FROM inc GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CAST(upto AS BIGINT) AS degree_as_of FROM rd ASOF LEFT JOIN ic ON rd.node_id = ic.node_id AND rd.t >= ic.first_us""")
def graph_degree_as_of(spark, sf):
    reads = tel.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("P"), F.col("l_partkey")).alias("node_id"),
                                                   micros(F.col("l_shipdate")).alias("ts_us"))
    return graph_query.degree_as_of(reads, _supply_edges(spark, sf)).select("l_orderkey", "l_linenumber", "degree_as_of")


# --- geography graph: customer / supplier - nation - region -------------------------------------
_GEO = ("geo AS (SELECT concat('C', c_custkey) AS src_id, 'lives_in' AS edge_type, concat('N', c_nationkey) AS dst_id FROM customer "
        "UNION ALL SELECT concat('S', s_suppkey), 'based_in', concat('N', s_nationkey) FROM supplier "
        "UNION ALL SELECT concat('N', n_nationkey), 'part_of', concat('R', n_regionkey) FROM nation), "
        "ga AS (SELECT concat(src_id, '|', edge_type, '|', dst_id) AS edge_id, src_id AS node, dst_id AS other FROM geo UNION ALL SELECT concat(src_id, '|', edge_type, '|', dst_id), dst_id, src_id FROM geo)")


def _geo_edges(spark, sf):
    c = tel.read(spark, sf, "customer").selectExpr("concat('C', c_custkey) AS src_id", "'lives_in' AS edge_type", "concat('N', c_nationkey) AS dst_id")
    s = tel.read(spark, sf, "supplier").selectExpr("concat('S', s_suppkey) AS src_id", "'based_in' AS edge_type", "concat('N', s_nationkey) AS dst_id")
    n = tel.read(spark, sf, "nation").selectExpr("concat('N', n_nationkey) AS src_id", "'part_of' AS edge_type", "concat('R', n_regionkey) AS dst_id")
    out = c.unionByName(s).unionByName(n)
    return out.withColumn("edge_id", edge_key(F.col("src_id"), F.col("edge_type"), F.col("dst_id")))


def _sql_hops(depth: int, start: str) -> str:
    parts = [f"h0 AS ({start})"]
    for d in range(1, depth + 1):
        parts.append(f"h{d} AS (SELECT origin, node, min(dist) AS dist FROM (SELECT * FROM h{d - 1} UNION ALL SELECT origin, ga.other, {d} FROM h{d - 1} JOIN ga USING (node) WHERE dist = {d - 1}) GROUP BY 1, 2)")
    return ", ".join(parts)


_REGIONS = "SELECT concat('R', r_regionkey) AS origin, concat('R', r_regionkey) AS node, 0 AS dist FROM region"


@query("graph_neighborhood_nodes", f"WITH {_GEO}, {_sql_hops(2, _REGIONS)} SELECT origin AS root, node AS node_id, dist FROM h2")
def graph_neighborhood_nodes(spark, sf):
    roots = tel.read(spark, sf, "region").selectExpr("concat('R', r_regionkey) AS node_id")
    return graph_query.neighborhood(_geo_edges(spark, sf), roots, 2, None)[0]


@query("graph_neighborhood_edges", f"""WITH {_GEO}, {_sql_hops(2, _REGIONS)}, fe AS (SELECT origin AS root, edge_id, min(dist + 1) AS hop FROM h2 JOIN ga USING (node) WHERE dist < 2 GROUP BY 1, 2)
SELECT root, edge_id, hop FROM fe""")
def graph_neighborhood_edges(spark, sf):
    roots = tel.read(spark, sf, "region").selectExpr("concat('R', r_regionkey) AS node_id")
    return graph_query.neighborhood(_geo_edges(spark, sf), roots, 2)[1]


@query("graph_attack_path", f"""WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey AS sr FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT c_custkey, c_nationkey, n_regionkey AS cr FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT concat('S', s_suppkey) AS src, concat('C', c_custkey) AS dst, sr = cr AS found, CASE WHEN s_nationkey = c_nationkey THEN 2 WHEN sr = cr THEN 4 ELSE -1 END AS length,
CASE WHEN s_nationkey = c_nationkey THEN concat('S', s_suppkey, '|based_in|N', s_nationkey, ',C', c_custkey, '|lives_in|N', c_nationkey)
 WHEN sr = cr THEN concat('S', s_suppkey, '|based_in|N', s_nationkey, ',N', s_nationkey, '|part_of|R', sr, ',N', c_nationkey, '|part_of|R', cr, ',C', c_custkey, '|lives_in|N', c_nationkey) ELSE '' END AS path
FROM s JOIN c ON s_suppkey = c_custkey""")
def graph_attack_path(spark, sf):
    """Shortest path between every supplier and the customer of the same number."""
    s = tel.read(spark, sf, "supplier").select("s_suppkey")
    c = tel.read(spark, sf, "customer").select("c_custkey")
    pairs = s.join(c, F.col("s_suppkey") == F.col("c_custkey")).selectExpr("concat('S', s_suppkey) AS src", "concat('C', c_custkey) AS dst")
    return graph_query.attack_paths(_geo_edges(spark, sf), pairs).withColumn("path", joined(F.col("path")))


_BAD = "SELECT 0 AS origin, concat('S', s_suppkey) AS node, 0 AS dist FROM supplier WHERE s_acctbal < 0"


@query("graph_distance_to_bad", f"WITH {_GEO}, {_sql_hops(4, _BAD)} SELECT node AS node_id, dist AS path_length FROM h4")
def graph_distance_to_bad(spark, sf):
    bad = tel.read(spark, sf, "supplier").where("s_acctbal < 0").selectExpr("concat('S', s_suppkey) AS node_id")
    return graph_query.distance_to_bad(_geo_edges(spark, sf), bad)


@query("graph_case_subgraph", f"""WITH {_GEO}, ce AS (SELECT concat('case', n_regionkey) AS case_id, concat('N', n_nationkey) AS entity_id FROM nation),
x AS (SELECT case_id, edge_id, other AS node_id FROM ce JOIN ga ON node = entity_id UNION ALL SELECT case_id, NULL, entity_id FROM ce)
SELECT case_id, count(DISTINCT edge_id) AS edges, count(DISTINCT node_id) AS nodes FROM x GROUP BY 1""")
def graph_case_subgraph(spark, sf):
    ce = tel.read(spark, sf, "nation").selectExpr("concat('case', n_regionkey) AS case_id", "concat('N', n_nationkey) AS entity_id")
    edges = _geo_edges(spark, sf)
    ids = graph_query.degrees(edges).select("node_id", F.substring("node_id", 1, 1).alias("node_type"),
                                            F.create_map(F.lit("display_name"), F.col("node_id")).alias("properties"))
    nodes, at = graph_query.case_subgraph(ce, ids, edges)
    a = nodes.groupBy("case_id").agg(F.count_distinct("node_id").alias("nodes"))
    return a.join(at.groupBy("case_id").agg(F.count_distinct("edge_id").alias("edges")), "case_id")


@query("graph_node_lookup", f"WITH {_GEO}, d AS (SELECT node, count(*) AS degree FROM ga GROUP BY 1) SELECT node AS node_id, degree FROM d WHERE node = 'N7'")
def graph_node_lookup(spark, sf):
    return graph_query.node_lookup(graph_query.degrees(_geo_edges(spark, sf)), "N7")
