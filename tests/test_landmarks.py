"""Landmark labels against breadth-first search, also for every moment of a growing graph."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from watchtide.operators import landmarks
from watchtide.operators.graph_query import adjacency


def graph(seed, nodes, links, span=1000):
    rnd = random.Random(seed)
    out = []
    for i in range(links):
        # preferential ends, so that there are hubs, leaves, parallel edges and self-loops
        a, b = f"n{int(rnd.random() ** 3 * nodes)}", f"n{rnd.randrange(nodes)}"
        out.append((f"e{i:04d}", "t", a, b, rnd.randrange(span)))
    return out + [("x1", "t", "p", "q", 5), ("x2", "t", "q", "r", 7), ("x3", "t", "u", "v", 9)]


def frame(spark, edges):
    df = spark.createDataFrame(edges, "edge_id string, edge_type string, src_id string, dst_id string, first_us long")
    return adjacency(df).join(df.select("edge_id", "first_us"), "edge_id")


def search(edges, start, depth, until=None):
    near = {}
    for _, _, a, b, t in edges:
        if until is None or t <= until:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    dist, todo = {start: 0}, deque([start])
    while todo:
        n = todo.popleft()
        if dist[n] < depth:
            for o in near.get(n, ()):
                if o not in dist:
                    dist[o] = dist[n] + 1
                    todo.append(o)
    return dist


def pairs_of(edges, seed, n=250):
    rnd = random.Random(seed)
    names = sorted({x for e in edges for x in e[2:4]}) + ["nowhere"]
    return sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(n)} | {("n0", "n0"), ("nowhere", "nowhere"), ("p", "r"), ("u", "v"), ("p", "u")})


@pytest.mark.parametrize("seed,nodes,links,depth", [(1, 60, 90, 4), (2, 40, 200, 6)])
def test_distances_and_paths(spark, seed, nodes, links, depth):
    edges = graph(seed, nodes, links)
    pairs = pairs_of(edges, seed)
    index = landmarks.build(frame(spark, edges), depth)
    df = spark.createDataFrame(pairs, "src string, dst string")
    want = {(s, d): search(edges, s, depth)[d] for s, d in pairs if d in search(edges, s, depth)}
    assert {(r.src, r.dst): r.length for r in landmarks.distances(index, df).collect()} == want
    ends = {e[0]: e[2:4] for e in edges}
    got = landmarks.paths(index, df).collect()
    assert {(r.src, r.dst): r.length for r in got} == want
    for r in got:
        assert len(r.path) == r.length
        at = r.src
        for e in r.path:
            assert at in ends[e]
            at = ends[e][1] if ends[e][0] == at else ends[e][0]
        assert at == r.dst


def test_distances_at_every_moment(spark):
    edges = graph(3, 35, 80, span=30)
    pairs = pairs_of(edges, 3, 150)
    index = landmarks.build(frame(spark, edges), 4, since="first_us")
    got = {}
    for r in landmarks.distances_over_time(index, spark.createDataFrame(pairs, "src string, dst string")).collect():
        got.setdefault((r.src, r.dst), []).append((r.length, r.since))
    for s, d in pairs:
        for t in range(-1, 31, 3):
            lengths = [n for n, since in got.get((s, d), []) if since is None or since <= t]
            assert (min(lengths) if lengths else None) == search(edges, s, 4, t).get(d), (s, d, t)


def test_a_hub_adds_one_label_to_each_neighbor(spark):
    edges = [(f"e{i}", "t", "hub", f"n{i}", i) for i in range(10_000)] + [(f"f{i}", "t", f"n{i}", f"n{i + 1}", i) for i in range(0, 10_000, 2)]
    index = landmarks.build(frame(spark, edges), 4)
    assert index.labels.count() <= 3 * 10_001
    pairs = spark.createDataFrame([("n1", "n9999"), ("n0", "n1"), ("hub", "n7")], "src string, dst string")
    assert {(r.src, r.dst): r.length for r in landmarks.distances(index, pairs).collect()} == {("n1", "n9999"): 2, ("n0", "n1"): 1, ("hub", "n7"): 1}


def test_empty_graph(spark):
    index = landmarks.build(frame(spark, graph(1, 5, 5)).where("false"), 4)
    df = spark.createDataFrame([("a", "b"), ("a", "a")], "src string, dst string")
    assert [tuple(r) for r in landmarks.distances(index, df).collect()] == [("a", "a", 0)]
    assert index.labels.where(F.lit(True)).count() == 0


def test_features_as_of_see_only_earlier_edges(spark):
    from watchtide.operators import graph_query
    edges = spark.createDataFrame(
        [("a|x|b", "x", "a", "b", 10), ("a|x|c", "x", "a", "c", 20), ("b|y|d", "y", "b", "d", 30), ("a|y|a", "y", "a", "a", 40), ("c|z|d", "z", "c", "d", 50)],
        "edge_id string, edge_type string, src_id string, dst_id string, first_us long")
    entity = "entities array<struct<type:string,id:string,display_name:string,attributes:map<string,string>>>"
    rows = [(f"e{t}", "t0", [], t, [("Host", "a", "a", {})]) for t in (5, 10, 25, 30, 45)] + [("none", "t0", [], 50, [])]
    events = spark.createDataFrame(rows, f"event_id string, tenant_id string, intel_matches array<string>, ts_us long, {entity}")
    got = {r.event_id: (r.degree, r.rare_edge_score, r.neighbor_count, r.path_length) for r in graph_query.features_as_of(events, edges).collect()}
    # one type only: rarity 0; then x has 2 of 3 edges of two types: 1 - 2 / 3 * 2 < 0; at 45 two x and two y: 1 - 1 / 2 * 2 = 0
    assert got == {"e5": (0, 0.5, None, None), "e10": (1, 0.0, 2, None), "e25": (2, 0.0, 3, None), "e30": (2, 0.0, 3, None),
                   "e45": (3, 0.0, 3, None), "none": (0, 0.5, None, None)}
