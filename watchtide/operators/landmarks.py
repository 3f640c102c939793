"""Distances and shortest paths by landmark labels (a 2-hop cover).

Every node keeps a short list of better connected nodes, its landmarks, with the hops to them; for any two connected
nodes the best connected node of some shortest path is on both lists, so a distance is one join of two lists.  Labels are
built level by level for all nodes at once: a node takes over the landmarks of its neighbors, unless a landmark is not
better connected than the node or labels found so far already tell as short a way.  A hub with any number of neighbors
adds one label to each of them.

Edges may have a time from which they exist.  A label then holds the earliest time by which its way is there, and ways of
more hops are kept if they exist earlier; so one index answers for every moment.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from watchtide.session import cut_lineage, stored


def _better(degree: str, node: str, than_degree: str, than_node: str) -> Column:
    """Whether the first node is better connected than the second; of equally connected ones the smaller id."""
    return (F.col(degree) > F.col(than_degree)) | ((F.col(degree) == F.col(than_degree)) & (F.col(node) < F.col(than_node)))


@dataclass
class Landmarks:
    """``labels`` (node, landmark, hops, since, edge_id, step) of the core; ``leaves`` (node, anchor, since, edge_id) beside it.

    A leaf is a node with one neighbor, its anchor, that has others; no way between other nodes leads over it.  ``edge_id``
    and ``step`` are the first edge and node of the way to the landmark, whose own label of the landmark continues it; an
    index of edges without ids has neither and serves distances only.
    """

    labels: DataFrame
    leaves: DataFrame
    depth: int


def build(adj: DataFrame, depth: int, since: str | None = None) -> Landmarks:
    """Index of the undirected graph ``adj`` (node, other, edge_id) for ways of up to ``depth`` hops; without edge_id, of distances.

    ``adj`` holds both directions; of parallel edges the earliest counts, then the smallest id.  Without ``since``, the
    name of the edges' time column, all times are 0.  Every core node is its own landmark at 0 hops; its time is null.
    """
    time = F.col(since) if since else F.lit(0).cast("long")
    ids = [c for c in ("edge_id",) if c in adj.columns]
    steps = ["step"] if ids else []
    links = adj.where("node <> other").groupBy("node", "other").agg(F.min(F.struct(time.alias("since"), *ids)).alias("e"))
    links = stored(links.select("node", "other", "e.since", *[f"e.{c}" for c in ids]), "links")
    degree = links.groupBy("node").agg(F.count("*").alias("degree"))
    links = stored(links.join(degree.withColumnRenamed("degree", "node_degree"), "node").join(
        degree.select(F.col("node").alias("other"), F.col("degree").alias("other_degree")), "other"), "links")
    leaf = (F.col("node_degree") == 1) & (F.col("other_degree") > 1)
    leaves = links.where(leaf).select("node", F.col("other").alias("anchor"), "since", *ids)
    links = links.where(~leaf & ~((F.col("other_degree") == 1) & (F.col("node_degree") > 1)))
    # anchors whose neighbors are all leaves have no links left, but are still ends of ways
    core = degree.where("degree > 1").unionByName(links.where("node_degree = 1").select("node", F.col("node_degree").alias("degree")))
    own = core.select("node", F.col("node").alias("landmark"), "degree", F.lit(0).alias("hops"),
                      F.lit(None).cast(links.schema["since"].dataType).alias("since"),
                      *[F.lit(None).cast("string").alias(c) for c in ids], *[F.lit(None).cast(links.schema["node"].dataType).alias(c) for c in steps])
    ring = stored(links.where(_better("other_degree", "other", "node_degree", "node")).select(
        "node", F.col("other").alias("landmark"), F.col("other_degree").alias("degree"), F.lit(1).alias("hops"), "since", *ids,
        *[F.col("other").alias(c) for c in steps]), "labels")
    labels = stored(own, "labels").unionByName(ring)
    onward = links.select(F.col("other").alias("to"), F.col("node").alias("step"), F.col("other_degree").alias("to_degree"),
                          F.col("since").alias("edge_since"), *[F.col(c).alias("via") for c in ids])
    for hops in range(2, depth + 1):
        if ring.isEmpty():
            break
        reached = ring.select(F.col("node").alias("step"), "landmark", "degree", "since").join(onward, "step")
        reached = reached.where(_better("degree", "landmark", "to_degree", "to")).groupBy("to", "landmark", "degree").agg(
            F.min(F.struct(F.greatest("since", "edge_since").alias("since"), *[F.col("via").alias(c) for c in ids], *steps)).alias("way"))
        reached = stored(reached.select(F.col("to").alias("node"), "landmark", "degree", F.lit(hops).alias("hops"), "way.*"), "reached")
        # a way over a landmark of both that is no longer and exists no later makes the label needless
        mine = labels.select("node", F.col("landmark").alias("over"), F.col("degree").alias("over_degree"), F.col("hops").alias("h1"), F.col("since").alias("s1"))
        its = labels.select(F.col("node").alias("landmark"), F.col("landmark").alias("over"), F.col("hops").alias("h2"), F.col("since").alias("s2"))
        known = reached.select("node", "landmark", "degree", "since").join(mine, "node").where(
            (F.col("over") == F.col("landmark")) | _better("over_degree", "over", "degree", "landmark"))
        known = known.where(F.coalesce(F.col("s1") <= F.col("since"), F.lit(True))).join(its, ["landmark", "over"]).where(
            (F.col("h1") + F.col("h2") <= hops) & F.coalesce(F.col("s2") <= F.col("since"), F.lit(True)))
        ring = stored(reached.join(known.select("node", "landmark").distinct(), ["node", "landmark"], "left_anti"), "labels")
        labels = labels.unionByName(ring)
    return Landmarks(labels.drop("degree"), leaves, depth)


def _anchored(index: Landmarks, pairs: DataFrame) -> DataFrame:
    """(src, dst, a, b, ...): pairs of different nodes with the core nodes next to them, and the hops and edges up to there."""
    ends = pairs.where("src <> dst").select("src", "dst").distinct()
    ids = [c for c in ("edge_id",) if c in index.leaves.columns]
    for end, core in (("src", "a"), ("dst", "b")):
        mine = index.leaves.select(F.col("node").alias(end), F.col("anchor").alias(f"{core}_anchor"), F.col("since").alias(f"{core}_since"),
                                   *[F.col(c).alias(f"{core}_edge") for c in ids])
        ends = ends.join(mine, end, "left").withColumn(core, F.coalesce(f"{core}_anchor", end))
    extra = F.when(F.col("a_anchor").isNull(), 0).otherwise(1) + F.when(F.col("b_anchor").isNull(), 0).otherwise(1)
    return ends.withColumn("extra", extra).drop("a_anchor", "b_anchor")


def _met(index: Landmarks, anchored: DataFrame) -> DataFrame:
    """(a, b, over, h1, h2, since): every way over a landmark of both core nodes."""
    near = index.labels.select(F.col("node").alias("a"), F.col("landmark").alias("over"), F.col("hops").alias("h1"), F.col("since").alias("s1"))
    far = index.labels.select(F.col("node").alias("b"), F.col("landmark").alias("over"), F.col("hops").alias("h2"), F.col("since").alias("s2"))
    met = anchored.select("a", "b").distinct().join(near, "a").join(far, ["b", "over"])
    return met.where(F.col("h1") + F.col("h2") <= index.depth).select("a", "b", "over", "h1", "h2", F.greatest("s1", "s2").alias("since"))


def distances(index: Landmarks, pairs: DataFrame) -> DataFrame:
    """(src, dst, length) of the pairs that are connected within the index's depth; every node reaches itself."""
    anchored = _anchored(index, pairs)
    core = _met(index, anchored).groupBy("a", "b").agg(F.min(F.col("h1") + F.col("h2")).alias("hops"))
    out = anchored.join(core, ["a", "b"]).select("src", "dst", (F.col("hops") + F.col("extra")).alias("length"))
    same = pairs.where("src = dst").select("src", "dst", F.lit(0).alias("length")).distinct()
    return out.where(F.col("length") <= index.depth).unionByName(same)


def distances_over_time(index: Landmarks, pairs: DataFrame) -> DataFrame:
    """(src, dst, length, since): for each length the first time by which such a way exists; null for the node itself."""
    anchored = _anchored(index, pairs)
    core = _met(index, anchored).groupBy("a", "b", (F.col("h1") + F.col("h2")).alias("hops")).agg(F.min("since").alias("since"))
    out = anchored.join(core, ["a", "b"]).select("src", "dst", (F.col("hops") + F.col("extra")).alias("length"),
                                                 F.greatest("since", "a_since", "b_since").alias("since"))
    same = pairs.where("src = dst").select("src", "dst", F.lit(0).alias("length"), F.lit(None).cast(out.schema["since"].dataType).alias("since"))
    return out.where(F.col("length") <= index.depth).unionByName(same.distinct())


def paths(index: Landmarks, pairs: DataFrame) -> DataFrame:
    """(src, dst, length, path): edge ids of a shortest path in order, always the same one.

    The way goes over the best landmark of both ends by (length, hops from src, id); each step follows one label.
    """
    anchored = cut_lineage(_anchored(index, pairs))
    best = _met(index, anchored).groupBy("a", "b").agg(F.min(F.struct((F.col("h1") + F.col("h2")).alias("hops"), "h1", "over")).alias("m"))
    best = cut_lineage(best.select("a", "b", "m.*").withColumn("h2", F.col("hops") - F.col("h1")))
    steps = index.labels.where("hops > 0").select(F.col("node").alias("at"), F.col("landmark").alias("over"), F.col("hops").alias("left"), "edge_id", "step")

    def walked(end: str, hops: str) -> DataFrame:
        """Edge ids from one end to the landmark."""
        state = best.select("a", "b", "over", F.col(end).alias("at"), F.col(hops).alias("left"), F.array().cast("array<string>").alias(f"{end}_path"))
        done = state.where("left = 0")
        for _ in range(index.depth):
            state = cut_lineage(state.where("left > 0").join(steps, ["at", "over", "left"]).select(
                "a", "b", "over", F.col("step").alias("at"), (F.col("left") - 1).alias("left"),
                F.array_append(f"{end}_path", F.col("edge_id")).alias(f"{end}_path")))
            if state.isEmpty():
                break
            done = done.unionByName(state.where("left = 0"))
        return done.select("a", "b", f"{end}_path")

    core = best.join(walked("a", "h1"), ["a", "b"]).join(walked("b", "h2"), ["a", "b"])
    path = F.array_compact(F.concat(F.array("a_edge"), "a_path", F.reverse("b_path"), F.array("b_edge")))
    out = anchored.join(core, ["a", "b"]).select("src", "dst", (F.col("hops") + F.col("extra")).alias("length"), path.alias("path"))
    same = pairs.where("src = dst").select("src", "dst", F.lit(0).alias("length"), F.array().cast("array<string>").alias("path")).distinct()
    return out.where(F.col("length") <= index.depth).unionByName(same)
