"""Alert clustering.

``overlap_links`` / ``components`` / ``fold_clusters`` are the parallel path: the same overlap rule,
closed transitively.  ``greedy_clusters`` keeps the order-dependent rule (best open cluster wins) and
streams sorted alerts through a small open-cluster state, without loading a group.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from watchtide import fixed
from watchtide.operators.windows import SECOND, sessionize
from watchtide.session import cut_lineage

WINDOW = fixed.CLUSTER_WINDOW_SECONDS * SECOND


def signatures(alerts: DataFrame, t: str = "ts_us") -> DataFrame:
    """Alerts with equal item sets in one window-wide bucket, folded to one row.

    ``alerts``: tenant_id, alert_id, t and ``items`` (distinct entity and technique ids).  Equal sets
    overlap fully, so all alerts of such a row belong together.  An alert without items overlaps with
    nothing and gets a signature of its own.
    """
    items = F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))))
    base = alerts.withColumn("items", items).withColumn("bucket", F.floor(F.col(t) / WINDOW).cast("long"))
    base = base.withColumn("sig", F.sha2(F.concat_ws("\x1f", F.col("tenant_id"), F.col("bucket").cast("string"), F.concat_ws("\x1f", "items"),
        F.when(F.size("items") == 0, F.col("alert_id").cast("string"))), 256))
    return base


def _sized(sigs: DataFrame, *more: str) -> DataFrame:
    return sigs.select("tenant_id", "sig", "bucket", "items", "lo", "hi", *more, F.size("items").alias("size")).where("size > 0")


def overlap_links(sigs: DataFrame, threshold: float = fixed.OVERLAP_THRESHOLD, keep: Sequence[str] = (),
                  sizes: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(a, b, jaccard): overlapping signature rows of one bucket, or of two neighboring ones within the window.

    Items are ordered rarest first; two sets that reach the threshold share an item among the first
    n - ceil(threshold * n) + 1 of each, so only these are joined on.  An item that most alerts carry
    comes last and is hardly ever a key.  Sizes and times are compared before the items are.  A pair comes out at the
    first item the two sets share and nowhere else, so pairs are never shuffled, however many there are.

    ``sigs``: tenant_id, sig (any unique orderable value), bucket, items, lo, hi (first and last time).  Columns named in
    ``keep`` come along as ``<name>_a`` and ``<name>_b``; ``sizes`` limits the pairs to some set sizes.
    """
    sized = _sized(sigs, *keep)
    each = sized.select("tenant_id", "sig", F.explode("items").alias("item"))
    named = cut_lineage(each.groupBy("tenant_id", "item").agg(F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id()))
    ranked = each.join(named, ["tenant_id", "item"])
    order = ranked.groupBy("tenant_id", "sig").agg(F.array_sort(F.collect_list(F.struct("n", "no"))).alias("o"))  # the items of one row
    first = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
    keyed = sized.drop("items").join(order, ["tenant_id", "sig"]).withColumn("o", F.transform("o", lambda x: x["no"])).withColumn(
        "key", F.explode(F.slice("o", F.lit(1), first)))
    early = keyed.withColumn("slot", F.explode(F.array("bucket", F.col("bucket") + 1))).select(
        "tenant_id", "key", "slot", *[F.col(c).alias(f"{c}_a") for c in dict.fromkeys(("sig", "bucket", "o", "hi", "size", *keep))])
    late = keyed.select("tenant_id", "key", F.col("bucket").alias("slot"), *[F.col(c).alias(f"{c}_b") for c in dict.fromkeys(("sig", "o", "lo", "size", *keep))])
    same = (F.col("bucket_a") == F.col("slot")) & (F.col("sig_a") < F.col("sig_b"))
    next_ = (F.col("bucket_a") < F.col("slot")) & (F.col("lo_b") - F.col("hi_a") <= WINDOW)
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-9
    if sizes is not None:
        fits = fits & sizes(F.col("size_a"), F.col("size_b"))
    pairs = early.join(late, ["tenant_id", "key", "slot"]).where((same | next_) & fits).withColumn("both", F.array_intersect("o_a", "o_b"))
    pairs = pairs.where(F.element_at("both", 1) == F.col("key"))
    common = F.size("both")
    jaccard = common / (F.col("size_a") + F.col("size_b") - common)
    out = pairs.select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b"), jaccard.alias("jaccard"), *[f"{c}{x}" for c in keep for x in ("_a", "_b")])
    return out.where(F.col("jaccard") >= threshold)


def _enough(x: Column, y: Column, threshold: float) -> Column:
    """Whether one shared item makes sets of these sizes overlap."""
    return 1 / (x + y - 1) >= threshold


def spanning_links(sigs: DataFrame, threshold: float = fixed.OVERLAP_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(owners, links): few links with the components of :func:`overlap_links`; their number grows with the items of ``sigs``.

    Where one shared item makes sets of a size overlap, all that share it in a bucket are one group and its
    smallest ``sig`` stands for them; ``owners`` (sig, node) names what stands for each row.  Groups of one item meet
    in their bucket, and in the next one when the last time of one and the first of the other lie within the window.
    Only pairs of sizes that need two shared items or more are looked for one by one.
    """
    members = _sized(sigs).select("tenant_id", "bucket", "sig", "size", "lo", "hi", F.explode("items").alias("item"))
    size = F.col("size")
    alone = _enough(size, size, threshold)
    group = ["tenant_id", "bucket", "item", "size"]
    groups = cut_lineage(members.where(alone).groupBy(*group).agg(F.min("sig").alias("node"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    nodes = members.where(alone).select(*group, "sig").join(groups.select(*group, "node"), group).groupBy("sig").agg(
        F.min("node").alias("node"), F.collect_set("node").alias("all"))  # the items of one row
    nodes = cut_lineage(nodes)
    owners = sigs.select("sig").join(nodes.select("sig", "node"), "sig", "left").withColumn("node", F.coalesce("node", "sig"))
    links = nodes.select(F.explode("all").alias("a"), F.col("node").alias("b"))
    units = groups.withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).unionByName(
        members.where(~alone).withColumnRenamed("sig", "node").withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))))
    hubs = groups.select("tenant_id", "item", F.col("bucket").alias("slot"), *[F.col(c).alias(f"{c}_h") for c in ("size", "node", "lo", "hi")])
    near = (F.col("step") == 0) | ((F.col("step") == 1) & (F.col("lo_h") - F.col("hi") <= WINDOW)) | (
        (F.col("step") == -1) & (F.col("lo") - F.col("hi_h") <= WINDOW))
    links = links.unionByName(units.withColumn("slot", F.col("bucket") + F.col("step")).join(hubs, ["tenant_id", "item", "slot"]).where(
        near & _enough(size, F.col("size_h"), threshold)).select(F.col("node").alias("a"), F.col("node_h").alias("b")))
    links = links.where("a <> b")

    found = [r[0] for r in members.select("size").distinct().collect()]  # sizes of sets, not sets
    more = [x for x in found if any(1 / (x + y - 1) < threshold and min(x, y) >= max(x, y) * threshold - 1e-9 for y in found)]
    if more:
        rest = overlap_links(sigs.where(F.size("items").isin(more)), threshold, sizes=lambda x, y: ~_enough(x, y, threshold))
        rest = rest.join(owners.toDF("a", "node_a"), "a").join(owners.toDF("b", "node_b"), "b")
        links = links.unionByName(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    return owners, links


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component): smallest id reachable over ``links`` (a, b).

    Alternates large-star and small-star steps, each one aggregate and one join, until the links stop
    changing; rounds grow with the logarithm of the component size, not with its diameter.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    found = edges.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.select("id").distinct().join(found, F.col("id") == F.col("a"), "left").select(
        "id", F.coalesce("component", "id").alias("component"))


def overlap_components(alerts: DataFrame, t: str = "ts_us", threshold: float = fixed.OVERLAP_THRESHOLD) -> DataFrame:
    """Alerts with ``cluster_id``: the smallest alert id they reach over overlapping alerts in time."""
    tagged = signatures(alerts, t).withColumnRenamed("sig", "of")
    sigs = tagged.groupBy("tenant_id", "of", "bucket").agg(
        F.first("items").alias("items"), F.min(t).alias("lo"), F.max(t).alias("hi"), F.min("alert_id").alias("first_alert"))
    sigs = cut_lineage(sigs.withColumn("sig", F.monotonically_increasing_id()))  # numbers for the many rounds
    owners, links = spanning_links(sigs, threshold)
    owners = cut_lineage(owners)
    comp = components(owners.select(F.col("node").alias("id")), links)
    named = sigs.select("of", "sig", "first_alert").join(owners, "sig").join(comp, F.col("node") == F.col("id"))
    label = named.groupBy("component").agg(F.min("first_alert").alias("cluster_id"))
    member = named.select("of", "component").join(label, "component").select("of", "cluster_id")
    return tagged.join(member, "of").drop("of", "bucket")


def fold_clusters(clustered: DataFrame, t: str = "ts_us") -> DataFrame:
    """Cluster roll-up: alert count, best score with its severity, technique union, last update.

    Techniques are bounded by the catalog and stay an array; entities and alerts stay rows (see
    :func:`cluster_items`).
    """
    base = clustered.groupBy("tenant_id", "cluster_id").agg(
        F.count("*").alias("alerts"), F.min(t).alias("created_us"), F.max(t).alias("updated_us"),
        F.max("calibrated_score").alias("calibrated_score"),
        F.max_by("severity", F.struct("calibrated_score", F.negate(t))).alias("severity"))
    tech = clustered.select("cluster_id", F.explode("technique_ids").alias("x")).groupBy("cluster_id").agg(
        F.array_sort(F.collect_set("x")).alias("technique_ids"))
    out = base.join(tech, "cluster_id", "left")
    return out.withColumn("priority", F.floor(F.round(F.col("calibrated_score") * 100, 6)).cast("int"))


def cluster_items(clustered: DataFrame) -> DataFrame:
    return clustered.select("cluster_id", F.explode("items").alias("item")).distinct()


# --- order-dependent clustering -----------------------------------------------------------------

MEMO = 100_000  # item sets whose last decision is kept at a time


class OpenClusters:
    """Open clusters of one tenant; an item index finds candidates, idle clusters are evicted.

    An alert costs the same however many clusters are open: idle ones come off a heap, and the decision for an item set is
    kept until a cluster with one of its items is opened, grows or closes (``changes`` counts that for each item).
    """

    def __init__(self, threshold: float, window: int):
        self.threshold, self.window = threshold, window
        self.clusters: dict[str, list] = {}      # id -> [created order, last time, item set]
        self.by_item: dict[str, set[str]] = {}
        self.order = 0
        self.idle: list[tuple[int, str]] = []    # heap: for each cluster an entry no later than its last time
        self.changes: dict[str, int] = {}
        self.decided: dict[tuple, tuple[int, list, str]] = {}  # items -> changes of its items then, cluster, its id

    def to_json(self) -> str:
        return json.dumps({"order": self.order, "clusters": {c: [v[0], v[1], sorted(v[2])] for c, v in self.clusters.items()}})

    @classmethod
    def from_json(cls, doc: str, threshold: float, window: int) -> OpenClusters:
        data = json.loads(doc)
        out = cls(threshold, window)
        out.order = data["order"]
        for cid, (order, last, items) in data["clusters"].items():
            out.clusters[cid] = [order, last, set(items)]
            out.idle.append((last, cid))
            for item in items:
                out.by_item.setdefault(item, set()).add(cid)
        heapq.heapify(out.idle)
        return out

    def _changed(self, items: set[str]) -> None:
        for item in items:
            self.changes[item] = self.changes.get(item, 0) + 1

    def _drop(self, cid: str) -> None:
        gone = self.clusters.pop(cid)[2]
        self._changed(gone)
        for item in gone:
            self.by_item[item].discard(cid)
            if not self.by_item[item]:
                del self.by_item[item]

    def _close(self, before: int) -> None:
        while self.idle and self.idle[0][0] < before:
            cid = heapq.heappop(self.idle)[1]
            entry = self.clusters.get(cid)
            if entry is not None and entry[1] < before:
                self._drop(cid)
            elif entry is not None:
                heapq.heappush(self.idle, (entry[1], cid))

    def _best(self, mine: set[str]) -> str | None:
        """The cluster with the highest overlap, of equal ones the oldest."""
        shared: dict[str, int] = {}
        for item in mine:
            for cid in self.by_item.get(item, ()):
                shared[cid] = shared.get(cid, 0) + 1
        best, best_score, best_order = None, 0.0, 0
        for cid, common in shared.items():
            order, _, have = self.clusters[cid]
            score = common / (len(have) + len(mine) - common)
            if score >= self.threshold and (score > best_score or (score == best_score and order < best_order)):
                best, best_score, best_order = cid, score, order
        return best

    def assign(self, alert_id: str, t: int, items: list[str]) -> str:
        if self.idle and self.idle[0][0] < t - self.window:
            self._close(t - self.window)
        key = tuple(items)
        changes = self.changes
        known = self.decided.get(key)
        if known is not None:
            now = 0
            for item in key:
                now += changes.get(item, 0)
            if now == known[0]:  # its cluster holds all of its items since then
                entry = known[1]
                if t < entry[1]:
                    heapq.heappush(self.idle, (t, known[2]))
                entry[1] = t
                return known[2]
        mine = set(items)
        best = self._best(mine)
        if best is None:
            best = alert_id
            if best in self.clusters:
                self._drop(best)
            self.clusters[best] = [self.order, t, set()]
            heapq.heappush(self.idle, (t, best))
            self.order += 1
        entry = self.clusters[best]
        if t < entry[1]:
            heapq.heappush(self.idle, (t, best))
        entry[1] = t
        if not mine <= entry[2]:
            entry[2] |= mine
            self._changed(entry[2])
            for item in mine:
                self.by_item.setdefault(item, set()).add(best)
        if key:  # alerts without items open a cluster each
            if len(self.decided) >= MEMO:
                self.decided.clear()
            self.decided[key] = (sum(changes.get(item, 0) for item in key), entry, best)
        return best


def _fold_greedy(threshold: float, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            ids = []
            for tenant, epoch, t, alert_id, items in zip(pdf["tenant_id"], pdf["epoch"], pdf["t"], pdf["alert_id"], pdf["items"]):
                if (tenant, epoch) != key:
                    key, state = (tenant, epoch), OpenClusters(threshold, window)
                ids.append(state.assign(alert_id, int(t), list(items)))
            yield pd.DataFrame({"tenant_id": pdf["tenant_id"], "alert_id": pdf["alert_id"], "cluster_id": ids})
    return run


def greedy_clusters(alerts: DataFrame, t: str = "ts_us", threshold: float = fixed.OVERLAP_THRESHOLD) -> DataFrame:
    """Assign each alert, in (time, id) order, to the open cluster it overlaps with most.

    Work is split wherever a tenant is silent for longer than the cluster window, because every
    cluster has closed by then.  Within such an epoch the rule is sequential by definition; alerts are
    streamed in order and only clusters of the last window are held.
    """
    rows = sessionize(alerts.select("tenant_id", "alert_id", F.col(t).alias("t"), "items"), ["tenant_id"], "t",
                      fixed.CLUSTER_WINDOW_SECONDS, "epoch")
    ordered = rows.repartition("tenant_id", "epoch").sortWithinPartitions("tenant_id", "epoch", "t", "alert_id")
    return ordered.mapInPandas(_fold_greedy(threshold, WINDOW), "tenant_id string, alert_id string, cluster_id string")
