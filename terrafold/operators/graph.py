"""Walking graphs: collapse, nearest sources with paths, k nearest sources, components.

A context - a municipality's network - is one group of a grouped map and is
searched there with a heap; contexts run in parallel.  A network larger than a task is
searched by joins instead: labels within a step of the nearest unsettled one are
relaxed together, round by round (delta-stepping).  Components, which may span
everything, are found by joins, too.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.operators.relational import keep_best, top_k
from terrafold.session import forget, shared_dir, stored, workers_import

LABELS = "context string, node string, source string, cost double, next string"


def collapse_graph(edges: DataFrame) -> DataFrame:
    """Directed multigraph (context, u, v, length as text or number) to undirected simple edges, both ways, with the least length.

    A missing length is 0, one that is no number, negative or not finite is skipped, and so are loops.
    """
    length = F.when(F.col("length").isNull(), F.lit(0.0)).otherwise(F.col("length").cast("string").try_cast("double"))
    good = edges.select("context", "u", "v", length.alias("length")).where("length >= 0 AND length < double('infinity') AND NOT isnan(length) AND u <> v")
    one = good.groupBy("context", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("length").alias("length"))
    return one.select("context", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"), "length").select("context", "e.u", "e.v", "length")


def _adjacency(edges: pd.DataFrame) -> dict[str, list[tuple[str, float]]]:
    out: dict[str, list[tuple[str, float]]] = {}
    for u, v, w in zip(edges["u"], edges["v"], edges["length"], strict=True):
        out.setdefault(u, []).append((v, w))
    return out


def _nearest(context: str, edges: pd.DataFrame, seeds: pd.DataFrame) -> list[tuple]:
    """Label of each node reached: least (cost, source); equal within 1e-9 goes to the smaller source."""
    ahead = _adjacency(edges)
    best: dict[str, tuple[float, str, str | None]] = {}
    heap: list[tuple[float, str, str]] = []

    def offer(node: str, cost: float, source: str, toward: str | None) -> None:
        old = best.get(node)
        if old is None or cost < old[0] - 1e-9 or (abs(cost - old[0]) <= 1e-9 and source < old[1]):
            best[node] = (cost, source, toward)
            heapq.heappush(heap, (cost, source, node))

    for node, source, cost in sorted(zip(seeds["node"], seeds["source"], seeds["cost"], strict=True), key=lambda s: (s[2], s[1])):
        offer(node, cost, source, None)
    while heap:
        cost, source, node = heapq.heappop(heap)
        if best[node][:2] == (cost, source):
            for other, length in ahead.get(node, ()):
                offer(other, cost + length, source, node)
    return [(context, node, source, cost, toward) for node, (cost, source, toward) in best.items()]


def _nearest_k(context: str, edges: pd.DataFrame, seeds: pd.DataFrame, k: int) -> list[tuple]:
    """The ``k`` least (cost, source) labels of distinct sources at each node: settled in order, each node takes each source once."""
    ahead = _adjacency(edges)
    settled: dict[str, dict[str, tuple[float, str | None]]] = {}
    heap = [(cost, source, node, "") for node, source, cost in zip(seeds["node"], seeds["source"], seeds["cost"], strict=True)]
    heapq.heapify(heap)
    while heap:
        cost, source, node, toward = heapq.heappop(heap)
        own = settled.setdefault(node, {})
        if source in own or len(own) >= k:
            continue
        own[source] = (cost, toward or None)
        for other, length in ahead.get(node, ()):
            there = settled.get(other)
            if there is None or (source not in there and len(there) < k):
                heapq.heappush(heap, (cost + length, source, other, node))
    return [(context, node, source, cost, toward) for node, own in settled.items() for source, (cost, toward) in own.items()]


def nearest_sources(edges: DataFrame, seeds: DataFrame, k: int = 1) -> DataFrame:
    """(context, node, source, cost, next): the nearest ``k`` sources of each node over edges (context, u, v, length), both ways.

    ``seeds``: context, node, source, cost of the connector.  ``next`` is one step
    towards the source, null at its seed.
    """

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = _nearest(key[0], left, right) if k == 1 else _nearest_k(key[0], left, right, k)
        return pd.DataFrame(rows, columns=["context", "node", "source", "cost", "next"])

    workers_import(edges.sparkSession)
    good = seeds.where("cost >= 0").select("context", "node", "source", F.col("cost").cast("double").alias("cost"))
    # Attributes of their own on either side: seeds are often made from the edges.
    rows, starts = edges.select("context", "u", "v", "length").toDF("context", "u", "v", "length"), good.toDF("context", "node", "source", "cost")
    return rows.groupBy("context").cogroup(starts.groupBy("context")).applyInPandas(search, LABELS)


def _ordered_cost(cost: Column) -> Column:
    """Costs that differ by less than a billionth are equal, so that the smaller source decides."""
    return F.round(cost, 9)


def nearest_by_joins(edges: DataFrame, seeds: DataFrame, k: int = 1, delta: float | None = None, rounds: int = 10_000) -> DataFrame:
    """What :func:`nearest_sources` gives, for networks of any size: (context, node, source, cost, next).

    A label is (context, node, source) with its cost; a node keeps the ``k`` least by
    (cost, source).  Each round takes the labels that changed and lie within the
    current step of ``delta`` (by default four mean edge lengths), offers their cost plus the edge to the
    neighbours, and keeps what is better; a step ends when none in it changes.  Labels are
    written between rounds, so a round's lineage is one join.  An edge is joined
    only with labels that changed; a node with very many edges is dealt out by the
    adaptive join, and offers are combined before they are shuffled.

    ``next`` is the neighbour that the label came from, of several the least by
    (cost, node); over edges of no length it is the one that was there first, so that
    no path is circular; null at the source's seed.  Lengths are at least zero.
    """
    ways = stored(edges.select("context", F.col("u").alias("node"), F.col("v").alias("other"), F.col("length").cast("double").alias("length")), "ways")
    if delta is None:
        mean = ways.agg(F.avg("length")).first()[0]
        delta = 4 * mean if mean else 1.0
    start = seeds.where("cost >= 0").groupBy("context", "node", "source").agg(F.min(F.col("cost").cast("double")).alias("cost"))
    start = stored(start, "seeds")
    best = Window.partitionBy("context", "node").orderBy(_ordered_cost(F.col("cost")), "source")

    def kept(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k).drop("_place")

    labels = stored(kept(start.select("*", F.lit(True).alias("fresh"), F.lit(None).cast("string").alias("via"))), "labels")
    for _ in range(rounds):
        nearest = labels.where("fresh").agg(F.min("cost")).first()[0]
        if nearest is None:
            break
        edge = (math.floor(nearest / delta) + 1) * delta
        now = F.col("fresh") & (F.col("cost") < edge)
        offers = labels.where(now).drop("fresh", "via").join(ways, ["context", "node"]).select("context", F.col("other").alias("node"), "source", (F.col("cost") + F.col("length")).alias("cost"), F.lit(True).alias("fresh"), F.col("node").alias("via"))
        known = labels.select("context", "node", "source", "cost", (F.col("fresh") & ~now).alias("fresh"), "via")
        # Of equal costs the label that is known already stays, so that nothing is relaxed twice.
        by = F.struct(_ordered_cost(F.col("cost")), F.col("fresh"), F.col("cost"), F.col("via"))
        merged = known.unionByName(offers).groupBy("context", "node", "source").agg(F.min_by(F.struct("cost", "fresh", "via"), by).alias("l"))
        new = stored(kept(merged.select("context", "node", "source", "l.cost", "l.fresh", "l.via")), "labels")
        forget(labels)
        labels = new
    else:
        raise RuntimeError(f"labels did not settle in {rounds} rounds")

    done = labels.select("context", "node", "source", "cost", "via")
    there = done.select("context", F.col("node").alias("other"), "source", F.col("cost").alias("_onward"))
    at_seed = start.select("context", "node", "source", F.col("cost").alias("_seed"))
    steps = done.join(ways, ["context", "node"]).join(there, ["context", "other", "source"])
    fits = (_ordered_cost(F.col("_onward") + F.col("length")) == _ordered_cost(F.col("cost"))) & (_ordered_cost(F.col("_onward")) < _ordered_cost(F.col("cost")))
    onward = steps.where(fits).groupBy("context", "node", "source").agg(F.min_by("other", F.struct("_onward", "other")).alias("_next"))
    out = done.join(onward, ["context", "node", "source"], "left").join(at_seed, ["context", "node", "source"], "left")
    seeded = F.coalesce(_ordered_cost(F.col("_seed")) == _ordered_cost(F.col("cost")), F.lit(False))
    result = stored(out.select("context", "node", "source", "cost", F.when(~seeded, F.coalesce("_next", "via")).alias("next")), "nearest")
    for scratch in (labels, ways, start):
        forget(scratch)
    return result


def node_paths(labels: DataFrame, origins: DataFrame) -> DataFrame:
    """(context, node, path): nodes from each origin (context, node) to its source by ``next``; a broken or circular trail is an error."""

    def walk(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        onward = dict(zip(left["node"], left["next"], strict=True))
        owner = dict(zip(left["node"], left["source"], strict=True))
        rows = []
        for node in right["node"]:
            if node not in onward:
                continue
            path, passed, at = [node], {node}, node
            while isinstance(onward[at], str):
                at = onward[at]
                if at in passed or owner[at] != owner[node]:
                    raise ValueError(f"path from {node} is circular or changes its source at {at}")
                path.append(at)
                passed.add(at)
            rows.append((key[0], node, path))
        return pd.DataFrame(rows, columns=["context", "node", "path"])

    workers_import(labels.sparkSession)
    # Attributes of their own on either side: origins are often made from the labels.
    there, asked = labels.select("context", "node", "source", "next").toDF("context", "node", "source", "next"), origins.select("context", "node").toDF("context", "node")
    return there.groupBy("context").cogroup(asked.groupBy("context")).applyInPandas(walk, "context string, node string, path array<string>")


def origin_seeds(origins: DataFrame) -> DataFrame:
    """(mesh_id, context, node, access): one node, or both ends of an edge with the walk along it; a gap has none."""
    node = F.array(F.struct(F.col("node").alias("node"), F.col("connector_m").alias("access")))
    ends = F.array(
        F.struct(F.col("edge_u").alias("node"), (F.col("connector_m") + F.col("along_u_m")).alias("access")),
        F.struct(F.col("edge_v").alias("node"), (F.col("connector_m") + F.col("along_v_m")).alias("access")),
    )
    options = F.when(F.col("origin_method") == "walk_node_within_mesh", node).when(
        F.col("origin_method").isin("walk_edge_intersects_mesh", "nearest_walk_edge_fallback"), ends
    )
    return origins.select("mesh_id", "context", F.inline(options))


def choose_origin(seeds: DataFrame, labels: DataFrame) -> DataFrame:
    """The origin's best (total, source, node) and its parts: access, network and connector add up to the total."""
    joined = seeds.join(labels, ["context", "node"]).withColumn("total", F.col("access") + F.col("cost"))
    return keep_best(joined, ["mesh_id"], [F.col("total"), F.col("source"), F.col("node")]).select("mesh_id", "context", "node", "source", "access", F.col("cost").alias("from_node"), "total")


def rank_candidates(seeds: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """Per mesh the best total for each source, then the first ``k`` by (total, source, node)."""
    joined = seeds.join(labels, ["context", "node"]).withColumn("total", F.col("access") + F.col("cost"))
    best = keep_best(joined, ["mesh_id", "source"], [F.col("total"), F.col("node")])
    return top_k(best, ["mesh_id"], [F.col("total"), F.col("source"), F.col("node")], k, "candidate_rank").select("mesh_id", "source", "candidate_rank", "access", "total")


def dedupe_by_node(snapped: DataFrame) -> DataFrame:
    """One candidate (common_id, node, connector_m) per node: least connector, then id; with the number dropped."""
    counted = snapped.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return keep_best(snapped, ["node"], [F.col("connector_m"), F.col("common_id")]).join(counted, "node").withColumn("duplicates", F.col("n") - 1).drop("n")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(context, node, component): component is the smallest node of the connected part.  Minimum labels spread by joins, with shortcuts, until nothing changes."""
    shared_dir(edges.sparkSession)  # checkpoints go there
    both = edges.select("context", "u", "v").unionByName(edges.select("context", F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy("context", F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), ["context", "v"]).groupBy("context", F.col("u").alias("node")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, ["context", "node"]).select("context", "node", F.col("component").alias("before"), F.least("component", "m").alias("c"))
        jump = hooked.select("context", F.col("node").alias("c"), F.col("c").alias("further"))
        new = hooked.join(jump, ["context", "c"], "left").select("context", "node", "before", F.least("c", F.coalesce("further", "c")).alias("component")).checkpoint()
        changed = new.where("before <> component").limit(1).count()
        labels = new.select("context", "node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def component_sizes(labels: DataFrame, first: int = 10) -> DataFrame:
    """Per context: components, nodes, share of the largest and the largest sizes."""
    sizes = labels.groupBy("context", "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("context").agg(
        F.count(F.lit(1)).alias("components"),
        F.sum("n").alias("nodes"),
        (F.max("n") / F.sum("n")).alias("largest_share"),
        F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, first).alias("largest"),
    )
