import random

import pytest

from terrafold.operators import graph

EDGES = "context string, u string, v string, length string"
SEEDS = "context string, node string, source string, cost double"


def test_multi_source_and_path(spark):
    edges = graph.collapse_graph(spark.createDataFrame([("m", "a", "b", "100"), ("m", "b", "c", "100"), ("m", "c", "b", "150"), ("m", "a", "c", "bad")], EDGES))
    seeds = spark.createDataFrame([("m", "a", "S1", 50.0), ("m", "c", "S2", 10.0)], SEEDS)
    labels = graph.nearest_sources(edges, seeds)
    got = {r.node: (r.source, r.cost) for r in labels.collect()}
    assert got == {"a": ("S1", 50.0), "b": ("S2", 110.0), "c": ("S2", 10.0)}
    paths = graph.node_paths(labels, spark.createDataFrame([("m", "b")], "context string, node string"))
    assert paths.first().path == ["b", "c"]


def test_k_labels(spark):
    edges = graph.collapse_graph(spark.createDataFrame([("m", "o", "x", "100"), ("m", "x", "a", "100"), ("m", "x", "b", "200"), ("m", "x", "c", "300")], EDGES))
    seeds = spark.createDataFrame([("m", n, n.upper(), 10.0) for n in "abc"], SEEDS)
    got = {r.source: r.cost for r in graph.nearest_sources(edges, seeds, k=2).where("node = 'o'").collect()}
    assert got == {"A": 210.0, "B": 310.0}


def test_against_relaxation(spark):
    rng = random.Random(4)
    nodes = [f"n{i}" for i in range(30)]
    rows = [("m", *rng.sample(nodes, 2), str(rng.randint(1, 50))) for _ in range(70)]
    seeds = [("m", n, f"S{n}", float(rng.randint(0, 9))) for n in rng.sample(nodes, 5)]
    best = {(n, s): c for _, n, s, c in seeds}
    for _ in nodes:
        for _, u, v, w in rows:
            for a, b in ((u, v), (v, u)):
                for (n, s), c in list(best.items()):
                    if n == a and c + int(w) < best.get((b, s), 1e18):
                        best[b, s] = c + int(w)
    per = {}
    for (n, s), c in best.items():
        per.setdefault(n, []).append((c, s))
    edges = graph.collapse_graph(spark.createDataFrame(rows, EDGES))
    sd = spark.createDataFrame(seeds, SEEDS)
    assert {r.node: (r.cost, r.source) for r in graph.nearest_sources(edges, sd).collect()} == {n: min(v) for n, v in per.items()}
    k3 = {}
    for r in graph.nearest_sources(edges, sd, k=3).collect():
        k3.setdefault(r.node, []).append((r.cost, r.source))
    assert {n: sorted(v) for n, v in k3.items()} == {n: sorted(v)[:3] for n, v in per.items()}


def test_components_and_dedupe(spark):
    edges = spark.createDataFrame([("m", "b", "a", "1"), ("m", "b", "c", "1"), ("m", "e", "d", "1")], EDGES)
    labels = graph.components(edges)
    assert {r.node: r.component for r in labels.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    sizes = graph.component_sizes(labels).first()
    assert (sizes.components, sizes.nodes, sizes.largest, sizes.largest_share) == (2, 5, [3, 2], 0.6)
    snapped = spark.createDataFrame([("E2", "n", 25.0), ("E1", "n", 25.0), ("E3", "n", 20.0), ("E4", "m", 30.0)], "common_id string, node string, connector_m double")
    assert {r.node: (r.common_id, r.duplicates) for r in graph.dedupe_by_node(snapped).collect()} == {"n": ("E3", 2), "m": ("E4", 0)}


def test_origin_choice(spark):
    origins = spark.createDataFrame([("m1", "c", "walk_edge_intersects_mesh", None, 10.0, "u", "v", 10.0, 60.0), ("m2", "c", "network_coverage_gap", None, None, None, None, None, None)], "mesh_id string, context string, origin_method string, node string, connector_m double, edge_u string, edge_v string, along_u_m double, along_v_m double")
    labels = spark.createDataFrame([("c", "u", "S1", 500.0, None), ("c", "v", "S2", 100.0, None)], graph.LABELS)
    rows = graph.choose_origin(graph.origin_seeds(origins), labels).collect()
    assert [(r.mesh_id, r.node, r.source, r.access, r.total) for r in rows] == [("m1", "v", "S2", 70.0, 170.0)]


@pytest.mark.parametrize(("seed", "k", "delta"), [(1, 1, None), (2, 3, 4.0), (3, 1, 1000.0), (4, 2, 0.5)])
def test_search_by_joins_gives_what_the_heap_gives(spark, seed, k, delta):
    rng = random.Random(seed)
    edges, seeds = [], []
    for c in "xy":
        for _ in range(90):
            u, v = rng.sample([f"n{i:02}" for i in range(40)], 2)
            edges.append((c, u, v, rng.choice([0.0, 1.0, 1.0, 2.0, 2.5])))
        edges.append((c, "far", "away", 1.0))  # reached by none
        seeds += [(c, n, f"s{i}", rng.choice([0.0, 1.0, 3.0])) for i, n in enumerate(rng.sample([f"n{i:02}" for i in range(40)], 6))]
        seeds += [(c, seeds[-1][1], "s0b", seeds[-1][3]), (c, "n01", "bad", -1.0)]
    net = graph.collapse_graph(spark.createDataFrame(edges, "context string, u string, v string, length double"))
    starts = spark.createDataFrame(seeds, "context string, node string, source string, cost double")
    heap = {(r.context, r.node, r.source): r for r in graph.nearest_sources(net, starts, k).collect()}
    joins = {(r.context, r.node, r.source): r for r in graph.nearest_by_joins(net, starts, k, delta).collect()}
    assert heap.keys() == joins.keys() and len(heap) > 70
    length = {(r.context, r.u, r.v): r.length for r in net.collect()}
    for key, r in joins.items():
        assert r.cost == pytest.approx(heap[key].cost, abs=1e-9)
        assert (r.next is None) == (heap[key].next is None)
        if r.next is not None:  # of several ways that are as short each search may give its own
            assert joins[key[0], r.next, key[2]].cost + length[key[0], key[1], r.next] == pytest.approx(r.cost, abs=1e-9)
    for (c, node, source), r in joins.items():  # each trail ends at a seed
        passed = [node]
        while joins[c, passed[-1], source].next is not None:
            passed.append(joins[c, passed[-1], source].next)
            assert len(passed) == len(set(passed))
    alone = graph.nearest_by_joins(net.where("false"), starts, k, delta).collect()
    assert {(r.context, r.node) for r in alone} == {(c, n) for c, n, _, cost in seeds if cost >= 0} and all(r.next is None for r in alone)
    assert graph.nearest_by_joins(net, starts.where("false"), k, delta).count() == 0
