import itertools
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrafold.operators import allocation as A

CANDS = [("m1", 1, "A", 100.0), ("m1", 2, "B", 300.0), ("m2", 1, "A", 120.0), ("m2", 2, "B", 180.0)]


def tables(spark, b=10.0):
    cands = spark.createDataFrame(CANDS, "mesh_id string, candidate_rank int, shelter_key string, total_walking_distance_m double")
    mesh = spark.createDataFrame([("m1", 8.0, 10.0), ("m2", 8.0, 12.0)], "mesh_id string, area double, whole double")
    caps = spark.createDataFrame([("A", 10.0), ("B", b)], "shelter_key string, capacity double")
    return cands, mesh, caps


def summary(spark, runs, **k):
    cands, mesh, caps = tables(spark, **k)
    return {r.run_id: r for r in A.allocation_summary(A.allocate(cands, mesh, caps, runs), A.prepare_candidates(cands, caps)).collect()}


def test_reference_cases(spark):
    got = summary(spark, [("r", "area", 10, 0.0), ("w", "whole", 10, 0.0)])
    assert (got["r"].served_demand, got["r"].unserved_demand) == (16.0, 0.0)
    assert (got["w"].served_demand, got["w"].unserved_demand) == (20.0, 2.0)
    got = summary(spark, [("r", "area", 10, 0.0), ("p", "area", 10, 6.0)], b=None)
    assert (got["r"].served_demand, got["r"].unserved_demand, got["r"].known_capacity_shelters) == (10.0, 6.0, 1)
    assert (got["p"].unserved_demand, got["p"].added_capacity_used) == (0.0, 6.0)


def test_budgets_are_monotone_and_statuses(spark):
    got = summary(spark, [(f"b{b}", "whole", 10, float(b)) for b in (0, 1, 2, 5)])
    assert [got[f"b{b}"].unserved_demand for b in (0, 1, 2, 5)] == [2.0, 1.0, 0.0, 0.0]
    cands, mesh, caps = tables(spark, b=None)
    flow = A.allocate(cands, mesh, caps, [("r", "area", 10, 0.0)])
    rows = {r.mesh_id: r.allocation_status for r in A.mesh_results(flow, A.prepare_candidates(cands, caps)).collect()}
    assert rows["m1"] == "nearest_known_capacity" and rows["m2"] == "capacity_constrained_partial"


def test_bad_input_is_an_error(spark):
    cands, mesh, caps = tables(spark)
    run = [("r", "area", 10, 0.0)]
    more = lambda *rows: cands.unionByName(spark.createDataFrame(list(rows), cands.schema))
    lacking = spark.createDataFrame([("m1", None, 1.0)], mesh.schema)
    cases = [
        (more(("m1", 3, "A", 5.0)), mesh, "duplicate mesh and shelter"),
        (more(("m1", 4, "C", 5.0)), mesh, "ranks are not 1..n"),
        (cands, lacking, "demand is missing or negative"),
        (cands, mesh.withColumn("area", -mesh["area"]), "demand is missing or negative"),
        (cands, mesh.unionByName(mesh), "duplicate mesh"),
    ]
    for c, m, said in cases:
        with pytest.raises(ValueError, match=said):
            A.allocate(c, m, caps, run)
    with pytest.raises(ValueError, match="duplicate capacity"):
        A.allocate(cands, mesh, caps.unionByName(caps), run)
    # A candidate without a distance, or below zero, is not usable; the rest must still be 1..n.
    unusable = more(("m1", 3, "C", None), ("m2", 3, "C", -1.0))
    assert A.allocate(unusable, mesh, caps, run).where("shelter_key = 'C'").count() == 0


def test_statuses_shelters_and_plan(spark):
    cands, mesh, caps = tables(spark)
    prepared = A.prepare_candidates(cands, caps)
    flow = spark.createDataFrame([("r", "m1", "B", 80, False), ("r", "m2", "A", 50, False), ("r", "m2", "B", 30, False), ("r", "", "A", 20, True), ("r", "", "B", 20, True)], A.FLOW)
    rows = {r.mesh_id: r for r in A.mesh_results(flow, prepared).collect()}
    assert rows["m1"].allocation_status == "capacity_constrained_rerouted" and rows["m1"].additional_distance_m == 200.0
    assert rows["m2"].allocation_status == "capacity_constrained_split" and rows["m2"].dominant_shelter == "A"
    shelters = {r.shelter_key: r for r in A.shelter_results(flow, prepared).collect()}
    assert (shelters["B"].effective_capacity, shelters["B"].allocated_demand, shelters["B"].saturated) == (12.0, 11.0, False)
    assert [(r.plan_rank, r.shelter_key) for r in A.investment_plan(flow, prepared).orderBy("plan_rank").collect()] == [(1, "B"), (2, "A")]
    status = lambda units, shelter: next(r for r in A.mesh_results(spark.createDataFrame([("r", "m1", shelter, units, False)], A.FLOW), prepared).collect()).allocation_status
    assert status(0, None) == "zero_demand" and status(5, None) == "capacity_constrained_unserved" and status(5, "A") == "nearest_known_capacity"
    none = A.prepare_candidates(cands.where("false"), caps)
    assert A.mesh_results(spark.createDataFrame([("r", "m1", None, 5, False)], A.FLOW), none).first().allocation_status == "route_unavailable_or_no_candidate"
    unknown = A.prepare_candidates(cands, caps.where("false"))
    assert A.mesh_results(spark.createDataFrame([("r", "m1", None, 5, False)], A.FLOW), unknown).first().allocation_status == "unknown_capacity_only"


def cost(pairs, units, dist):
    unserved = int(A.UNSERVED_M * A.SCALE) * A.TIES
    return sum(n * (dist[p] if p[1] else unserved) for p, n in pairs.items())


def test_flow_is_optimal_by_enumeration():
    rng = random.Random(2)
    for _ in range(25):
        meshes, shelters = range(3), "XY"
        units = {m: rng.randint(0, 3) for m in meshes}
        caps = {s: rng.randint(1, 4) for s in shelters}
        dist = {(m, s): rng.randint(1, 50) for m in meshes for s in shelters}
        rows = [(f"m{m}", units[m], s, dist[m, s], caps[s]) for m in meshes for s in shelters]
        flow = A.PartFlow(pd.DataFrame(rows, columns=["mesh_id", "units", "shelter_key", "cost", "capacity"]))
        for extra in range(4):  # each unit of added capacity in turn, at a cost of 1
            given = sum(n for *_, n, added in flow.rows() if added)
            total = cost({(int(m[1:]), s): n for m, s, n, added in flow.rows() if not added}, units, dist) + given
            best = None
            options = [[(x, y) for x in range(u + 1) for y in range(u + 1 - x)] for u in units.values()]
            for choice in itertools.product(*options):
                over = sum(max(0, sum(c[i] for c in choice) - caps[s]) for i, s in enumerate(shelters))
                if over <= extra:
                    pairs = {(m, s): c for m, ch in zip(meshes, choice, strict=True) for s, c in zip(shelters, ch, strict=True)}
                    pairs |= {(m, None): units[m] - sum(ch) for m, ch in zip(meshes, choice, strict=True)}
                    value = cost(pairs, units, dist) + over
                    best = value if best is None else min(best, value)
            assert total == best == flow.cost and given <= extra
            flow.widen(1)


def one_solve(units, arcs, caps, budget, each):
    """Least cost of a whole run in one network with a pool of added capacity."""
    net = A.MinCostFlow()
    source, sink, lost, pool = (net.node() for _ in range(4))
    net.arc(lost, sink, sum(units.values()), 0)
    net.arc(pool, sink, budget, 0)
    m, s = {k: net.node() for k in units}, {k: net.node() for k in caps}
    for k, n in units.items():
        net.arc(source, m[k], n, 0)
        net.arc(m[k], lost, n, A.UNSERVED_COST)
    for k, n in caps.items():
        net.arc(s[k], sink, n, 0)
        net.arc(s[k], pool, budget if each is None else min(budget, each), 1)
    for (mesh, shelter), c in arcs.items():
        net.arc(m[mesh], s[shelter], units[mesh], c)
    return net.solve(source, sink)


def one_part(rng, n, m, tight):
    """Demand, costs and capacities of one linked part: everybody chooses among ten neighbours on a line."""
    units = {f"m{i:05d}": rng.randint(1, 9) for i in range(n)}
    caps = {f"s{j:04d}": max(1, int(5 * n / m * tight * rng.random() * 2)) for j in range(m)}
    arcs = {}
    for i, mesh in enumerate(units):
        first = i * m // n
        for k, j in enumerate(sorted(rng.sample(range(max(0, first - 8), min(m, first + 8)), 5))):
            arcs[mesh, f"s{j:04d}"] = rng.randint(10, 4000) * 100 + k + 1
    rows = [(mesh, units[mesh], s, c, caps[s]) for (mesh, s), c in arcs.items()]
    return units, arcs, caps, pd.DataFrame(rows, columns=["mesh_id", "units", "shelter_key", "cost", "capacity"])


def test_widening_step_by_step_is_one_solve_with_each_budget():
    rng = random.Random(5)
    for tight, each in ((0.5, None), (0.9, None), (1.3, None), (0.7, 3)):
        units, arcs, caps, rows = one_part(rng, 60, 16, tight)
        flow, given = A.PartFlow(rows, each), 0
        for budget in (0, 1, 7, 40, 41, 300, 5000):
            while given < budget and (step := flow.widen(budget - given)):
                given += step[1]
            assert flow.cost == one_solve(units, arcs, caps, budget, each)
            used = flow.rows()
            assert flow.lost_units() == sum(n for _, s, n, added in used if s is None) and given == sum(n for *_, n, added in used if added)
            total = cost({(m, s): n for m, s, n, added in used if not added}, units, arcs)
            assert total + given == flow.cost


def test_searches_stay_near_their_mesh(monkeypatch):
    pops = []
    pop = A.heapq.heappop
    monkeypatch.setattr(A.heapq, "heappop", lambda heap: pops.append(1) or pop(heap))
    flow = A.PartFlow(one_part(random.Random(9), 3000, 300, 1.2)[3])
    assert len(pops) < 60 * 3000  # each search over all nodes: millions
    while flow.widen(500):
        pass
    assert flow.lost_units() == 0


@pytest.mark.parametrize(("seed", "each"), [(1, None), (2, 0.7), (3, None)])
def test_parts_share_the_budget_as_one_solve_does(spark, seed, each):
    rng = random.Random(seed)
    meshes, shelters = [f"m{i}" for i in range(40)], [f"s{i}" for i in range(14)]
    demand = {m: rng.choice([0.0, 0.3, 1.2, 2.5]) for m in meshes}
    caps = {s: rng.choice([0.4, 1.0, 2.0]) for s in shelters}
    caps["s3"], caps["s5"] = None, 0.0
    rows = []
    for i, m in enumerate(meshes[:-3]):  # the last have no candidate; the others choose among neighbours, so there are several parts
        near = rng.sample([s for j, s in enumerate(shelters) if j // 4 == i % 4], rng.randint(1, 2))
        rows += [(m, k + 1, s, float(rng.choice([10, 20, 30, 45])) + 5 * k) for k, s in enumerate(near)]
    cands = spark.createDataFrame(rows, "mesh_id string, candidate_rank int, shelter_key string, total_walking_distance_m double")
    mesh = spark.createDataFrame(list(demand.items()), "mesh_id string, d double")
    capacities = spark.createDataFrame(list(caps.items()), "shelter_key string, capacity double")
    runs = [(f"k{k}b{b}", "d", k, b) for k in (1, 2) for b in (0.0, 0.1, 1.0, 3.3, 50.0)]
    flow = A.allocate(cands, mesh, capacities, runs, each)
    got = {r.run_id: r for r in A.allocation_summary(flow, A.prepare_candidates(cands, capacities)).collect()}
    curves = A.capacity_curves(cands, mesh, capacities, runs, each)
    merged = {r.run_id: r for r in A.merged_curves(curves, runs).collect()}
    assert curves.select("k", "part").distinct().count() > 6
    units = {m: round(d * 10) for m, d in demand.items()}
    for run, _, k, b in runs:
        arcs = {(m, s): round(x * 10) * 100 + r for m, r, s, x in rows if r <= k and caps[s]}
        want = one_solve(units, arcs, {s: round(c * 10) for s, c in caps.items() if c}, round(b * 10), None if each is None else round(each * 10))
        assert int(got[run].objective_cost) == want == int(merged[run].objective_cost), run
        assert round(got[run].unserved_demand * 10) == merged[run].unserved_units and round(got[run].added_capacity_used * 10) == merged[run].added_units <= round(b * 10)
        assert got[run].overfilled_shelters == 0 and round((got[run].served_demand + got[run].unserved_demand) * 10) == sum(units.values())


def test_a_budget_solves_a_part_once_for_its_curve_and_once_for_its_flow(spark, monkeypatch, tmp_path):
    class Noted(A.PartFlow):
        def __init__(self, *given):
            tempfile.mkstemp(dir=noted)
            super().__init__(*given)

    noted = str(tmp_path)
    monkeypatch.setattr(A, "PartFlow", Noted)
    cands, mesh, caps = tables(spark)
    runs = [("r", "whole", 10, 0.0), ("p", "whole", 10, 1.0)]
    got = {r.run_id: r.unserved_demand for r in A.allocation_summary(A.allocate(cands, mesh, caps, runs), A.prepare_candidates(cands, caps)).collect()}
    assert got == {"r": 2.0, "p": 1.0}
    assert len(list(tmp_path.iterdir())) == 2
    A.merged_curves(A.capacity_curves(cands, mesh, caps, runs), runs).collect()
    assert len(list(tmp_path.iterdir())) == 3


def test_ordered_operators_match_sorting(spark):
    from terrafold.operators import ordered, relational

    rng = random.Random(7)
    rows = [(g, i, float(rng.choice([1, 1, 1, 1, 2, 3, rng.random() * 9, None or -4.5])), rng.randint(0, 5)) for g in "ab" for i in range(400)] + [("c", 0, 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, i int, v double, n int")
    got = {(r.g, r.i): r.before for r in ordered.running_total(df, ["g"], "v", ["i"], "n", 8).collect()}
    for g in "abc":
        total = 0
        for _, i, v, n in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            assert got[g, i] == total
            total += n
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(x) for x in (0.0, 0.05, 0.5, 0.951, 1.0)])).alias("q")).collect()}
    found = {r.g: list(r)[1:] for r in ordered.quantiles(df, ["g"], "v", [0.0, 0.05, 0.5, 0.951, 1.0], 8).collect()}
    assert found.keys() == want.keys() and all(found[g] == pytest.approx(want[g], abs=1e-12) for g in want)
    one = ordered.quantiles(df.where("g = 'a'"), [], "v", [0.3], 16).first()
    assert one.q0 == pytest.approx(df.where("g = 'a'").agg(F.percentile("v", 0.3)).first()[0], abs=1e-12)
    assert ordered.quantiles(df.where("false"), [], "v", [0.3]).first().q0 is None and ordered.quantiles(df.where("false"), ["g"], "v", [0.3]).count() == 0
    samples = spark.createDataFrame([("r", i, rng.choice([None, 1, 1, 2]) if i % 50 > 9 else 7, 1.5) for i in range(500)] + [("s", i, 3, 1.0) for i in range(30)], "k string, i int, v int, m double")
    want = {tuple(r) for r in relational.merge_runs(samples, ["k"], ["i"], "v", "m").collect()}
    for large, slices in ((0, 64), (40, 7), (40, 500), (1000, 64)):
        assert {tuple(r) for r in ordered.runs_in_slices(samples, ["k"], ["i"], F.col("i"), "v", "m", large, slices).collect()} == want
