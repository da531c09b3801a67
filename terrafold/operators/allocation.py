"""Capacity-constrained allocation: candidates prepared by joins, runs solved as min-cost flows of their parts.

A run is a demand scenario, a candidate limit and a budget.  Meshes and shelters that no
candidate links do not compete, but for the budget: a run falls into the
connected parts of its candidates, and each is a group of its own.  A part's least
cost is convex and piecewise linear in the capacity that is added to it; its
pieces (what one more unit saves, for how many units) come from the same search that
finds the flow.  The pieces of all parts, by what they save, share the budget:
no part could use a unit better than the one that has it.

The flow of a part is exact: successive shortest paths with potentials on
integers, many units to a path; added capacity follows as shortest paths from the sink
back to the pool of added capacity.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import values as V
from terrafold.operators.gates import Gate, require, unique_key
from terrafold.operators.graph import components
from terrafold.operators.ordered import running_total
from terrafold.operators.relational import keep_best
from terrafold.session import stored, workers_import

# What unserved demand costs in metres, units of demand and distance, room for ranks below a unit of distance.
UNSERVED_M = 1_000_000.0
SCALE, TIES = 10, 100
UNSERVED_COST = int(UNSERVED_M * SCALE) * TIES
FLOW = "run_id string, mesh_id string, shelter_key string, units long, added boolean"


class MinCostFlow:
    """Integer min-cost flow from a source to a sink by successive shortest paths."""

    def __init__(self) -> None:
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def _search(self, start: int, goal: int) -> tuple[int, dict[int, int]] | None:
        """(true cost, last arc into each node) of a shortest path; potentials move so that costs along it are zero.

        Only nodes nearer than the goal are looked at, and only theirs move: they sink by what they are nearer.
        """
        p, out, to, room, cost = self.potential, self.out, self.to, self.room, self.cost
        far, via, done, heap = {start: 0}, {}, set(), [(0, start)]
        while heap:
            limit, u = heapq.heappop(heap)
            if u == goal:
                break
            if u in done:
                continue
            done.add(u)
            base = limit + p[u]
            for e in out[u]:
                if room[e]:
                    v = to[e]
                    nd = base + cost[e] - p[v]
                    if v not in far or nd < far[v]:
                        far[v], via[v] = nd, e
                        heapq.heappush(heap, (nd, v))
        else:
            return None
        true = limit - p[start] + p[goal]
        for v in done:
            p[v] += far[v] - limit
        return true, via

    def _push(self, start: int, goal: int, via: dict[int, int], most: int | None = None) -> int:
        push, v = most, goal
        while v != start:
            e = via[v]
            push = self.room[e] if push is None else min(push, self.room[e])
            v = self.to[e ^ 1]
        v = goal
        while v != start:
            e = via[v]
            self.room[e] -= push
            self.room[e ^ 1] += push
            v = self.to[e ^ 1]
        return push

    def solve(self, source: int, sink: int) -> int:
        """The least cost of the largest flow; all first costs are at least zero."""
        self.potential, total = [0] * len(self.out), 0
        while found := self._search(source, sink):
            total += found[0] * self._push(source, sink, found[1])
        return total

    def send(self, supplies: Sequence[tuple[int, int]], sink: int) -> int:
        """The least cost of sending supplies (node, units), each of which has a way of its own to the sink.

        One node after the other, from where it is: a search ends at the first room, most often
        a few arcs away, while one from a common source would pass all nodes that are left.
        """
        self.potential, total = [0] * len(self.out), 0
        for node, units in supplies:
            while units:
                found = self._search(node, sink)
                sent = self._push(node, sink, found[1], units)
                total += found[0] * sent
                units -= sent
        return total

    def _tree(self, root: int) -> None:
        """Shortest paths from ``root`` to all nodes: their costs, the last arc of each and the nodes that hang from it."""
        p, n = self.potential, len(self.out)
        self.far: list[int | None] = [None] * n
        self.last, self.below, done = [-1] * n, [set() for _ in range(n)], [False] * n
        near, heap = {root: 0}, [(0, root)]
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u], self.far[u] = True, d - p[root] + p[u]
            if u != root:
                self.below[self.to[self.last[u] ^ 1]].add(u)
            for e in self.out[u]:
                v = self.to[e]
                if self.room[e] and not done[v]:
                    nd = d + self.cost[e] + p[u] - p[v]
                    if v not in near or nd < near[v]:
                        near[v], self.last[v] = nd, e
                        heapq.heappush(heap, (nd, v))

    def _mend(self, cut: list[int]) -> None:
        """Costs of the nodes below ``cut``, whose last arcs are full; no other cost changes, as what a push opens lies on a shortest path."""
        far, last, below, to, room, cost = self.far, self.last, self.below, self.to, self.room, self.cost
        loose, todo = set(), list(cut)
        while todo:
            v = todo.pop()
            if v not in loose:
                loose.add(v)
                todo += below[v]
        for v in loose:
            below[to[last[v] ^ 1]].discard(v)
        heap: list[tuple[int, int, int]] = []
        for v in loose:
            ways = [(far[to[e]] + cost[e ^ 1] - far[v], v, e ^ 1) for e in self.out[v] if room[e ^ 1] and to[e] not in loose and far[to[e]] is not None]
            if ways:
                heap.append(min(ways))
        heapq.heapify(heap)
        while heap:
            more, v, e = heapq.heappop(heap)
            if v not in loose:
                continue
            loose.discard(v)
            far[v] += more
            last[v] = e
            below[to[e ^ 1]].add(v)
            for e in self.out[v]:
                if room[e] and to[e] in loose:
                    heapq.heappush(heap, (far[v] + cost[e] - far[to[e]], to[e], e))
        for v in loose:  # no way is left, and none comes back
            far[v] = None

    def widen(self, gate: int, sink: int, pool: int, most: int) -> tuple[int, int, int] | None:
        """After all is sent: (saving a unit, units, first arc), at most ``most``, of the best use of more room on the arc ``gate`` from pool to sink; None if nothing is saved.

        Shortest paths from the sink are kept from call to call; a step mends those that its full arcs break.
        """
        if not hasattr(self, "far"):
            self._tree(sink)
        saving = self.far[pool]
        if not most or saving is None or saving >= 0:
            return None
        path, v = [], pool
        while v != sink:
            path.append(self.last[v])
            v = self.to[self.last[v] ^ 1]
        units = min(most, *(self.room[e] for e in path))
        for e in path:
            self.room[e] -= units
            self.room[e ^ 1] += units
        self.room[gate ^ 1] += units  # the room that was made is in use at once
        self._mend([self.to[e] for e in path if not self.room[e]])
        return -saving, units, path[-1]


class PartFlow:
    """The flow of one part: solved without a budget, then widened step by step.

    ``arcs``: mesh_id, units, shelter_key, cost, capacity (units; null shelters only state the mesh's demand).
    """

    def __init__(self, arcs: pd.DataFrame, cap_each: int | None = None) -> None:
        net = self.net = MinCostFlow()
        self.sink, self.pool = net.node(), net.node()
        meshes, shelters, supplies = {}, {}, []
        self.flows: list[tuple[str, str | None, int]] = []
        self.added: list[tuple[str, int]] = []
        self.unserved: set[int] = set()
        self.gate = net.arc(self.pool, self.sink, 0, 0)
        for r in arcs.sort_values(["mesh_id", "cost", "shelter_key"], na_position="last").itertuples(index=False):
            units = int(r.units)
            if not units:
                continue
            if r.mesh_id not in meshes:
                meshes[r.mesh_id] = net.node()
                supplies.append((meshes[r.mesh_id], units))
                alone = net.arc(meshes[r.mesh_id], self.sink, units, UNSERVED_COST)
                self.unserved.add(alone)
                self.flows.append((r.mesh_id, None, alone))
            if r.shelter_key is None or pd.isna(r.capacity) or r.capacity <= 0:
                continue
            if r.shelter_key not in shelters:
                s = shelters[r.shelter_key] = net.node()
                net.arc(s, self.sink, int(r.capacity), 0)
                self.added.append((r.shelter_key, net.arc(s, self.pool, 1 << 62 if cap_each is None else cap_each, 1)))
            self.flows.append((r.mesh_id, r.shelter_key, net.arc(meshes[r.mesh_id], shelters[r.shelter_key], units, int(r.cost))))
        self.cost = net.send(supplies, self.sink)
        self.lost = sum(net.room[e ^ 1] for e in self.unserved)

    def lost_units(self) -> int:
        return self.lost

    def widen(self, most: int) -> tuple[int, int, int] | None:
        """(saving a unit, units, units newly served) of the next step."""
        step = self.net.widen(self.gate, self.sink, self.pool, most)
        if not step:
            return None
        saving, units, first = step
        self.cost -= saving * units
        served = units if first ^ 1 in self.unserved else 0
        self.lost -= served
        return saving, units, served

    def rows(self) -> list[tuple[str, str | None, int, bool]]:
        """Flows (mesh, shelter or None for unserved, units, False) and added capacity ('', shelter, units, True)."""
        room = self.net.room
        used = [(m, s, room[e ^ 1], False) for m, s, e in self.flows if room[e ^ 1]]
        return used + [("", s, room[e ^ 1], True) for s, e in self.added if room[e ^ 1]]


def usable_candidates(candidates: DataFrame, limit: int = 10) -> DataFrame:
    """Candidates of rank 1..limit with a known distance of at least zero and a key."""
    distance = F.col("total_walking_distance_m")
    return candidates.where(F.col("candidate_rank").between(1, limit) & (distance >= 0) & ~F.isnan(distance) & (F.col("shelter_key").cast("string") != ""))


def candidate_gates(candidates: DataFrame, capacities: DataFrame, limit: int = 10) -> list[Gate]:
    """What an allocation needs: pairs and capacities unique, ranks 1..n in each mesh."""
    good = usable_candidates(candidates, limit)
    ranks = good.groupBy("mesh_id").agg(F.max("candidate_rank").alias("last"), F.count_distinct("candidate_rank").alias("ranks"), F.count(F.lit(1)).alias("n"))
    return [
        Gate("duplicate mesh and shelter", unique_key(good, ["mesh_id", "shelter_key"])),
        Gate("ranks are not 1..n", ranks.where("last <> n OR ranks <> n")),
        Gate("duplicate capacity", unique_key(capacities, ["shelter_key"])),
    ]


def prepare_candidates(candidates: DataFrame, capacities: DataFrame, limit: int = 10) -> DataFrame:
    """Usable candidates with their capacity, whether it is known, and its status (that of the capacity table where it has one)."""
    kept = ["shelter_key", F.col("capacity").alias("shelter_capacity")]
    said = "capacity_status" in capacities.columns
    joined = usable_candidates(candidates, limit).join(capacities.select(*kept, *(["capacity_status"] if said else [])), "shelter_key", "left")
    known = F.coalesce(F.col("shelter_capacity") > 0, F.lit(False))
    status = F.coalesce("capacity_status", F.lit("missing")) if said else V.capacity_status(F.col("shelter_capacity"))
    return joined.withColumn("capacity_known", known).withColumn("capacity_status", F.when(known, "available").otherwise(status))


def allocate(
    candidates: DataFrame,
    mesh: DataFrame,
    capacities: DataFrame,
    runs: Sequence[tuple[str, str, int, float]],
    each_most: float | None = None,
    check: bool = True,
) -> DataFrame:
    """(run_id, mesh_id, shelter_key, units, added) for runs (run_id, demand column, candidate limit, budget).

    Units are tenths.  A null shelter is unserved demand; rows with ``added`` are
    capacity from the budget.  Served demand comes first, then distance, then rank,
    then added capacity; of several optima any may be given.  Candidates that are
    not usable are left out; repeated pairs, gaps in ranks, repeated meshes and
    missing or negative demand are errors (``check`` runs a job for them).  The flow is
    solved and written once, as what is read out of it reads it several times.
    """
    most_rank = max(r[2] for r in runs)
    if check:
        columns = sorted({r[1] for r in runs})
        wrong = F.lit(False)
        for c in columns:
            wrong = wrong | F.col(c).isNull() | (F.col(c) < 0) | F.isnan(F.col(c).cast("double"))
        own = [Gate("demand is missing or negative", mesh, wrong), Gate("duplicate mesh", unique_key(mesh, ["mesh_id"]))]
        require([*candidate_gates(candidates, capacities, most_rank), *own])
    parts, plan, most = _parts(candidates, mesh, capacities, runs, each_most)
    spark = mesh.sparkSession
    free = plan.where("budget = 0").select("run_id", "demand", "k", F.lit(0).cast("long").alias("share")).join(parts.select("demand", "k", "part").distinct(), ["demand", "k"])
    shares = free.unionByName(budget_shares(_curves(parts, plan, most), plan, parts)) if any(r[3] > 0 for r in runs) else free

    def solve(key: tuple, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        flow, given, out = PartFlow(_keyed(rows), most), 0, []
        for run_id, share in sorted(zip(wanted["run_id"], wanted["share"], strict=True), key=lambda r: (r[1], r[0])):
            while given < share and (step := flow.widen(int(share) - given)):
                given += step[1]
            out += [(run_id, *r) for r in flow.rows()]
        return pd.DataFrame(out, columns=["run_id", "mesh_id", "shelter_key", "units", "added"])

    keys = ["demand", "k", "part"]
    solved = parts.where("part IS NOT NULL").groupBy(*keys).cogroup(shares.select("run_id", "share", *keys).toDF("run_id", "share", *keys).groupBy(*keys)).applyInPandas(solve, FLOW)
    # Meshes without a shelter that could take anybody need no search.
    alone = parts.where("part IS NULL AND units > 0").join(F.broadcast(plan), ["demand", "k"])  # plan: a row for each run
    none = F.lit(None).cast("string").alias("shelter_key")
    return stored(solved.unionByName(alone.select("run_id", "mesh_id", none, "units", F.lit(False).alias("added"))), "flow")


def _keyed(rows: pd.DataFrame) -> pd.DataFrame:
    rows["shelter_key"] = rows["shelter_key"].astype(object).where(rows["shelter_key"].notna(), None)
    return rows


def _parts(candidates: DataFrame, mesh: DataFrame, capacities: DataFrame, runs: Sequence[tuple[str, str, int, float]], each_most: float | None) -> tuple[DataFrame, DataFrame, int | None]:
    """((demand, k, part, mesh_id, units, shelter_key, cost, capacity), runs as a table, most units a shelter may be given).

    ``part`` is the smallest node of the connected part of meshes and shelters of
    known capacity among the first ``k`` candidates, null for a mesh without any.
    """
    spark = mesh.sparkSession
    workers_import(spark)
    plan = spark.createDataFrame([(r, c, k, int(round(b * SCALE))) for r, c, k, b in runs], "run_id string, demand string, k int, budget long")
    columns, limits = sorted({r[1] for r in runs}), sorted({r[2] for r in runs})
    demand = mesh.select(F.col("mesh_id").cast("string").alias("mesh_id"), F.inline(F.array(*[F.struct(F.lit(c).alias("demand"), V.demand_units(F.col(c)).alias("units")) for c in columns])))
    arcs = usable_candidates(candidates, max(limits)).select(
        F.col("mesh_id").cast("string").alias("mesh_id"),
        F.col("shelter_key").cast("string").alias("shelter_key"),
        "candidate_rank",
        V.walk_cost(F.col("total_walking_distance_m"), F.col("candidate_rank")).alias("cost"),
    ).join(capacities.select(F.col("shelter_key").cast("string").alias("shelter_key"), V.capacity_units(F.col("capacity")).alias("capacity")), "shelter_key")
    within = F.explode(F.array(*[F.lit(k) for k in limits]))
    arcs = stored(arcs.where("capacity > 0").withColumn("k", within).where("candidate_rank <= k"), "flow-arcs")
    linked = components(arcs.select(F.col("k").cast("string").alias("context"), F.concat(F.lit("m"), "mesh_id").alias("u"), F.concat(F.lit("s"), "shelter_key").alias("v")))
    part = linked.where("node LIKE 'm%'").select(F.col("context").cast("int").alias("k"), F.expr("substring(node, 2)").alias("mesh_id"), F.col("component").alias("part"))
    wanted = F.broadcast(plan.select("demand", "k").distinct()).join(demand, "demand")
    full = wanted.join(part, ["k", "mesh_id"], "left").join(arcs.select("k", "mesh_id", "shelter_key", "cost", "capacity"), ["k", "mesh_id"], "left")
    most = None if each_most is None else int(round(each_most * SCALE))
    return stored(full.select("demand", "k", "part", "mesh_id", "units", "shelter_key", "cost", "capacity"), "flow-parts"), plan, most


CURVE = "demand string, k int, part string, step long, saving long, units long, served long, lost long, cost decimal(38,0)"


def _curves(parts: DataFrame, plan: DataFrame, most: int | None) -> DataFrame:
    """(demand, k, part, step, saving, units, served, lost, cost): what added units save in each part.

    Step 0 holds the demand that is lost and the cost without any; each further one
    how many units save ``saving`` each, and how many more are served.  Solved and written once: a budget's order is read three times.
    """
    budgets = plan.groupBy("demand", "k").agg(F.max("budget").alias("budget"))

    def curve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        flow, left = PartFlow(_keyed(rows), most), int(rows["budget"].iloc[0])
        out = [(*key, 0, 0, 0, 0, flow.lost_units(), Decimal(flow.cost))]
        while left and (step := flow.widen(left)):
            out.append((*key, len(out), *step, 0, Decimal(0)))
            left -= step[1]
        return pd.DataFrame(out, columns=[c.split()[0] for c in CURVE.split(", ")])

    rows = parts.where("part IS NOT NULL").join(F.broadcast(budgets), ["demand", "k"])  # a row for each scenario
    return stored(rows.groupBy("demand", "k", "part").applyInPandas(curve, CURVE), "curves")


def capacity_curves(candidates: DataFrame, mesh: DataFrame, capacities: DataFrame, runs: Sequence[tuple[str, str, int, float]], each_most: float | None = None) -> DataFrame:
    """The curves of all parts of the runs' demands and candidate limits, up to the largest budget of each; meshes alone are parts of their own."""
    parts, plan, most = _parts(candidates, mesh, capacities, runs, each_most)
    alone = parts.where("part IS NULL").groupBy("demand", "k").agg(F.sum("units").alias("lost"))
    zero = F.lit(0).cast("long")
    rest = alone.select(
        "demand", "k", F.lit("").alias("part"), zero.alias("step"), zero.alias("saving"), zero.alias("units"), zero.alias("served"), "lost",
        (F.col("lost").cast("decimal(20,0)") * F.lit(UNSERVED_COST).cast("decimal(17,0)")).cast("decimal(38,0)").alias("cost"),
    )
    return _curves(parts, plan, most).unionByName(rest)


def _taken(curves: DataFrame, plan: DataFrame) -> DataFrame:
    """(run_id, ..., taken): units of each step that a run's budget pays for: what saves most first."""
    # One number for the order: the saving, then part of a hash, so that steps that save the same are dealt over slices.
    order = (-F.col("saving") * F.lit(1 << 20) + F.pmod(F.xxhash64("part"), F.lit(1 << 20))).alias("_order")
    steps = curves.where("step > 0").select("*", order)
    ahead = running_total(steps, ["demand", "k"], "_order", ["part", "step"], "units").drop("_order")
    with_runs = ahead.join(F.broadcast(plan.where("budget > 0")), ["demand", "k"])  # plan: a row for each run
    return with_runs.withColumn("taken", F.least("units", F.greatest(F.lit(0), F.col("budget") - F.col("before")))).where("taken > 0")


def budget_shares(curves: DataFrame, plan: DataFrame, parts: DataFrame) -> DataFrame:
    """(run_id, demand, k, share, part): what each part gets of the budget of each run that has one."""
    got = _taken(curves, plan).groupBy("run_id", "part").agg(F.sum("taken").alias("share"))
    every = F.broadcast(plan.where("budget > 0")).join(parts.where("part IS NOT NULL").select("demand", "k", "part").distinct(), ["demand", "k"])
    return every.join(got, ["run_id", "part"], "left").select("run_id", "demand", "k", F.coalesce("share", F.lit(0)).alias("share"), "part")


def merged_curves(curves: DataFrame, runs: Sequence[tuple[str, str, int, float]]) -> DataFrame:
    """(run_id, added_units, unserved_units, objective_cost) of runs from the parts' curves alone, without their flows."""
    spark = curves.sparkSession
    plan = spark.createDataFrame([(r, c, k, int(round(b * SCALE))) for r, c, k, b in runs], "run_id string, demand string, k int, budget long")
    base = curves.where("step = 0").groupBy("demand", "k").agg(F.sum("lost").alias("lost"), F.sum("cost").alias("cost"))
    # A step is either all taken or, the last one, in part; its units are all of one kind, so a share of it serves that share.
    taken = _taken(curves, plan).withColumn("more", F.col("taken") * F.col("served") / F.col("units"))
    gained = taken.groupBy("run_id").agg(
        F.sum("taken").alias("added"), F.sum("more").cast("long").alias("more"), F.sum(F.col("taken").cast("decimal(19,0)") * F.col("saving").cast("decimal(19,0)")).alias("saved")
    )
    out = F.broadcast(plan).join(base, ["demand", "k"]).join(gained, "run_id", "left")
    return out.select(
        "run_id",
        F.coalesce("added", F.lit(0)).cast("long").alias("added_units"),
        (F.col("lost") - F.coalesce("more", F.lit(0))).cast("long").alias("unserved_units"),
        (F.col("cost") - F.coalesce("saved", F.lit(0))).cast("decimal(38,0)").alias("objective_cost"),
    )


def _people(units: Column) -> Column:
    return units / float(SCALE)


def flow_rows(flow: DataFrame, prepared: DataFrame) -> DataFrame:
    """Served demand by (run_id, mesh_id, shelter_key) with the candidate's rank, distance and ``cross_border`` and its share of the mesh's demand."""
    text = lambda c: F.col(c).cast("string").alias(c)
    cross = F.coalesce("cross_border", F.lit(False)) if "cross_border" in prepared.columns else F.lit(False)
    cand = prepared.select(text("mesh_id"), text("shelter_key"), "candidate_rank", "total_walking_distance_m", cross.alias("cross_border"))
    own = flow.where("NOT added")
    demand = own.groupBy("run_id", "mesh_id").agg(F.sum("units").alias("demand_units"))
    met = own.where("shelter_key IS NOT NULL").join(cand, ["mesh_id", "shelter_key"]).join(demand, ["run_id", "mesh_id"])
    return met.select(
        "run_id",
        "mesh_id",
        "shelter_key",
        "candidate_rank",
        "cross_border",
        "total_walking_distance_m",
        _people(F.col("units")).alias("allocated_demand"),
        (F.col("units") / F.col("demand_units")).alias("allocation_share"),
    )


def mesh_results(flow: DataFrame, prepared: DataFrame) -> DataFrame:
    """(run_id, mesh_id, ...): allocated, unserved, mean and additional distance, dominant shelter (most units, then nearest, then key) and status."""
    own = flow.where("NOT added")
    text = lambda c: F.col(c).cast("string").alias(c)
    cand = prepared.select(text("mesh_id"), text("shelter_key"), "total_walking_distance_m", "candidate_rank", "capacity_known")
    served, units = F.col("shelter_key").isNotNull(), F.col("units")
    total = lambda c: F.coalesce(F.sum(F.when(c, units)), F.lit(0))
    best = F.struct(-units, F.col("total_walking_distance_m"), F.col("shelter_key").alias("key"))
    per = own.join(cand, ["mesh_id", "shelter_key"], "left").groupBy("run_id", "mesh_id").agg(
        _people(total(served)).alias("allocated_demand"),
        _people(total(~served)).alias("unserved_demand"),
        F.count("shelter_key").alias("shelters"),
        V.safe_ratio(F.sum(units * F.col("total_walking_distance_m")), F.sum(F.when(served, units))).alias("mean_distance_m"),
        F.min(F.when(served, best)).getField("key").alias("dominant_shelter"),
    )
    first = keep_best(cand, ["mesh_id"], [F.col("candidate_rank")])
    first = first.select("mesh_id", F.col("shelter_key").alias("nearest_shelter"), F.col("total_walking_distance_m").alias("nearest_distance_m"))
    counts = cand.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("capacity_known").alias("known"))
    out = per.join(first, "mesh_id", "left").join(counts, "mesh_id", "left").fillna(0, ["candidates", "known"])
    allocated, unserved = F.col("allocated_demand"), F.col("unserved_demand")
    status = V.ladder(
        ((allocated == 0) & (unserved == 0), "zero_demand"),
        (F.col("candidates") == 0, "route_unavailable_or_no_candidate"),
        (F.col("known") == 0, "unknown_capacity_only"),
        ((unserved > 0) & (allocated > 0), "capacity_constrained_partial"),
        (unserved > 0, "capacity_constrained_unserved"),
        (F.col("shelters") > 1, "capacity_constrained_split"),
        (F.col("dominant_shelter") != F.col("nearest_shelter"), "capacity_constrained_rerouted"),
        default="nearest_known_capacity",
    )
    return out.withColumn("additional_distance_m", F.col("mean_distance_m") - F.col("nearest_distance_m")).withColumn("allocation_status", status)


def shelter_results(flow: DataFrame, prepared: DataFrame) -> DataFrame:
    """(run_id, shelter_key, ...) of every candidate shelter of known capacity: added and effective capacity, allocated demand, utilisation, saturated."""
    known = prepared.where("capacity_known").select(F.col("shelter_key").cast("string").alias("shelter_key"), "shelter_capacity").distinct()
    runs = flow.select("run_id").distinct()
    used = flow.where("shelter_key IS NOT NULL").groupBy("run_id", "shelter_key").agg(
        F.sum(F.when(F.col("added"), F.col("units"))).alias("extra"), F.sum(F.when(~F.col("added"), F.col("units"))).alias("given")
    )
    rows = known.crossJoin(F.broadcast(runs)).join(used, ["run_id", "shelter_key"], "left")  # runs: a row for each scenario
    extra, given = F.coalesce("extra", F.lit(0)), F.coalesce("given", F.lit(0))
    room = V.capacity_units(F.col("shelter_capacity")) + extra
    return rows.select(
        "run_id",
        "shelter_key",
        "shelter_capacity",
        _people(extra).alias("added_capacity_used"),
        _people(room).alias("effective_capacity"),
        _people(given).alias("allocated_demand"),
        V.safe_ratio(given.cast("double"), room).alias("utilization"),
        ((room > 0) & (given >= room)).alias("saturated"),
    )


def allocation_summary(flow: DataFrame, prepared: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """One row per run: demand served and not, meshes by what became of them, person-metres, demand beyond rank 1 and across borders, capacity added, cost.

    ``baseline`` (mesh_id, baseline_shelter): the fixed assignment that destinations are compared with; by default the nearest candidate.
    """
    mesh, rows, shelters = mesh_results(flow, prepared), flow_rows(flow, prepared), shelter_results(flow, prepared)
    if baseline is not None:
        mesh = mesh.join(baseline.select(F.col("mesh_id").cast("string").alias("mesh_id"), F.col("baseline_shelter").cast("string")), "mesh_id", "left")
    compared = F.col("baseline_shelter" if baseline is not None else "nearest_shelter")
    status = F.col("allocation_status")
    unserved = ("capacity_constrained_unserved", "unknown_capacity_only", "route_unavailable_or_no_candidate")
    by_mesh = mesh.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("target_meshes"),
        F.sum("allocated_demand").alias("served_demand"),
        F.sum("unserved_demand").alias("unserved_demand"),
        F.count_if(F.col("candidates") == 0).alias("meshes_with_no_candidate"),
        F.count_if(status == "unknown_capacity_only").alias("meshes_with_unknown_capacity_only"),
        F.count_if(status == "capacity_constrained_partial").alias("meshes_partially_unserved"),
        F.count_if(status.isin(*unserved)).alias("meshes_fully_unserved"),
        F.count_if(F.col("shelters") > 1).alias("meshes_split_across_shelters"),
        F.count_if(F.col("dominant_shelter").isNotNull() & ~F.col("dominant_shelter").eqNullSafe(compared)).alias("meshes_dominant_destination_changed"),
    )
    far = F.greatest(F.lit(0.0), F.col("total_walking_distance_m") - F.coalesce("nearest_distance_m", "total_walking_distance_m"))
    amount = F.col("allocated_demand")
    nearest = mesh.select("run_id", "mesh_id", "nearest_distance_m")
    by_flow = rows.join(nearest, ["run_id", "mesh_id"], "left").groupBy("run_id").agg(
        F.sum(amount * F.col("total_walking_distance_m")).alias("total_allocated_person_metres"),
        F.sum(amount * far).alias("additional_person_metres"),
        F.sum(F.when(F.col("candidate_rank") > 1, amount).otherwise(0.0)).alias("demand_beyond_rank_1"),
        F.sum(F.when(F.col("cross_border"), amount).otherwise(0.0)).alias("cross_border_demand"),
    )
    by_shelter = shelters.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("known_capacity_shelters"),
        F.count_if("saturated").alias("saturated_shelters"),
        F.count_if(F.col("allocated_demand") > F.col("effective_capacity") + 1e-9).alias("overfilled_shelters"),
        F.sum("added_capacity_used").alias("added_capacity_used"),
    )
    zero = ["total_allocated_person_metres", "additional_person_metres", "demand_beyond_rank_1", "cross_border_demand", "added_capacity_used"]
    out = by_mesh.join(by_flow, "run_id", "left").join(by_shelter, "run_id", "left").join(objective_costs(flow, prepared), "run_id", "left")
    out = out.fillna(0, [*zero, "known_capacity_shelters", "saturated_shelters", "overfilled_shelters"])
    total = F.col("served_demand") + F.col("unserved_demand")
    return out.select(
        "*",
        F.when(total > 0, F.col("served_demand") / total).otherwise(1.0).alias("served_share"),
        F.coalesce(V.safe_ratio(F.col("additional_person_metres"), F.col("served_demand")), F.lit(0.0)).alias("mean_additional_distance_m"),
    )


def objective_costs(flow: DataFrame, prepared: DataFrame) -> DataFrame:
    """(run_id, objective_cost): the flow's cost in whole units, which no sum of floating numbers could hold."""
    text = lambda c: F.col(c).cast("string").alias(c)
    cand = prepared.select(text("mesh_id"), text("shelter_key"), V.walk_cost(F.col("total_walking_distance_m"), F.col("candidate_rank")).alias("walk"))
    each = F.when(F.col("added"), F.lit(1)).when(F.col("shelter_key").isNull(), F.lit(UNSERVED_COST)).otherwise(F.col("walk"))
    whole = lambda c: c.cast("decimal(19,0)")
    joined = flow.join(cand, ["mesh_id", "shelter_key"], "left")
    return joined.groupBy("run_id").agg(F.sum(whole(F.col("units")) * whole(each)).cast("decimal(38,0)").alias("objective_cost"))


def investment_plan(flow: DataFrame, prepared: DataFrame) -> DataFrame:
    """(run_id, plan_rank, shelter_key, added_capacity_used, allocated_demand): by added capacity, then allocated demand, both falling, then key."""
    plan = shelter_results(flow, prepared).where("added_capacity_used > 0")
    order = W.partitionBy("run_id").orderBy(F.desc("added_capacity_used"), F.desc("allocated_demand"), "shelter_key")
    return plan.select("run_id", F.row_number().over(order).alias("plan_rank"), "shelter_key", "added_capacity_used", "allocated_demand")


def allocation_gates(summary: DataFrame, expected_meshes: int, budget_col: str | None = None) -> list[Gate]:
    """Contract of summaries: every mesh is there, no shelter takes more than it has, and no more capacity is added than the budget (none without one)."""
    most = F.col(budget_col) if budget_col else F.lit(0.0)
    return [
        Gate("target meshes", summary, F.col("target_meshes") != expected_meshes),
        Gate("capacity exceeded", summary, F.col("overfilled_shelters") > 0),
        Gate("added capacity over budget", summary, F.col("added_capacity_used") > most + 1e-9),
    ]


def dominance_gates(summary: DataFrame, keys: Sequence[str], order: str) -> list[Gate]:
    """Of summaries with ``keys`` and a number that grants more as it rises (candidates or budget): unserved demand and cost may not rise with it."""
    w = W.partitionBy(*keys).orderBy(order)
    seen = summary.withColumn("_unserved", F.lag("unserved_demand").over(w)).withColumn("_cost", F.lag("objective_cost").over(w))
    return [
        Gate("unserved demand rises", seen, F.col("unserved_demand") > F.col("_unserved") + 1e-9),
        Gate("cost rises", seen, F.col("objective_cost") > F.col("_cost")),
    ]
