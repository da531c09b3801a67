"""Demand, shelter pressure, the composite score, its robustness and what-if capacity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import values as V
from terrafold.operators.ordered import quantiles
from terrafold.operators.relational import exact_quantiles, rank_within, top_k

COMPONENTS = {
    "tsunami_exposure": "tsunami_exposure_component",
    "vulnerable_population": "vulnerable_population_component",
    "walking_accessibility": "walking_accessibility_component",
    "route_inundation_exposure": "route_inundation_exposure_component",
    "shelter_capacity_pressure": "shelter_capacity_pressure_component_area_weighted",
}


def targets(mesh: DataFrame, ratio: str = "tsunami_inundation_ratio") -> DataFrame:
    """Meshes whose ratio is above zero; a null ratio is no target."""
    return mesh.where(F.col(ratio) > 0)


def demand(mesh: DataFrame) -> DataFrame:
    return mesh.withColumn("demand_area_weighted", F.col("total_population") * F.col("tsunami_inundation_ratio")).withColumn(
        "demand_full_mesh", F.col("total_population").cast("double")
    )


def shelter_pressure(assigned: DataFrame, shelters: DataFrame) -> DataFrame:
    """One row per selected shelter: aggregated demand, capacity and, where capacity is above zero, pressure."""
    per = assigned.groupBy("shelter_key").agg(
        F.count(F.lit(1)).alias("assigned_mesh_count"),
        F.sum("demand_area_weighted").alias("assigned_demand_area_weighted"),
        F.sum("demand_full_mesh").alias("assigned_demand_full_mesh"),
    )
    out = per.join(shelters.select("shelter_key", "capacity"), "shelter_key", "left")
    return out.select(
        "*",
        V.safe_ratio(F.col("assigned_demand_area_weighted"), F.col("capacity")).alias("capacity_pressure_area_weighted"),
        V.safe_ratio(F.col("assigned_demand_full_mesh"), F.col("capacity")).alias("capacity_pressure_full_mesh"),
    )


def quantile_bounds(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> tuple[float, float]:
    """Exact interpolated quantiles; none known gives (0, 1), no spread gives high = low + 1.  Runs jobs."""
    lo, hi = exact_quantiles(df, column, (low, high))
    if lo is None:
        return 0.0, 1.0
    return lo, hi if hi > lo else lo + 1.0


def bounds_in_plan(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """What :func:`quantile_bounds` gives, as one row (low, high) of the plan itself: no job runs, and no task holds more than a slice of the values."""
    found = quantiles(df, [], column, (low, high)).toDF("lo", "hi")
    lo = F.coalesce("lo", F.lit(0.0))
    return found.select(lo.alias("low"), F.when(F.col("lo").isNull(), 1.0).when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(lo + 1.0).alias("high"))


def composite(mesh: DataFrame, nearest: DataFrame, shelters: DataFrame, in_plan: bool = True) -> DataFrame:
    """Target meshes with demand, the selected shelter's pressure, components, scores with bounds, completeness and status.

    ``mesh``: mesh_id, total_population, tsunami_inundation_ratio, aging_rate_65plus;
    ``nearest``: mesh_id, shelter_key, total_walking_distance_m, inundation_ratio,
    unknown_ratio, classified_ratio (one row per mesh with a route);
    ``shelters``: shelter_key, capacity.  The walking bounds are a row of the plan, or,
    not ``in_plan``, two numbers that jobs find first, for more meshes than a task can hold.
    """
    base = demand(targets(mesh)).join(nearest, "mesh_id", "left").withColumn("ready", F.col("shelter_key").isNotNull())
    pressure = shelter_pressure(base.where("ready"), shelters)
    full = base.join(pressure, "shelter_key", "left")
    if in_plan:
        full = full.crossJoin(F.broadcast(bounds_in_plan(base.where("ready"), "total_walking_distance_m")))  # one row
        low, high = F.col("low"), F.col("high")
    else:
        low, high = map(F.lit, quantile_bounds(base.where("ready"), "total_walking_distance_m"))
    when_ready = lambda c: F.when(F.col("ready"), c)
    hundred = lambda c: V.clip_keep_null(c * 100.0, 0.0, 100.0)
    full = full.select(
        "*",
        hundred(F.col("tsunami_inundation_ratio")).alias("tsunami_exposure_component"),
        hundred(F.col("aging_rate_65plus")).alias("vulnerable_population_component"),
        when_ready(V.minmax_0_100(F.col("total_walking_distance_m"), low, high)).alias("walking_accessibility_component"),
        when_ready(hundred(F.col("inundation_ratio"))).alias("route_inundation_exposure_component_lower"),
        when_ready(hundred(F.col("classified_ratio"))).alias("route_inundation_exposure_component"),
        when_ready(hundred(F.col("inundation_ratio") + F.col("unknown_ratio"))).alias("route_inundation_exposure_component_upper"),
        F.coalesce(F.col("ready") & (F.col("unknown_ratio") > 0), F.lit(False)).alias("route_exposure_uncertainty_flag"),
        when_ready(hundred(F.col("capacity_pressure_area_weighted"))).alias("shelter_capacity_pressure_component_area_weighted"),
        when_ready(hundred(F.col("capacity_pressure_full_mesh"))).alias("shelter_capacity_pressure_component_full_mesh"),
    )

    def score(weights: Mapping[str, float], route: str = "", pressure: str = "area_weighted") -> Column:
        at = {k: F.col(c) for k, c in COMPONENTS.items()}
        at["route_inundation_exposure"] = F.col(f"route_inundation_exposure_component{route}")
        at["shelter_capacity_pressure"] = F.col(f"shelter_capacity_pressure_component_{pressure}")
        return when_ready(V.weighted_score(at, weights))

    scored = full.drop("low", "high").select(
        "*",
        *[score(V.CORE_WEIGHTS, b).alias(f"core_score{b}") for b in ("", "_lower", "_upper")],
        *[score(V.FULL_WEIGHTS, b).alias(f"full_score{b}") for b in ("", "_lower", "_upper")],
        score(V.FULL_WEIGHTS, pressure="full_mesh").alias("full_score_full_mesh"),
        V.completeness([F.col(c) for c in list(COMPONENTS.values())[:4]]).alias("core_data_completeness"),
        V.completeness([F.col(c) for c in COMPONENTS.values()]).alias("data_completeness"),
    )
    return scored.withColumn("score_status", V.score_status(F.col("ready"), F.col("core_score"), F.col("full_score")))


def weight_scenarios(weights: Mapping[str, float] = V.FULL_WEIGHTS, factors: Sequence[float] = (0.8, 1.2)) -> dict[str, dict[str, float]]:
    """The baseline, each weight times each factor, and equal weights."""
    out = {"baseline": dict(weights)}
    for key in weights:
        for factor in factors:
            out[f"{key}_x{factor:g}".replace(".", "_")] = {**weights, key: weights[key] * factor}
    return out | {"equal": dict.fromkeys(weights, 20.0)}


def rank_scenarios(complete: DataFrame, scenarios: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(scenario, mesh_id, score, rank, place) of the complete rows; ties in place go by mesh_id as text.

    Scores lie between 0 and 100, so steps of a fifth of a hundredth spread a scenario over many tasks.
    """
    at = {k: F.col(c) for k, c in COMPONENTS.items()}
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), V.weighted_score(at, w).alias("score")) for s, w in scenarios.items()])
    long = complete.select("mesh_id", F.inline(rows))
    return rank_within(long, ["scenario"], "score", F.floor(F.col("score") * 50).cast("int"), F.col("mesh_id").cast("string"))


def rank_summary(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("mesh_id").agg(
        F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), (F.max("rank") - F.min("rank")).alias("rank_range"), F.median("rank").alias("median_rank")
    )


def robust_top(ranks: DataFrame, n: int | None = None, share: float | None = None) -> DataFrame:
    """Meshes among the first ``n`` (or max(1, ceil(share of the rows))) places of every scenario."""
    rows = ranks.groupBy("scenario").agg(F.count(F.lit(1)).alias("rows"))
    size = F.least(F.lit(n), F.col("rows")) if n is not None else F.greatest(F.lit(1), F.ceil(F.col("rows") * share))
    tops = F.broadcast(rows.select("scenario", size.alias("size")))  # one row for each scenario
    inside = ranks.join(tops, "scenario").where("place <= size")
    held = inside.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("k"))
    return held.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("all")))).where("k = all").select("mesh_id")


def rank_corr(ranks: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Correlation of each scenario's ranks with the baseline's."""
    base = ranks.where(F.col("scenario") == baseline).select("mesh_id", F.col("rank").alias("base_rank"))
    return ranks.join(base, "mesh_id").groupBy("scenario").agg(F.corr(F.col("rank").cast("double"), F.col("base_rank").cast("double")).alias("spearman"))


def what_if_capacity(risk: DataFrame, pressure: DataFrame, deltas: Sequence[float]) -> DataFrame:
    """(delta, shelter_key, ...): pressure and score reductions when every known capacity grows by ``delta``.

    ``risk`` has complete rows' components and full_score; routes and demand stay.
    More capacity cannot raise a score: a reduction below -1e-8 is an error.
    """
    known = pressure.where((F.col("capacity") > 0) & (F.col("assigned_demand_area_weighted") >= 0))
    runs = known.select("*", F.explode(F.array(*[F.lit(float(d)) for d in deltas])).alias("delta"))
    runs = runs.withColumn("simulated_pressure", F.col("assigned_demand_area_weighted") / (F.col("capacity") + F.col("delta")))
    component = V.clip_keep_null(F.col("simulated_pressure") * 100.0, 0.0, 100.0)
    at = {k: F.col(c) for k, c in COMPONENTS.items()} | {"shelter_capacity_pressure": component}
    cols = [c for k, c in COMPONENTS.items() if k != "shelter_capacity_pressure"]
    complete = risk.where("score_status = 'complete'").select("shelter_key", "full_score", *cols)
    joined = runs.join(complete, "shelter_key", "left").withColumn("reduction", F.col("full_score") - V.weighted_score(at, V.FULL_WEIGHTS))
    wrong = F.raise_error(F.concat(F.lit("more capacity raised a score at shelter "), F.col("shelter_key").cast("string"))).cast("double")
    joined = joined.withColumn("reduction", F.when(F.col("reduction") < -1e-8, wrong).when(F.col("reduction").isNotNull(), F.greatest(F.lit(0.0), F.col("reduction"))))
    out = joined.groupBy("delta", "shelter_key", "capacity", "assigned_demand_area_weighted", "capacity_pressure_area_weighted", "simulated_pressure").agg(
        F.count("reduction").alias("affected_complete_meshes"),
        F.coalesce(F.sum("reduction"), F.lit(0.0)).alias("total_score_reduction"),
        F.coalesce(F.avg("reduction"), F.lit(0.0)).alias("mean_score_reduction"),
        F.coalesce(F.max("reduction"), F.lit(0.0)).alias("max_score_reduction"),
    )
    return out.select(
        "*",
        (F.col("capacity_pressure_area_weighted") > 1).alias("baseline_over_capacity"),
        (F.col("simulated_pressure") > 1).alias("simulated_over_capacity"),
        ((F.col("capacity_pressure_area_weighted") > 1) & (F.col("simulated_pressure") <= 1)).alias("resolved_over_capacity"),
    )


def what_if_ranking(simulated: DataFrame, n: int = 12, order: str = "text", name: str = "shelter_key", collation: str | None = None) -> DataFrame:
    """The first ``n`` shelters of each delta, which Spark cuts off before the exchange.

    ``order`` ``text``: reduction, resolved, pressure, key; ``demand``: reduction,
    pressure reduction, demand, key.  The last is the column ``name``, ordered bytewise or by
    a ``collation`` (``ja``, ``UNICODE``), as a reader's language has it.
    """
    key = F.col(name).cast("string")
    if collation:
        key = F.collate(key, collation)
    if order == "demand":
        by = [F.desc("total_score_reduction"), (F.col("capacity_pressure_area_weighted") - F.col("simulated_pressure")).desc(), F.desc("assigned_demand_area_weighted"), key]
    else:
        by = [F.desc("total_score_reduction"), F.col("resolved_over_capacity").cast("int").desc(), F.asc("simulated_pressure"), key]
    return top_k(simulated, ["delta"], by, n, "place")
