"""The stages' gate sets: what each stage must satisfy before its results are used."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from terrafold.functions import values as V
from terrafold.operators.areas import ring_faults
from terrafold.operators.gates import Gate, expected_count, set_equality, unique_key
from terrafold.operators.relational import rank_gaps
from terrafold.operators.scoring import COMPONENTS

# What a route may be, the longest connector, and what makes a modeled length an outlier.
ROUTE_STATUSES = ("complete", "no_network_path", "network_coverage_gap", "no_candidate_shelter_in_aoi", "all_candidate_shelters_snap_excluded")
LONGEST_CONNECTOR_M = 500.0
OUTLIER_M, OUTLIER_SHARE = 100.0, 0.05


def _known(c: str) -> Column:
    return V.finite(F.col(c))


def _any_missing(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in names))


def source_gates(population: DataFrame, shelters: DataFrame, exposure: DataFrame, rings: DataFrame) -> list[Gate]:
    """Source data: population (mesh_id, total_population, population_65plus, population_75plus), shelters (common_id, latitude, longitude, tsunami, capacity),
    exposure (mesh_id, tsunami_inundation_ratio, tsunami_exposure_score, tsunami_sample_count, tsunami_inundated_sample_count), rings (mesh_id, ring of points x, y).

    What may be missing by nature is a warning, what contradicts itself a failure.  A mesh's
    ring must be a valid polygon: closed, its sides meeting at corners only.
    """
    total, old = _known("total_population"), _known("population_65plus")
    ratio, score = _known("tsunami_inundation_ratio"), _known("tsunami_exposure_score")
    samples, wet = _known("tsunami_sample_count"), _known("tsunami_inundated_sample_count")
    flag = V.to_number(F.col("tsunami"))
    capacity = V.parse_capacity(F.col("capacity"))["value"]
    bad_samples = samples.isNull() | wet.isNull() | (samples <= 0) | (wet < 0) | (wet > samples)
    shapes = rings.select(F.col("mesh_id").alias("shape"), F.when(F.col("ring").isNotNull(), F.array("ring")).alias("rings"))
    features = rings.agg(F.count(F.lit(1)).alias("n")).crossJoin(population.agg(F.count(F.lit(1)).alias("rows")))  # one row each
    # The names of the checks, as a published report has them.
    return [
        Gate("mesh_id_unique", unique_key(population, ["mesh_id"])),
        Gate("population_total_null", population, total.isNull()),
        Gate("population_65plus_not_over_total", population, old > total),
        Gate("age_missing_preserved", population, _any_missing(["population_65plus", "population_75plus"]), "warning"),
        Gate("shelter_common_id_duplicates", unique_key(shelters.where("common_id IS NOT NULL"), ["common_id"]), None, "warning"),
        Gate("shelter_coordinate_missing", shelters, _any_missing(["latitude", "longitude"]), "warning"),
        Gate("shelter_tsunami_flag_values", shelters, ~flag.isin(0, 1)),
        Gate("tsunami_shelter_capacity_missing", shelters, (flag == 1) & capacity.isNull(), "warning"),
        Gate("tsunami_mesh_id_unique", unique_key(exposure, ["mesh_id"])),
        Gate("tsunami_mesh_in_population", exposure.join(population.select("mesh_id").distinct(), "mesh_id", "left_anti")),
        Gate("tsunami_inundation_ratio_0_1", exposure, ratio.isNull() | (ratio < 0) | (ratio > 1)),
        Gate("tsunami_exposure_score_formula", exposure, F.abs(score - ratio * 100) > 1e-8),
        Gate("tsunami_sample_counts", exposure, bad_samples),
        Gate("mesh_geometry_valid", ring_faults(shapes).select("shape").distinct()),
        Gate("mesh_geojson_feature_count", features.where("n <> rows")),
    ]


def foundation_gates(foundation: DataFrame, origins: DataFrame) -> list[Gate]:
    """Release of the routing foundation from its two one-row reports; a flag that is missing does not hold."""
    lacks = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return [
        Gate("network_aoi_is_boundary_based", foundation, lacks("network_aoi_is_boundary_based")),
        Gate("all_meshes_snap_checked", foundation, lacks("all_meshes_snap_checked")),
        Gate("all_meshes_checked", origins, lacks("all_meshes_checked")),
        Gate("all_analysis_targets_classified", origins, lacks("all_analysis_targets_classified")),
        Gate("network_coverage_gaps_are_explicit", origins, lacks("network_coverage_gaps_are_explicit")),
        Gate("unresolved_targets", origins, F.coalesce("blocking", F.lit(False))),
    ]


def route_gates(routes: DataFrame, targets: DataFrame, gap_ids: DataFrame, expected: int) -> list[Gate]:
    """Routes against the targets: counts, keys, statuses, needed fields, the distance formula, connectors, geometry, the exact gaps.

    ``routes``: mesh_id, route_status, shelter_key, origin_access_distance_m, network_path_distance_m, shelter_connector_distance_m,
    total_walking_distance_m, route_network_coordinates (JSON); ``gap_ids``: mesh_id.
    """
    complete = F.coalesce(F.col("route_status") == "complete", F.lit(False))
    parts = ["origin_access_distance_m", "network_path_distance_m", "shelter_connector_distance_m", "total_walking_distance_m"]
    needed = ["shelter_key", *parts, "route_network_coordinates"]
    formula = reduce(lambda a, b: a + b, map(_known, parts[:3]))
    points = F.from_json("route_network_coordinates", "array<variant>")
    gaps = routes.where("route_status = 'network_coverage_gap'")
    return [
        expected_count("target_count", targets, expected),
        expected_count("route_count", routes, expected),
        Gate("route_mesh_unique", unique_key(routes, ["mesh_id"])),
        Gate("missing_targets", targets.join(routes.select("mesh_id"), "mesh_id", "left_anti")),
        Gate("unexpected_meshes", routes.join(targets.select("mesh_id"), "mesh_id", "left_anti")),
        Gate("known_statuses", routes, F.col("route_status").isNotNull() & ~F.col("route_status").isin(*ROUTE_STATUSES)),
        Gate("complete_routes_have_all_fields", routes, complete & _any_missing(needed)),
        Gate("distance_formula", routes, complete & (F.abs(formula - _known(parts[3])) > 1e-6)),
        Gate("connector_length", routes, complete & (_known(parts[2]) > LONGEST_CONNECTOR_M + 1e-9)),
        Gate("complete_route_geometry", routes, complete & (F.coalesce(F.size(points), F.lit(0)) < 1)),
        set_equality("coverage_gaps", gaps, gap_ids, "mesh_id"),
    ]


def exposure_gates(routes: DataFrame, expected: int, expected_complete: int) -> list[Gate]:
    """Modeled exposure of routes: counts, both statuses together, ratios, coverage, samples, lengths against the walk, nothing on the unavailable."""
    source, own = F.coalesce(F.col("route_status") == "complete", F.lit(False)), F.coalesce(F.col("route_exposure_status") == "complete", F.lit(False))
    numbers = ["route_modeled_geometry_distance_m", "route_inundation_distance_m", "route_inundation_ratio", "route_tsunami_sample_count", "route_unknown_ratio", "route_classified_coverage_ratio"]
    at = {c: _known(c) for c in numbers}
    outside = lambda c: (at[c] < 0) | (at[c] > 1)
    off = F.abs(at[numbers[0]] - _known("total_walking_distance_m"))
    share = V.safe_ratio(off, _known("total_walking_distance_m"))
    return [
        expected_count("row_count", routes, expected),
        Gate("mesh_unique", unique_key(routes, ["mesh_id"])),
        expected_count("source_complete_count", routes.where(source), expected_complete),
        expected_count("exposure_complete_count", routes.where(own), expected_complete),
        Gate("same_complete_set", routes, source != own),
        Gate("row_errors", routes, F.startswith(F.col("route_exposure_status"), F.lit("error:"))),
        Gate("complete_has_numbers", routes, own & reduce(lambda a, b: a | b, (c.isNull() for c in at.values()))),
        Gate("inundation_ratio_0_1", routes, own & outside("route_inundation_ratio")),
        Gate("unknown_ratio_0_1", routes, own & outside("route_unknown_ratio")),
        Gate("unknown_and_coverage_add_to_one", routes, own & (F.abs(at["route_unknown_ratio"] + at["route_classified_coverage_ratio"] - 1.0) > 1e-9)),
        Gate("samples_above_zero", routes, own & (at["route_tsunami_sample_count"] <= 0)),
        Gate("length_above_zero", routes, own & (at[numbers[0]] <= 0)),
        Gate("unavailable_is_kept", routes, ~source & ~F.col("route_exposure_status").eqNullSafe(F.lit("route_unavailable"))),
        Gate("unavailable_has_no_ratio", routes, ~source & at["route_inundation_ratio"].isNotNull()),
        Gate("length_like_the_walk", routes, own & (off > OUTLIER_M) & (share > OUTLIER_SHARE)),
    ]


def sensitivity_gates(risk: DataFrame, ranks: DataFrame, expected: Mapping[str, int], score: str = "full_score") -> list[Gate]:
    """Scores before ranking, and ranks: rows by status as expected, scores only where complete, the baseline recomputed within 1e-9, no rank missing.

    ``ranks``: scenario, mesh_id, score, rank.
    """
    complete = F.col("score_status") == "complete"
    baseline = ranks.where("scenario = 'baseline'").select("mesh_id", F.col("score").alias("again"))
    both = risk.where(complete).select("mesh_id", score).join(baseline, "mesh_id", "left")
    counted = risk.groupBy("score_status").agg(F.count(F.lit(1)).alias("n"))
    names = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    wrong = counted.where(~F.col("n").eqNullSafe(F.try_element_at(names, F.col("score_status")).cast("long")))
    return [
        Gate("mesh_unique", unique_key(risk, ["mesh_id"])),
        Gate("status_counts", wrong),
        Gate("complete_has_score", risk, complete & F.col(score).isNull()),
        Gate("score_only_where_complete", risk, ~complete & F.col(score).isNotNull()),
        Gate("baseline_recomputed", both, F.col("again").isNull() | (F.abs(F.col(score) - F.col("again")) > 1e-9)),
        Gate("ranks_known", ranks, F.col("rank").isNull() | F.col("score").isNull()),
    ]


def candidate_parity_gates(candidates: DataFrame, status: DataFrame, baselines: Mapping[str, DataFrame], limit: int, tolerance: float) -> list[Gate]:
    """Candidates (mesh_id, candidate_rank, shelter_key, total_walking_distance_m) and statuses (mesh_id, candidate_status) against routes of the same and of the canonical network.

    Each baseline: mesh_id, route_status, shelter_key, total_walking_distance_m.
    """
    gates = [
        Gate("status_mesh_unique", unique_key(status, ["mesh_id"])),
        Gate("pair_unique", unique_key(candidates, ["mesh_id", "shelter_key"])),
        Gate("rank_unique", unique_key(candidates, ["mesh_id", "candidate_rank"])),
        Gate("rank_within_limit", candidates, F.col("candidate_rank").isNull() | ~F.col("candidate_rank").between(1, limit)),
        Gate("ranks_and_distances_rise", rank_gaps(candidates, ["mesh_id"], "candidate_rank", "total_walking_distance_m")),
    ]
    first = candidates.where("candidate_rank = 1").select("mesh_id", F.col("shelter_key").alias("_key"), F.col("total_walking_distance_m").alias("_m"))
    for name, baseline in baselines.items():
        said = status.join(baseline.select("mesh_id", "route_status"), "mesh_id", "left")
        both = baseline.where("route_status = 'complete'").join(first, "mesh_id", "left")
        gates += [
            set_equality(f"{name}_meshes", status, baseline, "mesh_id"),
            Gate(f"{name}_status", said, ~F.col("candidate_status").eqNullSafe(F.col("route_status"))),
            Gate(f"{name}_identity", both, ~F.col("shelter_key").eqNullSafe(F.col("_key"))),
            Gate(f"{name}_distance", both, F.coalesce(F.abs(F.col("total_walking_distance_m") - F.col("_m")) > tolerance, F.lit(True))),
        ]
    return gates


def regression(actual: DataFrame, expected: Mapping[str, float], tolerance: Mapping[str, float] | None = None) -> DataFrame:
    """(kpi, expected, actual, passed) of a one-row frame of indicators; one that is missing fails, exact where no tolerance is given."""
    rows = []
    for name, value in expected.items():
        now = F.col(name).cast("double") if name in actual.columns else F.lit(None).cast("double")
        near = (tolerance or {}).get(name, 0.0)
        passed = F.coalesce(F.abs(now - F.lit(float(value))) <= near, F.lit(False))
        rows.append(F.struct(F.lit(name).alias("kpi"), F.lit(float(value)).alias("expected"), now.alias("actual"), passed.alias("passed")))
    return actual.select(F.inline(F.array(*rows)))


def explorer_gates(meshes: DataFrame, shown: DataFrame) -> list[Gate]:
    """The map's rows: every mesh once, analysed ones have a status, a score only where that is complete and within 0 to 100."""
    complete = F.col("score_status") == "complete"
    return [
        set_equality("same_meshes", meshes, shown, "mesh_id"),
        Gate("mesh_unique", unique_key(shown, ["mesh_id"])),
        Gate("target_has_status", shown, F.col("analysis_target") != (F.col("score_status") != "not_target")),
        Gate("score_only_where_complete", shown, F.col("full_score").isNotNull() != complete),
        Gate("score_0_100", shown, (F.col("full_score") < 0) | (F.col("full_score") > 100)),
    ]


def demand_gates(scored: DataFrame, pressure: DataFrame, shelters: DataFrame) -> list[Gate]:
    """Demand and capacity pressure: ``scored`` rows (mesh_id, ready, shelter_key, demand_area_weighted, demand_full_mesh, capacity, capacity_pressure_area_weighted),
    ``pressure`` of the shelters they were sent to (shelter_key, assigned demands, capacity, pressures), ``shelters`` that there are (shelter_key).

    Demand is neither lost nor doubled on its way to shelters; a capacity that is not known never becomes a pressure.
    """
    ready, of = F.coalesce(F.col("ready"), F.lit(False)), lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    known = F.coalesce(_known("capacity") > 0, F.lit(False))
    names = {"area": "area_weighted", "full": "full_mesh"}
    sums = scored.agg(*[of(F.col(f"demand_{n}")).alias(f"all_{n}") for n in names.values()], *[of(F.when(~ready, F.col(f"demand_{n}"))).alias(f"left_{n}") for n in names.values()])
    given = pressure.agg(*[of(F.col(f"assigned_demand_{n}")).alias(f"given_{n}") for n in names.values()])
    both = sums.crossJoin(given)  # one row each
    off = F.abs(_known("assigned_demand_area_weighted") / F.col("capacity") - _known("capacity_pressure_area_weighted"))
    return [
        Gate("selected_shelter_exists", scored.where(ready).join(shelters.select("shelter_key").distinct(), "shelter_key", "left_anti")),
        Gate("no_pressure_without_route", scored, ~ready & F.col("capacity_pressure_area_weighted").isNotNull()),
        Gate("no_pressure_without_capacity", scored, ready & ~known & F.col("capacity_pressure_area_weighted").isNotNull()),
        Gate("pressure_is_demand_over_capacity", pressure, known & F.coalesce(off > 1e-9, F.lit(True))),
        *[Gate(f"{short}_demand_conserved", both, F.abs(F.col(f"all_{n}") - F.col(f"left_{n}") - F.col(f"given_{n}")) > 1e-6) for short, n in names.items()],
        Gate("area_demand_within_full", scored, F.col("demand_area_weighted") - F.col("demand_full_mesh") > 1e-9),
    ]


def simulation_gates(before: DataFrame, after: DataFrame, simulated: DataFrame, expected: Mapping[str, int], score: str = "full_score") -> list[Gate]:
    """More capacity: ``before`` and ``after`` are the scored rows as they were and are, ``simulated`` rows of a what-if by delta and shelter.

    ``expected`` counts ``complete`` and ``noncomplete`` rows, ``known_shelters`` and
    ``overloaded`` ones.  On complete rows the capacity component is the clipped pressure and gives the
    score again, within 1e-8; no delta makes more shelters overloaded than were, a larger one not more than
    a smaller, nor does it save less; and no score has changed.
    """
    complete = F.col("score_status") == "complete"
    pressure, component, own = _known("capacity_pressure_area_weighted"), _known(COMPONENTS["shelter_capacity_pressure"]), _known(score)
    again = V.weighted_score({k: F.col(c) for k, c in COMPONENTS.items()}, V.FULL_WEIGHTS)
    broken = (F.abs(component - V.clip_keep_null(pressure * 100.0, 0.0, 100.0)) > 1e-8) | (F.abs(again - own) > 1e-8)
    per = simulated.groupBy("delta").agg(
        F.count(F.lit(1)).alias("known"),
        F.count_if("baseline_over_capacity").alias("was_over"),
        F.count_if("simulated_over_capacity").alias("is_over"),
        F.sum("affected_complete_meshes").alias("affected"),
        F.sum("total_score_reduction").alias("saved"),
    )
    w = Window.orderBy("delta")  # a row for each delta
    steps = per.withColumn("over_before", F.lag("is_over").over(w)).withColumn("saved_before", F.lag("saved").over(w))
    was, now = before.select("mesh_id", F.col(score).alias("_was")), after.select("mesh_id", F.col(score).alias("_now"), F.lit(True).alias("_there"))
    changed = was.withColumn("_here", F.lit(True)).join(now, "mesh_id", "full").where("NOT (_was <=> _now) OR _here IS NULL OR _there IS NULL")
    return [
        expected_count("complete_rows", before.where(complete), expected["complete"]),
        expected_count("noncomplete_rows", before.where(~complete), expected["noncomplete"]),
        Gate("component_contract", before, complete & F.coalesce(broken, F.lit(True))),
        Gate("known_shelters", per, F.col("known") != expected["known_shelters"]),
        Gate("overloaded_before", per, F.col("was_over") != expected["overloaded"]),
        Gate("no_new_overload", per, F.col("is_over") > expected["overloaded"]),
        Gate("affected_rows", per, F.col("affected") != expected["complete"]),
        Gate("reduction_not_negative", per, F.col("saved") < -1e-9),
        Gate("overload_does_not_rise", steps, F.col("is_over") > F.col("over_before")),
        Gate("reduction_does_not_fall", steps, F.col("saved") + 1e-8 < F.col("saved_before")),
        Gate("scores_unchanged", changed),
    ]


def export_gates(rows: DataFrame, pressure: DataFrame, expected: Mapping[str, int], statuses: Mapping[str, int], places: Sequence[object], score: str = "full_score") -> list[Gate]:
    """What is to be published: ``rows`` (mesh_id, municipality_code, route_status, score_status, cross_border, shelter_municipality_code, route_coordinates, route_segments as JSON, the score), ``pressure`` of shelters.

    ``expected`` counts ``rows``, ``complete`` routes, ``cross_border`` ones and ``overloaded`` shelters; ``statuses`` rows by
    status; ``places`` are the municipalities that there must be, and no other.
    """
    complete = F.coalesce(F.col("route_status") == "complete", F.lit(False))
    scored = F.coalesce(F.col("score_status") == "complete", F.lit(False))
    spark = rows.sparkSession
    wanted = spark.createDataFrame(sorted(statuses.items()), "score_status string, wanted long")
    counted = rows.groupBy("score_status").agg(F.count(F.lit(1)).alias("n")).join(wanted, "score_status", "full").where("NOT n <=> wanted")
    there = spark.createDataFrame([(p,) for p in places], StructType([StructField("municipality_code", rows.schema["municipality_code"].dataType)]))
    points, segments = (F.from_json(c, "array<string>") for c in ("route_coordinates", "route_segments"))
    return [
        expected_count("row_count", rows, expected["rows"]),
        Gate("mesh_unique", unique_key(rows, ["mesh_id"])),
        set_equality("municipalities", rows, there, "municipality_code"),
        expected_count("complete_routes", rows.where(complete), expected["complete"]),
        expected_count("unavailable_routes", rows.where(~complete), expected["rows"] - expected["complete"]),
        Gate("shelter_municipality_known", rows, complete & F.col("shelter_municipality_code").isNull()),
        expected_count("cross_border_routes", rows.where(complete & F.col("cross_border")), expected["cross_border"]),
        Gate("status_counts", counted),
        Gate("complete_has_score", rows, scored & _known(score).isNull()),
        Gate("score_only_where_complete", rows, ~scored & _known(score).isNotNull()),
        Gate("no_score_without_route", rows, ~complete & _known(score).isNotNull()),
        expected_count("overloaded_shelters", pressure.where(_known("capacity_pressure_area_weighted") > 1), expected["overloaded"]),
        Gate("route_geometry", rows, complete & (F.coalesce(F.size(points), F.lit(0)) < 1)),
        Gate("route_segments", rows, complete & segments.isNull()),
    ]
