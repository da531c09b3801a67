"""Queries of the stages' gate sets and of candidates, plans and exports, with their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import values as V
from terrafold.operators import allocation, candidates as C, gate_sets as G, nested, relational, scoring
from terrafold.operators.gates import Gate, evaluate, set_equality, summary, unique_key
from terrafold.plans import registry as R
from terrafold.plans import surrogates as S
from terrafold.plans.registry import query, r6


def gate_sql(views: str, gates: Sequence[tuple[str, str, str]]) -> str:
    """``views``, then a row for each (gate, severity, number of failures as SQL)."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS gate, '{severity}' AS severity, ({n})::BIGINT AS failures" for name, severity, n in gates)
    return f"{views} SELECT *, failures <= 0 AS passed FROM ({rows})"


def of(table: str, condition: str = "true") -> str:
    return f"SELECT count(*) FILTER (WHERE {condition}) FROM {table}"


def repeated(table: str, *keys: str, where: str = "true") -> str:
    k = ", ".join(keys)
    return f"SELECT count(*) FROM (SELECT {k} FROM {table} WHERE {where} GROUP BY {k} HAVING count(*) > 1)"


def only_in(left: str, right: str, key: str = "mesh_id") -> str:
    return f"SELECT count(*) FROM (SELECT DISTINCT {key} FROM {left} WHERE {key} NOT IN (SELECT {key} FROM {right}))"


# --- source data (gate set of the inputs)

SOURCES = S.with_views("t_mesh") + """,
    pop AS (SELECT mesh_id, CASE WHEN mesh_id % 53 > 0 THEN total_population END AS total, CASE WHEN mesh_id % 17 = 0 THEN total_population + 1.0 ELSE
        total_population * aging_rate_65plus END AS p65,
      CASE WHEN mesh_id % 13 > 0 THEN total_population * aging_rate_65plus / 2 END AS p75 FROM t_mesh),
    shel AS (SELECT 'id' || s_suppkey // 2 AS common_id, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END AS latitude, s_acctbal AS longitude,
      CASE s_suppkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN '2' ELSE '1' END AS tsunami, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey::VARCHAR END AS capacity FROM
        supplier),
    expo AS (SELECT mesh_id + CASE WHEN mesh_id % 101 = 0 THEN 10000000 ELSE 0 END AS mesh_id, tsunami_inundation_ratio AS r, tsunami_inundation_ratio * 100 +
        (mesh_id % 29 = 0)::INT AS s,
      CASE WHEN mesh_id % 31 = 0 THEN 170 ELSE 100 END AS wet FROM t_mesh WHERE mesh_id % 3 > 0),
    ring AS (SELECT mesh_id, mesh_id % 37 > 0 AND mesh_id % 43 > 0 AS valid FROM t_mesh WHERE mesh_id % 41 > 0)"""


SOURCE_GATES = gate_sql(
    SOURCES,
    [
        ("mesh_id_unique", "failure", repeated("pop", "mesh_id")),
        ("population_total_null", "failure", of("pop", "total IS NULL")),
        ("population_65plus_not_over_total", "failure", of("pop", "p65 > total")),
        ("age_missing_preserved", "warning", of("pop", "p65 IS NULL OR p75 IS NULL")),
        ("shelter_common_id_duplicates", "warning", repeated("shel", "common_id")),
        ("shelter_coordinate_missing", "warning", of("shel", "latitude IS NULL OR longitude IS NULL")),
        ("shelter_tsunami_flag_values", "failure", of("shel", "tsunami = '2'")),
        ("tsunami_shelter_capacity_missing", "warning", of("shel", "tsunami = '1' AND capacity IS NULL")),
        ("tsunami_mesh_id_unique", "failure", repeated("expo", "mesh_id")),
        ("tsunami_mesh_in_population", "failure", of("expo", "mesh_id NOT IN (SELECT mesh_id FROM pop)")),
        ("tsunami_inundation_ratio_0_1", "failure", of("expo", "r IS NULL OR r < 0 OR r > 1")),
        ("tsunami_exposure_score_formula", "failure", of("expo", "abs(s - r * 100) > 1e-8")),
        ("tsunami_sample_counts", "failure", of("expo", "wet > 169")),
        ("mesh_geometry_valid", "failure", of("ring", "NOT valid")),
        ("mesh_geojson_feature_count", "failure", "SELECT ((SELECT count(*) FROM ring) <> (SELECT count(*) FROM pop))::INT"),
    ],
)


@query(SOURCE_GATES)
def source_gates(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(G.source_gates(*_sources(spark, d)))


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    m = S.meshes(spark, d)
    population = m.selectExpr(
        "mesh_id",
        "CASE WHEN mesh_id % 53 > 0 THEN total_population END AS total_population",
        "CASE WHEN mesh_id % 17 = 0 THEN total_population + 1.0D ELSE total_population * aging_rate_65plus END AS population_65plus",
        "CASE WHEN mesh_id % 13 > 0 THEN total_population * aging_rate_65plus / 2 END AS population_75plus",
    )
    shelters = S.table(spark, d, "supplier").selectExpr(
        "concat('id', s_suppkey div 2) AS common_id",
        "CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END AS latitude",
        "s_acctbal AS longitude",
        "CASE s_suppkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN '2' ELSE '1' END AS tsunami",
        "CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey AS STRING) END AS capacity",
    )
    exposure = m.where("mesh_id % 3 > 0").selectExpr(
        "mesh_id + CASE WHEN mesh_id % 101 = 0 THEN 10000000 ELSE 0 END AS mesh_id",
        "tsunami_inundation_ratio",
        "tsunami_inundation_ratio * 100 + CAST(mesh_id % 29 = 0 AS INT) AS tsunami_exposure_score",
        "169 AS tsunami_sample_count",
        "CASE WHEN mesh_id % 31 = 0 THEN 170 ELSE 100 END AS tsunami_inundated_sample_count",
    )
    # Squares, some of them open, some with two corners changed for each other.
    corner = lambda x, y: f"named_struct('x', mesh_id + {x}, 'y', {y})"
    square = [corner("0.0D", "0.0D"), corner("0.5D", "0.0D"), corner("0.5D", "0.5D"), corner("0.0D", "0.5D"), corner("0.0D", "0.0D")]
    bow = [square[0], square[2], square[1], square[3], square[0]]
    ring = f"CASE WHEN mesh_id % 37 = 0 THEN array({', '.join(square[:4])}) WHEN mesh_id % 43 = 0 THEN array({', '.join(bow)}) ELSE array({', '.join(square)}) END AS ring"
    rings = m.where("mesh_id % 41 > 0").selectExpr("mesh_id", ring)
    return population, shelters, exposure, rings


@query(f"""SELECT CASE WHEN bool_or(NOT passed AND severity = 'failure') THEN 'failure' ELSE 'pass' END AS status, count(*) FILTER (WHERE NOT passed AND
        severity = 'failure') AS failure_count,
    count(*) FILTER (WHERE NOT passed AND severity = 'warning') AS warning_count FROM ({SOURCE_GATES})""")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of the 15 source gates, those that the surrogate rows are made to fail."""
    return summary(evaluate(G.source_gates(*_sources(spark, d))))


@query("""WITH f AS (SELECT bool_and(n_regionkey < 5) AS a, count(*) = 25 AS b FROM nation), o AS (SELECT true AS c, count(*) FILTER (WHERE n_nationkey = 24) =
        0 AS d, count(*) > 30 AS x FROM nation)
    SELECT unnest(['network_aoi_is_boundary_based', 'all_meshes_snap_checked', 'all_meshes_checked', 'all_analysis_targets_classified',
        'network_coverage_gaps_are_explicit', 'unresolved_targets']) AS gate,
      'failure' AS severity, unnest([(NOT a)::BIGINT, (NOT b)::BIGINT, (NOT c)::BIGINT, (NOT d)::BIGINT, 1::BIGINT, x::BIGINT]) AS failures,
      unnest([a, b, c, d, false, NOT x]) AS passed FROM f, o""")
def foundation_gates(spark: SparkSession, d: str) -> DataFrame:
    n = S.table(spark, d, "nation")
    foundation = n.agg(F.bool_and(F.col("n_regionkey") < 5).alias("network_aoi_is_boundary_based"), (F.count(F.lit(1)) == 25).alias("all_meshes_snap_checked"))
    origins = n.agg(
        F.lit(True).alias("all_meshes_checked"),
        (F.count_if(F.col("n_nationkey") == 24) == 0).alias("all_analysis_targets_classified"),
        F.lit(None).cast("boolean").alias("network_coverage_gaps_are_explicit"),
        (F.count(F.lit(1)) > 30).alias("blocking"),
    )
    return evaluate(G.foundation_gates(foundation, origins))


# --- routes and their exposure

ROUTES = S.with_views("t_mesh", "t_candidate") + """,
    target AS (SELECT mesh_id FROM t_mesh WHERE tsunami_inundation_ratio > 0),
    route AS (SELECT t.mesh_id, CASE WHEN c.mesh_id IS NULL THEN 'no_network_path' WHEN t.mesh_id % 61 = 0 THEN 'network_coverage_gap' WHEN t.mesh_id % 59 = 0
        THEN 'lost' ELSE 'complete' END AS status,
        c.shelter_key, total_walking_distance_m AS total, total_walking_distance_m * 0.1 AS access, CASE WHEN t.mesh_id % 43 > 0 THEN total_walking_distance_m *
        0.6 END AS path,
        total_walking_distance_m * 0.3 + (t.mesh_id % 47 = 0)::INT AS connector, CASE WHEN t.mesh_id % 23 = 0 THEN '[]' WHEN t.mesh_id % 19 = 0 THEN 'x' ELSE
        '[[1,2]]' END AS line,
        inundation_ratio AS ratio, unknown_ratio AS unknown
      FROM target t LEFT JOIN t_candidate c ON c.mesh_id = t.mesh_id AND c.candidate_rank = 1)"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return scoring.targets(S.meshes(spark, d)).select("mesh_id")


def _routes(spark: SparkSession, d: str) -> DataFrame:
    status = "CASE WHEN shelter_key IS NULL THEN 'no_network_path' WHEN mesh_id % 61 = 0 THEN 'network_coverage_gap' WHEN mesh_id % 59 = 0 THEN 'lost' ELSE 'complete' END"
    return _targets(spark, d).join(R.first_candidates(spark, d), "mesh_id", "left").selectExpr(
        "mesh_id",
        f"{status} AS route_status",
        "shelter_key",
        "total_walking_distance_m",
        "total_walking_distance_m * 0.1D AS origin_access_distance_m",
        "CASE WHEN mesh_id % 43 > 0 THEN total_walking_distance_m * 0.6D END AS network_path_distance_m",
        "total_walking_distance_m * 0.3D + CAST(mesh_id % 47 = 0 AS INT) AS shelter_connector_distance_m",
        "CASE WHEN mesh_id % 23 = 0 THEN '[]' WHEN mesh_id % 19 = 0 THEN 'x' ELSE '[[1,2]]' END AS route_network_coordinates",
        "inundation_ratio",
        "unknown_ratio",
    )


DONE = "status = 'complete'"


@query(
    gate_sql(
        ROUTES + ", gap AS (SELECT mesh_id FROM target WHERE mesh_id % 122 = 0)",
        [
            ("target_count", "failure", "SELECT (count(*) <> 10)::INT FROM target"),
            ("route_count", "failure", "SELECT (count(*) <> 10)::INT FROM route"),
            ("route_mesh_unique", "failure", repeated("route", "mesh_id")),
            ("missing_targets", "failure", only_in("target", "route")),
            ("unexpected_meshes", "failure", only_in("route", "target")),
            ("known_statuses", "failure", of("route", "status = 'lost'")),
            ("complete_routes_have_all_fields", "failure", of("route", f"{DONE} AND path IS NULL")),
            ("distance_formula", "failure", of("route", f"{DONE} AND abs(access + path + connector - total) > 1e-6")),
            ("connector_length", "failure", of("route", f"{DONE} AND connector > 500 + 1e-9")),
            ("complete_route_geometry", "failure", of("route", f"{DONE} AND line <> '[[1,2]]'")),
            ("coverage_gaps", "failure", "SELECT count(*) FROM (SELECT mesh_id FROM route WHERE status = 'network_coverage_gap') a FULL JOIN gap USING (mesh_id) WHERE a.mesh_id IS NULL OR gap.mesh_id IS NULL"),
        ],
    )
)
def route_gates(spark: SparkSession, d: str) -> DataFrame:
    targets = _targets(spark, d)
    return evaluate(G.route_gates(_routes(spark, d), targets, targets.where("mesh_id % 122 = 0"), 10))


EXPOSED = ROUTES + """, e AS (SELECT *, CASE WHEN status = 'complete' AND mesh_id % 71 = 0 THEN 'error:KeyError' WHEN status = 'complete' THEN 'complete' WHEN
        mesh_id % 2 = 0 THEN 'route_unavailable' ELSE 'none' END AS exposed,
      total * CASE WHEN mesh_id % 67 = 0 THEN 1.2 ELSE 1.01 END AS modeled, CASE WHEN mesh_id % 73 = 0 THEN ratio + 1 ELSE ratio END AS share, 1 - unknown +
        CASE WHEN mesh_id % 79 = 0 THEN 0.1 ELSE 0 END AS coverage,
      mesh_id % 83 AS samples FROM route)"""
SHOWN = "exposed = 'complete'"


@query(
    gate_sql(
        EXPOSED,
        [
            ("row_count", "failure", "SELECT (count(*) <> 10)::INT FROM e"),
            ("mesh_unique", "failure", repeated("e", "mesh_id")),
            ("source_complete_count", "failure", f"SELECT (count(*) <> 10)::INT FROM e WHERE {DONE}"),
            ("exposure_complete_count", "failure", f"SELECT (count(*) <> 10)::INT FROM e WHERE {SHOWN}"),
            ("same_complete_set", "failure", of("e", f"({DONE}) <> ({SHOWN})")),
            ("row_errors", "failure", of("e", "exposed = 'error:KeyError'")),
            ("complete_has_numbers", "failure", of("e", f"{SHOWN} AND (modeled IS NULL OR share IS NULL OR unknown IS NULL)")),
            ("inundation_ratio_0_1", "failure", of("e", f"{SHOWN} AND (share < 0 OR share > 1)")),
            ("unknown_ratio_0_1", "failure", of("e", f"{SHOWN} AND (unknown < 0 OR unknown > 1)")),
            ("unknown_and_coverage_add_to_one", "failure", of("e", f"{SHOWN} AND abs(unknown + coverage - 1) > 1e-9")),
            ("samples_above_zero", "failure", of("e", f"{SHOWN} AND samples <= 0")),
            ("length_above_zero", "failure", of("e", f"{SHOWN} AND modeled <= 0")),
            ("unavailable_is_kept", "failure", of("e", f"NOT ({DONE}) AND exposed <> 'route_unavailable'")),
            ("unavailable_has_no_ratio", "failure", of("e", f"NOT ({DONE}) AND share IS NOT NULL")),
            ("length_like_the_walk", "failure", of("e", f"{SHOWN} AND abs(modeled - total) > 100 AND abs(modeled - total) / total > 0.05")),
        ],
    )
)
def exposure_gates(spark: SparkSession, d: str) -> DataFrame:
    exposed = "CASE WHEN route_status = 'complete' AND mesh_id % 71 = 0 THEN 'error:KeyError' WHEN route_status = 'complete' THEN 'complete' WHEN mesh_id % 2 = 0 THEN 'route_unavailable' ELSE 'none' END"
    rows = _routes(spark, d).selectExpr(
        "mesh_id",
        "route_status",
        f"{exposed} AS route_exposure_status",
        "total_walking_distance_m",
        "total_walking_distance_m * CASE WHEN mesh_id % 67 = 0 THEN 1.2D ELSE 1.01D END AS route_modeled_geometry_distance_m",
        "0.0D AS route_inundation_distance_m",
        "CASE WHEN mesh_id % 73 = 0 THEN inundation_ratio + 1 ELSE inundation_ratio END AS route_inundation_ratio",
        "unknown_ratio AS route_unknown_ratio",
        "1 - unknown_ratio + CASE WHEN mesh_id % 79 = 0 THEN 0.1D ELSE 0.0D END AS route_classified_coverage_ratio",
        "mesh_id % 83 AS route_tsunami_sample_count",
    )
    return evaluate(G.exposure_gates(rows, 10, 10))


@query(ROUTES + """ SELECT mesh_id, round(abs(access + path + connector - total), 6) AS residual_m, coalesce(abs(access + path + connector - total) > 1e-6,
        false) AS off FROM route""")
def distance_accounting(spark: SparkSession, d: str) -> DataFrame:
    rows, gate = C.account(_routes(spark, d))
    return rows.select("mesh_id", r6("residual_m"), F.coalesce(gate.failing, F.lit(False)).alias("off"))


@query(S.with_views("t_mesh", "t_candidate") + """ SELECT m.mesh_id, coalesce(c.n, 0) AS sample_count, c.least AS total_walking_distance_m,
      CASE WHEN c.n IS NOT NULL THEN 'complete' WHEN total_population = 0 THEN 'network_coverage_gap' ELSE 'no_network_path' END AS route_status
    FROM t_mesh m LEFT JOIN (SELECT mesh_id, count(*) AS n, round(min(total_walking_distance_m), 6) AS least FROM t_candidate GROUP BY 1) c USING (mesh_id)""")
def failure_rows(spark: SparkSession, d: str) -> DataFrame:
    found = S.candidates(spark, d).groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.round(F.min("total_walking_distance_m"), 6).alias("total_walking_distance_m"), F.lit("complete").alias("route_status")
    )
    why = F.when(F.col("total_population") == 0, "network_coverage_gap").otherwise("no_network_path")
    rows = C.with_failures(S.meshes(spark, d), found, "mesh_id", ["sample_count"], "route_status", why)
    return rows.select("mesh_id", "sample_count", "total_walking_distance_m", "route_status")


# --- scores, ranks and what-if

COUNTS = {"complete": 10, "core_data_incomplete": 10, "core_only_missing_capacity": 10, "route_unavailable": 10}


@query(
    gate_sql(
        R.RANKS,
        [
            ("mesh_unique", "failure", repeated("risk", "mesh_id")),
            ("status_counts", "failure", "SELECT count(*) FROM (SELECT score_status FROM risk GROUP BY 1 HAVING count(*) <> 10)"),
            ("complete_has_score", "failure", of("risk", "score_status = 'complete' AND full_score IS NULL")),
            ("score_only_where_complete", "failure", of("risk", "score_status <> 'complete' AND full_score IS NOT NULL")),
            ("baseline_recomputed", "failure", "SELECT count(*) FROM risk LEFT JOIN (SELECT * FROM ranks WHERE scenario = 'baseline') r USING (mesh_id) WHERE score_status = 'complete' AND coalesce(abs(full_score - r.score) > 1e-9, true)"),
            ("ranks_known", "failure", of("ranks", "rank IS NULL OR score IS NULL")),
        ],
    )
)
def sensitivity_gates(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(G.sensitivity_gates(R.risk(spark, d), R.ranks(spark, d), COUNTS))


@query(R.RANKS + """, k AS (SELECT count(*) AS target_meshes, count(*) FILTER (WHERE score_status = 'complete') AS complete_scores, count(*) FILTER (WHERE NOT
        ready) AS route_unavailable,
      (SELECT count(DISTINCT scenario) FROM ranks) AS scenario_count FROM risk)
    SELECT kpi, expected, actual, coalesce(abs(actual - expected) <= CASE kpi WHEN 'complete_scores' THEN 1e9 ELSE 0 END, false) AS passed FROM (
      SELECT 'target_meshes' AS kpi, 100.0::DOUBLE AS expected, target_meshes::DOUBLE AS actual FROM k UNION ALL SELECT 'complete_scores', 50, complete_scores
        FROM k
      UNION ALL SELECT 'scenario_count', 12, scenario_count FROM k UNION ALL SELECT 'cross_border_routes', 13, NULL)""")
def kpi_regression(spark: SparkSession, d: str) -> DataFrame:
    r = R.risk(spark, d)
    scenarios = R.ranks(spark, d).agg(F.count_distinct("scenario").alias("scenario_count"))
    kpis = r.agg(F.count(F.lit(1)).alias("target_meshes"), F.count_if(F.col("score_status") == "complete").alias("complete_scores")).crossJoin(scenarios)  # one row each
    return G.regression(kpis, {"target_meshes": 100, "complete_scores": 50, "scenario_count": 12, "cross_border_routes": 13}, {"complete_scores": 1e9})


@query(R.WHATIF + """, o AS (SELECT *, row_number() OVER (PARTITION BY delta ORDER BY round(total_score_reduction, 9) DESC,
        round(capacity_pressure_area_weighted - simulated_pressure, 9) DESC, assigned DESC, shelter_key::VARCHAR) AS place
      FROM (SELECT w.*, round(p.assigned_demand_area_weighted, 9) AS assigned FROM whatif w JOIN pressure p USING (shelter_key)))
    SELECT delta, place::INT AS place, round(total_score_reduction + 1e-8, 6) AS total_score_reduction FROM o WHERE place <= 12""")
def whatif_ranking_demand(spark: SparkSession, d: str) -> DataFrame:
    """The panel's order: reduction, pressure reduction, demand, key."""
    w = scoring.what_if_capacity(R.risk(spark, d), R.pressures(spark, d), R.DELTAS)
    w = w.withColumns({c: F.round(c, 9) for c in ("total_score_reduction", "capacity_pressure_area_weighted", "simulated_pressure", "assigned_demand_area_weighted")})
    top = scoring.what_if_ranking(w, order="demand")
    return top.select("delta", "place", r6("total_score_reduction", F.col("total_score_reduction") + 1e-8))


@query(R.WHATIF + """ SELECT delta, shelter_key, round(CASE WHEN affected_complete_meshes > 0 THEN total_score_reduction / affected_complete_meshes ELSE 0 END +
        1e-8, 6) AS mean_score_reduction FROM whatif""")
def whatif_means(spark: SparkSession, d: str) -> DataFrame:
    w = scoring.what_if_capacity(R.risk(spark, d), R.pressures(spark, d), R.DELTAS)
    return w.select("delta", "shelter_key", r6("mean_score_reduction", F.col("mean_score_reduction") + 1e-8))


SCORED_FAULTS = R.RISK + """, scored AS (SELECT mesh_id, ready, CASE WHEN mesh_id % 61 = 0 THEN shelter_key + 1000000 ELSE shelter_key END AS shelter_key,
      demand_area_weighted + CASE WHEN mesh_id % 59 = 0 THEN 1e6 ELSE 0 END AS area, demand_full_mesh AS whole, capacity,
      CASE WHEN mesh_id % 47 = 0 THEN 1.0 ELSE capacity_pressure_area_weighted END AS p FROM risk),
    given AS (SELECT shelter_key, assigned_demand_area_weighted AS area, assigned_demand_full_mesh AS whole, capacity, capacity_pressure_area_weighted + CASE
        WHEN shelter_key % 7 = 0 THEN 0.5 ELSE 0 END AS p FROM pressure)"""


@query(
    gate_sql(
        SCORED_FAULTS,
        [
            ("selected_shelter_exists", "failure", "SELECT count(*) FROM scored WHERE ready AND shelter_key NOT IN (SELECT shelter_key FROM t_shelter)"),
            ("no_pressure_without_route", "failure", of("scored", "NOT ready AND p IS NOT NULL")),
            ("no_pressure_without_capacity", "failure", of("scored", "ready AND NOT coalesce(capacity > 0, false) AND p IS NOT NULL")),
            ("pressure_is_demand_over_capacity", "failure", of("given", "capacity > 0 AND coalesce(abs(area / capacity - p) > 1e-9, true)")),
            ("area_demand_conserved", "failure", "SELECT (abs((SELECT sum(area) FROM scored WHERE ready) - (SELECT sum(area) FROM given)) > 1e-6)::INT"),
            ("full_demand_conserved", "failure", "SELECT (abs((SELECT sum(whole) FROM scored WHERE ready) - (SELECT sum(whole) FROM given)) > 1e-6)::INT"),
            ("area_demand_within_full", "failure", of("scored", "area - whole > 1e-9")),
        ],
    )
)
def demand_gates(spark: SparkSession, d: str) -> DataFrame:
    """Scored rows and pressures, some of them made wrong."""
    change = lambda df, **c: df.withColumns({n: F.expr(e) for n, e in c.items()})
    scored = change(
        R.risk(spark, d),
        shelter_key="CASE WHEN mesh_id % 61 = 0 THEN shelter_key + 1000000 ELSE shelter_key END",
        demand_area_weighted="demand_area_weighted + IF(mesh_id % 59 = 0, 1e6D, 0D)",
        capacity_pressure_area_weighted="CASE WHEN mesh_id % 47 = 0 THEN 1.0D ELSE capacity_pressure_area_weighted END",
    )
    given = change(R.pressures(spark, d), capacity_pressure_area_weighted="capacity_pressure_area_weighted + IF(shelter_key % 7 = 0, 0.5D, 0D)")
    return evaluate(G.demand_gates(scored, given, S.shelters(spark, d)))


SIMULATED = R.WHATIF + f""", was AS (SELECT mesh_id, score_status, capacity_pressure_area_weighted AS p, pa + CASE WHEN mesh_id % 41 = 0 THEN 1 ELSE 0 END AS
        component, full_score,
      {R.clip("(te * 25.0 + vp * 20.0 + wa * 25.0 + rp * 15.0 + (pa + CASE WHEN mesh_id % 41 = 0 THEN 1 ELSE 0 END) * 15.0) / 100.0")} AS again FROM risk),
    sim2 AS (SELECT delta, shelter_key, capacity_pressure_area_weighted > 1 AS was_over, simulated_pressure > 1 OR delta = 500 AND shelter_key % 2 = 0 AS
        is_over, affected_complete_meshes AS n,
      CASE WHEN delta = 1000 THEN total_score_reduction / 1000 ELSE total_score_reduction END AS saved FROM whatif),
    per AS (SELECT delta, count(*) AS known, count(*) FILTER (WHERE was_over) AS was_over, count(*) FILTER (WHERE is_over) AS is_over, sum(n) AS affected,
        sum(saved) AS saved FROM sim2 GROUP BY delta),
    steps AS (SELECT *, lag(is_over) OVER (ORDER BY delta) AS o0, lag(saved) OVER (ORDER BY delta) AS s0 FROM per)"""


@query(
    gate_sql(
        SIMULATED,
        [
            ("complete_rows", "failure", "SELECT (count(*) <> 10)::INT FROM was WHERE score_status = 'complete'"),
            ("noncomplete_rows", "failure", "SELECT (count(*) <> 10)::INT FROM was WHERE score_status <> 'complete'"),
            ("component_contract", "failure", of("was", f"score_status = 'complete' AND coalesce(abs(component - ({R.clip('p * 100')})) > 1e-8 OR abs(again - full_score) > 1e-8, true)")),
            ("known_shelters", "failure", of("per", "known <> 10")),
            ("overloaded_before", "failure", of("per", "was_over <> 10")),
            ("no_new_overload", "failure", of("per", "is_over > 10")),
            ("affected_rows", "failure", of("per", "affected <> 10")),
            ("reduction_not_negative", "failure", of("per", "saved < -1e-9")),
            ("overload_does_not_rise", "failure", of("steps", "is_over > o0")),
            ("reduction_does_not_fall", "failure", of("steps", "saved + 1e-8 < s0")),
            ("scores_unchanged", "failure", of("was", "mesh_id % 43 = 0 AND full_score IS NOT NULL")),
        ],
    )
)
def simulation_gates(spark: SparkSession, d: str) -> DataFrame:
    """Scores and what-if rows, some of them made wrong: a component, an overload that comes with more capacity, a reduction that falls, scores that changed."""
    r = R.risk(spark, d)
    component = "shelter_capacity_pressure_component_area_weighted"
    before = r.withColumn(component, F.col(component) + F.expr("IF(mesh_id % 41 = 0, 1D, 0D)"))
    after = r.withColumn("full_score", F.col("full_score") + F.expr("IF(mesh_id % 43 = 0, 1D, 0D)"))
    w = scoring.what_if_capacity(r, R.pressures(spark, d), R.DELTAS)
    w = w.withColumn("simulated_over_capacity", F.expr("simulated_over_capacity OR delta = 500 AND shelter_key % 2 = 0"))
    w = w.withColumn("total_score_reduction", F.expr("IF(delta = 1000, total_score_reduction / 1000, total_score_reduction)"))
    return evaluate(G.simulation_gates(before, after, w, {"complete": 10, "noncomplete": 10, "known_shelters": 10, "overloaded": 10}))


PUBLIC = R.RISK + """, pub AS (SELECT mesh_id, municipality_code, CASE WHEN ready THEN 'complete' ELSE 'no_network_path' END AS route_status, score_status,
        mesh_id % 5 = 0 AS crossing,
      CASE WHEN mesh_id % 19 > 0 THEN 1 END AS shelter_place, CASE mesh_id % 23 WHEN 0 THEN '[]' WHEN 1 THEN 'x' ELSE '[[1,2]]' END AS points, CASE mesh_id % 29
        WHEN 0 THEN '{"a"' ELSE '[]' END AS segments,
      CASE WHEN mesh_id % 31 = 0 THEN 1.0 WHEN mesh_id % 37 = 0 THEN NULL ELSE full_score END AS score FROM risk),
    off AS (SELECT municipality_code FROM pub GROUP BY 1 HAVING municipality_code > 13)"""


@query(
    gate_sql(
        PUBLIC,
        [
            ("row_count", "failure", "SELECT (count(*) <> 1090)::INT FROM pub"),
            ("mesh_unique", "failure", repeated("pub", "mesh_id")),
            ("municipalities", "failure", "SELECT count(*) FROM off"),
            ("complete_routes", "failure", "SELECT (count(*) <> 1062)::INT FROM pub WHERE route_status = 'complete'"),
            ("unavailable_routes", "failure", "SELECT (count(*) <> 28)::INT FROM pub WHERE route_status <> 'complete'"),
            ("shelter_municipality_known", "failure", of("pub", "route_status = 'complete' AND shelter_place IS NULL")),
            ("cross_border_routes", "failure", "SELECT (count(*) <> 13)::INT FROM pub WHERE route_status = 'complete' AND crossing"),
            ("status_counts", "failure", """SELECT count(*) FROM (SELECT score_status, count(*) AS n FROM pub GROUP BY 1) FULL JOIN
              (VALUES ('complete', 813), ('core_only_missing_capacity', 128), ('core_data_incomplete', 121), ('route_unavailable', 28)) w(score_status, wanted)
        USING (score_status) WHERE n IS DISTINCT FROM wanted"""),
            ("complete_has_score", "failure", of("pub", "score_status = 'complete' AND score IS NULL")),
            ("score_only_where_complete", "failure", of("pub", "score_status <> 'complete' AND score IS NOT NULL")),
            ("no_score_without_route", "failure", of("pub", "route_status <> 'complete' AND score IS NOT NULL")),
            ("overloaded_shelters", "failure", "SELECT (count(*) <> 35)::INT FROM pressure WHERE capacity_pressure_area_weighted > 1"),
            ("route_geometry", "failure", of("pub", "route_status = 'complete' AND points <> '[[1,2]]'")),
            ("route_segments", "failure", of("pub", "route_status = 'complete' AND segments <> '[]'")),
        ],
    )
)
def export_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gates of a public export over scored rows that are made to fail some of them."""
    return evaluate(G.export_gates(_public(spark, d), R.pressures(spark, d), EXPORTED, EXPORTED_STATUSES, range(14)))


# What the published export holds.
EXPORTED = {"rows": 1090, "complete": 1062, "cross_border": 13, "overloaded": 35}
EXPORTED_STATUSES = {"complete": 813, "core_only_missing_capacity": 128, "core_data_incomplete": 121, "route_unavailable": 28}


def _public(spark: SparkSession, d: str) -> DataFrame:
    return R.risk(spark, d).selectExpr(
        "mesh_id", "municipality_code", "IF(ready, 'complete', 'no_network_path') AS route_status", "score_status", "mesh_id % 5 = 0 AS cross_border",
        "IF(mesh_id % 19 > 0, 1, NULL) AS shelter_municipality_code", "CASE mesh_id % 23 WHEN 0 THEN '[]' WHEN 1 THEN 'x' ELSE '[[1,2]]' END AS route_coordinates",
        """CASE mesh_id % 29 WHEN 0 THEN '{"a"' ELSE '[]' END AS route_segments""", "CASE WHEN mesh_id % 31 = 0 THEN 1.0D WHEN mesh_id % 37 = 0 THEN NULL ELSE full_score END AS full_score",
    )


@query("""WITH c AS (SELECT c_custkey AS k, c_acctbal AS bal FROM customer)
    SELECT k AS doc, '$.at.balance' AS path, 'value' AS problem FROM c WHERE k % 7 = 0 UNION ALL SELECT k, '$.tags', 'length' FROM c WHERE k % 11 = 0
    UNION ALL SELECT k, '$.tags[1].n', 'value' FROM c WHERE k % 13 = 0 AND k % 11 > 0 UNION ALL SELECT k, '$.name', 'missing' FROM c WHERE k % 17 = 0
    UNION ALL SELECT k, '$.name', 'kind' FROM c WHERE k % 19 = 0 AND k % 17 > 0""")
def nested_regression(spark: SparkSession, d: str) -> DataFrame:
    """A document for each customer against one with some of its values changed, within and beyond the tolerance."""
    c = S.table(spark, d, "customer")
    body = lambda name, balance, tags: c.selectExpr("c_custkey AS doc", f"to_json(named_struct('name', {name}, 'at', named_struct('balance', {balance}, 'nation', c_nationkey), 'tags', {tags})) AS body")
    tag = lambda n: f"named_struct('n', {n}, 'yes', c_acctbal > 0)"
    plain = body("c_name", "c_acctbal", f"array({tag('c_nationkey')}, {tag('c_custkey')})")
    changed = body(
        "CASE WHEN c_custkey % 17 > 0 AND c_custkey % 19 > 0 THEN c_name END", "c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 0.5D ELSE 1e-8D END",
        f"IF(c_custkey % 11 = 0, array({tag('c_nationkey')}), array({tag('c_nationkey')}, {tag('c_custkey + IF(c_custkey % 13 = 0, 1, 0)')}))",
    )
    wrong = F.when((F.col("doc") % 19 == 0) & (F.col("doc") % 17 > 0), F.regexp_replace("body", r"^\{", '{"name":5,')).otherwise(F.col("body"))
    return nested.differences(plain, changed.withColumn("body", wrong), depth=4)


# --- candidates

PARITY = S.with_views("t_mesh", "t_candidate") + """, cand AS (SELECT mesh_id, candidate_rank, shelter_key, total_walking_distance_m + CASE WHEN mesh_id % 40 =
        0 AND candidate_rank = 2 THEN 1e6 ELSE 0 END AS m FROM t_candidate),
    status AS (SELECT mesh_id, CASE WHEN mesh_id IN (SELECT mesh_id FROM t_candidate) THEN 'complete' ELSE 'no_network_path' END AS s FROM t_mesh),
    base AS (SELECT status.mesh_id, CASE WHEN status.mesh_id % 33 = 0 THEN 'no_network_path' ELSE s END AS s, shelter_key + (status.mesh_id % 35 = 0)::INT AS
        shelter_key, m + CASE WHEN status.mesh_id % 39 = 0 THEN 0.01 ELSE 0 END AS m
      FROM status LEFT JOIN cand ON cand.mesh_id = status.mesh_id AND candidate_rank = 1 WHERE status.mesh_id % 97 > 0),
    pair2 AS (SELECT base.*, c.shelter_key AS k2, c.m AS m2 FROM base LEFT JOIN cand c ON c.mesh_id = base.mesh_id AND c.candidate_rank = 1 WHERE s =
        'complete')"""


@query(
    gate_sql(
        PARITY,
        [
            ("status_mesh_unique", "failure", repeated("status", "mesh_id")),
            ("pair_unique", "failure", repeated("cand", "mesh_id", "shelter_key")),
            ("rank_unique", "failure", repeated("cand", "mesh_id", "candidate_rank")),
            ("rank_within_limit", "failure", of("cand", "candidate_rank > 9")),
            ("ranks_and_distances_rise", "failure", "SELECT count(DISTINCT mesh_id) FROM (SELECT mesh_id, m < lag(m) OVER (PARTITION BY mesh_id ORDER BY candidate_rank) AS falls FROM cand) WHERE falls"),
            ("same_meshes", "failure", f"({only_in('status', 'base')}) + ({only_in('base', 'status')})"),
            ("same_status", "failure", "SELECT count(*) FROM status LEFT JOIN base USING (mesh_id) WHERE status.s IS DISTINCT FROM base.s"),
            ("same_identity", "failure", of("pair2", "shelter_key IS DISTINCT FROM k2")),
            ("same_distance", "failure", of("pair2", "coalesce(abs(m - m2) > 1e-6, true)")),
        ],
    )
)
def candidate_parity_gates(spark: SparkSession, d: str) -> DataFrame:
    cand = S.candidates(spark, d).selectExpr(
        "mesh_id", "candidate_rank", "shelter_key", "total_walking_distance_m + CASE WHEN mesh_id % 40 = 0 AND candidate_rank = 2 THEN 1e6D ELSE 0.0D END AS total_walking_distance_m"
    )
    there = cand.select("mesh_id").distinct().withColumn("candidate_status", F.lit("complete"))
    status = S.meshes(spark, d).select("mesh_id").join(there, "mesh_id", "left").withColumn("candidate_status", F.coalesce("candidate_status", F.lit("no_network_path")))
    base = status.where("mesh_id % 97 > 0").join(cand.where("candidate_rank = 1"), "mesh_id", "left").selectExpr(
        "mesh_id",
        "CASE WHEN mesh_id % 33 = 0 THEN 'no_network_path' ELSE candidate_status END AS route_status",
        "shelter_key + CAST(mesh_id % 35 = 0 AS INT) AS shelter_key",
        "total_walking_distance_m + CASE WHEN mesh_id % 39 = 0 THEN 0.01D ELSE 0.0D END AS total_walking_distance_m",
    )
    return evaluate(G.candidate_parity_gates(cand, status, {"same": base}, 9, 1e-6))


@query(S.with_views("t_candidate") + """ SELECT mesh_id, shelter_key, candidate_rank::INT AS candidate_rank, CASE WHEN candidate_rank = 1 AND mesh_id % 2 = 0
        THEN mesh_id * 10 ELSE shelter_key END AS code,
      CASE WHEN candidate_rank = 1 AND mesh_id % 2 = 0 THEN mesh_id % 4 = 0 END AS cross_border FROM t_candidate""")
def anchor_overlay(spark: SparkSession, d: str) -> DataFrame:
    c = S.candidates(spark, d).select("mesh_id", "shelter_key", "candidate_rank", F.col("shelter_key").alias("code"), F.lit(None).cast("boolean").alias("cross_border"))
    canonical = c.where("candidate_rank = 1 AND mesh_id % 2 = 0").select("mesh_id", (F.col("mesh_id") * 10).alias("code"), (F.col("mesh_id") % 4 == 0).alias("cross_border"))
    return C.anchored(c, canonical, ["code", "cross_border"], F.lit(True))


RAW_SHELTERS = """raw AS (SELECT s_suppkey AS place, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE ' E3820' || s_suppkey // 3 % 9 || 'x ' END AS id, CASE WHEN
        s_suppkey % 11 = 0 THEN NULL ELSE 'n' || s_suppkey // 6 END AS nm,
    CASE s_suppkey % 5 WHEN 0 THEN '0' WHEN 1 THEN 'x' ELSE '1' END AS flag, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE (s_suppkey * 3)::VARCHAR END AS cap, CASE
        WHEN s_suppkey % 3 = 0 THEN ' ' ELSE ' c' || s_suppkey % 2 END AS city,
    CASE WHEN s_suppkey % 8 = 0 THEN '-' ELSE '33.5' END AS lat, '132.25' AS lon FROM supplier),
    ok AS (SELECT *, trim(id) || '||' || nm AS key FROM raw WHERE flag = '1' AND trim(id) <> '' AND nm IS NOT NULL)"""


def _raw_shelters(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "supplier").selectExpr(
        "s_suppkey AS place",
        "CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE concat(' E3820', (s_suppkey div 3) % 9, 'x ') END AS common_id",
        "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE concat('n', s_suppkey div 6) END AS name",
        "CASE s_suppkey % 5 WHEN 0 THEN '0' WHEN 1 THEN 'x' ELSE '1' END AS tsunami",
        "CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(s_suppkey * 3 AS STRING) END AS capacity",
        "CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE concat(' c', s_suppkey % 2) END AS address_city",
        "CASE WHEN s_suppkey % 8 = 0 THEN '-' ELSE '33.5' END AS latitude",
        "'132.25' AS longitude",
    )


@query(f"WITH {RAW_SHELTERS} SELECT place, key AS shelter_key FROM ok")
def shelter_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return C.eligible_shelters(_raw_shelters(spark, d)).select("place", "shelter_key")


@query(f"WITH {RAW_SHELTERS} SELECT place, lat::DOUBLE AS latitude, lon::DOUBLE AS longitude FROM raw WHERE flag = '1' AND lat <> '-'")
def candidate_shelter_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.candidate_shelters(_raw_shelters(spark, d)).select("place", "latitude", "longitude")


@query(f"""WITH {RAW_SHELTERS}, g AS (SELECT key, sum(CASE WHEN cap <> '' THEN cap::DOUBLE END) AS c, count(*) AS n, string_agg(DISTINCT CASE WHEN cap = '' THEN
        'unparseable' ELSE 'numeric' END, ';' ORDER BY CASE WHEN cap = '' THEN 'unparseable' ELSE 'numeric' END) AS st,
      arg_min(trim(city), place) FILTER (WHERE trim(city) <> '') AS city, count(DISTINCT trim(city) || '|' || lat) AS sigs FROM ok GROUP BY key)
    SELECT key AS shelter_key, c AS shelter_capacity, n AS capacity_record_count, st AS capacity_parse_status, city AS shelter_city, sigs AS
        facility_signature_count,
      CASE WHEN c IS NULL THEN 'missing' WHEN c > 0 THEN 'available' ELSE 'invalid' END AS capacity_status, sigs > 1 AS ambiguous FROM g""")
def shelter_identities(spark: SparkSession, d: str) -> DataFrame:
    return C.collapse_shelters(C.eligible_shelters(_raw_shelters(spark, d)), "place")


SNAPPED = "snapped AS (SELECT s_suppkey AS shelter, CASE WHEN s_suppkey % 6 = 0 THEN 'none' ELSE 'E' || lpad((38200 + s_suppkey % 3)::VARCHAR, 5, '0') || '01' END AS common_id, 'k' || s_suppkey // 2 AS shelter_key, 'n' || s_suppkey % 37 AS node, abs(s_acctbal) / 10 AS connector_m, s_acctbal AS latitude, s_suppkey AS longitude FROM supplier)"


def _snapped(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "supplier").selectExpr(
        "s_suppkey AS shelter",
        "CASE WHEN s_suppkey % 6 = 0 THEN 'none' ELSE concat('E', 38200 + s_suppkey % 3, '01') END AS common_id",
        "concat('k', s_suppkey div 2) AS shelter_key",
        "concat('n', s_suppkey % 37) AS node",
        "abs(s_acctbal) / 10 AS connector_m",
        "s_acctbal AS latitude",
        "s_suppkey AS longitude",
    )


@query(f"""WITH {SNAPPED} SELECT shelter, CASE WHEN common_id <> 'none' THEN common_id[2:6] END AS shelter_municipality_code, CASE WHEN common_id <> 'none' THEN
        common_id[2:6] <> '38201' END AS cross_border,
    CASE WHEN connector_m > 500 THEN 'shelter_connector_over_500m' END AS exclusion_reason FROM snapped""")
def snap_cross_border(spark: SparkSession, d: str) -> DataFrame:
    accepted, excluded = C.snap_shelters(_snapped(spark, d), F.lit("38201"))
    columns = ["shelter", "shelter_municipality_code", "cross_border", "exclusion_reason"]
    return accepted.withColumn("exclusion_reason", F.lit(None).cast("string")).select(columns).unionByName(excluded.select(columns))


@query(f"WITH {SNAPPED} SELECT shelter_key, shelter FROM (SELECT *, row_number() OVER (PARTITION BY shelter_key ORDER BY connector_m, node, latitude, longitude) AS rn FROM snapped WHERE connector_m <= 500) WHERE rn = 1")
def snap_by_identity(spark: SparkSession, d: str) -> DataFrame:
    return C.snap_by_identity(_snapped(spark, d)).select("shelter_key", "shelter")


RAW_EDGES = "e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, 's' || least(l_suppkey, l_partkey % 9) AS u, 's' || greatest(l_suppkey, l_partkey % 9) AS v, CASE WHEN l_linenumber = 3 THEN 'x' ELSE l_extendedprice::VARCHAR END AS length, CASE WHEN l_tax > 0.06 THEN 'Ferry' WHEN l_tax > 0.03 THEN 'path' END AS highway, l_linestatus AS route FROM lineitem)"


def _raw_edges(spark: SparkSession, d: str) -> DataFrame:
    a, b = "concat('s', least(l_suppkey, l_partkey % 9))", "concat('s', greatest(l_suppkey, l_partkey % 9))"
    return S.table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS edge_id",
        f"CASE WHEN l_linenumber % 2 = 0 THEN {a} ELSE {b} END AS u",
        f"CASE WHEN l_linenumber % 2 = 0 THEN {b} ELSE {a} END AS v",
        "CASE WHEN l_linenumber = 3 THEN 'x' ELSE CAST(l_extendedprice AS STRING) END AS length",
        "CASE WHEN l_tax > 0.06 THEN 'Ferry' WHEN l_tax > 0.03 THEN 'path' END AS highway",
        "l_linestatus AS route",
        "CAST(NULL AS STRING) AS ferry",
    )


@query(f"WITH {RAW_EDGES} SELECT least(u, v) AS a, greatest(u, v) AS b, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY length::DOUBLE, edge_id) AS rn FROM e WHERE length <> 'x') WHERE rn = 1")
def cheapest_raw_edge(spark: SparkSession, d: str) -> DataFrame:
    return C.cheapest_edges(_raw_edges(spark, d)).select("a", "b", "edge_id")


@query(f"WITH {RAW_EDGES} SELECT least(u, v) AS a, greatest(u, v) AS b, route AS geometry, 1::BIGINT AS n FROM e GROUP BY ALL")
def physical_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = C.physical_edges(_raw_edges(spark, d).withColumnRenamed("route", "geometry"))
    return rows.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "geometry").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RAW_EDGES} SELECT count(*) AS edges, count(*) FILTER (WHERE highway = 'Ferry') AS ferry_tagged_edges FROM e")
def ferry_edges(spark: SparkSession, d: str) -> DataFrame:
    return _raw_edges(spark, d).agg(F.count(F.lit(1)).alias("edges"), C.ferry_edges().alias("ferry_tagged_edges"))


BORDER = S.with_views("t_pair", "t_mesh") + """, near AS (SELECT p.mesh_id, s_nationkey AS municipality, total_walking_distance_m AS m, row_number() OVER
        (PARTITION BY p.mesh_id ORDER BY total_walking_distance_m, shelter_key) AS rn FROM t_pair p JOIN supplier ON s_suppkey = shelter_key),
    home AS (SELECT p.mesh_id, min(total_walking_distance_m) AS m FROM t_pair p JOIN t_mesh t USING (mesh_id) JOIN supplier ON s_suppkey = shelter_key WHERE
        s_nationkey // 5 = municipality_code // 5 GROUP BY 1)"""


@query(BORDER + """ SELECT t.mesh_id, near.municipality // 5 AS external_municipality, round(near.m, 6) AS all_distance_m, round(home.m - near.m, 6) AS
        improvement_m FROM t_mesh t JOIN near ON near.mesh_id = t.mesh_id AND rn = 1 LEFT JOIN home ON home.mesh_id = t.mesh_id
    WHERE t.mesh_id % 10 <= 6 AND near.municipality // 5 <> t.municipality_code // 5 AND (home.m IS NULL OR home.m - near.m > 1)""")
def border_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Municipalities are nations by five; the distance to the border is the id's last digit."""
    shelters = S.table(spark, d, "supplier").selectExpr("s_suppkey AS shelter_key", "s_nationkey div 5 AS municipality")
    meshes = S.meshes(spark, d).selectExpr("mesh_id", "CAST(municipality_code div 5 AS BIGINT) AS municipality", "mesh_id % 10 AS boundary_m")
    rows = S.pairs(spark, d).join(shelters, "shelter_key").select("mesh_id", "shelter_key", "municipality", F.col("total_walking_distance_m").alias("distance"))
    everywhere = relational.keep_best(rows, ["mesh_id"], [F.col("distance"), F.col("shelter_key")])
    home = rows.join(meshes.select("mesh_id", "municipality"), ["mesh_id", "municipality"], "left_semi").groupBy("mesh_id").agg(F.min("distance").alias("distance"))
    return C.border_gains(everywhere, home, meshes, 6).select("mesh_id", "external_municipality", r6("all_distance_m"), r6("improvement_m"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def last_wins_lookup(spark: SparkSession, d: str) -> DataFrame:
    return C.last_wins(S.table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


# --- joins and sets


@query("""SELECT 'unique right o_orderkey' AS gate, 'failure' AS severity, 0::BIGINT AS failures, true AS passed UNION ALL SELECT 'unique left o_orderkey',
        'failure', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)),
      (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) = 0""")
def join_contracts(spark: SparkSession, d: str) -> DataFrame:
    """A join that says one to one over tables that are many to one."""
    lines, orders = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"), S.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return evaluate(relational.checked_join(lines, orders, ["o_orderkey"], "inner", "1:1")[1])


@query("""SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS quantity, any_value(o_totalprice) AS price, count(*) AS rows FROM lineitem LEFT JOIN (SELECT *
        FROM orders WHERE o_orderkey % 2 = 0) ON o_orderkey = l_orderkey GROUP BY 1""")
def many_to_one_join(spark: SparkSession, d: str) -> DataFrame:
    lines = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    orders = S.table(spark, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice")
    joined, _ = relational.checked_join(lines, orders, ["o_orderkey"], "left", "m:1")
    return joined.groupBy("o_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.first("o_totalprice").alias("price"), F.count(F.lit(1)).alias("rows"))


@query("SELECT c_custkey, n_name AS c_name, round(c_acctbal, 6) AS c_acctbal FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_nationkey")
def column_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The right side's columns take the place of those of the same name, null where nothing matches."""
    left = S.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), "c_name", "c_acctbal")
    right = S.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("c_name"))
    return relational.replace_columns(left, right, ["k"]).select("c_custkey", "c_name", r6("c_acctbal"))


@query("""SELECT 'customers_with_orders' AS gate, 'failure' AS severity, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
        AS failures,
    (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) = 0 AS passed""")
def key_set_equality(spark: SparkSession, d: str) -> DataFrame:
    left, right = S.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), S.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return evaluate([set_equality("customers_with_orders", left, right, "k")])


# --- allocation: what is read out of a given flow

FLOW = R.RISK.split(",\n    base AS")[0] + """,
    mesh AS (SELECT mesh_id, round_even(total_population * tsunami_inundation_ratio * 10, 0)::BIGINT AS units FROM t_mesh WHERE tsunami_inundation_ratio > 0),
    cand AS (SELECT c.mesh_id, c.shelter_key, c.candidate_rank, c.total_walking_distance_m AS m, s.capacity AS cap, coalesce(s.capacity > 0, false) AS known
        FROM t_candidate c JOIN mesh USING (mesh_id) LEFT JOIN t_shelter s USING (shelter_key)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY candidate_rank) AS kr FROM cand WHERE known),
    flow AS (SELECT mesh.mesh_id, shelter_key, CASE WHEN kr = 1 THEN units - units // 4 - (CASE WHEN mesh.mesh_id % 3 = 0 THEN units // 5 ELSE 0 END) ELSE units
        // 4 END AS n FROM mesh JOIN ranked USING (mesh_id)
        WHERE kr = 1 OR kr = 2 AND units // 4 > 0),
    given AS (SELECT * FROM flow WHERE n > 0),
    lost AS (SELECT mesh.mesh_id, units - coalesce((SELECT sum(n) FROM given WHERE given.mesh_id = mesh.mesh_id), 0) AS n FROM mesh),
    fr AS (SELECT g.*, c.candidate_rank, c.m FROM given g JOIN cand c USING (mesh_id, shelter_key)),
    near AS (SELECT mesh_id, shelter_key::VARCHAR AS nearest, m AS nearest_m FROM cand WHERE candidate_rank = 1),
    mr AS (SELECT mesh.mesh_id, mesh.units, coalesce(sum(fr.n), 0) AS a, any_value(lost.n) AS u, count(fr.n) AS shelters, sum(fr.n * fr.m) / nullif(sum(fr.n),
        0) AS mean_m,
        arg_min(fr.shelter_key::VARCHAR, (-fr.n, fr.m, fr.shelter_key::VARCHAR)) AS dominant FROM mesh LEFT JOIN fr USING (mesh_id) JOIN lost ON lost.mesh_id =
        mesh.mesh_id GROUP BY ALL),
    cc AS (SELECT mesh_id, count(*) AS candidates, count(*) FILTER (WHERE known) AS known FROM cand GROUP BY 1),
    res AS (SELECT mr.*, nearest, nearest_m, coalesce(candidates, 0) AS candidates, coalesce(cc.known, 0) AS known, CASE WHEN units = 0 THEN 'zero_demand' WHEN
        candidates IS NULL THEN 'route_unavailable_or_no_candidate'
        WHEN cc.known = 0 THEN 'unknown_capacity_only' WHEN u > 0 AND a > 0 THEN 'capacity_constrained_partial' WHEN u > 0 THEN 'capacity_constrained_unserved'
        WHEN shelters > 1 THEN 'capacity_constrained_split'
        WHEN dominant <> nearest THEN 'capacity_constrained_rerouted' ELSE 'nearest_known_capacity' END AS st FROM mr LEFT JOIN near USING (mesh_id) LEFT JOIN
        cc USING (mesh_id)),
    extra AS (SELECT shelter_key, (shelter_key % 5 * 10)::BIGINT AS x FROM (SELECT DISTINCT shelter_key FROM cand WHERE known) WHERE shelter_key % 5 > 0),
    sr AS (SELECT k.shelter_key, any_value(k.cap) AS cap, coalesce(any_value(x), 0) AS x, greatest(0, floor(any_value(k.cap) * 10 + 1e-9))::BIGINT +
        coalesce(any_value(x), 0) AS room, coalesce(any_value(g.n), 0) AS a
        FROM (SELECT DISTINCT shelter_key, cap FROM cand WHERE known) k LEFT JOIN extra USING (shelter_key) LEFT JOIN (SELECT shelter_key, sum(n) AS n FROM
        given GROUP BY 1) g USING (shelter_key) GROUP BY 1)"""


def _given_flow(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A flow that is no optimum but is the same in both engines: most of a mesh's demand to its first known shelter, a quarter to the second, some unserved."""
    targets, base = R._target_candidates(spark, d)
    prepared = allocation.prepare_candidates(targets, S.shelters(spark, d))
    mesh = base.select("mesh_id", V.demand_units(F.col("demand_area_weighted")).alias("n"))
    known = relational.top_k(prepared.where("capacity_known"), ["mesh_id"], [F.col("candidate_rank")], 2, "kr").select("mesh_id", "shelter_key", "kr")
    amount = "CASE WHEN kr = 1 THEN n - n div 4 - CASE WHEN mesh_id % 3 = 0 THEN n div 5 ELSE 0 END ELSE n div 4 END"
    served = mesh.join(known, "mesh_id").selectExpr("mesh_id", "shelter_key", f"{amount} AS units").where("units > 0")
    total = served.groupBy("mesh_id").agg(F.sum("units").alias("s"))
    lost = mesh.join(total, "mesh_id", "left").selectExpr("mesh_id", "CAST(NULL AS BIGINT) AS shelter_key", "n - coalesce(s, 0) AS units")
    added = prepared.where("capacity_known AND shelter_key % 5 > 0").select("shelter_key").distinct().selectExpr("'' AS mesh_id", "CAST(shelter_key AS STRING) AS shelter_key", "CAST(shelter_key % 5 * 10 AS BIGINT) AS units", "true AS added")
    text = lambda df: df.selectExpr("CAST(mesh_id AS STRING) AS mesh_id", "CAST(shelter_key AS STRING) AS shelter_key", "units", "false AS added")
    flow = text(served).unionByName(text(lost)).unionByName(added)
    return flow.select(F.lit("r").alias("run_id"), "mesh_id", "shelter_key", "units", "added"), prepared


@query(FLOW + """ SELECT 'r' AS run_id, fr.mesh_id::VARCHAR AS mesh_id, fr.shelter_key::VARCHAR AS shelter_key, candidate_rank::INT AS candidate_rank, fr.n /
        10.0::DOUBLE AS allocated_demand, round(fr.n / mesh.units::DOUBLE, 6) AS allocation_share FROM fr JOIN mesh USING (mesh_id)""")
def allocation_flow_rows(spark: SparkSession, d: str) -> DataFrame:
    return allocation.flow_rows(*_given_flow(spark, d)).select("run_id", "mesh_id", "shelter_key", "candidate_rank", "allocated_demand", r6("allocation_share"))


@query(FLOW + """ SELECT mesh_id::VARCHAR AS mesh_id, a / 10.0::DOUBLE AS allocated_demand, u / 10.0::DOUBLE AS unserved_demand, shelters, round(mean_m + 1e-8,
        6) AS mean_distance_m, dominant AS dominant_shelter, nearest AS nearest_shelter, candidates, known,
      round(mean_m - nearest_m + 1e-8, 6) AS additional_distance_m, st AS allocation_status FROM res""")
def allocation_mesh_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = allocation.mesh_results(*_given_flow(spark, d))
    return rows.select(
        "mesh_id", "allocated_demand", "unserved_demand", "shelters", r6("mean_distance_m", F.col("mean_distance_m") + 1e-8), "dominant_shelter", "nearest_shelter", "candidates", "known",
        r6("additional_distance_m", F.col("additional_distance_m") + 1e-8), "allocation_status"
    )


@query(FLOW + """ SELECT shelter_key::VARCHAR AS shelter_key, cap AS shelter_capacity, x / 10.0::DOUBLE AS added_capacity_used, room / 10.0::DOUBLE AS
        effective_capacity, a / 10.0::DOUBLE AS allocated_demand, round(CASE WHEN room > 0 THEN a / room::DOUBLE END, 6) AS utilization,
      room > 0 AND a >= room AS saturated FROM sr""")
def allocation_shelter_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = allocation.shelter_results(*_given_flow(spark, d)).drop("run_id")
    return rows.withColumn("utilization", F.round("utilization", 6))


@query(FLOW + """ SELECT 'r' AS run_id, count(*) AS target_meshes, round(sum(a) / 10.0, 6)::DOUBLE AS served_demand, round(sum(u) / 10.0, 6)::DOUBLE AS
        unserved_demand, count(*) FILTER (WHERE candidates = 0) AS meshes_with_no_candidate,
      count(*) FILTER (WHERE st = 'unknown_capacity_only') AS meshes_with_unknown_capacity_only, count(*) FILTER (WHERE st = 'capacity_constrained_partial') AS
        meshes_partially_unserved,
      count(*) FILTER (WHERE st IN ('capacity_constrained_unserved', 'unknown_capacity_only', 'route_unavailable_or_no_candidate')) AS meshes_fully_unserved,
        count(*) FILTER (WHERE shelters > 1) AS meshes_split_across_shelters,
      count(*) FILTER (WHERE dominant IS NOT NULL AND dominant IS DISTINCT FROM nearest) AS meshes_dominant_destination_changed,
      (SELECT round(sum(n / 10.0 * m), 3) FROM fr)::DOUBLE AS total_allocated_person_metres, (SELECT round(sum(n / 10.0 * greatest(0, m - nearest_m)), 3) FROM
        fr JOIN near USING (mesh_id))::DOUBLE AS additional_person_metres,
      (SELECT round(sum(n / 10.0) FILTER (WHERE candidate_rank > 1), 6) FROM fr)::DOUBLE AS demand_beyond_rank_1, (SELECT count(*) FROM sr) AS
        known_capacity_shelters, (SELECT count(*) FROM sr WHERE room > 0 AND a >= room) AS saturated_shelters,
      (SELECT sum(x) / 10.0 FROM sr)::DOUBLE AS added_capacity_used, round(sum(a)::DOUBLE / (sum(a) + sum(u)), 6) AS served_share FROM res""")
def allocation_kpis(spark: SparkSession, d: str) -> DataFrame:
    """The summary's numbers over the given flow: person-metres, demand beyond the first candidate, meshes by what became of them."""
    s = allocation.allocation_summary(*_given_flow(spark, d))
    return s.select(
        "run_id",
        "target_meshes",
        r6("served_demand"),
        r6("unserved_demand"),
        *[c for c in s.columns if c.startswith("meshes_")],
        F.round("total_allocated_person_metres", 3).alias("total_allocated_person_metres"),
        F.round("additional_person_metres", 3).alias("additional_person_metres"),
        r6("demand_beyond_rank_1"),
        "known_capacity_shelters",
        "saturated_shelters",
        "added_capacity_used",
        r6("served_share"),
    )


@query(FLOW + """ SELECT 'r' AS run_id, row_number() OVER (ORDER BY x DESC, a DESC, shelter_key::VARCHAR)::INT AS plan_rank, shelter_key::VARCHAR AS
        shelter_key, x / 10.0::DOUBLE AS added_capacity_used, a / 10.0::DOUBLE AS allocated_demand FROM sr WHERE x > 0""")
def plan_order(spark: SparkSession, d: str) -> DataFrame:
    return allocation.investment_plan(*_given_flow(spark, d))


@query(FLOW + """ SELECT plan_rank, shelter_key FROM (SELECT row_number() OVER (ORDER BY x DESC, a DESC, shelter_key::VARCHAR)::INT AS plan_rank,
        shelter_key::VARCHAR AS shelter_key FROM sr WHERE x > 0) WHERE plan_rank <= 12""")
def plan_panel(spark: SparkSession, d: str) -> DataFrame:
    from terrafold.plans import ui

    plan = allocation.investment_plan(*_given_flow(spark, d)).select(F.lit("area_weighted").alias("scenario"), F.lit(100.0).alias("budget"), "plan_rank", "shelter_key")
    return ui.plan_panel(plan, "area_weighted", 100.0).select("plan_rank", "shelter_key")


CANDIDATE_FAULTS = S.with_views("t_candidate") + """, c AS (SELECT mesh_id, CASE WHEN mesh_id % 45 = 0 AND candidate_rank = 2 THEN 1 ELSE shelter_key END AS
        shelter_key,
    CASE WHEN mesh_id % 44 = 0 AND candidate_rank = 1 THEN 3 ELSE candidate_rank END AS rank, CASE WHEN mesh_id % 46 = 0 AND candidate_rank = 1 THEN -1 ELSE
        total_walking_distance_m END AS m FROM t_candidate),
    good AS (SELECT * FROM c WHERE rank BETWEEN 1 AND 10 AND m >= 0),
    cap AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN s_suppkey - 1 ELSE s_suppkey END AS shelter_key FROM supplier)"""


@query(
    gate_sql(
        CANDIDATE_FAULTS,
        [
            ("duplicate mesh and shelter", "failure", repeated("good", "mesh_id", "shelter_key")),
            ("ranks are not 1..n", "failure", "SELECT count(*) FROM (SELECT mesh_id FROM good GROUP BY 1 HAVING max(rank) <> count(*) OR count(DISTINCT rank) <> count(*))"),
            ("duplicate capacity", "failure", repeated("cap", "shelter_key")),
        ],
    )
)
def candidate_gates(spark: SparkSession, d: str) -> DataFrame:
    c = S.candidates(spark, d).selectExpr(
        "mesh_id",
        "CASE WHEN mesh_id % 45 = 0 AND candidate_rank = 2 THEN 1 ELSE shelter_key END AS shelter_key",
        "CASE WHEN mesh_id % 44 = 0 AND candidate_rank = 1 THEN 3 ELSE candidate_rank END AS candidate_rank",
        "CASE WHEN mesh_id % 46 = 0 AND candidate_rank = 1 THEN -1.0D ELSE total_walking_distance_m END AS total_walking_distance_m",
    )
    twice = S.shelters(spark, d).withColumn("shelter_key", F.expr("CASE WHEN shelter_key % 9 = 0 THEN shelter_key - 1 ELSE shelter_key END"))
    return evaluate(allocation.candidate_gates(c, twice))


SUMMARIES = """s AS (SELECT c_nationkey AS scenario, c_custkey AS budget, c_acctbal AS unserved_demand, round(c_acctbal * 100)::DECIMAL(38,0) AS objective_cost,
        c_mktsegment AS seg FROM customer),
    w AS (SELECT *, lag(unserved_demand) OVER (PARTITION BY scenario ORDER BY budget) AS u0, lag(objective_cost) OVER (PARTITION BY scenario ORDER BY budget) AS
        o0 FROM s)"""


@query(gate_sql(f"WITH {SUMMARIES}", [("unserved demand rises", "failure", of("w", "unserved_demand > u0 + 1e-9")), ("cost rises", "failure", of("w", "objective_cost > o0"))]))
def dominance_gates(spark: SparkSession, d: str) -> DataFrame:
    """Over customers as summaries, whose balances rise and fall at will."""
    s = S.table(spark, d, "customer").selectExpr("c_nationkey AS scenario", "c_custkey AS budget", "c_acctbal AS unserved_demand", "CAST(round(c_acctbal * 100) AS DECIMAL(38,0)) AS objective_cost")
    return evaluate(allocation.dominance_gates(s, ["scenario"], "budget"))


@query(gate_sql(FLOW, [("target meshes", "failure", "SELECT (count(*) <> 7)::INT FROM mesh"), ("capacity exceeded", "failure", "SELECT (count(*) > 0)::INT FROM sr WHERE a > room"), ("added capacity over budget", "failure", "SELECT (sum(x) > 0)::INT FROM sr")]))
def allocation_gates(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(allocation.allocation_gates(allocation.allocation_summary(*_given_flow(spark, d)), 7))


FAULTY_CURVES = R.FIRST_SQL + """, s AS (SELECT s AS scenario, b AS budget, unserved_units / 10.0 + CASE WHEN b = 1000 THEN 1e6 ELSE 0 END AS unserved_demand,
    objective_cost::HUGEINT + CASE WHEN b IN (500, 5000) THEN 1000000000000000000 ELSE 0 END AS objective_cost FROM curve),
    w AS (SELECT *, lag(unserved_demand) OVER (PARTITION BY scenario ORDER BY budget) AS u0, lag(objective_cost) OVER (PARTITION BY scenario ORDER BY budget) AS
        o0 FROM s)"""


@query(gate_sql(FAULTY_CURVES, [("unserved demand rises", "failure", of("w", "unserved_demand > u0 + 1e-9")), ("cost rises", "failure", of("w", "objective_cost > o0"))]))
def curve_gates(spark: SparkSession, d: str) -> DataFrame:
    """Merged curves of the budget sweep, some of them made worse: more budget may neither leave more demand nor cost more."""
    budgets = spark.createDataFrame([(r, r.split("_")[0], b) for r, _, _, b in R.CURVES], "run_id string, scenario string, budget double")
    s = R.first_candidate_curves(spark, d).join(F.broadcast(budgets), "run_id").selectExpr(
        "scenario", "budget", "unserved_units / 10.0D + IF(budget = 1000, 1e6D, 0.0D) AS unserved_demand",
        "objective_cost + CAST(IF(budget IN (500, 5000), 1000000000000000000, 0) AS DECIMAL(38,0)) AS objective_cost",
    )
    return evaluate(allocation.dominance_gates(s, ["scenario"], "budget"))


def _run_checks(spark: SparkSession, d: str, runs: list[tuple[str, str, int, float]], order: str, more: bool) -> DataFrame:
    """Per run: target meshes and demand as the solver saw them, and on how many gates of all runs it failed."""
    named = spark.createDataFrame([(r, r.split("_")[0], k, b) for r, _, k, b in runs], "run_id string, scenario string, k int, budget double")
    s = allocation.allocation_summary(*R._allocation(spark, d, runs)).join(F.broadcast(named), "run_id")
    gates = [*allocation.dominance_gates(s, ["scenario"], order), *(allocation.allocation_gates(s, 0, "budget")[1:] if more else [])]
    failed = evaluate(gates).agg(F.sum("failures").alias("failures"))
    return s.select("run_id", "target_meshes", F.round(F.col("served_demand") + F.col("unserved_demand"), 1).alias("demand")).crossJoin(F.broadcast(failed))  # one row


def _run_sql(runs: list[tuple[str, str, int, float]]) -> str:
    rows = ", ".join(f"('{r}', '{r.split('_')[0]}')" for r, *_ in runs)
    return R.FIRST_SQL + f""" SELECT run_id, count(*) FILTER (WHERE units > 0) AS target_meshes, sum(units) / 10.0 AS demand, 0::BIGINT AS failures
    FROM (VALUES {rows}) r(run_id, s) JOIN demand USING (s) GROUP BY run_id"""


@query(_run_sql(R.SWEEP))
def sweep_gates(spark: SparkSession, d: str) -> DataFrame:
    """The optimised budget sweep of both demand scenarios: no demand is lost, unserved demand and cost do not rise with the budget, nor is capacity exceeded."""
    return _run_checks(spark, d, R.SWEEP, "budget", more=True)


@query(_run_sql(R.RUNS))
def candidate_limit_gates(spark: SparkSession, d: str) -> DataFrame:
    """Ten candidates a mesh serve no less, at no higher cost, than five."""
    return _run_checks(spark, d, R.RUNS, "k", more=False)


SHOWN = R.RISK + """, map AS (SELECT m.mesh_id, CASE WHEN score_status IS NULL OR m.mesh_id % 83 > 0 THEN full_score END AS full_score, coalesce(score_status, 'not_target') AS score_status,
      score_status IS NOT NULL AND m.mesh_id % 71 > 0 AS analysis_target FROM t_mesh m LEFT JOIN risk r USING (mesh_id)),
    shown AS (SELECT mesh_id, full_score + CASE WHEN mesh_id % 79 = 0 THEN 200 ELSE 0 END AS full_score, score_status, analysis_target FROM map WHERE mesh_id % 89 > 0
      UNION ALL SELECT mesh_id, full_score, score_status, analysis_target FROM map WHERE mesh_id % 97 = 0)"""


@query(
    gate_sql(
        SHOWN,
        [
            ("same_meshes", "failure", f"({only_in('t_mesh', 'shown')}) + ({only_in('shown', 't_mesh')})"),
            ("mesh_unique", "failure", repeated("shown", "mesh_id")),
            ("target_has_status", "failure", of("shown", "analysis_target <> (score_status <> 'not_target')")),
            ("score_only_where_complete", "failure", of("shown", "(full_score IS NOT NULL) <> (score_status = 'complete')")),
            ("score_0_100", "failure", of("shown", "full_score < 0 OR full_score > 100")),
        ],
    )
)
def explorer_gates(spark: SparkSession, d: str) -> DataFrame:
    """The contract of the map's rows over the real projection with faults: rows that lack or repeat, scores lost or out of range, targets that are none."""
    from terrafold.plans import ui

    m = S.meshes(spark, d)
    shown = ui.ui_map(m, R.risk(spark, d)).withColumns({
        "full_score": F.expr("CASE WHEN NOT analysis_target OR mesh_id % 83 > 0 THEN full_score END"), "analysis_target": F.expr("analysis_target AND mesh_id % 71 > 0"),
    })
    again = shown.where("mesh_id % 97 = 0")
    shown = shown.where("mesh_id % 89 > 0").withColumn("full_score", F.col("full_score") + F.expr("IF(mesh_id % 79 = 0, 200D, 0D)"))
    return evaluate(G.explorer_gates(m, shown.unionByName(again)))


@query("SELECT o_orderpriority, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def unique_key_violations(spark: SparkSession, d: str) -> DataFrame:
    return unique_key(S.table(spark, d, "orders"), ["o_orderpriority"])
