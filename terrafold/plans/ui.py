"""The explorer's queries: indicators, ranking, map projection, reasons and panels, by municipality and mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import values as V
from terrafold.operators.scoring import what_if_ranking

MODES = {"current": "full_score", "elderly": "aging_rate_65plus", "capacity": "capacity_pressure_area_weighted"}
# What the explorer divides a measure by to get its severity.
SEVERITY = {"walking_minutes": 30.0, "tsunami_inundation_ratio": 0.6, "aging_rate_65plus": 0.5, "capacity_pressure_area_weighted": 1.5, "inundation_ratio": 0.7}


# What the explorer calls the statuses.
SCORE_LABELS = {
    "complete": "5要素完全",
    "core_only_missing_capacity": "容量不明：4要素coreのみ",
    "core_data_incomplete": "年齢構成データ欠損",
    "route_unavailable": "経路未成立：数値スコアなし",
}
ROUTE_LABELS = {
    "complete": "経路成立",
    "no_network_path": "道路ネットワーク上の到達経路なし",
    "network_coverage_gap": "道路ネットワークcoverage gap",
    "no_candidate_shelter_in_aoi": "候補避難場所なし",
    "all_candidate_shelters_snap_excluded": "候補避難場所を接続距離基準で除外",
}
NOTHING = "—"


def status_label(status: Column, labels: dict[str, str]) -> Column:
    """The label of a status; an unknown one as it is, a dash for none."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(known, status), F.nullif(status, F.lit("")), F.lit(NOTHING))


def number_text(c: Column, digits: int = 0) -> Column:
    """A number with grouped thousands and fixed digits; a dash for null or what is not finite."""
    return F.coalesce(F.format_number(V.finite(c), digits), F.lit(NOTHING))


def percent_text(share: Column, digits: int = 1) -> Column:
    return F.when(V.finite(share).isNull(), NOTHING).otherwise(F.concat(number_text(share * 100, digits), F.lit("%")))


def metres_text(c: Column) -> Column:
    """Kilometres with two digits from 1000 m on, else whole metres."""
    far = F.concat(number_text(c / 1000, 2), F.lit("km"))
    return F.when(V.finite(c).isNull(), NOTHING).when(c >= 1000, far).otherwise(F.concat(number_text(c, 0), F.lit("m")))


def minutes_of(new: Column, old_seconds: Column) -> Column:
    """Walking minutes of the new field, or of the seconds of the one before it."""
    return F.coalesce(V.finite(new), V.finite(old_seconds) / 60.0)


def exposure_of(classified: Column, plain: Column) -> Column:
    """A route's classified share, or its plain one."""
    return F.coalesce(V.finite(classified), V.finite(plain))


def policy_score(status: Column, score: Column) -> Column:
    """The published score, of complete rows only; it is never computed again."""
    return F.when(status == "complete", V.finite(score))


def segment_features(rows: DataFrame, key: str, segments: str) -> DataFrame:
    """(key, place, depth_class, points): inundated stretches of complete routes from their JSON; those of fewer than two points are left out."""
    shape = "array<struct<depth_class:int,coordinates:array<array<double>>>>"
    done = rows.where("route_status = 'complete'").select(key, F.posexplode(F.from_json(segments, shape)).alias("place", "s"))
    return done.where(F.size("s.coordinates") >= 2).select(key, "place", "s.depth_class", F.size("s.coordinates").alias("points"))


def simulation_panel(simulated: DataFrame, delta: float, n: int = 12) -> DataFrame:
    """The first shelters of one delta, in the panel's order, that are over capacity or gain anything."""
    shown = simulated.where((F.col("delta") == delta) & (F.col("baseline_over_capacity") | (F.col("total_score_reduction") > 0)))
    return what_if_ranking(shown, n, order="demand")


def plan_panel(plan: DataFrame, scenario: str, budget: float, n: int = 12) -> DataFrame:
    """The first rows of one plan, by rank."""
    return plan.where((F.col("scenario") == scenario) & (F.col("budget") == budget)).orderBy("plan_rank").limit(n)


def in_municipality(risk: DataFrame, code: int | None) -> DataFrame:
    return risk if code is None else risk.where(F.col("municipality_code") == code)


def ui_kpis(risk: DataFrame, code: int | None = None) -> DataFrame:
    """One row: meshes, population (null if any is unknown), those far from or without a shelter, distinct shelters over capacity."""
    minutes = F.col("total_walking_distance_m") / 60.0
    own = F.col("shelter_key").cast("string")
    # A row without a key stands for a shelter of its own.
    over = F.when(F.col("capacity_pressure_area_weighted") > 1, F.coalesce(own, F.concat(F.lit("mesh:"), F.col("mesh_id").cast("string"))))
    return in_municipality(risk, code).agg(
        F.count(F.lit(1)).alias("meshes"),
        V.sum_all_or_null(F.col("total_population")).alias("population"),
        F.coalesce(F.sum(F.when(minutes > 20, F.col("total_population"))), F.lit(0)).alias("population_over_20_min"),
        F.coalesce(F.sum(F.when(~F.col("ready"), F.col("total_population"))), F.lit(0)).alias("population_without_route"),
        F.count_distinct(over).alias("over_capacity_shelters"),
    )


def ui_ranking(risk: DataFrame, mode: str = "current", n: int = 8, code: int | None = None) -> DataFrame:
    """The first ``n`` meshes by the mode's measure; a null counts as -1, ties by mesh_id."""
    measure = F.coalesce(F.col(MODES[mode]).cast("double"), F.lit(-1.0))
    return in_municipality(risk, code).select("mesh_id", measure.alias("measure")).orderBy(F.desc("measure"), "mesh_id").limit(n)


def ui_map(meshes: DataFrame, risk: DataFrame) -> DataFrame:
    """All meshes with their status and whether they are analysed."""
    own = risk.select("mesh_id", "full_score", "score_status")
    return meshes.join(own, "mesh_id", "left").select(
        "mesh_id", "municipality_code", "full_score", F.coalesce("score_status", F.lit("not_target")).alias("score_status"), F.col("score_status").isNotNull().alias("analysis_target")
    )


def ui_reasons(risk: DataFrame, most: int = 3) -> DataFrame:
    """(mesh_id, place, key, severity): measures over their divisor, most severe first; ties in the fixed order."""
    at: dict[str, Column] = {k: F.col(k) for k in SEVERITY if k != "walking_minutes"} | {"walking_minutes": F.col("total_walking_distance_m") / 60.0}
    items = F.array(*[F.struct((-at[k] / d).alias("minus"), F.lit(i).alias("i"), F.lit(k).alias("key")) for i, (k, d) in enumerate(SEVERITY.items())])
    ordered = F.slice(F.array_sort(F.filter(items, lambda x: x["minus"].isNotNull())), 1, most)
    return risk.select("mesh_id", F.posexplode(ordered).alias("place", "r")).select("mesh_id", (F.col("place") + 1).alias("place"), "r.key", (-F.col("r.minus")).alias("severity"))
