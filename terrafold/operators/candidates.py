"""Candidate shelters and routes: eligibility, identities, snapping, accounts of distance, failure rows, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import values as V
from terrafold.operators.gates import Gate, evaluate
from terrafold.operators.graph import nearest_by_joins
from terrafold.operators.relational import keep_best


def candidate_shelters(shelters: DataFrame, flag: str = "tsunami") -> DataFrame:
    """Shelters whose flag is 1 and whose latitude and longitude are numbers, which they become."""
    at = {c: V.to_number(F.col(c)) for c in ("latitude", "longitude")}
    good = (V.to_number(F.col(flag)) == 1) & at["latitude"].isNotNull() & at["longitude"].isNotNull()
    return shelters.where(good).withColumns(at)


def eligible_shelters(shelters: DataFrame, flag: str = "tsunami") -> DataFrame:
    """Shelters whose flag is 1 and whose id and name are not blank once normalised; both normalised, with their ``shelter_key``."""
    named = shelters.withColumns({"common_id": V.norm_text(F.col("common_id")), "name": V.norm_text(F.col("name"))})
    good = named.where((V.to_number(F.col(flag)) == 1) & (F.col("common_id") != "") & (F.col("name") != ""))
    return good.withColumn("shelter_key", F.concat("common_id", F.lit("||"), "name"))


def collapse_shelters(eligible: DataFrame, place: str) -> DataFrame:
    """One row per identity of rows (shelter_key, capacity text, address_city, latitude, longitude, ``place`` in the source).

    Capacities add up, null if none is known; parse statuses are joined; the first
    non-blank city stays; an identity at several places - city and coordinates to
    six digits - is ambiguous.
    """
    parsed = eligible.withColumn("_p", V.parse_capacity(F.col("capacity")))
    city = V.norm_text(F.col("address_city"))
    number = lambda c: F.coalesce(F.round(V.to_number(F.col(c)), 6).cast("string"), F.lit(""))
    parsed = parsed.withColumn("_city", F.nullif(city, F.lit(""))).withColumn("_signature", F.concat_ws("|", city, number("latitude"), number("longitude")))
    out = parsed.groupBy("shelter_key").agg(
        F.sum("_p.value").alias("shelter_capacity"),
        F.count(F.lit(1)).alias("capacity_record_count"),
        F.array_join(F.sort_array(F.collect_set("_p.status")), ";").alias("capacity_parse_status"),
        F.min_by(F.col("_city"), F.when(F.col("_city").isNotNull(), F.col(place))).alias("shelter_city"),
        F.count_distinct("_signature").alias("facility_signature_count"),
    )
    ambiguous = (F.col("facility_signature_count") > 1).alias("ambiguous")
    return out.select("*", V.capacity_status(F.col("shelter_capacity")).alias("capacity_status"), ambiguous)


def with_failures(targets: DataFrame, found: DataFrame, key: str, counts: Sequence[str], status: str, missing: Column) -> DataFrame:
    """All targets with what was found: of the others measures are null, counts 0 and the status says why."""
    rows = targets.join(found, key, "left")
    return rows.withColumn(status, F.coalesce(status, missing)).fillna(0, list(counts))


def snap_shelters(snapped: DataFrame, home: Column, limit: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """(accepted, excluded) of shelters (common_id, connector_m, ...) snapped to a node.

    ``cross_border`` tells whether the code in the id is another than ``home``,
    null when there is none; a connector over the limit excludes, with the reason.
    """
    code = V.code_from_id(F.col("common_id"))
    rows = snapped.withColumn("shelter_municipality_code", code).withColumn("cross_border", F.col("shelter_municipality_code") != home)
    far = F.col("connector_m") > limit
    return rows.where(~far), rows.where(far).withColumn("exclusion_reason", F.lit(f"shelter_connector_over_{limit:g}m"))


def snap_by_identity(snapped: DataFrame, limit: float = 500.0) -> DataFrame:
    """One row for each shelter_key within the limit: least connector, then node, latitude, longitude."""
    near = snapped.where(F.col("connector_m") <= limit)
    return keep_best(near, ["shelter_key"], [F.col(c) for c in ("connector_m", "node", "latitude", "longitude")])


def account(routes: DataFrame, tolerance: float = 1e-6) -> tuple[DataFrame, Gate]:
    """Routes with the residual of access + network + connector against their total, and the gate that none is over the tolerance."""
    parts = F.col("origin_access_distance_m") + F.col("network_path_distance_m") + F.col("shelter_connector_distance_m")
    out = routes.withColumn("residual_m", F.abs(parts - F.col("total_walking_distance_m")))
    return out, Gate("distance formula", out, F.col("residual_m") > tolerance)


def cheapest_edges(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Of parallel raw edges (u, v, length as text or number, edge_id), either way, the one of least length, then id; lengths that are no number are skipped."""
    number = V.to_number(F.col("length"))
    pair = {"a": F.least("u", "v"), "b": F.greatest("u", "v")}
    rows = edges.withColumns({"length": number, **pair}).where("length IS NOT NULL")
    return keep_best(rows, [*keys, "a", "b"], [F.col("length"), F.col("edge_id")])


def physical_edges(edges: DataFrame) -> DataFrame:
    """Raw edges (u, v, geometry as text) without the second direction of one physical edge."""
    return edges.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")}).dropDuplicates(["a", "b", "geometry"]).drop("a", "b")


def border_gains(everywhere: DataFrame, at_home: DataFrame, meshes: DataFrame, within: float, better: float = 1.0) -> DataFrame:
    """Meshes (mesh_id, municipality, boundary_m) near the border whose nearest shelter abroad is more than ``better`` metres nearer than the nearest at home.

    ``everywhere``: mesh_id, distance, municipality of the nearest of all shelters;
    ``at_home``: mesh_id, distance of the nearest of the own municipality, if any.
    """
    rows = meshes.where(F.col("boundary_m") <= within)
    rows = rows.join(everywhere.select("mesh_id", F.col("distance").alias("all_distance_m"), F.col("municipality").alias("external_municipality")), "mesh_id")
    rows = rows.join(at_home.select("mesh_id", F.col("distance").alias("home_distance_m")), "mesh_id", "left")
    gain = F.col("home_distance_m") - F.col("all_distance_m")
    abroad = ~F.col("external_municipality").eqNullSafe(F.col("municipality"))
    return rows.where(abroad & (F.col("home_distance_m").isNull() | (gain > better))).withColumn("improvement_m", gain)


def border_comparison(edges: DataFrame, seeds: DataFrame, meshes: DataFrame, within: float, better: float = 1.0, delta: float | None = None) -> DataFrame:
    """:func:`border_gains` by two searches of one network (context, u, v, length): from all sources, and from those of each municipality alone.

    ``seeds``: context, node, source, cost, municipality; ``meshes``: mesh_id, node,
    municipality, boundary_m.  The second search is one, too: each municipality is a
    context, of those whose meshes lie near enough to the border.
    """
    near = meshes.where(F.col("boundary_m") <= within)
    owners = seeds.select("source", F.col("municipality").alias("_of")).distinct()
    everywhere = nearest_by_joins(edges, seeds.drop("municipality"), delta=delta).join(owners, "source")
    everywhere = near.select("mesh_id", "node").join(everywhere, "node").select("mesh_id", F.col("cost").alias("distance"), F.col("_of").alias("municipality"))
    places = near.select(F.col("municipality").cast("string").alias("place")).distinct()
    own = edges.drop("context").crossJoin(F.broadcast(places)).withColumnRenamed("place", "context")  # a row for each municipality
    starts = seeds.select(F.col("municipality").cast("string").alias("context"), "node", "source", "cost").join(places, F.col("context") == F.col("place"), "left_semi")
    at_home = nearest_by_joins(own, starts, delta=delta).select(F.col("context").alias("_home"), "node", F.col("cost").alias("distance"))
    home = near.select("mesh_id", "node", F.col("municipality").cast("string").alias("_home")).join(at_home, ["_home", "node"]).select("mesh_id", "distance")
    return border_gains(everywhere, home, near, within, better)


def anchored_if(candidates: DataFrame, canonical: DataFrame, columns: Sequence[str], gates: Sequence[Gate]) -> DataFrame:
    """:func:`anchored` where all the gates pass, found in the plan: one that fails leaves every candidate as it is."""
    verdict = evaluate(gates).agg(F.bool_and("passed").alias("_passed"))
    return anchored(candidates.crossJoin(F.broadcast(verdict)), canonical, columns, F.col("_passed")).drop("_passed")  # one row


def last_wins(df: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """The row of each key that comes last in the source."""
    return keep_best(df, keys, [-F.col(place)])


def anchored(candidates: DataFrame, canonical: DataFrame, columns: Sequence[str], passed: Column) -> DataFrame:
    """Rank-1 candidates take ``columns`` from the canonical route of their mesh where ``passed`` holds; all others stay."""
    side = canonical.select("mesh_id", F.lit(True).alias("_there"), *[F.col(c).alias(f"_c_{c}") for c in columns])
    rows = candidates.join(side, "mesh_id", "left")
    take = passed & (F.col("candidate_rank") == 1) & F.coalesce("_there", F.lit(False))
    chosen = [F.when(take, F.col(f"_c_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in candidates.columns]
    return rows.select(*chosen)


def ferry_edges(tags: Sequence[str] = ("route", "highway", "ferry")) -> Column:
    """Aggregate: how many edges name a ferry in one of their tags."""
    return F.count_if(F.contains(F.lower(F.concat_ws(" ", *tags)), F.lit("ferry")))
