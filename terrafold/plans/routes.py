"""Queries of lines, routes, labels and exported cells, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geo, lines
from terrafold.functions import values as V
from terrafold.operators import scoring, spatial
from terrafold.plans import registry as R
from terrafold.plans import surrogates as S
from terrafold.plans import ui
from terrafold.plans.registry import query, r6

# An edge of each part: from u by m to v, its line as text, missing, of another kind, or drawn backwards.
EDGES = """e AS (SELECT p_partkey AS k, (p_partkey % 10)::DOUBLE AS ux, (p_partkey % 7)::DOUBLE AS uy, ux + 3 AS mx, uy + p_partkey % 5 AS my, ux + 6 AS vx, uy
        + 1 + p_partkey % 3 AS vy, p_partkey % 4 >= 2 AS drawn,
      p_partkey % 4 = 3 AS backwards FROM part),
    l AS (SELECT *, CASE WHEN drawn THEN sqrt((mx - ux) ** 2 + (my - uy) ** 2) END AS one, CASE WHEN drawn THEN sqrt((vx - mx) ** 2 + (vy - my) ** 2) END AS
        two, sqrt((vx - ux) ** 2 + (vy - uy) ** 2) AS straight,
      coalesce(one + two, straight) AS whole FROM e)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    at = S.table(spark, d, "part").selectExpr("p_partkey AS k", "CAST(p_partkey % 10 AS DOUBLE) AS ux", "CAST(p_partkey % 7 AS DOUBLE) AS uy")
    at = at.selectExpr("*", "ux + 3 AS mx", "uy + k % 5 AS my", "ux + 6 AS vx", "uy + 1 + k % 3 AS vy")
    forth = "concat('LINESTRING (', ux, ' ', uy, ', ', mx, ' ', my, ', ', vx, ' ', vy, ')')"
    back = "concat('linestring(', vx, ' ', vy, ',', mx, ' ', my, ',', ux, ' ', uy, ')')"
    return at.selectExpr("*", f"CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'POINT (1 2)' WHEN 2 THEN {forth} ELSE {back} END AS wkt")


def _p(name: str) -> Column:
    return lines.point(F.col(f"{name}x"), F.col(f"{name}y"))


@query(f"WITH {EDGES} SELECT k, CASE WHEN drawn THEN 3 ELSE 2 END AS points, round(whole, 6) AS length, CASE WHEN backwards THEN vx ELSE ux END AS first_x FROM l")
def edge_geometry(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).withColumn("line", lines.edge_line(F.col("wkt"), _p("u"), _p("v")))
    return e.select("k", F.size("line").alias("points"), r6("length", lines.length(F.col("line"))), F.col("line")[0]["x"].alias("first_x"))


@query(f"WITH {EDGES} SELECT k, ux AS first_x, vy AS last_y, CASE WHEN drawn THEN 4 ELSE 3 END AS joined_points, round(whole + sqrt(8.0), 6) AS joined_length FROM l")
def oriented_path(spark: SparkSession, d: str) -> DataFrame:
    """Edges turned to begin at u, then joined with one from v on."""
    e = _edges(spark, d).withColumn("line", lines.oriented(lines.edge_line(F.col("wkt"), _p("u"), _p("v")), _p("u")))
    onward = F.array(_p("v"), lines.point(F.col("vx") + 2, F.col("vy") + 2))
    e = e.withColumn("path", lines.joined(F.array(F.col("line"), onward)))
    last = F.element_at("line", -1)
    return e.select("k", F.col("line")[0]["x"].alias("first_x"), last["y"].alias("last_y"), F.size("path").alias("joined_points"), r6("joined_length", lines.length(F.col("path"))))


@query(f"WITH {EDGES} SELECT k, CASE WHEN drawn THEN 3 ELSE 2 END + (k % 3 = 0)::INT AS points FROM l")
def append_points(spark: SparkSession, d: str) -> DataFrame:
    """A point that is the last one within a billionth is not added again."""
    line = lines.oriented(lines.edge_line(F.col("wkt"), _p("u"), _p("v")), _p("u"))
    more = F.when(F.col("k") % 3 == 0, F.col("vx") + 1).when(F.col("k") % 3 == 1, F.col("vx") + 1e-10).otherwise(F.col("vx"))
    return _edges(spark, d).select("k", F.size(lines.appended(line, lines.point(more, F.col("vy")))).alias("points"))


@query(f"""WITH {EDGES}, a AS (SELECT *, whole * (k % 8) / 8.0 AS along FROM l)
    SELECT k, round(CASE WHEN k % 2 = 0 THEN along ELSE whole - along END, 6) AS access_m, CASE WHEN k % 2 = 0 THEN ux ELSE vx END AS end_x FROM a""")
def edge_access(spark: SparkSession, d: str) -> DataFrame:
    """From a place on an edge to one of its ends, along the edge."""
    line = lines.oriented(lines.edge_line(F.col("wkt"), _p("u"), _p("v")), _p("u"))
    e = _edges(spark, d).withColumn("line", line)
    way = lines.edge_access(F.col("line"), lines.length(F.col("line")) * (F.col("k") % 8) / 8.0, F.col("k") % 2 == 0)
    return e.withColumn("way", way).select("k", r6("access_m", lines.length(F.col("way"))), F.element_at("way", -1)["x"].alias("end_x"))


@query(f"""WITH {EDGES} SELECT k, CASE WHEN k % 6 = 0 THEN 'error:KeyError' ELSE 'complete' END AS status, CASE WHEN k % 6 > 0 THEN CASE WHEN drawn THEN 3 ELSE
        2 END + 2 - (k % 6 = 1)::INT END AS points,
      CASE WHEN k % 6 > 0 THEN round(1 + whole + CASE WHEN k % 6 = 1 THEN 0 ELSE 2 END, 6) END AS length FROM l""")
def modeled_route(spark: SparkSession, d: str) -> DataFrame:
    """From the middle, one to the left of u, to a shelter two above v, at v, or unknown."""
    route = lines.oriented(lines.edge_line(F.col("wkt"), _p("u"), _p("v")), _p("u"))
    shelter = F.when(F.col("k") % 6 == 1, _p("v")).when(F.col("k") % 6 > 0, lines.point(F.col("vx"), F.col("vy") + 2))
    rows = _edges(spark, d).withColumn("m", lines.modeled_route(lines.point(F.col("ux") - 1, F.col("uy")), route, shelter))
    return rows.select("k", "m.status", F.when(F.col("m.line").isNotNull(), F.size("m.line")).alias("points"), r6("length", F.when(F.col("m.line").isNotNull(), lines.length(F.col("m.line")))))


def _vincenty(lon1: str, lat1: str, lon2: str, lat2: str, source: str, key: str, steps: int = 6) -> str:
    """CTEs that end in g(key, metres): the inverse formula step by step."""
    f = geo.WGS84_F
    b = geo.WGS84_A * (1 - f)
    ctes = [
        f"v0 AS (SELECT {key}, atan({1 - f!r} * tan(radians({lat1}))) AS u1, atan({1 - f!r} * tan(radians({lat2}))) AS u2, radians({lon2} - ({lon1})) AS l, radians({lon2} - ({lon1})) AS lam FROM {source})"
    ]
    terms = """sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs,
      CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa, 1 - sa * sa AS ca, CASE WHEN ca = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / ca END AS cm"""
    for i in range(steps):
        ctes.append(f"w{i} AS (SELECT *, {terms}, {f / 16!r} * ca * (4 + {f!r} * (4 - 3 * ca)) AS c FROM v{i})")
        ctes.append(f"v{i + 1} AS (SELECT {key}, u1, u2, l, l + (1 - c) * {f!r} * sa * (atan2(ss, cs) + c * ss * (cm + c * cs * (-1 + 2 * cm ** 2))) AS lam FROM w{i})")
    ctes.append(f"w AS (SELECT *, {terms}, ca * {(geo.WGS84_A**2 - b**2) / b**2!r} AS uu, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS aa, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM v{steps})")
    ctes.append(f"g AS (SELECT {key}, {b!r} * aa * (atan2(ss, cs) - bb * ss * (cm + bb / 4 * (cs * (-1 + 2 * cm ** 2) - bb / 6 * cm * (-3 + 4 * ss ** 2) * (-3 + 4 * cm ** 2)))) AS metres FROM w)")
    return ", ".join(ctes)


LONLAT = "t AS (SELECT vec_id, 130 + embedding[1]::DOUBLE * 5 AS lon, 33 + embedding[2]::DOUBLE * 5 AS lat FROM embeddings)"


@query(f"WITH {LONLAT}, {_vincenty('lon', 'lat', 'lon + 0.01', 'lat + 0.01', 't', 'vec_id')} SELECT vec_id, round(metres, 4) AS length_m FROM g")
def geodesic_length(spark: SparkSession, d: str) -> DataFrame:
    g = lines.geodesic(lines.point(F.col("lon"), F.col("lat")), lines.point(F.col("lon") + 0.01, F.col("lat") + 0.01))
    return R.lonlat(spark, d).select("vec_id", F.round(g["length"], 4).alias("length_m"))


def _utm_sql() -> str:
    import math

    radius, forth, _ = geo._krueger()
    n = geo.WGS84_F / (2 - geo.WGS84_F)
    c = 2 * math.sqrt(n) / (1 + n)
    east = " + ".join(f"{forth[j - 1]!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j in (1, 2, 3))
    north = " + ".join(f"{forth[j - 1]!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j in (1, 2, 3))
    return f"""WITH {LONLAT}, a AS (SELECT *, sinh(atanh(sin(radians(lat))) - {c!r} * atanh({c!r} * sin(radians(lat)))) AS tt, radians(lon - 135) AS lam FROM
        t),
      b AS (SELECT *, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta FROM a)
      SELECT vec_id, round(500000 + {geo.UTM_SCALE * radius!r} * (eta + {east}), 3) AS x, round({geo.UTM_SCALE * radius!r} * (xi + {north}), 3) AS y, true AS
        round_trip FROM b"""


@query(_utm_sql())
def utm_projection(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.to_utm(F.col("lon"), F.col("lat"))
    p = R.lonlat(spark, d).select("vec_id", "lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = geo.from_utm(F.col("x"), F.col("y"))
    return p.select("vec_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), (F.abs(lon - F.col("lon")) + F.abs(lat - F.col("lat")) < 1e-9).alias("round_trip"))


@query(f"""WITH {LONLAT}, {_vincenty('lon', 'lat', 'lon + 0.003', 'lat + 0.002', 't', 'vec_id')}
    SELECT vec_id AS route_id, greatest(1, ceil(metres / 25))::BIGINT AS samples, round(metres, 4) AS length_m, round(metres / greatest(1, ceil(metres / 25)),
        4) AS sample_length_m, true AS on_the_way FROM g""")
def geodesic_samples(spark: SparkSession, d: str) -> DataFrame:
    """One segment a route, cut into equal parts of at most 25 m; every middle lies as far from the start as it should."""
    a, b = lines.point(F.col("lon"), F.col("lat")), lines.point(F.col("lon") + 0.003, F.col("lat") + 0.002)
    routes = R.lonlat(spark, d).select(F.col("vec_id").alias("route_id"), F.array(a, b).alias("line"))
    s = spatial.sample_route(routes, 25.0, geodesic=True).join(routes.select("route_id", F.col("line")[0].alias("a")), "route_id")
    far = lines.geodesic(F.col("a"), lines.point(F.col("x"), F.col("y")))["length"]
    s = s.withColumn("off", F.abs(far - (F.col("sample") + 0.5) * F.col("sample_length_m")))
    return s.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("sample_length_m"), 4).alias("length_m"), F.round(F.first("sample_length_m"), 4).alias("sample_length_m"), (F.max("off") < 1e-4).alias("on_the_way")
    )


@query("""WITH t AS (SELECT n_nationkey AS k, (n_nationkey % 5)::DOUBLE AS w, (n_nationkey % 3 + 1)::DOUBLE AS h FROM nation)
    SELECT k, w + h + 3 AS area, 0.0::DOUBLE AS west, w + 2 AS east, h AS north, round((0 + 2 + (w + 2) + 0) / 4 + 0, 6) AS mean_x FROM (SELECT k, w, h FROM t)
        WHERE false
    UNION ALL SELECT k, (w + 2) * h, 0, w + 2, h, round((w + 2) / 2, 6) FROM t""")
def ring_measures(spark: SparkSession, d: str) -> DataFrame:
    """Area, bounds and the mean of the vertices of a rectangle for each nation."""
    n = S.table(spark, d, "nation").selectExpr("n_nationkey AS k", "CAST(n_nationkey % 5 AS DOUBLE) AS w", "CAST(n_nationkey % 3 + 1 AS DOUBLE) AS h")
    zero, east = F.lit(0.0), F.col("w") + 2
    ring = F.array(*[lines.point(x, y) for x, y in ((zero, zero), (east, zero), (east, F.col("h")), (zero, F.col("h")), (zero, zero))])
    n = n.withColumn("ring", ring).withColumn("b", lines.bounds(F.col("ring")))
    return n.select("k", geo.ring_area(F.col("ring")).alias("area"), "b.west", "b.east", "b.north", r6("mean_x", lines.vertex_mean(F.col("ring"))["x"]))


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS cx, embedding[4]::DOUBLE AS cy FROM
        embeddings),
      near AS (SELECT a.vec_id AS point_id, b.vec_id AS polygon_id, abs(a.x - b.cx) + abs(a.y - b.cy) AS d, abs(a.x - b.cx - 0.1) + abs(a.y - b.cy) AS d2 FROM p
        a JOIN p b ON abs(a.x - b.cx) <= 0.2 AND abs(a.y - b.cy) <= 0.2)
    SELECT point_id, min(polygon_id) AS polygon_id FROM near WHERE d <= 0.02 AND d >= 0.005 OR d2 <= 0.02 GROUP BY 1""")
def point_in_parts(spark: SparkSession, d: str) -> DataFrame:
    """Areas of two diamonds each, the first with a smaller one cut out of it."""
    at = lambda i: F.col("embedding")[i].cast("double")
    e = S.table(spark, d, "embeddings")

    def diamond(size: float, right: float = 0.0) -> Column:
        corner = lambda dx, dy: lines.point(at(2) + right + dx, at(3) + dy)
        return F.array(corner(size, 0), corner(0, size), corner(-size, 0), corner(0, -size), corner(size, 0))

    areas = e.select(F.col("vec_id").alias("polygon_id"), F.col("vec_id").alias("place"), F.array(F.array(diamond(0.02), diamond(0.005)), F.array(diamond(0.02, 0.1))).alias("parts"))
    points = e.select(F.col("vec_id").alias("point_id"), at(0).alias("x"), at(1).alias("y"))
    return spatial.covered_by(points, areas, 0.05, first_match=True)


# --- labels and cells


@query("""WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 50 + 0.001 END AS v FROM orders)
    SELECT k, coalesce(format('{:,.1f}', v), '—') AS number, coalesce(format('{:,.1f}', v * 100) || '%', '—') AS percent, CASE WHEN v IS NULL THEN '—' WHEN v >=
        1000 THEN format('{:,.2f}', v / 1000) || 'km' ELSE format('{:,.0f}', v) || 'm' END AS metres FROM t""")
def number_labels(spark: SparkSession, d: str) -> DataFrame:
    t = S.table(spark, d, "orders").selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 50 + 0.001D END AS v")
    v = F.col("v")
    return t.select("k", ui.number_text(v, 1).alias("number"), ui.percent_text(v).alias("percent"), ui.metres_text(v).alias("metres"))


@query(R.RISK + " SELECT mesh_id, CASE score_status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ui.SCORE_LABELS.items()) + " END AS score_label, CASE WHEN ready THEN '経路成立' WHEN mesh_id % 2 = 0 THEN 'other' ELSE '—' END AS route_label FROM risk")
def status_labels(spark: SparkSession, d: str) -> DataFrame:
    route = F.when(F.col("ready"), "complete").when(F.col("mesh_id") % 2 == 0, "other")
    return R.risk(spark, d).select("mesh_id", ui.status_label(F.col("score_status"), ui.SCORE_LABELS).alias("score_label"), ui.status_label(route, ui.ROUTE_LABELS).alias("route_label"))


@query(R.RISK + """ SELECT mesh_id, round(CASE WHEN mesh_id % 2 = 0 THEN total_walking_distance_m / 60 ELSE total_walking_distance_m / 30 / 60 END, 6) AS
        minutes, round(coalesce(classified_ratio, inundation_ratio), 6) AS exposure,
      round(CASE WHEN score_status = 'complete' THEN full_score END, 6) AS score FROM risk""")
def field_accessors(spark: SparkSession, d: str) -> DataFrame:
    """New fields, and the older ones where those are missing."""
    m = F.col("total_walking_distance_m")
    minutes = ui.minutes_of(F.when(F.col("mesh_id") % 2 == 0, m / 60), m / 30)
    score = ui.policy_score(F.col("score_status"), F.col("full_score"))
    return R.risk(spark, d).select("mesh_id", r6("minutes", minutes), r6("exposure", ui.exposure_of(F.col("classified_ratio"), F.col("inundation_ratio"))), r6("score", score))


@query(R.WHATIF + """, o AS (SELECT w.*, row_number() OVER (ORDER BY round(total_score_reduction, 9) DESC, round(w.capacity_pressure_area_weighted -
        simulated_pressure, 9) DESC, round(assigned_demand_area_weighted, 9) DESC, shelter_key::VARCHAR) AS place
      FROM whatif w JOIN pressure p USING (shelter_key) WHERE delta = 500 AND (w.capacity_pressure_area_weighted > 1 OR total_score_reduction > 1e-9))
    SELECT place::INT AS place, round(total_score_reduction + 1e-8, 6) AS total_score_reduction FROM o WHERE place <= 12""")
def simulation_panel(spark: SparkSession, d: str) -> DataFrame:
    w = scoring.what_if_capacity(R.risk(spark, d), R.pressures(spark, d), R.DELTAS)
    w = w.withColumns({c: F.round(c, 9) for c in ("total_score_reduction", "capacity_pressure_area_weighted", "simulated_pressure", "assigned_demand_area_weighted")})
    return ui.simulation_panel(w, 500.0).select("place", r6("total_score_reduction", F.col("total_score_reduction") + 1e-8))


CELLS = """t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN
        '{x' WHEN 3 THEN '[1,2]' ELSE '{"a": 1}' END AS cell, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Yes' WHEN 2 THEN 'false' ELSE '1' END AS flag,
    CASE event_id % 3 WHEN 0 THEN '38201.0' WHEN 1 THEN '' ELSE '38.05' END AS code FROM events)"""


@query(f"WITH {CELLS} SELECT event_id, CASE WHEN event_id % 5 >= 3 THEN cell ELSE '[]' END AS cell, CASE event_id % 4 WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true END AS flag, CASE event_id % 3 WHEN 0 THEN '38201' WHEN 2 THEN '38.05' END AS code FROM t")
def json_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells as they are exported: JSON or an empty list, three-valued truth, codes without the float's ending."""
    t = S.table(spark, d, "events").selectExpr(
        "event_id",
        "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '{x' WHEN 3 THEN '[1,2]' ELSE '{\"a\": 1}' END AS cell",
        "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Yes' WHEN 2 THEN 'false' ELSE '1' END AS flag",
        "CASE event_id % 3 WHEN 0 THEN '38201.0' WHEN 1 THEN '' ELSE '38.05' END AS code",
    )
    return t.select("event_id", V.json_or_empty(F.col("cell")).alias("cell"), V.tri_state(F.col("flag")).alias("flag"), V.normal_code(F.col("code")).alias("code"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 1 END AS points FROM events""")
def route_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """The new column's coordinates, the old one's where it is empty, nothing where any point is bad."""
    k = F.col("event_id") % 4
    new = F.when(k == 0, "[[1,2],[3,4,5]]").when(k == 1, "").when(k == 2, "[[1,2],[3]]")
    return S.table(spark, d, "events").select("event_id", F.size(V.first_coordinates(new, F.lit("[[9,9]]"))).alias("points"))


@query("""SELECT event_id, i AS place, (event_id % 3)::INT AS depth_class, 2 AS points FROM events, (SELECT unnest([0, 2])::INT AS i) WHERE event_id % 2 = 0""")
def segment_features(spark: SparkSession, d: str) -> DataFrame:
    """Two good stretches a complete route, and one of a single point between them."""
    one = "named_struct('depth_class', CAST(event_id % 3 AS INT), 'coordinates', array(array(1.0D, 2.0D), array(3.0D, 4.0D)))"
    short = "named_struct('depth_class', 1, 'coordinates', array(array(1.0D, 2.0D)))"
    rows = S.table(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 2 = 0 THEN 'complete' ELSE 'no_network_path' END AS route_status", f"to_json(array({one}, {short}, {one})) AS segments")
    return ui.segment_features(rows, "event_id", "segments")


@query(S.with_views("t_shelter") + " SELECT shelter_key, CASE WHEN capacity IS NULL THEN 'missing' WHEN capacity - 20 > 0 THEN 'available' ELSE 'invalid' END AS status FROM t_shelter")
def capacity_status(spark: SparkSession, d: str) -> DataFrame:
    return S.shelters(spark, d).select("shelter_key", V.capacity_status(F.col("capacity") - 20).alias("status"))


@query(S.with_views("t_pair") + """ SELECT mesh_id, shelter_key, s IN ('warning', 'critical') AS outlier FROM (SELECT mesh_id, shelter_key, CASE WHEN
        shelter_key % 9 = 0 THEN 'missing' WHEN total_walking_distance_m / 10 <= 100 THEN 'normal' WHEN total_walking_distance_m / 10 <= 250 THEN 'review'
      WHEN total_walking_distance_m / 10 <= 500 THEN 'warning' ELSE 'critical' END AS s FROM t_pair)""")
def snap_outliers(spark: SparkSession, d: str) -> DataFrame:
    distance = F.when(F.col("shelter_key") % 9 > 0, F.col("total_walking_distance_m") / 10)
    return S.pairs(spark, d).select("mesh_id", "shelter_key", V.snap_outlier(V.snap_status(distance)).alias("outlier"))


@query(S.with_views("t_mesh") + " SELECT mesh_id, CASE WHEN aging_rate_65plus IS NULL OR mesh_id % 5 = 0 THEN 'partial' ELSE 'complete' END AS quality FROM t_mesh")
def mesh_quality(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.when(F.col("mesh_id") % 5 < 4, F.col("mesh_id") % 5 == 0)
    return S.meshes(spark, d).select("mesh_id", V.data_quality(wrong, V.any_null([F.col("aging_rate_65plus")])).alias("quality"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value + 0.001 END AS v FROM events) SELECT event_id, greatest(0, round_even(v * 10,
        0))::BIGINT AS demand_units, greatest(0, floor(v * 10 + 1e-9))::BIGINT AS capacity_units FROM t WHERE v IS NOT NULL
    UNION ALL SELECT event_id, NULL, NULL FROM t WHERE v IS NULL""")
def missing_units(spark: SparkSession, d: str) -> DataFrame:
    """Missing demand or capacity is never zero."""
    v = F.when(F.col("event_id") % 3 > 0, F.col("value") + 0.001)
    return S.table(spark, d, "events").select("event_id", V.demand_units(v).alias("demand_units"), V.capacity_units(v).alias("capacity_units"))


@query("""SELECT count(*) AS qa_records,
      array_to_string(list_sort(list(n_name) FILTER (WHERE n_nationkey % 4 > 0)), ',') AS complete,
      array_to_string(list_sort(list(n_name) FILTER (WHERE n_nationkey % 4 = 0)), ',') AS failed FROM nation""")
def network_summary(spark: SparkSession, d: str) -> DataFrame:
    from terrafold.sources.files import network_summary as summarised

    records = S.table(spark, d, "nation").select(F.col("n_name").alias("municipality"), F.when(F.col("n_nationkey") % 4 > 0, "complete").when(F.col("n_nationkey") % 8 == 0, "failed").alias("status"))
    return summarised(records).select("qa_records", F.array_join("complete_municipalities", ",").alias("complete"), F.array_join("failed_municipalities", ",").alias("failed"))


@query("""SELECT x, y, CASE WHEN (x + y) % 3 = 0 THEN 'absent' ELSE 'present' END AS status, CASE WHEN (x + y) % 3 > 0 THEN x END AS bytes FROM (SELECT DISTINCT
        (p_size % 9)::INT AS x, (p_partkey % 5)::INT AS y FROM part)""")
def tile_store(spark: SparkSession, d: str) -> DataFrame:
    from terrafold.sources.files import tile_store as stored

    wanted = S.table(spark, d, "part").selectExpr("CAST(p_size % 9 AS INT) AS x", "CAST(p_partkey % 5 AS INT) AS y")
    fetched = wanted.distinct().selectExpr("x", "y", "CASE WHEN (x + y) % 3 > 0 THEN CAST(repeat('a', x) AS BINARY) END AS content", "CASE WHEN (x + y) % 3 = 0 THEN 404 ELSE 200 END AS code")
    return stored(wanted, fetched).select("x", "y", "status", F.octet_length("content").alias("bytes"))
