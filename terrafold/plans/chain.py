"""Queries of the route chain and of mesh exposure: origins, seeds, choices, paths, border searches, samples and pixels, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.functions import lines as L
from terrafold.functions import values as V
from terrafold.operators import allocation, candidates as C, gate_sets as G, graph, spatial
from terrafold.operators.gates import evaluate
from terrafold.plans import contracts, surrogates as S
from terrafold.plans import registry as R
from terrafold.plans.registry import query, r6
from terrafold.sources import files

# --- origins in a plane: nodes, straight edges between neighbours by id, meshes

PLANE = """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 1000 AS mx, embedding[4]::DOUBLE
        * 1000 AS my FROM embeddings),
    node AS (SELECT vec_id AS node, x, y FROM p WHERE vec_id % 3 > 0),
    edge AS (SELECT a.vec_id AS edge_id, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 4
        = 0),
    mesh AS (SELECT vec_id AS mesh_id, mx AS x, my AS y FROM p),
    near AS (SELECT *, greatest(0, least(1, ((x - ax) * dx + (y - ay) * dy) / nullif(dx * dx + dy * dy, 0))) AS t FROM mesh, edge),
    edged AS (SELECT mesh_id, edge_id, sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2) AS d, t * sqrt(dx * dx + dy * dy) AS along, (1 - t) * sqrt(dx * dx
        + dy * dy) AS rest,
      greatest(least((x - 6 - ax) / dx, (x + 6 - ax) / dx), least((y - 6 - ay) / dy, (y + 6 - ay) / dy), 0) <= least(greatest((x - 6 - ax) / dx, (x + 6 - ax) /
        dx), greatest((y - 6 - ay) / dy, (y + 6 - ay) / dy), 1) AS meets FROM near),
    choice AS (SELECT mesh_id, 1 AS k, sqrt((node.x - mesh.x) ** 2 + (node.y - mesh.y) ** 2) AS d, node::VARCHAR AS target, NULL::DOUBLE AS along, NULL::DOUBLE
        AS rest FROM mesh JOIN node ON abs(node.x - mesh.x) <= 6 AND abs(node.y - mesh.y) <= 6
      UNION ALL SELECT mesh_id, CASE WHEN meets THEN 2 ELSE 3 END, d, edge_id::VARCHAR, along, rest FROM edged WHERE meets OR d <= 20),
    best AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY k, d, target) AS r FROM choice),
    origin AS (SELECT mesh_id, CASE k WHEN 1 THEN 'walk_node_within_mesh' WHEN 2 THEN 'walk_edge_intersects_mesh' WHEN 3 THEN 'nearest_walk_edge_fallback' ELSE
        'network_coverage_gap' END AS origin_method,
      target, d AS connector_m, along, rest FROM mesh LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (mesh_id))"""


def _origins(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double") * 1000
    p = S.table(spark, d, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("mx"), at(3).alias("my"))
    other = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    edges = p.where("vec_id % 4 = 0").join(other, "vec_id").select(F.col("vec_id").alias("edge_id"), F.array(L.point(F.col("x"), F.col("y")), L.point(F.col("bx"), F.col("by"))).alias("line"))
    meshes = p.select(F.col("vec_id").alias("mesh_id"), F.col("mx").alias("x"), F.col("my").alias("y"), F.lit(6.0).alias("half_x"), F.lit(6.0).alias("half_y"))
    return spatial.select_origins(meshes, p.where("vec_id % 3 > 0").select(F.col("vec_id").alias("node"), "x", "y"), edges, 20.0)


@query(PLANE + " SELECT mesh_id, origin_method, target, round(connector_m, 6) AS connector_m, round(along, 6) AS along_u_m, round(rest, 6) AS along_v_m FROM origin")
def origin_choice(spark: SparkSession, d: str) -> DataFrame:
    """Origin of each mesh: a node inside, an edge that meets it, the nearest edge within reach, or a gap."""
    return _origins(spark, d).select("mesh_id", "origin_method", "target", *[r6(c) for c in ("connector_m", "along_u_m", "along_v_m")])


@query(PLANE + """ SELECT mesh_id, target AS node, round(connector_m, 6) AS access FROM origin WHERE origin_method = 'walk_node_within_mesh'
    UNION ALL SELECT mesh_id, target, round(connector_m + along, 6) FROM origin WHERE along IS NOT NULL UNION ALL SELECT mesh_id, (target::BIGINT + 1)::VARCHAR,
        round(connector_m + rest, 6) FROM origin WHERE rest IS NOT NULL""")
def origin_seed_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a search starts from: one node, or both ends of an edge with the walk along it; a gap has none."""
    o = _origins(spark, d).select("*", F.lit("all").alias("context"), F.col("target").alias("node"), F.col("target").alias("edge_u"), (F.col("target").cast("long") + 1).cast("string").alias("edge_v"))
    return graph.origin_seeds(o).select("mesh_id", "node", r6("access"))


# --- choices, paths and parts of networks


@query(R.CONTEXTS + """, best AS (SELECT context, node, arg_min(source, (round(cost, 9), source)) AS source, min(cost) AS cost FROM far GROUP BY 1, 2),
    seeds AS (SELECT context, u || ' ' || v AS mesh_id, unnest([u, v]) AS node, unnest([length / 4, length * 3 / 4]) AS access FROM c),
    total AS (SELECT s.*, b.source, b.cost, row_number() OVER (PARTITION BY mesh_id, context ORDER BY round(access + cost, 9), b.source, s.node) AS r FROM seeds
        s JOIN best b USING (context, node))
    SELECT mesh_id, context, node, source, round(access + cost, 6) AS total FROM total WHERE r = 1""")
def chosen_origins(spark: SparkSession, d: str) -> DataFrame:
    """Of the two ends of an edge on which a mesh starts, the one from which a source is nearer."""
    e = R.contexts(spark, d)
    labels = graph.nearest_sources(graph.collapse_graph(e), R._seeds(e))
    labels = labels.withColumn("cost", F.round("cost", 9))
    ends = F.array(F.struct(F.col("u").alias("node"), (F.col("length") / 4).alias("access")), F.struct(F.col("v").alias("node"), (F.col("length") * 3 / 4).alias("access")))
    seeds = e.select(F.concat_ws(" ", "context", "u", "v").alias("mesh_id"), "context", F.inline(ends))
    best = graph.choose_origin(seeds, labels)
    return best.select(F.expr("substring(mesh_id, length(context) + 2)").alias("mesh_id"), "context", "node", "source", r6("total"))


@query(R.ONE_CONTEXT + """, walk(origin, here, hops, trail) AS (SELECT node, node, 0, node FROM best WHERE node[1] = 'p'
      UNION ALL SELECT t.origin, o.next, t.hops + 1, t.trail || ' ' || o.next FROM walk t JOIN best b ON b.node = t.here AND b.node <> b.source JOIN onward o ON
        o.node = t.here)
    SELECT origin AS node, hops::INT AS hops, trail FROM walk JOIN best ON best.node = here AND best.node = best.source""")
def walked_paths(spark: SparkSession, d: str) -> DataFrame:
    """The nodes from each part to the source that is nearest to it."""
    labels = graph.nearest_by_joins(*R._one_context(spark, d))
    paths = graph.node_paths(labels, labels.where("node LIKE 'p%'").select("context", "node"))
    return paths.select("node", (F.size("path") - 1).alias("hops"), F.array_join("path", " ").alias("trail"))


@query(R.CONTEXTS.split(",\n    seed AS")[0] + """, reach AS (SELECT DISTINCT context, x AS node, x AS other FROM b UNION SELECT reach.context, reach.node, b.y
        FROM reach JOIN b ON b.context = reach.context AND b.x = reach.other),
    part AS (SELECT context, node, min(other) AS component FROM reach GROUP BY ALL), n AS (SELECT context, component, count(*) AS n FROM part GROUP BY ALL)
    SELECT context, count(*) AS components, sum(n)::BIGINT AS nodes, round(max(n) / sum(n), 6) AS largest_share, array_to_string(list(n ORDER BY n DESC)[:10],
        ' ') AS largest FROM n GROUP BY context""")
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many connected parts each network has, and the largest of them."""
    sizes = graph.component_sizes(graph.components(R.contexts(spark, d).select("context", "u", "v")))
    return sizes.select("context", "components", "nodes", r6("largest_share"), F.array_join(F.transform("largest", lambda n: n.cast("string")), " ").alias("largest"))


BORDER = R.ONE_CONTEXT + """, mesh AS (SELECT DISTINCT node AS mesh_id, node[2:]::BIGINT % 5 AS municipality, node[2:]::BIGINT % 10 AS boundary_m FROM far WHERE
        node[1] = 'p'),
    away AS (SELECT node AS mesh_id, arg_min(source[2:]::BIGINT % 5, (round(cost, 9), source)) AS abroad, min(cost) AS all_m FROM far GROUP BY 1),
    home AS (SELECT f.node AS mesh_id, min(cost) AS home_m FROM far f JOIN mesh m ON m.mesh_id = f.node AND source[2:]::BIGINT % 5 = m.municipality GROUP BY 1)
    SELECT mesh_id, abroad AS external_municipality, round(all_m, 6) AS all_distance_m, round(home_m - all_m, 6) AS improvement_m FROM mesh JOIN away USING
        (mesh_id) LEFT JOIN home USING (mesh_id)
    WHERE boundary_m <= 6 AND abroad <> municipality AND (home_m IS NULL OR home_m - all_m > 1.0)"""


@query(BORDER)
def border_searches(spark: SparkSession, d: str) -> DataFrame:
    """The border comparison by its own two searches: from all sources, and from those of each municipality alone."""
    edges, seeds = R._one_context(spark, d)
    place = lambda c: F.expr(f"CAST(substring({c}, 2) AS BIGINT) % 5")
    meshes = edges.where("u LIKE 'p%'").select(F.col("u").alias("mesh_id")).distinct()
    meshes = meshes.select("mesh_id", F.col("mesh_id").alias("node"), place("mesh_id").alias("municipality"), F.expr("CAST(substring(mesh_id, 2) AS BIGINT) % 10").alias("boundary_m"))
    got = C.border_comparison(edges, seeds.withColumn("municipality", place("source")), meshes, 6)
    return got.select("mesh_id", "external_municipality", r6("all_distance_m"), r6("improvement_m"))


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS cx, embedding[4]::DOUBLE AS cy FROM
        embeddings),
      near AS (SELECT a.vec_id AS point_id, b.vec_id AS polygon_id, abs(a.x - b.cx) AS u, abs(a.y - b.cy) AS v FROM p a JOIN p b ON abs(a.x - b.cx) <= 0.04 AND
        abs(a.y - b.cy) <= 0.04),
      t AS (SELECT *, greatest(0, least(1, (0.02 - u + v) / 0.04)) AS t FROM near)
    SELECT point_id, polygon_id FROM t WHERE u + v <= 0.02 OR sqrt((u - 0.02 * (1 - t)) ** 2 + (v - 0.02 * t) ** 2) <= 0.015""")
def buffered_cover(spark: SparkSession, d: str) -> DataFrame:
    """Points within diamonds or near enough to their border, without a buffer being drawn."""
    at = lambda i: F.col("embedding")[i].cast("double")
    e = S.table(spark, d, "embeddings")
    corner = lambda dx, dy: L.point(at(2) + dx, at(3) + dy)
    ring = F.array(corner(0.02, 0), corner(0, 0.02), corner(-0.02, 0), corner(0, -0.02), corner(0.02, 0))
    diamonds = e.select(F.col("vec_id").alias("polygon_id"), F.col("vec_id").alias("place"), ring.alias("ring"))
    return spatial.covered_by(e.select(F.col("vec_id").alias("point_id"), at(0).alias("x"), at(1).alias("y")), diamonds, 0.05, buffer=0.015)


# --- mesh exposure: samples, pixels, classes

SAMPLES = f"""WITH t AS (SELECT DISTINCT {R.MESH_CODE} AS code FROM customer),
    corner AS (SELECT code, code[1:2]::INT / 1.5 + code[5]::INT / 12.0 + code[7]::INT / 120.0 + CASE WHEN code[9]::INT IN (2, 4) THEN 1 / 240.0 ELSE 0 END AS
        south,
      100 + code[3:4]::INT + code[6]::INT / 8.0 + code[8]::INT / 80.0 + CASE WHEN code[9]::INT IN (3, 4) THEN 1 / 160.0 ELSE 0 END AS west FROM t),
    sample AS (SELECT code AS mesh_id, west + (i + 0.5) / 13 / 160.0 AS lon, south + (j + 0.5) / 13 / 240.0 AS lat FROM corner, range(13) a(i), range(13) b(j)),
    place AS (SELECT mesh_id, (lon + 180) / 360 * 4096 AS xf, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096 AS yf FROM sample),
    spot AS (SELECT mesh_id, floor(xf)::INT AS x, floor(yf)::INT AS y, floor((xf - floor(xf)) * 256)::INT AS px, floor((yf - floor(yf)) * 256)::INT AS py FROM
        place),
    seen AS (SELECT *, CASE WHEN (px * 31 + py * 17) % 5 < 3 THEN CASE (px + py) % 4 WHEN 0 THEN 1 WHEN 1 THEN 6 END END AS depth FROM spot)"""


def _mesh_ids(spark: SparkSession, d: str) -> DataFrame:
    return R.mesh_codes(spark, d).select("mesh_id").distinct()


@query(SAMPLES + " SELECT mesh_id, count(*) AS samples, round(min(lon), 9) AS west, round(max(lat), 9) AS north, round(avg(lon), 9) AS mean_lon, round(avg(lat), 9) AS mean_lat FROM sample GROUP BY 1")
def mesh_samples(spark: SparkSession, d: str) -> DataFrame:
    """Thirteen by thirteen sample points of each mesh."""
    r9 = lambda c, n: F.round(c, 9).alias(n)
    return spatial.grid_samples(_mesh_ids(spark, d)).groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("samples"), r9(F.min("lon"), "west"), r9(F.max("lat"), "north"), r9(F.avg("lon"), "mean_lon"), r9(F.avg("lat"), "mean_lat")
    )


@query(SAMPLES + """ SELECT mesh_id, count(*) AS sample_count, count(depth) AS inundated_sample_count, round(count(depth) / count(*)::DOUBLE, 6) AS
        inundation_ratio, max(depth)::INT AS max_depth_class,
    round(count(depth) / count(*)::DOUBLE * 100, 6) AS exposure_score FROM seen GROUP BY 1""")
def mesh_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Zonal statistics of meshes over pixels: two of the palette's colours, one that is none of it, transparent ones, and pixels that are not there."""
    meshes = _mesh_ids(spark, d)
    at = spatial.grid_samples(meshes).select(geo.tile_address(F.col("lon"), F.col("lat")).alias("t")).select("t.*").distinct()
    colour = [F.when((F.col("px") + F.col("py")) % 4 == 0, geo.PALETTE[1][i]).when((F.col("px") + F.col("py")) % 4 == 1, geo.PALETTE[6][i]).when((F.col("px") + F.col("py")) % 4 == 2, geo.PALETTE[8][i]).otherwise(9) for i in range(3)]
    alpha = F.when((F.col("px") + F.col("py")) % 4 == 2, 127).otherwise(255)
    pixels = at.where("(px * 31 + py * 17) % 5 < 3").select("x", "y", "px", "py", *[c.cast("int").alias(n) for c, n in zip(colour, "rgb", strict=True)], alpha.alias("a"))
    out = spatial.exposure_by_mesh(meshes, pixels)
    return out.select("mesh_id", "sample_count", "inundated_sample_count", r6("inundation_ratio"), F.col("max_depth_class").cast("int").alias("max_depth_class"), r6("exposure_score"))


@query(f"WITH t AS (SELECT {R.RGB}, p_partkey % 256 AS a FROM part), n AS (SELECT p_partkey, a, list_min([{R._NEAR}]) AS best FROM t) SELECT p_partkey, CASE WHEN a >= 128 AND best.d <= 900 THEN best.k END::INT AS depth FROM n")
def pixel_depths(spark: SparkSession, d: str) -> DataFrame:
    p = S.table(spark, d, "part").selectExpr("p_partkey", "200 + p_partkey % 56 AS r", "100 + p_partkey * 7 % 156 AS g", "140 + p_partkey * 13 % 116 AS b", "p_partkey % 256 AS a")
    return p.select("p_partkey", spatial.pixel_depth(F.col("r"), F.col("g"), F.col("b"), F.col("a")).cast("int").alias("depth"))


def _raw_image(content: bytes) -> np.ndarray | None:
    """Two rows of four pixels; an empty tile has none."""
    return np.frombuffer(content, np.uint8).reshape(2, 4, 4) if content else None


@query("""WITH t AS (SELECT c_custkey AS x, c_custkey % 7 AS y, CASE WHEN c_custkey % 5 > 0 THEN sha256(c_custkey::VARCHAR) END AS h FROM customer),
    p AS (SELECT x, y, h, unnest(range(8)) AS k FROM t WHERE h IS NOT NULL), hex AS (SELECT *, ('0x' || h[8 * k + 1:8 * k + 2])::INT AS r, ('0x' || h[8 * k +
        3:8 * k + 4])::INT AS g, ('0x' || h[8 * k + 5:8 * k + 6])::INT AS b, ('0x' || h[8 * k + 7:8 * k + 8])::INT AS a FROM p)
    SELECT x::INT AS x, y::INT AS y, (k % 4)::INT AS px, (k // 4)::INT AS py, r, g, b, a FROM hex""")
def tile_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of tiles whose bytes are digests; a tile without content has none."""
    c = S.table(spark, d, "customer").selectExpr("CAST(c_custkey AS INT) AS x", "CAST(c_custkey % 7 AS INT) AS y", "CASE WHEN c_custkey % 5 > 0 THEN unhex(sha2(CAST(c_custkey AS STRING), 256)) END AS content")
    return files.tile_pixels(c, _raw_image)


# --- shares across borders, several parts of an area, two baselines, the gate before the overlay


@query(contracts.FLOW + """ SELECT 'r' AS run_id, round(sum(CASE WHEN (mesh_id + shelter_key) % 2 = 0 THEN n / 10.0 ELSE 0 END), 6)::DOUBLE AS
        cross_border_demand,
    round(sum(n / 10.0 * greatest(0, m - nearest_m)) / sum(n / 10.0), 6)::DOUBLE AS mean_additional_distance_m, (sum(n * (round_even(m * 10, 0)::BIGINT * 100 +
        candidate_rank)::HUGEINT)
      + (SELECT sum(n) FROM lost) * 1000000000::HUGEINT + (SELECT sum(x) FROM extra))::BIGINT AS objective_cost FROM fr JOIN near USING (mesh_id)""")
def allocation_borders(spark: SparkSession, d: str) -> DataFrame:
    """Of the given flow: demand that crosses a border, what its ways are longer than the nearest, and its cost in whole units."""
    flow, prepared = contracts._given_flow(spark, d)
    crossing = prepared.withColumn("cross_border", (F.col("mesh_id") + F.col("shelter_key")) % 2 == 0)
    s = allocation.allocation_summary(flow, crossing)
    return s.select("run_id", r6("cross_border_demand"), r6("mean_additional_distance_m"), F.col("objective_cost").cast("long").alias("objective_cost"))


@query("""WITH s AS (SELECT s_suppkey AS k, (1 + s_suppkey % 5)::DOUBLE AS w, (1 + s_suppkey % 3)::DOUBLE AS h, s_nationkey::DOUBLE AS x FROM supplier)
    SELECT k, CASE WHEN k % 2 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS type, CASE WHEN k % 4 = 3 THEN w * h * 0.75 ELSE w * h END + CASE WHEN k % 2 = 0
        THEN 4 ELSE 0 END AS area,
      x AS west, 0.0::DOUBLE AS south, CASE WHEN k % 2 = 0 THEN x + 12 ELSE x + w END AS east, CASE WHEN k % 2 = 0 THEN greatest(h, 2) ELSE h END AS north FROM
        s""")
def area_measures(spark: SparkSession, d: str) -> DataFrame:
    """Type, area less holes, and bounds of areas of one part or two."""
    s = S.table(spark, d, "supplier").selectExpr("s_suppkey AS k", "CAST(1 + s_suppkey % 5 AS DOUBLE) AS w", "CAST(1 + s_suppkey % 3 AS DOUBLE) AS h", "CAST(s_nationkey AS DOUBLE) AS x")

    def box(x, y, w, h):
        return F.array(*[L.point(*p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))])

    x, w, h, zero = F.col("x"), F.col("w"), F.col("h"), F.lit(0.0)
    hole = F.when(F.col("k") % 4 == 3, F.array(box(x, zero, w, h), box(x + w / 4, h / 4, w / 2, h / 2))).otherwise(F.array(box(x, zero, w, h)))
    parts = F.when(F.col("k") % 2 == 0, F.array(hole, F.array(box(x + 10, zero, F.lit(2.0), F.lit(2.0))))).otherwise(F.array(hole))
    m = s.withColumn("parts", parts).withColumn("m", L.area_measures(F.col("parts")))
    return m.select("k", "m.type", r6("area", F.col("m.area")), "m.bounds.west", "m.bounds.south", "m.bounds.east", "m.bounds.north")


# Routes of the same network, which agree but for some meshes, and canonical ones, which agree but for others.
TWO = S.with_views("t_mesh", "t_candidate") + """, status AS (SELECT mesh_id, CASE WHEN mesh_id IN (SELECT mesh_id FROM t_candidate) THEN 'complete' ELSE
        'no_network_path' END AS s FROM t_mesh),
    one AS (SELECT status.mesh_id, s, shelter_key, total_walking_distance_m AS m FROM status LEFT JOIN t_candidate c ON c.mesh_id = status.mesh_id AND
        candidate_rank = 1),
    canon AS (SELECT mesh_id, s, shelter_key, m + CASE WHEN mesh_id % 400 = 1 THEN 0.01 ELSE 0 END AS m FROM one WHERE mesh_id % 500 <> 2),
    off AS (SELECT count(*) AS n FROM canon WHERE s = 'complete' AND mesh_id % 400 = 1)"""


def _baselines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    cand = S.candidates(spark, d).select("mesh_id", "candidate_rank", "shelter_key", "total_walking_distance_m")
    there = cand.select("mesh_id").distinct().withColumn("candidate_status", F.lit("complete"))
    status = S.meshes(spark, d).select("mesh_id").join(there, "mesh_id", "left").withColumn("candidate_status", F.coalesce("candidate_status", F.lit("no_network_path")))
    one = status.join(cand.where("candidate_rank = 1"), "mesh_id", "left").select("mesh_id", F.col("candidate_status").alias("route_status"), "shelter_key", "total_walking_distance_m")
    canon = one.where("mesh_id % 500 <> 2").withColumn("total_walking_distance_m", F.col("total_walking_distance_m") + F.expr("IF(mesh_id % 400 = 1, 0.01D, 0D)"))
    return cand, status, {"same_network": one, "canonical": canon}


@query(contracts.gate_sql(TWO, [
    ("status_mesh_unique", "failure", contracts.repeated("status", "mesh_id")),
    ("pair_unique", "failure", contracts.repeated("t_candidate", "mesh_id", "shelter_key")),
    ("rank_unique", "failure", contracts.repeated("t_candidate", "mesh_id", "candidate_rank")),
    ("rank_within_limit", "failure", contracts.of("t_candidate", "candidate_rank > 10")),
    ("ranks_and_distances_rise", "failure", "SELECT count(DISTINCT mesh_id) FROM (SELECT mesh_id, total_walking_distance_m < lag(total_walking_distance_m) OVER (PARTITION BY mesh_id ORDER BY candidate_rank) AS falls FROM t_candidate) WHERE falls"),
    ("same_network_meshes", "failure", contracts.only_in("status", "one")),
    ("same_network_status", "failure", "SELECT count(*) FROM status LEFT JOIN one USING (mesh_id) WHERE status.s IS DISTINCT FROM one.s"),
    ("same_network_identity", "failure", "SELECT count(*) FROM one LEFT JOIN t_candidate c ON c.mesh_id = one.mesh_id AND candidate_rank = 1 WHERE s = 'complete' AND one.shelter_key IS DISTINCT FROM c.shelter_key"),
    ("same_network_distance", "failure", "SELECT count(*) FROM one LEFT JOIN t_candidate c ON c.mesh_id = one.mesh_id AND candidate_rank = 1 WHERE s = 'complete' AND coalesce(abs(m - c.total_walking_distance_m) > 1e-6, true)"),
    ("canonical_meshes", "failure", contracts.only_in("status", "canon")),
    ("canonical_status", "failure", "SELECT count(*) FROM status LEFT JOIN canon USING (mesh_id) WHERE status.s IS DISTINCT FROM canon.s"),
    ("canonical_identity", "failure", "SELECT count(*) FROM canon LEFT JOIN t_candidate c ON c.mesh_id = canon.mesh_id AND candidate_rank = 1 WHERE s = 'complete' AND canon.shelter_key IS DISTINCT FROM c.shelter_key"),
    ("canonical_distance", "failure", "SELECT n FROM off"),
]))
def double_parity_gates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates against routes of the same network and against the canonical ones."""
    return evaluate(G.candidate_parity_gates(*_baselines(spark, d), 10, 1e-6))


@query(TWO + """ SELECT 'same' AS against, c.mesh_id, c.candidate_rank::INT AS candidate_rank, CASE WHEN c.candidate_rank = 1 THEN c.mesh_id * 10 ELSE
        c.shelter_key END AS code FROM t_candidate c
    UNION ALL SELECT 'both', c.mesh_id, c.candidate_rank::INT, CASE WHEN c.candidate_rank = 1 AND (SELECT n FROM off) = 0 AND NOT EXISTS (SELECT 1 FROM status
        WHERE mesh_id % 500 = 2) THEN c.mesh_id * 10 ELSE c.shelter_key END FROM t_candidate c""")
def gated_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Canonical codes on rank-1 candidates, only where the parity gates pass: against the same network they do, against the canonical one, too, only on data without its faults."""
    cand, status, baselines = _baselines(spark, d)
    rows = cand.withColumn("code", F.col("shelter_key"))
    codes = status.select("mesh_id", (F.col("mesh_id") * 10).alias("code"))
    out = []
    for name, some in (("same", ["same_network"]), ("both", ["same_network", "canonical"])):
        gates = G.candidate_parity_gates(cand, status, {k: baselines[k] for k in some}, 10, 1e-6)
        done = C.anchored_if(rows, codes, ["code"], gates)
        out.append(done.select(F.lit(name).alias("against"), "mesh_id", F.col("candidate_rank").cast("int").alias("candidate_rank"), "code"))
    return out[0].unionByName(out[1])


@query("""WITH d AS (SELECT s_suppkey AS shelter_key, s_nationkey AS place, s_acctbal AS total FROM supplier WHERE s_suppkey % 3 > 0)
    SELECT o.c_custkey AS mesh_id, o.c_nationkey AS place, o.c_acctbal AS total, d.place AS place_of_shelter, d.total AS total_of_shelter FROM customer o LEFT
        JOIN d ON d.shelter_key = o.c_custkey % 40""")
def renamed_join(spark: SparkSession, d: str) -> DataFrame:
    """A left join of keys by different names whose other columns share theirs."""
    from terrafold.operators.relational import join_renamed

    left = S.table(spark, d, "customer").selectExpr("c_custkey AS mesh_id", "c_custkey % 40 AS wanted", "c_nationkey AS place", "c_acctbal AS total")
    right = S.table(spark, d, "supplier").where("s_suppkey % 3 > 0").selectExpr("s_suppkey AS shelter_key", "s_nationkey AS place", "s_acctbal AS total")
    return join_renamed(left, right, {"wanted": "shelter_key"}, "_of_shelter").select("mesh_id", "place", "total", "place_of_shelter", "total_of_shelter")
