"""Queries of areas: dissolved boundaries, distances to them, validity of rings, each with SQL over cells or over all pairs of sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import areas
from terrafold.plans import surrogates as S
from terrafold.plans.registry import query, r6

# Boxes with whole corners, fifty to a place: what they cover are cells, which SQL can count.
CELLS = """WITH box AS (SELECT c_custkey // 50 AS place, c_custkey * 7919 % 16 AS x, c_custkey * 104729 % 16 AS y, 1 + c_custkey % 4 AS w, 1 + c_nationkey % 4
        AS h FROM customer),
    wide AS (SELECT place, unnest(range(x, x + w)) AS i, y, h FROM box),
    cell AS (SELECT DISTINCT place, i, unnest(range(y, y + h)) AS j FROM wide),
    side AS (SELECT c.place, c.i + greatest(d.a, 0) AS x0, c.j + greatest(d.b, 0) AS y0, c.i + CASE WHEN d.a = 0 THEN 1 ELSE greatest(d.a, 0) END AS x1, c.j +
        CASE WHEN d.b = 0 THEN 1 ELSE greatest(d.b, 0) END AS y1
      FROM cell c, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(a, b) WHERE NOT EXISTS (SELECT 1 FROM cell o WHERE o.place = c.place AND o.i = c.i + d.a AND o.j
        = c.j + d.b))"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "customer").selectExpr(
        "c_custkey div 50 AS place", "c_custkey AS part", "CAST(c_custkey * 7919 % 16 AS DOUBLE) AS x", "CAST(c_custkey * 104729 % 16 AS DOUBLE) AS y",
        "1 + c_custkey % 4 AS w", "1 + c_nationkey % 4 AS h",
    )
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, east, north = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    ring = F.array(corner(x, y), corner(east, y), corner(east, north), corner(x, north), corner(x, y))
    return c.select("place", "part", "x", "y", F.array(ring).alias("rings"))


@query(CELLS + """, area AS (SELECT place, count(*)::DOUBLE AS area FROM cell GROUP BY 1), around AS (SELECT place, count(*)::DOUBLE AS perimeter FROM side
        GROUP BY 1)
    SELECT place::VARCHAR AS place, area, perimeter FROM area JOIN around USING (place)""")
def dissolved_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area and perimeter of what a place's overlapping and touching parts cover together."""
    m = areas.boundary_measures(areas.dissolve(_boxes(spark, d)))
    return m.select("place", r6("area"), r6("perimeter"))


# Outer rings less holes: cells, less pairs of neighbours, and blocks of four.
@query(CELLS + """, pairs AS (SELECT c.place, count(*) AS n FROM cell c JOIN cell o ON o.place = c.place AND (o.i = c.i + 1 AND o.j = c.j OR o.i = c.i AND o.j =
        c.j + 1) GROUP BY 1),
    blocks AS (SELECT c.place, count(*) AS n FROM cell c JOIN cell r ON r.place = c.place AND r.i = c.i + 1 AND r.j = c.j JOIN cell u ON u.place = c.place AND
        u.i = c.i AND u.j = c.j + 1
      JOIN cell q ON q.place = c.place AND q.i = c.i + 1 AND q.j = c.j + 1 GROUP BY 1),
    cells AS (SELECT place, count(*) AS n FROM cell GROUP BY 1)
    SELECT cells.place::VARCHAR AS place, (cells.n - coalesce(pairs.n, 0) + coalesce(blocks.n, 0))::BIGINT AS outer_less_holes, cells.n::DOUBLE AS area
    FROM cells LEFT JOIN pairs USING (place) LEFT JOIN blocks USING (place)""")
def dissolved_rings(spark: SparkSession, d: str) -> DataFrame:
    """The boundary walked to rings: how many more outer ones than holes, and what they enclose."""
    walked = areas.rings(areas.dissolve(_boxes(spark, d)))
    return walked.groupBy("place").agg(
        (F.count_if(F.col("signed_area") > 0) - F.count_if(F.col("signed_area") < 0)).alias("outer_less_holes"), F.round(F.sum("signed_area"), 6).alias("area")
    )


@query(CELLS + """ SELECT c_custkey AS point_id, round(min(sqrt(greatest(x0 - px, 0, px - x1) ** 2 + greatest(y0 - py, 0, py - y1) ** 2)), 6) AS distance
    FROM (SELECT c_custkey, c_custkey // 50 AS place, c_custkey * 7919 % 16 + 0.3 AS px, c_custkey * 104729 % 16 + 2.4 AS py FROM customer) JOIN side USING
        (place) GROUP BY 1""")
def dissolved_distance(spark: SparkSession, d: str) -> DataFrame:
    """How far points within a place are from its outer boundary: borders between its parts do not count."""
    boxes = _boxes(spark, d)
    points = boxes.select(F.col("part").alias("point_id"), "place", (F.col("x") + 0.3).alias("x"), (F.col("y") + 2.4).alias("y"))
    return areas.boundary_distance(points, areas.dissolve(boxes), 1.0).select("point_id", r6("distance"))


QUADS = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: round(v::DOUBLE, 9)) AS e FROM embeddings),
    corner AS (SELECT vec_id, 0 AS ring, unnest([0, 1, 2, 3]) AS k, 4 AS n, e FROM e UNION ALL SELECT vec_id, 1, unnest([0, 1, 2]), 3, e FROM e),
    p AS (SELECT vec_id, ring, k, n, CASE ring WHEN 0 THEN e[2 * k + 1] ELSE round((e[1] + e[3] + e[5] + e[7]) / 4 + e[2 * k + 9] / 5, 9) END AS x,
      CASE ring WHEN 0 THEN e[2 * k + 2] ELSE round((e[2] + e[4] + e[6] + e[8]) / 4 + e[2 * k + 10] / 5, 9) END AS y FROM corner),
    s AS (SELECT a.vec_id, a.ring, a.k, a.n, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy FROM p a JOIN p b ON b.vec_id = a.vec_id AND b.ring = a.ring AND b.k =
        (a.k + 1) % a.n),
    hit AS (SELECT s.vec_id, s.ring, t.ring AS ring2 FROM s JOIN s t ON t.vec_id = s.vec_id AND (s.ring < t.ring OR s.ring = t.ring AND s.k < t.k AND (t.k -
        s.k) NOT IN (1, s.n - 1))
      WHERE ((s.qx - s.ax) * (t.ay - s.ay) - (s.qy - s.ay) * (t.ax - s.ax)) * ((s.qx - s.ax) * (t.qy - s.ay) - (s.qy - s.ay) * (t.qx - s.ax)) < 0
        AND ((t.qx - t.ax) * (s.ay - t.ay) - (t.qy - t.ay) * (s.ax - t.ax)) * ((t.qx - t.ax) * (s.qy - t.ay) - (t.qy - t.ay) * (s.qx - t.ax)) < 0),
    m AS (SELECT vec_id, (ax + qx) / 2 AS x, (ay + qy) / 2 AS y FROM s WHERE ring = 1 AND k = 0),
    inside AS (SELECT m.vec_id FROM m JOIN s ON s.vec_id = m.vec_id AND s.ring = 0 AND (ay > y) <> (qy > y) AND ax + (y - ay) * (qx - ax) / (qy - ay) > x GROUP
        BY 1 HAVING count(*) % 2 = 1)"""


@query(QUADS + """ SELECT DISTINCT vec_id AS shape, CASE WHEN ring = ring2 THEN 'crossing' ELSE 'rings_cross' END AS fault FROM hit
    UNION ALL SELECT vec_id, 'hole_outside' FROM m WHERE vec_id NOT IN (SELECT vec_id FROM inside)""")
def ring_faults(spark: SparkSession, d: str) -> DataFrame:
    """Quadrilaterals of the vectors' first numbers, each with a triangle of the next ones as a hole, against all pairs of their sides."""
    e = S.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 9)).alias("e"))
    at = lambda i: F.col("e")[i]
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quad = [corner(at(2 * k), at(2 * k + 1)) for k in (0, 1, 2, 3, 0)]
    middle = [(at(0 + c) + at(2 + c) + at(4 + c) + at(6 + c)) / 4 for c in (0, 1)]
    hole = [corner(middle[0] + at(2 * k + 8) / 5, middle[1] + at(2 * k + 9) / 5) for k in (0, 1, 2, 0)]
    return areas.ring_faults(e.select(F.col("vec_id").alias("shape"), F.array(F.array(*quad), F.array(*hole)).alias("rings")))
