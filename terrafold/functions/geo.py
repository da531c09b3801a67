"""Geometry as column expressions: half-kilometre meshes, map tiles, projections and rings.

Points are structs of lon and lat (or x and y); rings are arrays of such structs,
closed, so no geometry type is needed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of the depth classes, and the WGS84 ellipsoid.
PALETTE = {
    1: (255, 255, 179),
    2: (247, 245, 169),
    3: (248, 225, 166),
    4: (255, 216, 192),
    5: (255, 183, 183),
    6: (255, 145, 145),
    7: (242, 133, 201),
    8: (220, 122, 220),
}
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST = 0.9996, 500000.0


def is_mesh_code(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]{8}[1-4]$"), F.lit(False))


def mesh_corner(c: Column, quadrants: str = "reference") -> tuple[Column, Column]:
    """(lon, lat) of the south-west corner; null for what is no code.

    ``quadrants`` is ``reference`` (2 and 4 north, 3 and 4 east) or ``jis`` (3 and
    4 north, 2 and 4 east).
    """
    code = F.when(is_mesh_code(c), c)
    part = lambda at, n=1: F.substring(code, at, n).cast("int")
    north, east = ((2, 4), (3, 4)) if quadrants == "reference" else ((3, 4), (2, 4))
    quadrant = part(9)
    lat = part(1, 2) / F.lit(1.5) + part(5) / 12.0 + part(7) / 120.0 + F.when(quadrant.isin(*north), 1 / 240.0).otherwise(0.0)
    lon = 100.0 + part(3, 2) + part(6) / 8.0 + part(8) / 80.0 + F.when(quadrant.isin(*east), 1 / 160.0).otherwise(0.0)
    return F.when(code.isNotNull(), lon), F.when(code.isNotNull(), lat)


def mesh_polygon(c: Column, quadrants: str = "reference") -> Column:
    lon, lat = mesh_corner(c, quadrants)
    point = lambda east, north: F.struct((lon + east / 160.0).alias("lon"), (lat + north / 240.0).alias("lat"))
    return F.when(lon.isNotNull(), F.array(*[point(e, n) for e, n in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]))


def mesh_centroid(c: Column, quadrants: str = "reference") -> tuple[Column, Column]:
    lon, lat = mesh_corner(c, quadrants)
    return lon + 1 / 320.0, lat + 1 / 480.0


def mesh_of_point(lon: Column, lat: Column, quadrants: str = "reference") -> Column:
    """Code of the mesh that holds a point: point-in-mesh as an equality."""
    y, x = lat * 1.5, lon - 100.0
    p, q = F.floor(y), F.floor(x)
    r, s = F.floor((y - p) * 8), F.floor((x - q) * 8)
    t, u = F.floor(((y - p) * 8 - r) * 10), F.floor(((x - q) * 8 - s) * 10)
    north = ((((y - p) * 8 - r) * 10 - t) >= 0.5).cast("int")
    east = ((((x - q) * 8 - s) * 10 - u) >= 0.5).cast("int")
    quadrant = 1 + north + 2 * east if quadrants == "reference" else 1 + 2 * north + east
    return F.concat(*[v.cast("string") for v in (p, q, r, s, t, u, quadrant)])


def tile_address(lon: Column, lat: Column, zoom: int = 12) -> Column:
    """struct<x, y, px, py> of the Web-Mercator tile and pixel."""
    n = float(2**zoom)
    xf = (lon + 180.0) / 360.0 * n
    yf = (1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n
    pixel = lambda v: F.floor((v - F.floor(v)) * 256).cast("int")
    return F.struct(F.floor(xf).cast("int").alias("x"), F.floor(yf).cast("int").alias("y"), pixel(xf).alias("px"), pixel(yf).alias("py"))


def classify_rgb(r: Column, g: Column, b: Column, furthest: int = 900) -> Column:
    """Depth class of the nearest colour, ties to the smaller class; null beyond ``furthest`` squared."""
    near = [
        F.struct(((r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb)).alias("d"), F.lit(k).alias("k")) for k, (cr, cg, cb) in PALETTE.items()
    ]
    best = F.least(*near)
    return F.when(best["d"] <= furthest, best["k"])


def _krueger() -> tuple[float, list[float], list[float]]:
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forth = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, forth, back


def to_utm(lon: Column, lat: Column, zone: int = 53) -> tuple[Column, Column]:
    """(x, y) in metres by Krueger's series to the third order; northern hemisphere."""
    radius, forth, _ = _krueger()
    n = WGS84_F / (2 - WGS84_F)
    c = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = reduce(lambda a, j: a + forth[j - 1] * F.cos(2 * j * xi) * F.sinh(2 * j * eta), (1, 2, 3), eta)
    north = reduce(lambda a, j: a + forth[j - 1] * F.sin(2 * j * xi) * F.cosh(2 * j * eta), (1, 2, 3), xi)
    return UTM_EAST + UTM_SCALE * radius * east, UTM_SCALE * radius * north


def from_utm(x: Column, y: Column, zone: int = 53) -> tuple[Column, Column]:
    """(lon, lat) of a projected point; latitude by three fixed-point steps, good to far below a millimetre."""
    radius, _, back = _krueger()
    xi, eta = y / (UTM_SCALE * radius), (x - UTM_EAST) / (UTM_SCALE * radius)
    north = reduce(lambda a, j: a - back[j - 1] * F.sin(2 * j * xi) * F.cosh(2 * j * eta), (1, 2, 3), xi)
    east = reduce(lambda a, j: a - back[j - 1] * F.cos(2 * j * xi) * F.sinh(2 * j * eta), (1, 2, 3), eta)
    chi = F.asin(F.sin(north) / F.cosh(east))
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    psi, phi = F.asinh(F.tan(chi)), chi
    for _ in range(4):
        phi = F.atan(F.sinh(psi + e * F.atanh(e * F.sin(phi))))
    return F.degrees(F.atan2(F.sinh(east), F.cos(north))) + (6 * zone - 183), F.degrees(phi)


def _sides(ring: Column) -> Column:
    """Of a line or ring: structs of the ends a and b of each part."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / size))).otherwise(0.0)
    return F.sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)


def line_distance(x: Column, y: Column, line: Column) -> Column:
    """Distance to a line or boundary of structs x, y in the same plane."""
    return F.array_min(F.transform(_sides(line), lambda s: segment_distance(x, y, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def in_ring(x: Column, y: Column, ring: Column, edge: float = 1e-12) -> Column:
    """Whether a closed ring of structs x, y covers the point; its boundary counts."""
    crossed = F.filter(
        _sides(ring),
        lambda s: (
            ((s["a"]["y"] > y) != (s["b"]["y"] > y))
            & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) + s["a"]["x"])
        ),
    )
    odd = F.size(crossed) % 2 == 1
    return odd | (line_distance(x, y, ring) <= edge)


def ring_area(ring: Column) -> Column:
    twice = F.aggregate(_sides(ring), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return F.abs(twice) / 2.0


def project_on_line(x: Column, y: Column, line: Column) -> Column:
    """struct<offset, along, rest>: distance to the nearest place of a line, and the lengths along it to there and from there."""
    zero = F.struct(F.lit(float("inf")).alias("offset"), F.lit(0.0).alias("along"), F.lit(0.0).alias("walked"))

    def step(acc: Column, s: Column) -> Column:
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        size = (bx - ax) ** 2 + (by - ay) ** 2
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size))).otherwise(0.0)
        d, length = segment_distance(x, y, ax, ay, bx, by), F.sqrt(size)
        closer = d < acc["offset"]
        return F.struct(
            F.when(closer, d).otherwise(acc["offset"]).alias("offset"),
            F.when(closer, acc["walked"] + t * length).otherwise(acc["along"]).alias("along"),
            (acc["walked"] + length).alias("walked"),
        )

    return F.aggregate(
        _sides(line), zero, step, lambda acc: F.struct(acc["offset"].alias("offset"), acc["along"].alias("along"), (acc["walked"] - acc["along"]).alias("rest"))
    )
