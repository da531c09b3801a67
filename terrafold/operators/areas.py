"""Areas as joins of their sides: parts dissolved to one boundary, rings checked for validity.

Shapes are tables of sides.  Sides that could meet are found by the grid cells they
pass, sides beside a point by the strip it lies in, so that neither all sides of a
shape nor all shapes are compared with each other.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.session import stored, workers_import

#: Coordinates are rounded to so many places, so that parts that share a border share its points.
DIGITS = 9
POINT = "struct<x:double,y:double>"
RINGS = f"place string, ring int, points array<{POINT}>, signed_area double"


def sides(shapes: DataFrame, *keys: str) -> DataFrame:
    """(keys, ring, side, last, ax, ay, bx, by) of (keys, rings): an outer ring and holes, closed or not, of points (x, y).

    Outer rings run counterclockwise and holes clockwise, so what is inside lies on the left; ``last`` is the number of the ring's last side.
    """
    at = lambda p: F.struct(F.round(p["x"], DIGITS).alias("x"), F.round(p["y"], DIGITS).alias("y"))
    each = shapes.select(*keys, F.posexplode("rings").alias("ring", "points")).withColumn("points", F.transform("points", at))
    # A point that repeats the one before it, the closing one included, makes no side.
    new = F.filter("points", lambda p, i: (i == 0) | (p != F.element_at("points", F.greatest(i, F.lit(1)))))
    each = each.withColumn("points", new)
    open_end = F.size("points") > 1
    same = F.element_at("points", 1) == F.element_at("points", -1)
    each = each.where("size(points) > 0").withColumn("points", F.when(open_end & same, F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points")))
    n = F.size("points")
    pairs = F.transform("points", lambda p, i: F.struct(p.alias("a"), F.element_at("points", (i + 1) % n + 1).alias("b")))
    twice = F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    turned = (twice > 0) == (F.col("ring") > 0)
    each = each.withColumn("_turn", turned).select(*keys, "ring", (n - 1).alias("last"), "_turn", F.posexplode(pairs).alias("side", "s"))
    end = lambda one, other, c: F.when(F.col("_turn"), F.col(f"s.{other}.{c}")).otherwise(F.col(f"s.{one}.{c}"))
    return each.select(*keys, "ring", "side", "last", end("a", "b", "x").alias("ax"), end("a", "b", "y").alias("ay"), end("b", "a", "x").alias("bx"), end("b", "a", "y").alias("by"))


def named_parts(features: DataFrame) -> DataFrame:
    """(place, part, rings) for :func:`dissolve` of (code, parts), parts as nested arrays of [x, y]: the form in which documents have them."""
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))
    each = features.select(F.col("code").cast("string").alias("place"), F.posexplode("parts").alias("part", "rings"))
    return each.withColumn("rings", F.transform("rings", points))


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals both: files of whole coordinates take a byte or two a row, by which the planner would send millions of rows, and the cells made of each, through the driver."""
    return df.hint("merge")


def cell_size(rows: DataFrame) -> float:
    """Twice the mean extent of the sides: a cell for the grid in which they are compared.  Runs a job."""
    mean = rows.agg(F.avg(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0]
    return 2 * mean if mean else 1.0


def passed_cells(size: float) -> Column:
    """The cells that a side passes, column by column, so that a long one has as many as its length, not its box, needs."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    slack = size * 1e-6
    low, high = F.least(ax, bx) - slack, F.greatest(ax, bx) + slack
    slope = F.when(ax != bx, (by - ay) / (bx - ax))

    def column(i: Column) -> Column:
        west, east = F.greatest(low, i * size - slack), F.least(high, (i + 1) * size + slack)
        one, other = F.coalesce(ay + (west - ax) * slope, F.least(ay, by)), F.coalesce(ay + (east - ax) * slope, F.greatest(ay, by))
        south = F.greatest(F.least(one, other), F.least(ay, by)) - slack
        north = F.least(F.greatest(one, other), F.greatest(ay, by)) + slack
        rows = F.sequence(F.floor(south / size), F.greatest(F.floor(south / size), F.floor(north / size)))
        return F.transform(rows, lambda j: F.struct(i.alias("i"), j.alias("j")))

    return F.flatten(F.transform(F.sequence(F.floor(low / size), F.floor(high / size)), column))


def meetings(rows: DataFrame, key: str, size: float) -> DataFrame:
    """Pairs of sides (id, key, ax, ay, bx, by) of one key that have a point in common: id, other, kind, x, y.

    ``kind`` is ``cross`` (inside both), ``touch`` (an end of one) or ``overlap`` (parallel, with more
    than a point in common: a row for each end of the common stretch).  Each pair comes once, the smaller id first.
    """
    dealt = rows.select("id", key, "ax", "ay", "bx", "by", F.explode(passed_cells(size)).alias("cell"))
    other = dealt.select(key, "cell", F.col("id").alias("other"), *[F.col(c).alias(d) for c, d in zip(("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy"), strict=True)])
    slack = 10.0**-DIGITS
    apart = [(F.least(a, b) > F.greatest(c, d) + slack) | (F.least(c, d) > F.greatest(a, b) + slack) for a, b, c, d in (("ax", "bx", "cx", "dx"), ("ay", "by", "cy", "dy"))]
    near = dealt.join(_dealt(other), [key, "cell"]).where("id < other").where(~(apart[0] | apart[1])).drop("cell")
    ax, ay, bx, by, cx, cy, dx, dy = (F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"))
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    longer = F.greatest(F.abs(rx), F.abs(ry), F.lit(1e-300)) * F.greatest(F.abs(sx), F.abs(sy), F.lit(1e-300))
    cross, eps = rx * sy - ry * sx, 1e-9
    parallel = F.abs(cross) <= 1e-12 * longer
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    within = lambda p, q, e: (p >= F.least(q, e) - slack) & (p <= F.greatest(q, e) + slack)
    # The box of a side settles most ends, without the distance.
    on = lambda px, py, qx, qy, ex, ey: within(px, qx, ex) & within(py, qy, ey) & (geo.segment_distance(px, py, qx, qy, ex, ey) <= 10.0**-DIGITS / 2)
    ends = {"c": on(cx, cy, ax, ay, bx, by), "d": on(dx, dy, ax, ay, bx, by), "a": on(ax, ay, cx, cy, dx, dy), "b": on(bx, by, cx, cy, dx, dy)}
    t = ((cx - ax) * sy - (cy - ay) * sx) / F.nullif(cross, F.lit(0.0))
    u = ((cx - ax) * ry - (cy - ay) * rx) / F.nullif(cross, F.lit(0.0))
    inner = F.coalesce(~parallel & (t > eps) & (t < 1 - eps) & (u > eps) & (u < 1 - eps), F.lit(False))
    # Plain expressions, which are compiled, each worked out once: a filter before the points would repeat them all in the join.
    met = near.withColumns({f"on_{e}": hit for e, hit in ends.items()} | {"through": F.when(inner, point(F.round(ax + t * rx, DIGITS), F.round(ay + t * ry, DIGITS)))})
    same = lambda e, o: F.col(f"on_{o}") & (F.col(f"{e}x") == F.col(f"{o}x")) & (F.col(f"{e}y") == F.col(f"{o}y"))
    own = {e: F.col(f"on_{e}") for e in "cd"} | {e: F.col(f"on_{e}") & ~same(e, "c") & ~same(e, "d") for e in "ab"}  # an end in common counts once
    n = sum((F.when(hit, 1).otherwise(0) for hit in own.values()), F.lit(0))
    points = [F.when(hit, point(F.col(f"{e}x"), F.col(f"{e}y"))) for e, hit in own.items()]
    kind = F.when(n > 1, "overlap").when(n == 1, "touch").otherwise("cross")
    out = met.select("id", "other", kind.alias("kind"), F.explode(F.array(*points, F.when(n == 0, F.col("through")))).alias("at")).where("at IS NOT NULL")
    return out.select("id", "other", "kind", "at.x", "at.y").distinct()  # a pair meets in each cell that both pass


def _beside(points: DataFrame, rows: DataFrame, key: str, shape: str, size: float) -> DataFrame:
    """(id, shape) of the shapes of one key that hold a point (id, key, x, y) inside, which is on no side of theirs: an odd number of sides to its right."""
    # A shape's sides go to the columns from its west end to their own east end, which are as wide as the shape, so two at
    # most: a point meets the shapes about it, not all of its strip.  Widths are doublings of a cell, asked one by one.
    own = F.greatest(F.lit(0), F.ceil(F.log2((F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx"))) / size))).cast("int")
    wide = stored(rows.groupBy(key, shape).agg(F.min(F.least("ax", "bx")).alias("west"), F.coalesce(own, F.lit(0)).alias("level")), "widths")
    at = lambda x: F.floor(x / (F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))))
    column = F.explode(F.sequence(at(F.col("west")), at(F.greatest("ax", "bx")))).alias("column")
    strips = rows.select(key, F.col(shape), "ax", "ay", "bx", "by", F.explode(F.sequence(F.floor(F.least("ay", "by") / size), F.floor(F.greatest("ay", "by") / size))).alias("strip"))
    strips = strips.join(_dealt(wide), [key, shape]).select(key, F.col(shape), "ax", "ay", "bx", "by", "strip", "level", column)
    levels = wide.select(key, "level").distinct()
    asked = points.join(_dealt(levels), key).withColumn("strip", F.floor(F.col("y") / size)).withColumn("column", at(F.col("x")))
    y, x = F.col("y"), F.col("x")
    right = F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) > x
    hits = asked.join(_dealt(strips), [key, "strip", "level", "column"]).where(((F.col("ay") > y) != (F.col("by") > y)) & right)
    return hits.groupBy("id", shape).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("id", shape)


def dissolve(parts: DataFrame, size: float | None = None) -> DataFrame:
    """The boundary of the union of the parts of each place: (place, ax, ay, bx, by), what is inside on the left.

    ``parts``: place, part (distinct within a place), rings (outer ring and holes of points x, y).  Sides are cut where they
    meet; of the pieces those stay that have the union on one side only, so borders
    that parts share, or that lie within another part, are gone.
    """
    rows = sides(parts.select(F.col("place").cast("string").alias("place"), F.col("part").cast("string").alias("part"), "rings"), "place", "part")
    rows = stored(rows.withColumn("id", F.xxhash64("place", "part", "ring", "side")), "sides")
    size = size or cell_size(rows)
    met = meetings(rows, "place", size)
    cuts = met.select("id", "x", "y").unionByName(met.select(F.col("other").alias("id"), "x", "y"))
    cuts = cuts.groupBy("id").agg(F.collect_set(F.struct("x", "y")).alias("cuts"))
    along = lambda p: (p["x"] - F.col("ax")) * (F.col("bx") - F.col("ax")) + (p["y"] - F.col("ay")) * (F.col("by") - F.col("ay"))
    ends = F.array(*[F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "ab"])
    stops = F.array_sort(F.transform(F.array_union(ends, F.coalesce("cuts", F.array().cast(f"array<{POINT}>"))), lambda p: F.struct(along(p).alias("t"), p.alias("p"))))
    cut = rows.join(_dealt(cuts), "id", "left").withColumn("stops", stops)
    n = F.size("stops")
    pieces = cut.select("place", "part", F.explode(F.zip_with(F.slice("stops", 1, n - 1), F.slice("stops", 2, n - 1), lambda a, b: F.struct(a["p"].alias("a"), b["p"].alias("b")))).alias("e"))
    pieces = pieces.select("place", "part", F.least("e.a", "e.b").alias("lo"), F.greatest("e.a", "e.b").alias("hi"), (F.col("e.a") < F.col("e.b")).alias("ahead"))
    # Each piece once, with the parts that have it as a border on either side.
    owned = pieces.groupBy("place", "lo", "hi").agg(
        F.bool_or("ahead").alias("left"), F.bool_or(~F.col("ahead")).alias("right"), F.collect_set("part").alias("owners"), F.xxhash64("place", "lo", "hi").alias("id")
    )
    owned = stored(owned.where("NOT (left AND right)"), "pieces")
    middle = owned.select("id", "place", ((F.col("lo.x") + F.col("hi.x")) / 2).alias("x"), ((F.col("lo.y") + F.col("hi.y")) / 2).alias("y"))
    within = _beside(middle, rows, "place", "part", size)
    # What another part covers has the union on both sides.
    covered = within.join(_dealt(owned.select("id", "owners")), "id").where(~F.array_contains("owners", F.col("part"))).select("id").distinct()
    left = owned.join(_dealt(covered), "id", "left_anti")
    start, end = (F.when(F.col("left"), F.col(a)).otherwise(F.col(b)) for a, b in (("lo", "hi"), ("hi", "lo")))
    return left.select("place", start.alias("a"), end.alias("b")).select("place", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def boundary_measures(boundary: DataFrame) -> DataFrame:
    """(place, area, perimeter) of a dissolved boundary."""
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    return boundary.groupBy("place").agg((F.sum(cross) / 2).alias("area"), F.sum(length).alias("perimeter"))


def _turn(before: tuple[float, float], after: tuple[float, float]) -> float:
    """Angle to the left from one direction to the next, more than -pi, pi at most."""
    return math.atan2(before[0] * after[1] - before[1] * after[0], before[0] * after[0] + before[1] * after[1])


def _walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    out: dict[tuple, list[tuple]] = {}
    for ax, ay, bx, by in sorted(rows[["ax", "ay", "bx", "by"]].itertuples(index=False, name=None), reverse=True):
        out.setdefault((ax, ay), []).append((bx, by))
    found = []
    while out:
        start = min(out)
        ring, at, before = [start], start, None
        while True:
            choice = out[at]
            # Where rings touch, the way is the leftmost one, which stays with the same part of the inside.
            best = choice[-1] if before is None else max(choice, key=lambda p: _turn(before, (p[0] - at[0], p[1] - at[1])))
            choice.remove(best)
            if not choice:
                del out[at]
            before, at = (best[0] - at[0], best[1] - at[1]), best
            ring.append(at)
            if at == start:
                break
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring[:-1], ring[1:], strict=True)) / 2
        found.append((key[0], len(found), [{"x": x, "y": y} for x, y in ring], area))
    return pd.DataFrame(found, columns=["place", "ring", "points", "signed_area"])


def rings(boundary: DataFrame) -> DataFrame:
    """(place, ring, points, signed_area): the boundary walked to closed rings; holes have an area below zero.  A place's boundary is one group."""
    workers_import(boundary.sparkSession)
    return boundary.groupBy("place").applyInPandas(_walk, RINGS)


def boundary_distance(points: DataFrame, boundary: DataFrame, reach: float, rounds: int = 40) -> DataFrame:
    """(point_id, place, distance) of points (point_id, place, x, y) to the boundary of their place, inner borders not counted.

    A point looks at the cells within ``reach``; those that find nothing so near look
    twice as far, and so on.  Places without a boundary give no row.
    """
    place = F.col("place").cast("string").alias("place")
    boundary = stored(boundary, "boundary")  # each round reads it
    left = stored(points.select("point_id", place, "x", "y").join(_dealt(boundary.select("place").distinct()), "place", "left_semi"), "asking")
    found = None
    for _ in range(rounds):
        span = lambda c: F.sequence(F.floor((F.col(c) - reach) / reach), F.floor((F.col(c) + reach) / reach))  # noqa: E731, B023
        cells = F.flatten(F.transform(span("x"), lambda i: F.transform(span("y"), lambda j: F.struct(i.alias("i"), j.alias("j")))))  # noqa: B023
        there = boundary.withColumn("cell", F.explode(passed_cells(reach)))
        d = geo.segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
        near = left.withColumn("cell", F.explode(cells)).join(_dealt(there), ["place", "cell"]).groupBy("point_id", "place").agg(F.min(d).alias("distance")).where(F.col("distance") <= reach)
        near = stored(near, "near")
        found = near if found is None else found.unionByName(near)
        left = stored(left.join(_dealt(near), ["point_id", "place"], "left_anti"), "asking")
        if left.isEmpty():
            return found
        reach *= 2
    raise RuntimeError(f"points are further than {reach} from their boundary")


def ring_faults(shapes: DataFrame, size: float | None = None) -> DataFrame:
    """(shape, fault) of shapes (shape, rings) that are no valid polygons; shapes without a fault have no row.

    ``no_ring``, ``open_ring`` (ends where it doesn't begin), ``few_points`` (no three corners), ``crossing`` (sides of a ring that meet
    elsewhere than in their common corner, or fold back on each other), ``rings_cross`` (sides of two rings cross or overlap;
    to touch in a point is allowed), ``hole_outside`` (a hole that the outer ring doesn't hold) and ``hole_in_hole``.
    """
    named = shapes.select("shape", "rings")
    rows = stored(sides(named, "shape").withColumn("id", F.xxhash64("shape", "ring", "side")), "sides")
    size = size or cell_size(rows)
    each = named.select("shape", F.explode("rings").alias("points"))
    closed = F.element_at("points", 1) == F.element_at("points", -1)
    none = named.where("rings IS NULL OR size(rings) = 0").select("shape", F.lit("no_ring").alias("fault"))
    opened = each.where((F.size("points") > 0) & ~closed).select("shape", F.lit("open_ring").alias("fault"))
    corners = F.size(F.array_distinct(F.transform("points", lambda p: F.struct(F.round(p["x"], DIGITS), F.round(p["y"], DIGITS)))))
    few = each.where(F.col("points").isNull() | (corners < 3)).select("shape", F.lit("few_points").alias("fault"))

    met = meetings(rows, "shape", size)
    mine = rows.select("id", "shape", "ring", "side", "last", "ax", "ay", "bx", "by")
    pairs = met.join(_dealt(mine), "id").join(_dealt(mine.select(F.col("id").alias("other"), F.col("ring").alias("ring2"), F.col("side").alias("side2"))), "other")
    apart = F.abs(F.col("side") - F.col("side2"))
    neighbours = (apart == 1) | (apart == F.col("last"))
    bad = (F.col("kind") != "touch") | ~neighbours
    crossing = pairs.where((F.col("ring") == F.col("ring2")) & bad & (F.col("last") > 1)).select("shape", F.lit("crossing").alias("fault"))
    overlaps = pairs.where((F.col("ring") != F.col("ring2")) & (F.col("kind") != "touch")).select("shape", F.lit("rings_cross").alias("fault"))

    # With rings that don't cross, any point of a hole that lies on no other ring tells where it is.
    on_others = met.select("id", "x", "y").unionByName(met.select(F.col("other").alias("id"), "x", "y")).distinct()
    holes = rows.where("ring > 0").select("id", "shape", "ring", "side", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    free = holes.join(_dealt(on_others), ["id", "x", "y"], "left_anti")
    one = Window.partitionBy("shape", "ring").orderBy("side")
    asked = stored(free.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "side"), "holes")
    numbered = rows.withColumn("inside_of", F.col("ring"))
    within = _beside(asked.select("id", "shape", "x", "y"), numbered, "shape", "inside_of", size).join(_dealt(asked.select("id", "shape", "ring")), "id")
    inside = within.where("inside_of = 0").select("id")
    outside = asked.join(_dealt(inside), "id", "left_anti").select("shape", F.lit("hole_outside").alias("fault"))
    nested = within.where("inside_of > 0 AND inside_of <> ring").select("shape", F.lit("hole_in_hole").alias("fault"))
    out = none
    for more in (opened, few, crossing, overlaps, outside, nested):
        out = out.unionByName(more)
    return out.distinct()
