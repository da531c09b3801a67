"""Dissolved areas and ring faults against cells, sorted sides and known shapes."""

import random

import pytest

from terrafold.operators import areas

RING = "array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x, y, w=1.0, h=1.0, back=False):
    points = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return ring(*(points[::-1] if back else points))


def parts(spark, rows):
    return spark.createDataFrame(rows, f"place string, part int, rings {RING}")


def cells_of(boxes):
    return {(i, j) for x, y, w, h in boxes for i in range(x, x + w) for j in range(y, y + h)}


def pieces(cells, corners):
    left, n = set(cells), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            i, j = todo.pop()
            near = {(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))} & left
            left -= near
            todo += near
    return n


@pytest.mark.parametrize("seed", range(3))
def test_union_of_boxes_is_that_of_their_cells(spark, seed):
    rng = random.Random(seed)
    rows, boxes = [], {}
    for place in "abc":
        boxes[place] = [(rng.randrange(9), rng.randrange(9), rng.randint(1, 4), rng.randint(1, 4)) for _ in range(8)]
        rows += [(place, i, [box(*b, back=rng.random() < 0.5)]) for i, b in enumerate(boxes[place])]
    boundary = areas.dissolve(parts(spark, rows), size=rng.choice([0.7, 2.0, 50.0])).cache()
    got = {r.place: r for r in areas.boundary_measures(boundary).collect()}
    walked = areas.rings(boundary).collect()
    for place, own in boxes.items():
        cells = cells_of(own)
        sides = sum((i + a, j + b) not in cells for i, j in cells for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert (got[place].area, got[place].perimeter) == (pytest.approx(len(cells)), pytest.approx(sides))
        rest = {(i, j) for i in range(-1, 15) for j in range(-1, 15)} - cells
        mine = [r for r in walked if r.place == place]
        assert sum(r.signed_area > 0 for r in mine) == pieces(cells, False) and sum(r.signed_area < 0 for r in mine) == pieces(rest, True) - 1
        assert sum(r.signed_area for r in mine) == pytest.approx(len(cells)) and all(r.points[0] == r.points[-1] for r in mine)


def test_union_of_slanting_parts(spark):
    a, b = ring((0, 0), (4, 0), (2, 3), (0, 0)), ring((2, 1), (6, 1), (4, 4), (2, 1))  # their sides cross in two places
    hole = [box(0, 0, 10, 10), box(2, 2, 6, 6)]
    rows = [("t", 1, [a]), ("t", 2, [b]), ("h", 1, hole), ("h", 2, [box(3, 3, 2, 2)]), ("h", 3, [box(7, 7, 4, 1)]), ("same", 1, [box(0, 0)]), ("same", 2, [box(0, 0, back=True)]), ("dry", 1, [ring((0, 0), (1, 1), (0, 0))])]
    boundary = areas.dissolve(parts(spark, rows)).cache()
    area = {r.place: r.area for r in areas.boundary_measures(boundary).collect()}
    assert area == {"t": pytest.approx(6 + 6 - 2 / 3), "h": pytest.approx(64 + 4 + 1 + 1), "same": pytest.approx(1)}
    found = areas.rings(boundary).collect()
    assert sorted((r.place, r.signed_area > 0) for r in found) == [("h", False), ("h", True), ("h", True), ("same", True), ("t", True)]
    points = spark.createDataFrame([(1, "h", 5.0, -7.0), (2, "h", 4.0, 4.0), (3, "t", 3.0, 1.2), (4, "none", 0.0, 0.0), (5, "same", 90.0, 0.5)], "point_id int, place string, x double, y double")
    far = {r.point_id: r.distance for r in areas.boundary_distance(points, boundary, 0.5).collect()}
    # Of the two triangles' borders within each other none counts: the nearest place is the corner where the outer ones meet.
    assert far == {1: pytest.approx(7), 2: pytest.approx(1), 3: pytest.approx(((3 - 10 / 3) ** 2 + 0.2**2) ** 0.5), 5: pytest.approx(89)}


FAULTS = [
    ([box(0, 0)], set()), ([box(0, 0, back=True)], set()), (None, {"no_ring"}), ([], {"no_ring"}),
    ([ring((0, 0), (1, 0), (1, 1))], {"open_ring"}), ([ring((0, 0), (1, 0), (0, 0))], {"few_points"}), ([[]], {"few_points"}),
    ([ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))], {"crossing"}), ([ring((0, 0), (4, 0), (4, 4), (4, 0), (0, 4), (0, 0))], {"crossing"}),
    ([ring((0, 0), (4, 0), (6, 0), (4, 0), (4, 4), (0, 0))], {"crossing"}), ([ring((0, 0), (2, 0), (4, 0), (4, 4), (0, 4), (2, 0), (0, 0))], {"crossing"}),
    ([box(0, 0, 9, 9), box(1, 1, 2, 2), box(4, 4, 2, 2)], set()), ([box(0, 0, 9, 9), ring((0, 0), (2, 1), (1, 2), (0, 0))], set()),
    ([box(0, 0, 9, 9), box(8, 8, 2, 2)], {"rings_cross", "hole_outside"}), ([box(0, 0, 9, 9), box(20, 1, 2, 2)], {"hole_outside"}),
    ([box(0, 0, 9, 9), box(1, 1, 5, 5), box(2, 2, 1, 1)], {"hole_in_hole"}), ([box(0, 0, 9, 9), box(0, 1, 2, 2)], {"rings_cross"}),
    ([ring((0, 0), (0, 0), (3, 0), (3, 3), (3, 3), (0, 0))], set()),
]


def test_faults_of_known_shapes(spark):
    shapes = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(FAULTS)], f"shape int, rings {RING}")
    for size in (None, 0.6, 100.0):
        found = {i: set() for i in range(len(FAULTS))}
        for r in areas.ring_faults(shapes, size).collect():
            found[r.shape].add(r.fault)
        for i, (r, want) in enumerate(FAULTS):
            assert found[i] == want or want == {"rings_cross", "hole_outside"} and "rings_cross" in found[i], (i, r, found[i])
    assert areas.ring_faults(shapes.limit(0)).count() == 0 and areas.dissolve(parts(spark, [])).count() == 0


def test_boxes_in_a_row_meet_their_neighbours_only(spark, monkeypatch):
    kept = {}
    real = areas.stored
    monkeypatch.setattr(areas, "stored", lambda df, name: kept.setdefault(name, real(df, name)))
    box = lambda x: [[(x, 0.0), (x + 1, 0.0), (x + 1, 2.0), (x, 2.0), (x, 0.0)]]
    rows = spark.createDataFrame([("a", str(i), box(float(i))) for i in range(300)], "place string, part string, rings array<array<struct<x:double,y:double>>>")
    m = areas.boundary_measures(areas.dissolve(rows)).first()
    assert (round(m.area, 6), round(m.perimeter, 6)) == (600.0, 604.0)
    # Each box is searched in columns no wider than a few boxes, not in its whole strip.
    assert [r.level for r in kept["widths"].select("level").distinct().collect()] == [0]


def test_no_table_of_sides_or_points_goes_through_the_driver(spark, monkeypatch):
    plans = []
    stored = areas.stored

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, name)

    monkeypatch.setattr(areas, "stored", noted)
    box = lambda x, y: [[(x, y), (x + 2.0, y), (x + 2.0, y + 2.0), (x, y + 2.0), (x, y)]]
    parts = spark.createDataFrame([("p", str(i), box(float(i), 0.0)) for i in range(4)], "place string, part string, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(i, "p", i + 0.5, 0.75) for i in range(4)], "point_id int, place string, x double, y double")
    boundary = areas.dissolve(parts)
    near = areas.boundary_distance(points, boundary, 0.1)  # needs several rounds
    assert {r.point_id: round(r.distance, 9) for r in near.collect()} == {0: 0.5, 1: 0.75, 2: 0.75, 3: 0.75}
    # Files of a few bytes a row would be sent, whatever they hold.
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    assert {"sides", "pieces", "boundary", "asking", "near"} <= {n for n, _ in plans}
    assert [n for n, p in plans if "Broadcast" in p] == []
