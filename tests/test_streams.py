"""Streaming readers: what they read, and how little they hold."""

import json
import random
import tracemalloc
import zipfile

import pytest

from terrafold.operators import areas
from terrafold.sources import streams


def test_elements_of_an_array_in_any_chunks():
    doc = {"type": "x", "crs": {"features": [9]}, "features": [{"a": "]}\"\\"}, 1, [2, [3]], "é\n", None, {}, 12345], "after": [1, {"features": [7]}]}
    for text in (json.dumps(doc), json.dumps(doc, indent=2, ensure_ascii=False), json.dumps({"features": []}), json.dumps({"b": 1}), "{}", ' { "features" : [ 1 , 2 ] } '):
        for size in (1, 2, 7, 10_000):
            chunks = iter([text[i : i + size] for i in range(0, len(text), size)])
            assert list(streams.json_elements(chunks, "features")) == json.loads(text).get("features", [])
    for broken in ('{"features": [1, 2', '{"features": [1}', "[1]", '{"a" 1}'):
        with pytest.raises(json.JSONDecodeError):
            list(streams.json_elements(iter([broken]), "features"))


def test_formats(spark, tmp_path):
    streams.register(spark)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "id,名,x\r\n01,松山,\"1,5\"\r\n02,\"a\r\nb\",\r\n\r\n".encode("cp932"))
        z.writestr("TWO.CSV", "x,id\n7,03\n8\n".encode("cp932"))
        z.writestr("read.me", "no")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("empty.csv", "")
    df = spark.read.format("zipped_csv").option("columns", "id,名,x").load(f"{tmp_path}/*.zip")
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted([("01", "松山", "1,5"), ("02", "a\r\nb", ""), ("03", None, "7"), (None, None, "8")], key=str)
    assert df.rdd.getNumPartitions() == 3

    square = lambda x: [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"code": "38201", "n": 2, "no": None}, "geometry": {"type": "Polygon", "coordinates": square(0)}},
        {"type": "Feature", "properties": {"code": "38201"}, "geometry": {"type": "MultiPolygon", "coordinates": [square(1), square(5)]}},
        {"type": "Feature", "properties": None, "geometry": None}]}
    (tmp_path / "m.geojson").write_text(json.dumps(doc), encoding="utf-8-sig")
    rows = spark.read.format("geojson_features").load(f"file://{tmp_path}/m.geojson").orderBy("place").collect()
    assert [(r.place, r.type, r.properties) for r in rows] == [(0, "Polygon", {"code": "38201", "n": "2", "no": None}), (1, "MultiPolygon", {"code": "38201"}), (2, None, {})]
    assert json.loads(rows[1].coordinates) == [square(1), square(5)]

    (tmp_path / "g.graphml").write_text(
        '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" attr.name="x" for="node"/><key id="d1" for="edge"/>'
        '<graph edgedefault="directed"><node id="1"><data key="d0">132.7</data></node><node id="2"/><edge source="1" target="2"><data key="d1">9</data></edge></graph></graphml>'
    )
    read = spark.read.format("graphml")
    assert [tuple(r) for r in read.load(f"{tmp_path}/g.graphml").collect()] == [("1", {"x": "132.7"}), ("2", {})]
    assert [tuple(r) for r in read.option("element", "edge").load(f"{tmp_path}/g.graphml").collect()] == [("1", "2", {"d1": "9"})]
    with pytest.raises(Exception, match="nowhere"):
        read.load(f"{tmp_path}/nowhere").collect()


def test_features_dissolve_to_places(spark, tmp_path):
    """Touching features of one code, read and dissolved: the border between them is gone."""
    streams.register(spark)
    feature = lambda x: {"type": "Feature", "properties": {"code": "38201"}, "geometry": {"type": "Polygon", "coordinates": [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]}}
    (tmp_path / "f.geojson").write_text(json.dumps({"features": [feature(0), feature(1)]}))
    rows = spark.read.format("geojson_features").load(f"{tmp_path}/f.geojson")
    parts = rows.selectExpr("properties['code'] AS code", "array(from_json(coordinates, 'array<array<array<double>>>')) AS parts").groupBy("code").agg({"parts": "collect_list"}).toDF("code", "p").selectExpr("code", "flatten(p) AS parts")
    m = areas.boundary_measures(areas.dissolve(areas.named_parts(parts))).first()
    assert (m.place, m.area, m.perimeter) == ("38201", pytest.approx(2), pytest.approx(6))


def peak(reader, piece):
    tracemalloc.start()
    rows = sum(b.num_rows for b in reader.read(piece))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, most


def test_files_larger_than_what_is_held(tmp_path):
    rng, n = random.Random(1), 120_000
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("one.csv", "w") as f:
        f.write(b"id,text\n")
        for i in range(n):
            f.write(f"{i},{'word ' * 60}{rng.random()}\n".encode())
    with (tmp_path / "f.geojson").open("w") as f:
        f.write('{"features":[')
        for i in range(n // 8):
            f.write(("," if i else "") + json.dumps({"properties": {"i": i}, "geometry": {"type": "Point", "coordinates": [[rng.random()] * 2] * 60}}))
        f.write("]}")
    with (tmp_path / "g.graphml").open("w") as f:
        f.write("<graphml><graph>" + "".join(f'<node id="{i}"><data key="t">{"x" * 200}</data></node>' for i in range(n)) + "</graph></graphml>")
    schema = type("S", (), {"fieldNames": lambda self: ["id", "text"]})()
    for reader, name, member, rows in ((streams.ZippedCsvReader, "a.zip", "one.csv", n), (streams.FeatureReader, "f.geojson", "", n // 8), (streams.GraphReader, "g.graphml", "", n)):
        got, most = peak(reader({"path": str(tmp_path / name)}, schema), streams.Piece(str(tmp_path / name), member))
        assert got == rows and most < 20 << 20, (name, most)


def test_written_features_are_read_again(spark, tmp_path):
    """One feature a line, as JSON text."""
    from pyspark.sql import functions as F

    from terrafold.sources import files

    df = spark.createDataFrame([(1, 132.5, 33.25), (2, 0.0, -1.0)], "id int, x double, y double")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    files.write_features(df, f"{tmp_path}/lines", geometry, F.struct("id"))
    rows = sorted((json.loads(r.value) for r in spark.read.text(f"{tmp_path}/lines").collect()), key=lambda f: f["properties"]["id"])
    assert rows[0] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [132.5, 33.25]}, "properties": {"id": 1}} and len(rows) == 2
    with pytest.raises(Exception, match="not finite"):
        files.write_features(df.withColumn("x", F.lit(float("nan"))), f"{tmp_path}/bad", geometry, F.struct("id"))
