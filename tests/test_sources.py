import io
import json
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from terrafold.operators.gates import Gate, evaluate, require_columns, subset_diff
from terrafold.sources import files


def test_keys_keep_leading_zeros_and_bom(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("﻿code,n\n01201,3\n", encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path), "code string, n int", recursive=True, pattern="*.csv", source_col="src")
    row = df.first()
    assert (row.code, row.n) == ("01201", 3) and row.src.endswith("x.csv")


def test_zipped(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("t.csv", "KEY,人口\n012345678,*\n".encode("cp932"))
    (tmp_path / "t.zip").write_bytes(data.getvalue())
    assert [tuple(r) for r in files.read_zipped_csv(spark, str(tmp_path / "t.zip"), ["KEY", "人口"]).collect()] == [("012345678", "*")]


def test_shards_index_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("01", 1), ("01", 2), ("02", 3)], "code string, v int")
    index = files.write_shards(df, str(tmp_path / "s"), "code")
    assert sorted(r.feature_count for r in index.collect()) == [1, 2]
    assert files.read_shards(spark, str(tmp_path / "s"), "code string, v int", "code").count() == 3
    before = files.file_manifest(spark, str(tmp_path / "s" / "shards")).cache()
    assert before.count() >= 2
    assert files.manifest_diff(before, before).count() == 0


def test_features_and_graphml(spark, tmp_path):
    ring = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"N03_007": "38201"}, "geometry": {"type": t, "coordinates": c}} for t, c in (("Polygon", ring), ("MultiPolygon", [ring, ring]))]}
    (tmp_path / "b.json").write_text(json.dumps(doc))
    row = files.read_feature_collection(spark, str(tmp_path / "b.json"), "N03_007").first()
    assert row.code == "38201" and len(row.parts) == 3
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="1"><data key="x">2.5</data></node><node id="2"><data key="x">3</data></node><edge source="1" target="2"><data key="length">7.0</data></edge></graph></graphml>')
    nodes, edges = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert nodes.count() == 2 and edges.first().data == {"length": "7.0"}


def test_gates(spark):
    df = spark.range(10)
    got = {r.gate: r for r in evaluate([Gate("none", df, df["id"] > 99), Gate("some", df, df["id"] > 7), Gate("rows", df.where("id > 5"))]).collect()}
    assert got["none"].passed and got["some"].failures == 2 and not got["rows"].passed
    with pytest.raises(ValueError, match="lacks columns: b"):
        require_columns(df, ["id", "b"])
    assert subset_diff({"a": {"b": 1.0}}, {"a": {"b": 1.0000001, "c": 2}}) == []
    assert subset_diff({"a": [1, 2], "d": True}, {"a": [1, 3], "d": 1}) == ["$.a[1]: 2 != 3", "$.d: True != 1"]


def test_read_many(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "r1.csv").write_text("\ufeffcode,n\n01201,3\n", encoding="utf-8")
    (tmp_path / "r2.csv").write_text("n,code,other\n4,00001,x\n")
    (tmp_path / "r3.csv").write_text("code\n00002\n")
    (tmp_path / "r4.csv").write_text("")
    df = files.read_many(spark, str(tmp_path), "r*.csv", "code string, n int")
    assert sorted((r.code, r.n) for r in df.collect()) == [("00001", 4), ("00002", None), ("01201", 3)]
    assert df.columns == ["code", "n", "_source_file"]
    with pytest.raises(FileNotFoundError):
        files.read_many(spark, str(tmp_path), "z*.csv", "code string")


def test_prefecture_rows(spark):
    names = ["common_id", "name", "address_pref", "address_city", "address_detail"]
    raw = spark.createDataFrame([(i, f" {i} ", None if i == 5 else "n", "p", None, "d") for i in range(7)], "place int, _0 string, _1 string, _2 string, _3 string, _4 string")
    rows = files.prefecture_rows(raw, names, "place").orderBy("place").collect()
    assert [(r.common_id, r.address) for r in rows] == [("4", "pd"), ("6", "pd")]


def test_csv_with_mark(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("01", 1)], "code string, n int").coalesce(1), str(tmp_path / "c"), bom=True)
    (part,) = (tmp_path / "c").glob("*.csv")
    assert part.read_bytes().startswith("\ufeffcode,n".encode())


def test_features_refuse_what_is_not_finite(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1, 2.0), ("a", 0, None), ("b", 2, 1.0)], "code string, place int, v double")
    geometry, properties = F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")), F.struct("v")
    docs = {r.code: json.loads(r.document) for r in files.feature_collections(df, "code", "place", geometry, properties).collect()}
    assert docs["a"]["type"] == "FeatureCollection" and [f["properties"] for f in docs["a"]["features"]] == [{}, {"v": 2.0}]
    for bad in ("NaN", "Infinity"):
        with pytest.raises(Exception, match="not finite"):
            files.features(df.withColumn("v", F.lit(float(bad))), geometry, properties).collect()


def test_shards_need_every_key(spark, tmp_path):
    df = spark.createDataFrame([("01", 1), ("02", 3)], "code string, v int")
    assert [r.code for r in files.write_shards(df, str(tmp_path / "s"), "code", ["02", "01"]).orderBy("place").collect()] == ["02", "01"]
    for order in (["01"], ["01", "02", "03"]):
        with pytest.raises(ValueError, match="no public rows"):
            files.write_shards(df, str(tmp_path / "t"), "code", order)
    assert not (tmp_path / "t").exists()


def test_scenarios_are_refused(spark, tmp_path):
    tables = {"x": spark.range(3)}
    for gate, sha in (("FAIL", "s"), ("PASS", "other")):
        with pytest.raises(ValueError):
            files.export_scenarios(tables, str(tmp_path / "o"), "s", {"step8": ("PASS", "s"), "step9": (gate, sha)})
    assert not (tmp_path / "o").exists()
    files.export_scenarios(tables, str(tmp_path / "o"), "s", {"step8": ("PASS", "s"), "step9": ("PASS", "s")})
    assert spark.read.json(str(tmp_path / "o" / "x")).count() == 3


def test_tiles(spark):
    wanted = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1)], "x int, y int")

    def get(x, y):
        if x == 3:
            raise OSError("no network")
        return (404, None) if x == 2 else (200, b"tile")

    fetched = files.fetch_tiles(wanted, get)
    assert sorted((r.x, r.code, r.content) for r in fetched.collect()) == [(1, 200, bytearray(b"tile")), (2, 404, None), (3, -1, None)]
    stored = files.tile_store(wanted.where("x < 3"), fetched)
    assert sorted((r.x, r.status) for r in stored.collect()) == [(1, "present"), (2, "absent")]
    with pytest.raises(Exception, match="was not fetched"):
        files.tile_store(wanted, fetched).collect()


def test_stream_drives_a_batch_function(spark, tmp_path):
    from terrafold.streaming import rerun

    source, seen = str(tmp_path / "in"), []
    for n in (3, 4):  # the second time only what is new
        spark.range(n).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        assert rerun(stream, lambda df: seen.append(df.count()), str(tmp_path / "at")).awaitTermination(120)
        assert seen[-1] == n


def _image(content):
    """A tile's bytes are its height and width, then its pixels."""
    if not content:
        return None
    h, w = content[0], content[1]
    return np.frombuffer(content[2:], np.uint8).reshape(h, w, 4)


def test_pixels_of_many_tiles_come_together(spark, monkeypatch):
    rng = random.Random(4)
    tiles = []
    for i in range(300):
        h, w = rng.choice([(1, 1), (2, 4), (3, 2), (0, 2)])
        tiles.append((i, i % 7, None if i % 11 == 0 else b"" if i % 13 == 0 else bytes([h, w, *(rng.randrange(256) for _ in range(h * w * 4))])))
    want = set()
    for x, y, content in tiles:
        image = _image(content) if content is not None else None
        if image is not None:
            want |= {(x, y, px, py, *map(int, image[py, px])) for py in range(image.shape[0]) for px in range(image.shape[1])}
    given = spark.createDataFrame(tiles, "x int, y int, content binary").repartition(3)
    got = [tuple(r) for r in files.tile_pixels(given, _image).collect()]
    assert len(got) == len(want) and set(got) == want

    class Tiles:
        """What goes into the workers, given to the worker's function here."""

        select = lambda self, *_: self
        mapInPandas = lambda self, run, _: [len(p) for p in run([batch.to_pandas()])]
        mapInArrow = lambda self, run, _: [p.num_rows for p in run([batch])]

    batch = pa.RecordBatch.from_pylist([{"x": x, "y": y, "content": c} for x, y, c in tiles], pa.schema([("x", pa.int32()), ("y", pa.int32()), ("content", pa.binary())]))
    assert files.tile_pixels(Tiles(), _image) == [len(want)]  # not a frame for each tile
    monkeypatch.setattr(files, "PIXELS_AT_ONCE", 100)
    parts = files.tile_pixels(Tiles(), _image)
    assert sum(parts) == len(want) and max(parts) < 108 and len(parts) > 5
