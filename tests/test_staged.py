"""Staged exports, the tile cache and nested comparison."""

import json

import pytest
from pyspark.sql import functions as F

from terrafold.operators import nested
from terrafold.operators.gates import Gate, subset_diff
from terrafold.sources import staged

ROWS = "city string, mesh_id int, score double"


def rows(spark, n, extra=()):
    return spark.createDataFrame([("ab"[i % 2], i, float(i)) for i in range(n)] + list(extra), ROWS)


def no_minus(df):
    return [Gate("score_not_negative", df, F.col("score") < 0)]


def test_an_export_appears_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/public"
    assert staged.current_export(spark, root) is None
    with pytest.raises(FileNotFoundError):
        staged.read_export(spark, root, ROWS, "city")
    first = staged.staged_export(rows(spark, 6), root, "city", ["b", "a"], no_minus, {"source": "v1"})
    assert staged.current_export(spark, root) == first and staged.read_export(spark, root, ROWS, "city").count() == 6
    index = [(r.city, r.feature_count, r.place) for r in spark.read.json(f"{first}/index").orderBy("place").collect()]
    assert index == [("b", 3, 0), ("a", 3, 1)]
    assert json.loads(spark.read.text(f"{first}/facts").first().value) == {"rows": 6, "source": "v1"}

    # A gate that fails, keys that have no place, a run that ends before the pointer moves: the first export stays.
    with pytest.raises(ValueError, match="score_not_negative: 1"):
        staged.staged_export(rows(spark, 6, [("a", 9, -1.0)]), root, "city", ["b", "a"], no_minus)
    with pytest.raises(ValueError, match="no public rows for"):
        staged.staged_export(rows(spark, 6, [("c", 9, 1.0)]), root, "city", ["b", "a"], no_minus)

    def broken(df):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        staged.staged_export(rows(spark, 8), root, "city", ["b", "a"], broken)
    assert staged.current_export(spark, root) == first and staged.read_export(spark, root, ROWS, "city").count() == 6

    second = staged.staged_export(rows(spark, 8), root, "city", ["a", "b"], no_minus)
    assert second != first and staged.read_export(spark, root, ROWS, "city").count() == 8
    assert staged.changed_files(spark, second).count() == 0
    gone = staged.drop_old_exports(spark, root)
    assert len(gone) >= 3 and staged.read_export(spark, root, ROWS, "city").count() == 8 and not (tmp_path / "public" / first.rsplit("/", 1)[1]).exists()
    shard = next((tmp_path / "public").glob("export-*/shards/city=a/*.json"))
    (shard.parent / f".{shard.name}.crc").unlink()
    shard.write_text(shard.read_text() + "\n")
    assert [r.change for r in staged.changed_files(spark, second).collect()] == ["changed"]


def test_tiles_are_asked_for_once(spark, tmp_path):
    cache, log = f"file://{tmp_path}/tiles", tmp_path / "asked"
    log.mkdir()

    def get(x, y):
        (log / f"{x}-{y}").open("a").write(".")
        if x == 9:
            raise OSError("down")
        return (404, b"") if x == 3 else (500, b"") if x == 8 else (200, f"{x}/{y}".encode())

    asked = lambda: {p.name: len(p.read_text()) for p in log.iterdir()}
    want = lambda *keys: spark.createDataFrame(list(keys), "x int, y int")
    read = lambda df: {(r.x, r.y): (r.status, r.content and bytes(r.content)) for r in df.collect()}
    first = {(1, 1): ("present", b"1/1"), (3, 1): ("missing", None)}
    assert read(staged.cached_tiles(want((1, 1), (3, 1), (1, 1)), cache, 12, get)) == first and asked() == {"1-1": 1, "3-1": 1}
    assert read(staged.cached_tiles(want((1, 1), (3, 1)), cache, 12, get)) == first and asked() == {"1-1": 1, "3-1": 1}
    assert read(staged.cached_tiles(want((1, 1), (2, 2)), cache, 12, get)) == {(1, 1): ("present", b"1/1"), (2, 2): ("present", b"2/2")}
    for bad, times in (((8, 1), 1), ((9, 1), 3)):
        with pytest.raises(OSError, match=f"{bad[0]}/{bad[1]}"):
            staged.cached_tiles(want(bad, (5, 5 + bad[0])), cache, 12, get)
        assert asked()[f"{bad[0]}-{bad[1]}"] == times
    before = asked()
    assert (5, 13) in read(staged.cached_tiles(want((5, 13)), cache, 12, get)) and asked() == before  # what came beside a failure is kept
    staged.cached_tiles(want((1, 1)), cache, 13, get)
    assert asked()["1-1"] == 2  # another zoom is another tile
    assert staged.cached_tiles(want((1, 1)).where("false"), cache, 12, get).count() == 0


EXPECTED = {"a": 1, "b": {"c": [1, 2, {"d": "x"}], "e": None, "t": True}, "n": 1.0000001, "s": "1", "gone": {"x": {"y": 1}}, "k": {"z": [1]}, "l": [1, 2, 3], "big": 1e15, "o": {}, "f": [], "a.b": 1}
ACTUAL = {"a": 1.0, "b": {"c": [1, 2, {"d": "y"}], "e": None, "t": False, "more": 3}, "n": 1.0000002, "s": 1, "k": 5, "l": [1, 2], "big": 1e15 + 2000, "o": {"p": 1}, "f": {}, "a.b": 2}


def test_nested_documents_differ_as_on_the_driver(spark):
    docs = [(1, EXPECTED, ACTUAL), (2, EXPECTED, EXPECTED), (3, [1, [2, [3]]], [1, [2, [4]]]), (4, None, None), (5, 5, 5.0000001)]
    frame = lambda i: spark.createDataFrame([(d[0], json.dumps(d[i])) for d in docs] + [(9, "7")] * (i == 1), "doc int, body string")
    got = {(r.doc, r.path): r.problem for r in nested.differences(frame(1), frame(2), depth=5).collect()}
    want = {(d, line.split(": ")[0]) for d, a, b in docs for line in subset_diff(a, b)} | {(9, "$")}
    assert set(got) == want and got[9, "$"] == "missing" and got[1, "$.l"] == "length" and got[1, "$.k"] == "kind" and got[1, "$.a.b"] == "value"
    assert nested.differences(frame(1).limit(0), frame(2), depth=5).count() == 0
    with pytest.raises(Exception, match="deeper than 2 levels"):
        nested.leaves(frame(1), depth=2).collect()
