"""Queries of sources and sinks: tables written in a format and read back, with SQL over the tables themselves."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import lines as L
from terrafold.operators import areas
from terrafold.operators.gates import Gate
from terrafold.plans import surrogates as S
from terrafold.plans.registry import query, r6
from terrafold.session import shared_dir, workers_import
from terrafold.sources import files, staged, streams


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/terrafold/{name}-{uuid.uuid4().hex}"


@query("SELECT lpad(c_custkey::VARCHAR, 8, '0') AS code, c_name AS name, c_nationkey AS nation, CASE WHEN c_custkey % 7 > 0 THEN round(c_acctbal, 2) END AS balance FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Delimited files with a byte-order mark, read by an explicit schema: keys keep their leading zeros, what is missing stays missing."""
    at = _folder(spark, "csv")
    rows = S.table(spark, d, "customer").selectExpr("lpad(CAST(c_custkey AS STRING), 8, '0') AS code", "c_name AS name", "c_nationkey AS nation", "CASE WHEN c_custkey % 7 > 0 THEN round(c_acctbal, 2) END AS balance")
    files.write_csv(rows, at, bom=True)
    return files.read_csv(spark, at, "code string, name string, nation bigint, balance double")


@query("""SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS code, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS nation, s_acctbal AS balance, s_suppkey % 2 = 0
        AS first_folder FROM supplier""")
def many_csv(spark: SparkSession, d: str) -> DataFrame:
    """Files of two folders with other orders of columns, one of which lacks a column, taken by name and tagged with their file."""
    at = _folder(spark, "many")
    s = S.table(spark, d, "supplier").withColumn("code", F.expr("lpad(CAST(s_suppkey AS STRING), 6, '0')"))
    files.write_csv(s.where("s_suppkey % 2 = 0").selectExpr("code", "s_nationkey AS nation", "s_acctbal AS balance", "s_name AS spare"), f"{at}/one")
    files.write_csv(s.where("s_suppkey % 2 = 1").selectExpr("s_acctbal AS balance", "code"), f"{at}/two")
    rows = files.read_many(spark, at, "part-*.csv", "code string, nation bigint, balance double")
    return rows.select("code", "nation", "balance", F.contains("_source_file", F.lit("/one/")).alias("first_folder"))


def _zipped(at: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(at)

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, part in rows.groupby("member"):
                archive.writestr(f"{name}.csv", part.drop(columns=["nation", "member"]).to_csv(index=False).encode("cp932"))
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{key[0]}.zip") as out:  # a task that is tried again writes the same
            out.write(held.getvalue())
        return pd.DataFrame({"nation": [key[0]]})

    return write


@query("SELECT c_custkey::VARCHAR AS id, c_name || ',\"町\"' AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer")
def zipped_rows(spark: SparkSession, d: str) -> DataFrame:
    """Archives of several members in another encoding, streamed member by member."""
    at = _folder(spark, "zip")
    workers_import(spark)
    streams.register(spark)
    rows = S.table(spark, d, "customer").select(
        F.col("c_nationkey").alias("nation"), F.concat(F.lit("m"), F.col("c_custkey") % 2).alias("member"), F.col("c_custkey").cast("string").alias("id"),
        F.concat("c_name", F.lit(',"町"')).alias("name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    rows.groupBy("nation").applyInPandas(_zipped(at), "nation bigint").count()
    return spark.read.format("zipped_csv").option("columns", "id,name,segment").load(at)


@query("""SELECT c_nationkey::VARCHAR AS place, count(*) AS features, round(2.0 * count(*), 6)::DOUBLE AS area, round(4.0 + 2 * count(*), 6)::DOUBLE AS
        perimeter FROM customer GROUP BY 1""")
def feature_files(spark: SparkSession, d: str) -> DataFrame:
    """A GeoJSON document for each nation, boxes in a row that touch, streamed feature by feature and dissolved to places."""
    at = _folder(spark, "geojson")
    streams.register(spark)
    c = S.table(spark, d, "customer").selectExpr("c_nationkey AS nation", "c_custkey AS id", "CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS DOUBLE) AS x")
    corner = lambda dx, y: F.array(F.col("x") + dx, F.lit(y))
    ring = F.array(corner(0, 0.0), corner(1, 0.0), corner(1, 2.0), corner(0, 2.0), corner(0, 0.0))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    documents = files.feature_collections(c, "nation", "id", geometry, F.struct(F.col("nation").cast("string").alias("code"), "id"))
    documents.select(F.col("nation").alias("file"), "document").write.partitionBy("file").text(at)  # a file for each: a document is a line
    rows = spark.read.format("geojson_features").load(at)
    parts = rows.select(F.col("properties")["code"].alias("place"), F.col("properties")["id"].alias("part"), F.from_json("coordinates", "array<array<array<double>>>").alias("r"))
    points = F.transform("r", lambda ring: F.transform(ring, lambda p: L.point(p[0], p[1])))
    parts = parts.select("place", "part", points.alias("rings"))
    m = areas.boundary_measures(areas.dissolve(parts)).select("place", r6("area"), r6("perimeter"))
    return parts.groupBy("place").agg(F.count(F.lit(1)).alias("features")).join(m, "place")


@query("""SELECT 's' || l_suppkey AS u, 'p' || l_partkey AS v, round(min(l_extendedprice / 10), 6) AS length, true AS ends_known FROM lineitem WHERE
        l_returnflag = 'R' AND l_quantity <= 10 GROUP BY l_suppkey, l_partkey""")
def graph_files(spark: SparkSession, d: str) -> DataFrame:
    """GraphML files, one for each kind of supplier, streamed element by element; edges whose ends are nodes of their file."""
    at = _folder(spark, "graphml")
    streams.register(spark)
    e = S.edges(spark, d).withColumn("file", F.expr("CAST(substring(u, 2) AS INT) % 4"))
    ends = e.select("file", F.explode(F.array("u", "v")).alias("node")).distinct()
    nodes = ends.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<node id="'), "node", F.lit('"/>')))), "").alias("nodes"))
    text = F.concat(F.lit('<edge source="'), "u", F.lit('" target="'), "v", F.lit('"><data key="d0">'), F.col("length").cast("string"), F.lit("</data></edge>"))
    edges = e.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(text)), "").alias("edges"))
    head = '<graphml><key id="d0" for="edge" attr.name="length"/><graph edgedefault="directed">'
    nodes.join(edges, "file").select("file", F.concat(F.lit(head), "nodes", "edges", F.lit("</graph></graphml>")).alias("document")).write.partitionBy("file").text(at)
    found = spark.read.format("graphml").option("element", "edge").load(at).select("u", "v", F.col("data")["length"].cast("double").alias("length"))
    there = spark.read.format("graphml").load(at).select(F.col("node").alias("u"), F.lit(True).alias("known")).distinct()
    return found.join(there, "u", "left").select("u", "v", r6("length"), F.coalesce("known", F.lit(False)).alias("ends_known"))


@query("""SELECT c_mktsegment AS segment, c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_custkey % 2 = 0""")
def staged_rows(spark: SparkSession, d: str) -> DataFrame:
    """An export that passes its gates, and one that doesn't and leaves it: readers see the first."""
    at = _folder(spark, "public")
    rows = S.table(spark, d, "customer").selectExpr("c_mktsegment AS segment", "c_custkey AS id", "c_acctbal AS balance")
    order = [r[0] for r in rows.select("segment").distinct().orderBy("segment").collect()]  # a row for each segment
    even = lambda df: [Gate("even", df, F.col("id") % 2 == 1)]
    staged.staged_export(rows.where("id % 2 = 0"), at, "segment", order, even)
    try:
        staged.staged_export(rows, at, "segment", order, even)
    except ValueError:
        return staged.read_export(spark, at, "segment string, id bigint, balance double", "segment")
    raise AssertionError("a failing gate let an export through")


@query("""SELECT c_custkey::INT AS x, (c_custkey % 7)::INT AS y, CASE WHEN c_custkey % 3 > 0 THEN sha256(c_custkey::VARCHAR) END AS content, CASE WHEN c_custkey
        % 3 > 0 THEN 'present' ELSE 'missing' END AS status FROM customer""")
def cached_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles through a cache in two runs, the second of which asks for those alone that the first lacked; a tile that the server lacks is missing in both."""
    import hashlib

    at = _folder(spark, "tiles")
    want = S.table(spark, d, "customer").selectExpr("CAST(c_custkey AS INT) AS x", "CAST(c_custkey % 7 AS INT) AS y")

    def first(x: int, y: int) -> tuple[int, bytes]:
        return (404, b"") if x % 3 == 0 else (200, hashlib.sha256(str(x).encode()).hexdigest().encode())

    def second(x: int, y: int) -> tuple[int, bytes]:
        if x % 2 == 0:
            raise ValueError(f"tile {x}/{y} was asked for again")
        return first(x, y)

    workers_import(spark)
    staged.cached_tiles(want.where("x % 2 = 0"), at, 12, first)
    return staged.cached_tiles(want, at, 12, second).select("x", "y", F.col("content").cast("string").alias("content"), "status")
