"""Sources and sinks: delimited files, index and shards, feature collections, graphs, tiles, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, *, recursive: bool = False, pattern: str | None = None, source_col: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Delimited files with a header and an explicit schema, so keys keep their leading zeros; a byte-order mark is dropped.

    ``encoding`` MS932 needs ``spark.sql.legacy.javaCharsets``; ``source_col`` names the file each row came from.
    """
    reader = spark.read.schema(schema).option("header", True).option("encoding", encoding).option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    return df.select("*", F.col("_metadata.file_path").alias(source_col)) if source_col else df


def read_many(spark: SparkSession, root: str, pattern: str, schema: T.StructType | str, source_col: str = "_source_file") -> DataFrame:
    """All delimited files below ``root`` that match, columns taken by name, tagged with their file.

    Files whose header differs in order or lacks columns of the schema are read by
    their own header; empty files give nothing; that no file matches is an error.
    """
    wanted = spark.createDataFrame([], schema).schema
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    begun = lines.select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_block_start").alias("at"))
    first = begun.where("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("head"))  # the first block of a file is one task's, in order
    heads = first.select("path", F.regexp_replace("head", "^\ufeff", "").alias("head"))
    by_head: dict[str, list[str]] = {}
    for r in heads.collect():  # a row for each file
        by_head.setdefault(r["head"], []).append(r["path"])
    if not by_head:
        raise FileNotFoundError(f"no file that is not empty matches {pattern} under {root}")
    parts = []
    for head, paths in sorted(by_head.items()):
        names = [h.strip().strip('"') for h in head.split(",")]
        own = T.StructType([wanted[n] if n in wanted.names else T.StructField(n, T.StringType()) for n in names])
        df = read_csv(spark, paths, own, source_col=source_col)
        parts.append(df.select(*[F.col(f"`{n}`") for n in names if n in wanted.names], source_col))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields if f.name not in out.columns]
    return out.select("*", *lacking).select(*wanted.names, source_col)


def prefecture_rows(raw: DataFrame, names: Sequence[str], place: str, skip: int = 4) -> DataFrame:
    """Rows of an official sheet (columns in order, ``place`` from 0) as a named table: the first ``skip`` rows and those without a name (second column) left out, address parts joined."""
    cells = [c for c in raw.columns if c != place]
    named = raw.where((F.col(place) >= skip) & F.col(cells[1]).isNotNull()).select(place, *[F.col(c).alias(n) for c, n in zip(cells, names, strict=True)])
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("address_pref", "address_city", "address_detail")]
    return named.withColumn("address", F.concat(*parts)).withColumn("common_id", F.trim(F.col("common_id").cast("string")))


def read_zipped_csv(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "cp932") -> DataFrame:
    """The first member of each archive, every column as text.  An archive is decoded by one task; lines then spread."""
    import io
    import zipfile

    import pandas as pd

    def lines(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    text = archive.read(archive.namelist()[0]).decode(encoding)
                yield pd.read_csv(io.StringIO(text), dtype=str, keep_default_na=False)[list(columns)]

    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInPandas(lines, ", ".join(f"`{c}` string" for c in columns))


def write_csv(df: DataFrame, path: str, *, bom: bool = False) -> None:
    """Delimited files with a header; ``bom`` begins each with a byte-order mark, as spreadsheets want it."""
    if not bom:
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    first, *rest = df.columns
    df.withColumnRenamed(first, "\ufeff" + first).write.mode("overwrite").option("header", True).csv(path)


def read_feature_collection(spark: SparkSession, path: str, code_field: str) -> DataFrame:
    """(code, parts): the polygons of each code, in file order, of a GeoJSON document; rings as arrays of [lon, lat]."""
    ring = "array<array<double>>"
    schema = f"features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    each = doc.select(F.posexplode("d.features").alias("place", "f")).select(
        "place", F.col("f.properties")[code_field].alias("code"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c")
    )
    one = F.array(F.from_json("c", f"array<{ring}>"))
    many = F.from_json("c", f"array<array<{ring}>>")
    parts = each.withColumn("parts", F.when(F.col("type") == "Polygon", one).otherwise(many)).where("code IS NOT NULL")
    gathered = parts.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("place", "parts"))).alias("p"))
    return gathered.select("code", F.flatten(F.transform("p", lambda x: x["parts"])).alias("parts"))


def _checked(c: Column, kind: T.DataType) -> Column:
    """``c`` with an error in place of any number within it that is not finite."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("a number that is not finite has no place in JSON")).cast(kind)).otherwise(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _checked(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_checked(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def features(df: DataFrame, geometry: Column, properties: Column, *keys: str) -> DataFrame:
    """(keys, feature): GeoJSON features as text; a number that is not finite is an error, not text."""
    parts = df.select(*keys, geometry.alias("_g"), properties.alias("_p"))
    checked = {n: _checked(F.col(n), parts.schema[n].dataType) for n in ("_g", "_p")}
    return parts.select(*keys, F.to_json(F.struct(F.lit("Feature").alias("type"), checked["_g"].alias("geometry"), checked["_p"].alias("properties"))).alias("feature"))


def feature_collections(df: DataFrame, key: str, order: str, geometry: Column, properties: Column) -> DataFrame:
    """(key, document): one GeoJSON document for each key, its features by ``order``; a key's features must fit into one row."""
    rows = features(df, geometry, properties, key, order).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "feature"))).alias("f"))
    text = F.array_join(F.transform("f", lambda x: x["feature"]), ",")
    return rows.select(key, F.concat(F.lit('{"type":"FeatureCollection","features":['), text, F.lit("]}")).alias("document"))


def write_features(df: DataFrame, path: str, geometry: Column, properties: Column) -> None:
    """One feature a line."""
    features(df, geometry, properties).write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, data), edges(u, v, data)) of a GraphML file, data as key -> text."""
    entry = "array<struct<_key:string,_VALUE:string>>"
    to_map = lambda c: F.map_from_entries(F.transform(c, lambda e: F.struct(e["_key"], e["_VALUE"])))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {entry}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {entry}").load(path)
    return nodes.select(F.col("_id").alias("node"), to_map("data").alias("data")), edges.select(F.col("_source").alias("u"), F.col("_target").alias("v"), to_map("data").alias("data"))


def write_shards(df: DataFrame, root: str, key: str, order: Sequence[object] | None = None) -> DataFrame:
    """One folder of JSON for each key, and the index (key, file, feature_count, place), which is written beside them and returned.

    ``order`` fixes which keys there are and in what order: one without rows, or rows of another key, are an error.
    """
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("feature_count"))
    if order is not None:
        places = df.sparkSession.createDataFrame(list(enumerate(order)), T.StructType([T.StructField("place", T.IntegerType()), T.StructField(key, df.schema[key].dataType)]))
        off = F.broadcast(places).join(counted, key, "full").where("place IS NULL OR feature_count IS NULL").select(key).collect()
        if off:
            raise ValueError(f"no public rows for, or no place for: {sorted(str(r[0]) for r in off)}")
        counted = counted.join(F.broadcast(places), key)
    else:
        counted = counted.withColumn("place", F.lit(None).cast("int"))
    df.write.mode("overwrite").partitionBy(key).json(f"{root}/shards")
    index = counted.select(F.col(key).cast("string").alias(key), F.concat(F.lit(f"{key}="), F.col(key)).alias("file"), "feature_count", "place")
    index.orderBy("place", key).coalesce(1).write.mode("overwrite").json(f"{root}/index")
    return df.sparkSession.read.schema(index.schema).json(f"{root}/index")


def export_scenarios(tables: dict[str, DataFrame], root: str, canonical_sha: str, provenance: dict[str, tuple[str, str]]) -> None:
    """Tables added beside the canonical ones; refused unless every stage's (release gate, canonical source) is PASS and the same source.  All are checked before any is written."""
    for stage, (gate, sha) in provenance.items():
        if gate != "PASS":
            raise ValueError(f"{stage}: release gate is not PASS")
        if sha != canonical_sha:
            raise ValueError(f"{stage}: provenance does not match the canonical source")
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}")


def network_summary(records: DataFrame) -> DataFrame:
    """One row for records (municipality, status): how many, and which municipalities are complete and which are not."""
    done = F.coalesce(F.col("status") == "complete", F.lit(False))
    named = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("municipality"))))
    return records.agg(F.count(F.lit(1)).alias("qa_records"), named(done).alias("complete_municipalities"), named(~done).alias("failed_municipalities"))


def read_shards(spark: SparkSession, root: str, schema: T.StructType | str, key: str, *, check_counts: bool = True) -> DataFrame:
    """What :func:`write_shards` wrote; rows that do not match the index are an error."""
    df = spark.read.schema(schema).json(f"{root}/shards")
    if check_counts:
        index = spark.read.json(f"{root}/index").select(F.col(key).cast("string").alias(key), "feature_count")
        there = df.groupBy(F.col(key).cast("string").alias(key)).agg(F.count(F.lit(1)).alias("n"))
        off = index.join(there, key, "full").where("NOT feature_count <=> n").count()
        if off:
            raise ValueError(f"{off} shards under {root} do not match their index")
    return df


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of every file below, hashed where it is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def manifest_diff(before: DataFrame, after: DataFrame, outside: str | None = None) -> DataFrame:
    """(path, change) of files that were removed, added or changed, but for those under ``outside``."""
    b = before.select("path", F.col("sha256").alias("was"))
    a = after.select("path", F.col("sha256").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    diff = b.join(a, "path", "full").where("NOT was <=> now").select("path", change.alias("change"))
    return diff.where(~F.contains("path", F.lit(outside))) if outside else diff


def tile_store(wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    """(x, y, content, status) of wanted tiles (x, y) against fetched ones (x, y, content, code): ``present``, or ``absent`` where the server said 404; any other answer, or none, is an error."""
    rows = wanted.select("x", "y").distinct().join(fetched, ["x", "y"], "left")
    said = F.concat(F.lit("tile "), F.col("x"), F.lit("/"), F.col("y"), F.lit(" was not fetched: "), F.coalesce(F.col("code").cast("string"), F.lit("no answer")))
    status = F.when(F.col("content").isNotNull() & (F.col("code") == 200), "present").when(F.col("code") == 404, "absent").otherwise(F.raise_error(said))
    return rows.select("x", "y", F.when(F.col("code") == 200, F.col("content")).alias("content"), status.alias("status"))


def fetch_tiles(wanted: DataFrame, get, retries: int = 3) -> DataFrame:
    """(x, y, content, code) by ``get(x, y) -> (code, bytes)`` in the workers, each tile once, tried ``retries`` times where it raises; the last failure has code -1."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                code, content = -1, None
                for _ in range(retries):
                    try:
                        code, content = get(int(x), int(y))
                        break
                    except OSError:
                        continue
                rows.append((x, y, content if code == 200 else None, code))
            yield pd.DataFrame(rows, columns=["x", "y", "content", "code"])

    return wanted.select("x", "y").distinct().mapInPandas(run, "x int, y int, content binary, code int")


#: Pixels of tiles that go out together: tiles may have a few pixels or 65,536.
PIXELS_AT_ONCE = 1 << 18


def tile_pixels(tiles: DataFrame, decode) -> DataFrame:
    """(x, y, px, py, r, g, b, a) of tiles (x, y, content); ``decode`` turns bytes into an array (height, width, 4), None means absent."""
    import numpy as np
    import pyarrow as pa

    def pixels(batches):
        def rows(batch, at, images):
            sizes = [i.shape[0] * i.shape[1] for i in images]
            places = {shape: [p.ravel().astype("int32") for p in np.indices(shape)] for shape in {i.shape[:2] for i in images}}
            py, px = (np.concatenate([places[i.shape[:2]][k] for i in images]) for k in (0, 1))
            colours = np.concatenate([i[:, :, :4].reshape(-1, 4) for i in images]).astype("int32")
            tile = pa.array(np.repeat(at, sizes))
            own = [batch.column(c).take(tile) for c in "xy"]
            return pa.RecordBatch.from_arrays([*own, *map(pa.array, (px, py, *np.ascontiguousarray(colours.T)))], names=["x", "y", "px", "py", *"rgba"])

        for batch in batches:
            at, images, n = [], [], 0
            for i, content in enumerate(batch.column("content")):
                rgba = decode(content.as_py()) if content.is_valid else None
                if rgba is None or not rgba.size:
                    continue
                at.append(i)
                images.append(rgba)
                n += rgba.shape[0] * rgba.shape[1]
                if n >= PIXELS_AT_ONCE:
                    yield rows(batch, at, images)
                    at, images, n = [], [], 0
            if images:
                yield rows(batch, at, images)

    return tiles.select(F.col("x").cast("int"), F.col("y").cast("int"), "content").mapInArrow(pixels, "x int, y int, px int, py int, r int, g int, b int, a int")
