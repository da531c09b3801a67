"""Exports that appear as a whole or not at all, and a tile cache that lasts.

An export is written to a folder of its own, checked there - its gates, its index, its
manifest - and becomes the current one by replacing a pointer file in one rename.
A gate that fails, or a run that ends half-way, leaves the export that was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.operators.gates import Gate, require
from terrafold.sources.files import fetch_tiles, file_manifest, read_shards, write_shards

POINTER = "CURRENT"
TILES = "zoom int, x int, y int, status string, content binary"


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _read_text(spark: SparkSession, path: str) -> str | None:
    store, at = _store(spark, path)
    if not store.exists(at):
        return None
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one name


def _replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` beside ``path`` and rename it over it: a reader sees the old file or the new one."""
    store, at = _store(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = store.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else store.getUri(), spark._jsc.hadoopConfiguration())
    renames = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, at, renames)


def current_export(spark: SparkSession, root: str) -> str | None:
    """The folder of the export that readers see; None before the first."""
    name = _read_text(spark, f"{root}/{POINTER}")
    return f"{root}/{name.strip()}" if name else None


def staged_export(
    df: DataFrame,
    root: str,
    key: str,
    order: Sequence[object],
    gates: Callable[[DataFrame], list[Gate]],
    facts: dict[str, object] | None = None,
) -> str:
    """Write ``df`` in shards by ``key`` with an index, check what was written, and make it the current export; its folder.

    ``gates`` get the rows as read back from the staging folder; one that fails is an error
    that names it, and the current export stays.  The manifest (path, sha256, bytes)
    of the files and ``facts`` lie beside them.
    """
    spark = df.sparkSession
    name = f"export-{uuid.uuid4().hex}"
    folder = f"{root}/{name}"
    write_shards(df, folder, key, order)
    back = read_shards(spark, folder, df.schema, key)  # counts against the index
    require(gates(back))
    files = file_manifest(spark, f"{folder}/shards").withColumn("path", F.expr(f"substring(path, instr(path, '{name}') + {len(name) + 1})"))
    files.coalesce(1).write.json(f"{folder}/manifest")
    rows = {"rows": back.count(), **(facts or {})}
    spark.createDataFrame([(json.dumps(rows, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/facts")
    _replace_text(spark, f"{root}/{POINTER}", name)
    return folder


def read_export(spark: SparkSession, root: str, schema: T.StructType | str, key: str) -> DataFrame:
    """The rows of the current export, checked against its index."""
    folder = current_export(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no export under {root}")
    return read_shards(spark, folder, schema, key)


def drop_old_exports(spark: SparkSession, root: str, keep: Sequence[str] = ()) -> list[str]:
    """Delete the exports under ``root`` that are neither current nor in ``keep`` (those that never became current, too); their names."""
    now = current_export(spark, root)
    store, at = _store(spark, root)
    gone = []
    for s in store.listStatus(at):
        name = s.getPath().getName()
        if name.startswith("export-") and name not in keep and f"{root}/{name}" != now:
            store.delete(s.getPath(), True)
            gone.append(name)
    return gone


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, change) of an export's files that are no longer what its manifest says."""
    said = spark.read.schema("path string, sha256 string, bytes long").json(f"{folder}/manifest").select("path", F.col("sha256").alias("was"))
    now = file_manifest(spark, f"{folder}/shards")
    name = folder.rstrip("/").rsplit("/", 1)[1]
    now = now.select(F.expr(f"substring(path, instr(path, '{name}') + {len(name) + 1})").alias("path"), F.col("sha256").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return said.join(now, "path", "full").where("NOT was <=> now").select("path", change.alias("change"))


def cached_tiles(wanted: DataFrame, cache: str, zoom: int, get: Callable[[int, int], tuple[int, bytes]], retries: int = 3) -> DataFrame:
    """(x, y, content, status) of wanted tiles (x, y) through a stored table of tiles by zoom, x and y.

    Only tiles that the table lacks are fetched, once each, and appended: ``present`` with
    their content, or ``missing`` where the server said 404, so that a later run asks for neither.
    Any other answer is stored by no run and is an error after the others were
    stored.  A tile that two runs appended at once is read once.
    """
    spark = wanted.sparkSession
    store, at = _store(spark, cache)
    asked = wanted.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()

    def stored() -> DataFrame:
        table = spark.read.schema(TILES).parquet(cache).where(F.col("zoom") == zoom)
        return table.groupBy("x", "y").agg(F.min_by(F.struct("status", "content"), "status").alias("t")).select("x", "y", "t.status", "t.content")

    lacking = asked.join(stored().select("x", "y"), ["x", "y"], "left_anti") if store.exists(at) else asked
    fetched = fetch_tiles(lacking, get, retries)
    status = F.when(F.col("code") == 200, "present").when(F.col("code") == 404, "missing")
    rows = fetched.select(F.lit(zoom).cast("int").alias("zoom"), "x", "y", status.alias("status"), "content").where("status IS NOT NULL")
    rows.write.mode("append").parquet(cache)
    found = asked.join(stored(), ["x", "y"], "left")
    failed = found.where("status IS NULL").limit(5).collect()
    if failed:
        raise OSError("tiles that could not be fetched: " + ", ".join(f"{r['x']}/{r['y']}" for r in failed))
    return found.select("x", "y", F.when(F.col("status") == "present", F.col("content")).alias("content"), "status")
