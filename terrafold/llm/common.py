"""What the text operators share: scratch tables, worker set-up, text columns."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder; no two calls get the same one."""
    return f"{shared_dir(spark)}/terrafold/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what :func:`written` wrote for ``df``, once nothing that is still to run reads it; other frames stay as they are."""
    path = getattr(df, "scratch_path", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def python_ready(spark: SparkSession, batch_rows: int = 512, batch_bytes: int = 32 << 20) -> None:
    """Prepare the session for Python workers.

    They import this package from where the driver has it, use one thread each,
    and get batches of ``batch_rows`` rows or ``batch_bytes``, whichever is less (one
    row at least), so that long texts stay within memory.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    env.update({"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "RAYON_NUM_THREADS": "1", "TOKENIZERS_PARALLELISM": "false"})
    # Arrays of a few MB are made and freed for every batch: keep their memory instead of giving it back each time.
    env.update({"MALLOC_MMAP_THRESHOLD_": str(64 << 20), "MALLOC_TRIM_THRESHOLD_": str(128 << 20)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path`` in whichever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ASCII-only texts take the faster ``lower``."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``: the fold that the queries fix."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def id_type(df: DataFrame, name: str) -> str:
    """The type of a column, for the schema of a Python stage that passes it on."""
    return df.schema[name].dataType.simpleString()


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Just ``names``; extra columns, whatever they are called, cannot clash later."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose id is in the one column of ``ids``; rows with a null id stay.

    The ids are written and counted: up to ``broadcast_rows`` of them are broadcast,
    so that texts are not shuffled; more are joined by a shuffle.
    """
    (name,) = ids.columns
    gone = written(ids.where(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`").alias("gone_id")).distinct(), "gone-ids")
    few = gone.count() <= broadcast_rows
    return docs.join(F.broadcast(gone) if few else gone, docs[f"`{id_col}`"] == gone["gone_id"], "left_anti")
