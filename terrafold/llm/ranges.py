"""Rows dealt over tasks in an order, and merging of what neighbouring tasks hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import written


def parts_for(df: DataFrame, rows: int, most: int) -> int:
    """How many parts: ``most`` rows in each, but as many parts as the session shuffles to, if each has 500 rows."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // most), min(wanted, rows // 500))


def dealt(df: DataFrame, keys: list[Column], parts: int, name: str) -> DataFrame:
    """``df`` in the order of ``keys``, written: ``part`` numbers contiguous ranges of it, ``pos`` the rows of a part."""
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = written(ordered.withColumn("place", F.monotonically_increasing_id()), name)
    out = placed.withColumn("part", F.shiftright("place", 33)).withColumn("pos", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("place")
    out.scratch_path = placed.scratch_path
    return out


def spans(parts: int, fan_in: int) -> Iterator[int]:
    """Parts that a group of each level of the merge covers, until one group covers all."""
    span = 1
    while True:
        span *= fan_in
        yield span
        if span >= parts:
            return


def merged(fragments: DataFrame, merge: Callable, span: int, name: str) -> DataFrame:
    """Fragments of ``span`` neighbouring parts merged in one group each: ``merge(key, table)`` gives what they leave.

    Groups are contiguous, so what a group leaves open is at its two ends and does
    not grow with the number of rows or parts below it.
    """
    at = fragments.withColumn("up", F.floor(F.col("part") / span).cast("long"))
    return written(at.groupBy("up").applyInArrow(merge, fragments.schema), name)
