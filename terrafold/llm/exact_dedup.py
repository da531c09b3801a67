"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows are combined three times, each time by digest *and* full content:

1. locally - the map side of the first aggregation leaves one row per content
   and input task;
2. in salted groups - the salt is the input task's number, so a content that a
   third of all rows have is dealt over ``salts`` reducers, each of which gets
   at most one row per content and task;
3. globally - the salts' winners, at most ``salts`` rows per content.

Then each row finds its group by digest.  Rows of a digest that stands for more
than one content (a collision) are looked up by content as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import ascii_lower, columns_of, written


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _content(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    return (
        columns_of(docs, id_col, text_col)
        .select(F.col(f"`{id_col}`").alias("id"), _content(text_col).alias("content"))
        .select("id", "content", digest(F.col("content")).alias("digest"))
    )


def content_groups(rows: DataFrame, salts: int) -> DataFrame:
    """One row per distinct content of (id, content, digest): digest, content, keep_id, group_size."""
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "content", "salt")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    # Dealt by digest alone, so that counting the contents of a digest needs no other exchange.
    return (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row
    with the largest id stays.  A null text counts as empty.  A null id never wins
    over a known one; a group of null ids has a null ``keep_id`` and all of it is
    kept.  Rows that repeat id and text are one document: all of them carry its
    ``kept``.  Extra columns are ignored; an empty table gives an empty result.
    The groups, without their texts, are written to the shared folder.  ``digest``
    stands in for SHA-256 in tests of collisions.
    """
    rows = _rows(docs, id_col, text_col, digest)
    groups = written(
        content_groups(rows, salts)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")),
        "digest-groups",
    )
    collided = groups.where("contents > 1")
    joined = rows.drop("content").join(groups.where("contents = 1").drop("contents"), "digest", "left" if collided.isEmpty() else "inner")
    if not collided.isEmpty():
        apart = rows.join(collided.select("digest"), "digest", "left_semi")
        by_content = content_groups(rows.join(collided.select("digest"), "digest", "left_semi"), salts)
        apart = apart.join(by_content, ["digest", "content"])
        joined = joined.unionByName(apart.select("digest", "id", "keep_id", "group_size"))
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, broadcast_rows: int = 1_000_000, **how) -> DataFrame:
    """``docs`` with the row of the largest id of each content; of rows that repeat it, all.

    Removed are rows by id and digest: another text with the id of a removed copy stays.
    """
    out = exact_dedup(docs, id_col, text_col, digest=digest, **how)
    gone = out.where(f"NOT kept AND `{id_col}` IS NOT NULL").select(F.col(f"`{id_col}`").alias("gone_id"), F.col("text_sha256").alias("gone_digest"))
    gone = written(gone.distinct(), "gone-copies")
    few = gone.count() <= broadcast_rows
    same = (F.col(f"`{id_col}`") == F.col("gone_id")) & (digest(_content(text_col)) == F.col("gone_digest"))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
