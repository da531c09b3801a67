"""Views over the driver's tables that stand for meshes, shelters, candidates, edges and route samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators.relational import top_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meshes(spark: SparkSession, d: str) -> DataFrame:
    """Orders are pre-aggregated by customer before the join."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("mesh_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(urgent).alias("u")
    )
    return table(spark, d, "customer").select(F.col("c_custkey").alias("mesh_id"), F.col("c_nationkey").alias("municipality_code")).join(per, "mesh_id", "left").select(
        "mesh_id",
        "municipality_code",
        F.coalesce("n", F.lit(0)).alias("total_population"),
        (F.col("f") / F.col("n")).alias("tsunami_inundation_ratio"),
        F.when(F.col("n") >= 8, F.col("u") / F.col("n")).alias("aging_rate_65plus"),
    )


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity <= 10")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    joined = _lines(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.count(F.lit(1))
    out = joined.groupBy(F.col("o_custkey").alias("mesh_id"), F.col("l_suppkey").alias("shelter_key")).agg(
        F.min(F.col("l_extendedprice") / 10).alias("total_walking_distance_m"),
        (F.count_if(F.col("l_discount") >= 0.06) / n).alias("inundation_ratio"),
        (F.count_if((F.col("l_discount") >= 0.04) & (F.col("l_discount") < 0.055)) / n).alias("unknown_ratio"),
    )
    return out.withColumn("classified_ratio", F.when(F.col("unknown_ratio") < 1, F.col("inundation_ratio") / (1 - F.col("unknown_ratio"))))


def candidates(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return top_k(pairs(spark, d), ["mesh_id"], [F.col("total_walking_distance_m"), F.col("shelter_key")], k, "candidate_rank")


def shelters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("shelter_key"),
        F.col("s_nationkey").alias("municipality_code"),
        F.when(F.col("s_acctbal") >= 20, F.floor(F.col("s_acctbal") / 20).cast("double")).alias("capacity"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    u, v = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey"))
    return _lines(spark, d).groupBy(u.alias("u"), v.alias("v")).agg(F.min(F.col("l_extendedprice") / 10).alias("length"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Ordered route samples: depth class 0 dry, 1 and 2 inundated, null unknown."""
    depth = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2)
    return table(spark, d, "events").where("value > 0").select(
        F.col("user_id").alias("route_id"), "ts", "event_id", F.col("value").alias("sample_length_m"), depth.alias("depth_class")
    )


# The same views for DuckDB, as common table expressions.
SQL = {
    "t_mesh": """t_mesh AS (SELECT c_custkey AS mesh_id, c_nationkey AS municipality_code, count(o_orderkey) AS total_population,
      CASE WHEN count(o_orderkey) > 0 THEN count(*) FILTER (WHERE o_orderstatus = 'F') / count(o_orderkey)::DOUBLE END AS tsunami_inundation_ratio,
      CASE WHEN count(o_orderkey) >= 8 THEN count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) / count(o_orderkey)::DOUBLE END AS aging_rate_65plus
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""",
    "t_pair": """t_pair0 AS (SELECT o_custkey AS mesh_id, l_suppkey AS shelter_key, min(l_extendedprice / 10) AS total_walking_distance_m,
      count(*) FILTER (WHERE l_discount >= 0.06) / count(*)::DOUBLE AS inundation_ratio,
      count(*) FILTER (WHERE l_discount >= 0.04 AND l_discount < 0.055) / count(*)::DOUBLE AS unknown_ratio
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity <= 10 GROUP BY ALL),
      t_pair AS (SELECT *, CASE WHEN unknown_ratio < 1 THEN inundation_ratio / (1 - unknown_ratio) END AS classified_ratio FROM t_pair0)""",
    "t_candidate": """t_candidate AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY total_walking_distance_m, shelter_key) AS candidate_rank
      FROM t_pair) WHERE candidate_rank <= 10)""",
    "t_shelter": """t_shelter AS (SELECT s_suppkey AS shelter_key, s_nationkey AS municipality_code,
      CASE WHEN s_acctbal >= 20 THEN floor(s_acctbal / 20)::DOUBLE END AS capacity FROM supplier)""",
    "t_edge": """t_edge AS (SELECT 's' || l_suppkey AS u, 'p' || l_partkey AS v, min(l_extendedprice / 10) AS length
      FROM lineitem WHERE l_returnflag = 'R' AND l_quantity <= 10 GROUP BY ALL)""",
    "t_sample": """t_sample AS (SELECT user_id AS route_id, ts, event_id, value AS sample_length_m,
      CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS depth_class FROM events WHERE value > 0)""",
}


def with_views(*names: str) -> str:
    """``WITH`` and the named views with what they build on."""
    needs = {"t_candidate": ["t_pair"]}
    ordered: list[str] = []
    for name in names:
        for n in [*needs.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    return "WITH " + ", ".join(SQL[n] for n in ordered)
