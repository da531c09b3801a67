"""The registry of queries over the driver's tables and the SQL they are held against.

Floats are rounded to six decimals in the last projection on both sides; sums that
fall on a tie there are moved off it first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.functions import values as V
from terrafold.operators import allocation, graph, relational, scoring, spatial
from terrafold.operators.gates import Gate, evaluate
from terrafold.plans import surrogates as S
from terrafold.plans import ui
from terrafold.session import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(name: str, c: Column | None = None) -> Column:
    return F.round(F.col(name) if c is None else c, 6).alias(name)


def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    return S.candidates(spark, d, 1).drop("candidate_rank")


def risk(spark: SparkSession, d: str) -> DataFrame:
    return scoring.composite(S.meshes(spark, d), first_candidates(spark, d), S.shelters(spark, d))


def clip(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(100.0, greatest(0.0, ({x}))) END"


def weighted(r: str = "rp", p: str | None = "pa", weights: tuple[float, ...] = (25.0, 20.0, 25.0, 15.0, 15.0)) -> str:
    terms = [f"{c} * {w!r}" for c, w in zip(("te", "vp", "wa", r, p), weights, strict=True) if c]
    total = sum(w for c, w in zip(("te", "vp", "wa", r, p), weights, strict=True) if c)
    return clip(f"({' + '.join(terms)}) / {total!r}")


RISK = (
    S.with_views("t_mesh", "t_candidate", "t_shelter")
    + f""",
    base AS (SELECT m.*, c.* EXCLUDE (mesh_id, candidate_rank), c.shelter_key IS NOT NULL AS ready,
        total_population * tsunami_inundation_ratio AS demand_area_weighted, total_population::DOUBLE AS demand_full_mesh
      FROM t_mesh m LEFT JOIN t_candidate c ON c.mesh_id = m.mesh_id AND c.candidate_rank = 1 WHERE tsunami_inundation_ratio > 0),
    pressure AS (SELECT b.shelter_key, count(*) AS assigned_mesh_count, sum(demand_area_weighted) AS assigned_demand_area_weighted,
        sum(demand_full_mesh) AS assigned_demand_full_mesh, any_value(s.capacity) AS capacity,
        CASE WHEN any_value(s.capacity) > 0 THEN sum(demand_area_weighted) / any_value(s.capacity) END AS capacity_pressure_area_weighted,
        CASE WHEN any_value(s.capacity) > 0 THEN sum(demand_full_mesh) / any_value(s.capacity) END AS capacity_pressure_full_mesh
      FROM base b LEFT JOIN t_shelter s USING (shelter_key) WHERE ready GROUP BY b.shelter_key),
    bounds AS (SELECT coalesce(lo, 0.0) AS low, CASE WHEN coalesce(hi, 1.0) <= coalesce(lo, 0.0) THEN coalesce(lo, 0.0) + 1 ELSE coalesce(hi, 1.0) END AS high
      FROM (SELECT quantile_cont(total_walking_distance_m, 0.05) AS lo, quantile_cont(total_walking_distance_m, 0.95) AS hi FROM base WHERE ready)),
    parts AS (SELECT b.*, p.* EXCLUDE (shelter_key), {clip('tsunami_inundation_ratio * 100')} AS te, {clip('aging_rate_65plus * 100')} AS vp,
        CASE WHEN ready THEN {clip('(total_walking_distance_m - low) / (high - low) * 100')} END AS wa,
        CASE WHEN ready THEN {clip('inundation_ratio * 100')} END AS rl, CASE WHEN ready THEN {clip('classified_ratio * 100')} END AS rp,
        CASE WHEN ready THEN {clip('(inundation_ratio + unknown_ratio) * 100')} END AS ru,
        coalesce(ready AND unknown_ratio > 0, false) AS uncertain,
        CASE WHEN ready THEN {clip('capacity_pressure_area_weighted * 100')} END AS pa, CASE WHEN ready THEN {clip('capacity_pressure_full_mesh * 100')} END AS
        pf
      FROM base b LEFT JOIN pressure p USING (shelter_key) CROSS JOIN bounds),
    risk AS (SELECT *, {weighted(p=None)} AS core_score, {weighted('rl', None)} AS core_score_lower, {weighted('ru', None)} AS core_score_upper,
        {weighted()} AS full_score, {weighted('rl')} AS full_score_lower, {weighted('ru')} AS full_score_upper, {weighted(p='pf')} AS full_score_full_mesh,
        CASE WHEN NOT ready THEN 'route_unavailable' WHEN {weighted(p=None)} IS NULL THEN 'core_data_incomplete'
          WHEN {weighted()} IS NULL THEN 'core_only_missing_capacity' ELSE 'complete' END AS score_status FROM parts)
"""
)


# --- predicates, parsers and scalar functions


@query(S.with_views("t_mesh") + " SELECT mesh_id, municipality_code, total_population, round(tsunami_inundation_ratio, 6) AS tsunami_inundation_ratio FROM t_mesh WHERE tsunami_inundation_ratio > 0")
def target_filter(spark: SparkSession, d: str) -> DataFrame:
    return scoring.targets(S.meshes(spark, d)).select("mesh_id", "municipality_code", "total_population", r6("tsunami_inundation_ratio"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '***' WHEN 1 THEN '-' WHEN 2 THEN 'NaN' WHEN 3 THEN 'x' || value ELSE value::VARCHAR END AS
        raw FROM events)
    SELECT event_id, CASE WHEN event_id % 6 >= 4 THEN round(raw::DOUBLE, 6) END AS number FROM t""")
def null_scrub_numeric(spark: SparkSession, d: str) -> DataFrame:
    m, v = F.col("event_id") % 6, F.col("value").cast("string")
    raw = F.when(m == 0, "***").when(m == 1, "-").when(m == 2, "NaN").when(m == 3, F.concat(F.lit("x"), v)).otherwise(v)
    return S.table(spark, d, "events").select("event_id", r6("number", V.to_number(raw, V.NULL_TOKENS)))


AGES = "o_orderkey, o_totalprice AS total, o_totalprice * ((o_orderkey % 7) / 5.0) AS over65, CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice * ((o_orderkey % 5) / 6.0) END AS over75"


@query(f"""WITH t AS (SELECT {AGES} FROM orders), w AS (SELECT *, total IS NOT NULL AND over65 IS NOT NULL AND over75 IS NOT NULL
      AND (over65 > total OR over75 > over65 OR over75 > total) AS wrong FROM t)
    SELECT o_orderkey, wrong AS inconsistent, round(CASE WHEN NOT wrong AND total > 0 THEN over65 / total END, 6) AS rate65,
      round(CASE WHEN NOT wrong THEN total + over65 + over75 END, 6) AS all_three FROM w""")
def age_consistency(spark: SparkSession, d: str) -> DataFrame:
    t = S.table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_totalprice AS total", "o_totalprice * ((o_orderkey % 7) / 5.0D) AS over65", "CASE WHEN o_orderkey % 11 > 0 THEN o_totalprice * ((o_orderkey % 5) / 6.0D) END AS over75"
    )
    a, b, wrong = V.age_consistency(F.col("total"), F.col("over65"), F.col("over75"))
    return t.select("o_orderkey", wrong.alias("inconsistent"), r6("rate65", V.safe_ratio(a, F.col("total"))), r6("all_three", V.row_sum_or_null([F.col("total"), a, b])))


@query(S.with_views("t_pair") + """ SELECT status, count(*) AS n FROM (SELECT CASE WHEN d IS NULL THEN 'missing' WHEN d <= 100 THEN 'normal' WHEN d <= 250 THEN
        'review'
    WHEN d <= 500 THEN 'warning' ELSE 'critical' END AS status FROM (SELECT CASE WHEN shelter_key % 9 > 0 THEN total_walking_distance_m / 10 END AS d FROM
        t_pair)) GROUP BY status""")
def snap_status_classes(spark: SparkSession, d: str) -> DataFrame:
    distance = F.when(F.col("shelter_key") % 9 > 0, F.col("total_walking_distance_m") / 10)
    return S.pairs(spark, d).select(V.snap_status(distance).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(S.with_views("t_mesh", "t_candidate") + """, c AS (SELECT mesh_id, count(*) AS n, count(*) FILTER (WHERE total_walking_distance_m < 3000) AS near FROM
        t_candidate GROUP BY 1)
    SELECT m.mesh_id, CASE WHEN total_population = 0 THEN 'network_coverage_gap' WHEN coalesce(n, 0) = 0 THEN 'no_candidate_in_aoi'
      WHEN near = 0 THEN 'all_candidates_snap_excluded' WHEN m.mesh_id % 50 = 0 THEN 'no_network_path' ELSE 'complete' END AS route_status
    FROM t_mesh m LEFT JOIN c USING (mesh_id)""")
def route_status_ladder(spark: SparkSession, d: str) -> DataFrame:
    c = S.candidates(spark, d).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("total_walking_distance_m") < 3000).alias("near"))
    m = S.meshes(spark, d).join(c, "mesh_id", "left")
    status = V.route_status(F.col("total_population") == 0, F.coalesce("n", F.lit(0)), F.col("near"), F.col("mesh_id") % 50 != 0)
    return m.select("mesh_id", status.alias("route_status"))


@query(S.with_views("t_candidate") + """ SELECT mesh_id, shelter_key, round(total_walking_distance_m / 1.0 / 60, 6) AS walking_minutes_1_0,
    round(total_walking_distance_m / 0.62 / 60, 6) AS walking_minutes_0_62, round(total_walking_distance_m / 0.5 / 60, 6) AS walking_minutes_0_5 FROM
        t_candidate""")
def walking_minutes(spark: SparkSession, d: str) -> DataFrame:
    c = S.candidates(spark, d).select("mesh_id", "shelter_key", *V.walking_minutes(F.col("total_walking_distance_m")))
    return c.select("mesh_id", "shelter_key", *[r6(f"walking_minutes_{k}") for k in V.WALKING_SPEEDS])


CAPACITY_TEXT = """CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '1,' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') || ' persons' WHEN 3 THEN '0'
    WHEN 4 THEN (s_suppkey % 500 + 1)::VARCHAR ELSE 'about ' || s_suppkey END"""


@query(f"""WITH t AS (SELECT s_suppkey, {CAPACITY_TEXT} AS raw FROM supplier),
    q AS (SELECT *, nullif(regexp_extract(trim(raw), '^([0-9][0-9,]*(?:\\.[0-9]+)?)', 1), '') AS prefix FROM t),
    p AS (SELECT *, replace(prefix, ',', '')::DOUBLE AS v FROM q)
    SELECT s_suppkey, CASE WHEN v > 0 THEN v END AS value, CASE WHEN raw IS NULL THEN 'missing' WHEN v IS NULL THEN 'unparseable' WHEN v <= 0 THEN 'nonpositive'
      WHEN trim(raw) = prefix THEN 'numeric' ELSE 'numeric_prefix' END AS status FROM p""")
def capacity_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    long = F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" persons"))
    raw = F.when(k % 6 == 1, "").when(k % 6 == 2, long).when(k % 6 == 3, "0").when(k % 6 == 4, (k % 500 + 1).cast("string")).when(k % 6 == 5, F.concat(F.lit("about "), k))
    return S.table(spark, d, "supplier").select("s_suppkey", V.parse_capacity(raw).alias("p")).select("s_suppkey", "p.value", "p.status")


@query("""WITH t AS (SELECT s_suppkey, ' ' || coalesce(s_name, '') || ' (No.' || s_suppkey % 7 || ') /a_b-c ' AS name FROM supplier)
    SELECT s_suppkey, lower(regexp_replace(name, '[ ()/_-]', '', 'g')) AS name_key, s_suppkey || '||' || trim(name) AS identity_key FROM t""")
def identity_key_norm(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit(" "), F.coalesce("s_name", F.lit("")), F.lit(" (No."), F.col("s_suppkey") % 7, F.lit(") /a_b-c "))
    return S.table(spark, d, "supplier").select("s_suppkey", V.norm_key_ascii(name).alias("name_key"), V.identity_key(F.col("s_suppkey"), name).alias("identity_key"))


@query()
def identity_key_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "pages").select("page_id", V.norm_key(F.col("url")).alias("url_key"), V.norm_text(F.col("url")).alias("url_text"))


@query("""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN 'E' || lpad((c_custkey % 99999)::VARCHAR, 5, '0') || '0001' ELSE c_name END AS id,
      CASE WHEN c_custkey % 3 = 0 THEN c_nationkey || '.0' WHEN c_custkey % 3 = 1 THEN '  ' ELSE c_nationkey::VARCHAR END AS code FROM customer)
    SELECT c_custkey, nullif(regexp_extract(id, '^E([0-9]{5})', 1), '') AS id_code, regexp_replace(nullif(trim(code), ''), '^([0-9]+)\\.0$', '\\1') AS
        clean_code FROM t""")
def municipality_code(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    ident = F.when(k % 4 > 0, F.concat(F.lit("E"), F.lpad((k % 99999).cast("string"), 5, "0"), F.lit("0001"))).otherwise(F.col("c_name"))
    code = F.when(k % 3 == 0, F.concat(n, F.lit(".0"))).when(k % 3 == 1, "  ").otherwise(n)
    return S.table(spark, d, "customer").select("c_custkey", V.code_from_id(ident).alias("id_code"), V.normal_code(code).alias("clean_code"))


@query("""SELECT n_nationkey, CASE WHEN n_name = 'NATION_1' THEN '01' WHEN n_name = 'NATION_2' THEN '02' WHEN contains('x' || n_name, 'NATION_1') THEN '01'
    WHEN contains('x' || n_name, 'NATION_2') THEN '02' END AS code, lower(n_nationkey % 2 = 0) = 'true' AS even FROM nation""".replace("lower(n_nationkey % 2 = 0) = 'true'", "n_nationkey % 2 = 0"))
def city_code_and_truth(spark: SparkSession, d: str) -> DataFrame:
    code = V.code_from_city(F.col("n_name"), {"NATION_1": "01", "NATION_2": "02"})
    return S.table(spark, d, "nation").select("n_nationkey", code.alias("code"), V.truthy(F.when(F.col("n_nationkey") % 2 == 0, "True").otherwise("no")).alias("even"))


@query("""SELECT event_id, greatest(0, round_even(value * 10, 0))::BIGINT AS demand_units, greatest(0, floor(value * 10 + 1e-9))::BIGINT AS capacity_units,
    (round_even(value * 10, 0)::BIGINT * 100 + event_id % 10)::BIGINT AS walk_cost FROM (SELECT event_id, value + 0.001 AS value FROM events)""")
def fixed_point(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") + 0.001  # away from ties, which binary and decimal rounding settle differently
    return S.table(spark, d, "events").select(
        "event_id", V.demand_units(v).alias("demand_units"), V.capacity_units(v).alias("capacity_units"), V.walk_cost(v, F.col("event_id") % 10).alias("walk_cost")
    )


@query("""SELECT user_id, len(list_distinct(list_filter(['a' || user_id % 3, '', 'b', 'b'], lambda x: x <> ''))) AS ids FROM (SELECT DISTINCT user_id FROM
        events)""")
def id_list(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("a"), F.col("user_id") % 3, F.lit(", ,b,b"))
    return S.table(spark, d, "events").select("user_id").distinct().select("user_id", F.size(V.id_set(text)).cast("long").alias("ids"))


# --- joins and deduplication


SHELTER_REF = """ref AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 0 THEN 'dup' ELSE 'id' || s_suppkey END AS id,
    'n' || (s_suppkey // 2 * (s_suppkey % 4 // 2)) AS name, s_acctbal AS lat FROM supplier),
    src AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'dup' WHEN s_suppkey % 3 = 1 THEN NULL ELSE 'id' || s_suppkey END AS id,
    'n' || (s_suppkey // 2 * (s_suppkey % 4 // 2)) AS name FROM supplier)"""


def _reference(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = S.table(spark, d, "supplier")
    name = "concat('n', (s_suppkey div 2) * ((s_suppkey % 4) div 2)) AS name"
    ref = s.selectExpr("s_suppkey AS k", "CASE WHEN s_suppkey % 10 = 0 THEN 'dup' ELSE concat('id', s_suppkey) END AS id", name, "s_acctbal AS lat")
    src = s.selectExpr("s_suppkey AS k", "CASE WHEN s_suppkey % 3 = 0 THEN 'dup' WHEN s_suppkey % 3 = 1 THEN NULL ELSE concat('id', s_suppkey) END AS id", name)
    return src, ref


@query(f"""WITH {SHELTER_REF}, by_id AS (SELECT id, any_value(lat) AS lat FROM ref WHERE id IS NOT NULL GROUP BY id HAVING count(*) = 1),
      by_name AS (SELECT name, any_value(lat) AS lat FROM ref WHERE name IS NOT NULL GROUP BY name HAVING count(*) = 1)
    SELECT k, CASE WHEN a.id IS NOT NULL THEN a.lat WHEN b.name IS NOT NULL THEN b.lat END AS lat,
      CASE WHEN a.id IS NOT NULL THEN 'common_id' WHEN b.name IS NOT NULL THEN 'name' ELSE 'unmatched' END AS method
    FROM src LEFT JOIN by_id a USING (id) LEFT JOIN by_name b ON b.name = src.name""")
def shelter_join_cascade(spark: SparkSession, d: str) -> DataFrame:
    src, ref = _reference(spark, d)
    return relational.cascade_lookup(src, [(["id"], ref, "common_id"), (["name"], ref, "name")], ["lat"], "method").select("k", "lat", "method")


@query("""WITH t AS (SELECT o_orderkey, o_custkey AS a, o_orderstatus AS b, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS value FROM orders),
      ab AS (SELECT a, b, min(value) AS v FROM t WHERE value IS NOT NULL GROUP BY a, b HAVING count(DISTINCT value) = 1),
      one AS (SELECT a, min(value) AS v FROM t WHERE value IS NOT NULL GROUP BY a HAVING count(DISTINCT value) = 1)
    SELECT o_orderkey, coalesce(value, ab.v, one.v) AS value, CASE WHEN value IS NOT NULL THEN 'existing' WHEN ab.v IS NOT NULL THEN 'a+b' WHEN one.v IS NOT
        NULL THEN 'a' ELSE 'unresolved' END AS value_source
    FROM t LEFT JOIN ab USING (a, b) LEFT JOIN one ON one.a = t.a""")
def resolver_cascade(spark: SparkSession, d: str) -> DataFrame:
    t = S.table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey AS a", "o_orderstatus AS b", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS value")
    return relational.resolver(t, t, "value", [["a", "b"], ["a"]]).select("o_orderkey", "value", "value_source")


@query("""SELECT s_nationkey, sum(CASE WHEN s_acctbal >= 20 THEN floor(s_acctbal / 20) END)::DOUBLE AS capacity, count(*) AS records,
    string_agg(DISTINCT CASE WHEN s_acctbal >= 20 THEN 'numeric' ELSE 'missing' END, ';' ORDER BY CASE WHEN s_acctbal >= 20 THEN 'numeric' ELSE 'missing' END)
        AS statuses,
    count(DISTINCT s_name) > 1 AS ambiguous FROM supplier GROUP BY s_nationkey""")
def shelter_capacity_collapse(spark: SparkSession, d: str) -> DataFrame:
    s = S.table(spark, d, "supplier").selectExpr("s_nationkey", "CASE WHEN s_acctbal >= 20 THEN CAST(floor(s_acctbal / 20) AS DOUBLE) END AS c", "CASE WHEN s_acctbal >= 20 THEN 'numeric' ELSE 'missing' END AS st", "s_name")
    return relational.collapse_capacity(s, "s_nationkey", "c", "st", "s_name")


@query("SELECT o_custkey, count(*) AS rows FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    from terrafold.operators.gates import unique_key

    return unique_key(S.table(spark, d, "orders"), ["o_custkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def argmin_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return relational.keep_best(S.table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(S.with_views("t_mesh", "t_candidate") + """ SELECT 'missing' AS side, mesh_id FROM t_mesh WHERE mesh_id NOT IN (SELECT mesh_id FROM t_candidate)
    UNION ALL SELECT 'extra', shelter_key FROM (SELECT DISTINCT shelter_key FROM t_candidate) WHERE shelter_key NOT IN (SELECT s_suppkey FROM supplier WHERE
        s_acctbal >= 2000)""")
def missing_extra_ids(spark: SparkSession, d: str) -> DataFrame:
    c = S.candidates(spark, d)
    missing, _ = relational.missing_extra(S.meshes(spark, d), c, "mesh_id")
    _, extra = relational.missing_extra(S.shelters(spark, d).where("capacity >= 100"), c, "shelter_key")
    return missing.select(F.lit("missing").alias("side"), "mesh_id").unionByName(extra.select(F.lit("extra").alias("side"), F.col("shelter_key").alias("mesh_id")))


@query(S.with_views("t_candidate") + """, a AS (SELECT * FROM t_candidate WHERE candidate_rank = 1), b AS (SELECT mesh_id, CASE WHEN mesh_id % 7 > 0 THEN
        shelter_key + (mesh_id % 20 = 0)::INT END AS shelter_key, CASE WHEN mesh_id % 7 > 0 THEN total_walking_distance_m + (mesh_id % 30 = 0)::INT END AS dist
        FROM a)
    SELECT a.mesh_id, a.shelter_key IS NOT DISTINCT FROM b.shelter_key AS identity_match, round(total_walking_distance_m - dist, 6) AS distance_delta,
      coalesce(abs(total_walking_distance_m - dist) <= 1e-6, total_walking_distance_m IS NULL AND dist IS NULL) AS distance_match FROM a LEFT JOIN b USING
        (mesh_id)""")
def parity_check(spark: SparkSession, d: str) -> DataFrame:
    a = first_candidates(spark, d)
    b = a.selectExpr(
        "mesh_id",
        "CASE WHEN mesh_id % 7 > 0 THEN shelter_key + CAST(mesh_id % 20 = 0 AS INT) END AS shelter_key",
        "CASE WHEN mesh_id % 7 > 0 THEN total_walking_distance_m + CAST(mesh_id % 30 = 0 AS INT) END AS total_walking_distance_m",
    )
    p = relational.parity(a, b, ["mesh_id"], "shelter_key", "total_walking_distance_m", 1e-6)
    return p.select("mesh_id", "identity_match", r6("distance_delta"), "distance_match")


@query(S.with_views("t_candidate") + " SELECT mesh_id, shelter_key, candidate_rank::INT AS candidate_rank, round(total_walking_distance_m, 6) AS total_walking_distance_m FROM t_candidate")
def candidates_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.candidates(spark, d).select("mesh_id", "shelter_key", "candidate_rank", r6("total_walking_distance_m"))


@query(S.with_views("t_candidate") + """, t AS (SELECT mesh_id, candidate_rank + (mesh_id % 25 = 0)::INT AS candidate_rank, total_walking_distance_m FROM
        t_candidate)
    SELECT mesh_id, max(candidate_rank)::INT AS max_rank, count(*) AS rows FROM t GROUP BY mesh_id HAVING max(candidate_rank) <> count(*)""")
def rank_validation(spark: SparkSession, d: str) -> DataFrame:
    t = S.candidates(spark, d).withColumn("candidate_rank", (F.col("candidate_rank") + (F.col("mesh_id") % 25 == 0).cast("int")).cast("int"))
    return relational.rank_gaps(t, ["mesh_id"], "candidate_rank", "total_walking_distance_m").select("mesh_id", "max_rank", "rows")


# --- pressure, scores, robustness, what-if


def pressures(spark: SparkSession, d: str) -> DataFrame:
    base = scoring.demand(scoring.targets(S.meshes(spark, d))).join(first_candidates(spark, d), "mesh_id")
    return scoring.shelter_pressure(base, S.shelters(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shelter_pressure(spark, sf_dir)


@query(RISK + """ SELECT shelter_key, assigned_mesh_count, round(assigned_demand_area_weighted, 6) AS assigned_demand_area_weighted,
        round(assigned_demand_full_mesh, 6) AS assigned_demand_full_mesh,
    capacity, round(capacity_pressure_area_weighted, 6) AS capacity_pressure_area_weighted, round(capacity_pressure_full_mesh, 6) AS capacity_pressure_full_mesh
        FROM pressure""")
def shelter_pressure(spark: SparkSession, d: str) -> DataFrame:
    p = pressures(spark, d)
    names = ["assigned_demand_area_weighted", "assigned_demand_full_mesh", "capacity_pressure_area_weighted", "capacity_pressure_full_mesh"]
    return p.select("shelter_key", "assigned_mesh_count", "capacity", *[r6(n) for n in names])


@query(RISK + """ SELECT round(sum(demand_area_weighted), 6) AS total, round(sum(demand_area_weighted) FILTER (WHERE ready), 6) AS assigned,
    round(sum(demand_area_weighted) FILTER (WHERE NOT ready), 6) AS unassigned FROM base""")
def demand_conservation(spark: SparkSession, d: str) -> DataFrame:
    base = scoring.demand(scoring.targets(S.meshes(spark, d))).join(first_candidates(spark, d), "mesh_id", "left")
    x, ready = F.col("demand_area_weighted"), F.col("shelter_key").isNotNull()
    return base.agg(r6("total", F.sum(x)), r6("assigned", F.sum(F.when(ready, x))), r6("unassigned", F.sum(F.when(~ready, x))))


@query(RISK + " SELECT round(low, 6) AS low, round(high, 6) AS high FROM bounds")
def walking_bounds(spark: SparkSession, d: str) -> DataFrame:
    base = scoring.targets(S.meshes(spark, d)).join(first_candidates(spark, d), "mesh_id")
    low, high = scoring.quantile_bounds(base, "total_walking_distance_m")
    return spark.range(1).select(r6("low", F.lit(low)), r6("high", F.lit(high)))


@query(RISK + " SELECT round(low, 6) AS low, round(high, 6) AS high FROM bounds")
def walking_bounds_in_plan(spark: SparkSession, d: str) -> DataFrame:
    base = scoring.targets(S.meshes(spark, d)).join(first_candidates(spark, d), "mesh_id")
    return scoring.bounds_in_plan(base, "total_walking_distance_m").select(r6("low"), r6("high"))


SCORES = ["core_score", "core_score_lower", "core_score_upper", "full_score", "full_score_lower", "full_score_upper", "full_score_full_mesh"]


@query(RISK + f""" SELECT mesh_id, score_status, uncertain AS route_exposure_uncertainty_flag, round(wa, 6) AS walking_accessibility_component,
        {', '.join(f'round({s}, 6) AS {s}' for s in SCORES)} FROM risk""")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    return risk(spark, d).select("mesh_id", "score_status", "route_exposure_uncertainty_flag", r6("walking_accessibility_component"), *[r6(s) for s in SCORES])


@query(RISK + """ SELECT mesh_id, ((te IS NOT NULL)::INT + (vp IS NOT NULL)::INT + (wa IS NOT NULL)::INT + (rp IS NOT NULL)::INT) / 4.0::DOUBLE AS
        core_data_completeness,
    round(((te IS NOT NULL)::INT + (vp IS NOT NULL)::INT + (wa IS NOT NULL)::INT + (rp IS NOT NULL)::INT + (pa IS NOT NULL)::INT) / 5.0::DOUBLE, 6) AS
        data_completeness FROM risk""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return risk(spark, d).select("mesh_id", "core_data_completeness", r6("data_completeness"))


@query(RISK + " SELECT score_status, count(*) AS n FROM risk GROUP BY score_status")
def score_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return risk(spark, d).groupBy("score_status").agg(F.count(F.lit(1)).alias("n"))


_REASONS = " UNION ALL ".join(
    f"SELECT mesh_id, {i} AS i, '{k}' AS key, {c} AS s, {c} * {w / 100.0!r} AS w FROM risk WHERE {c} IS NOT NULL"
    for i, ((k, w), c) in enumerate(zip(V.FULL_WEIGHTS.items(), ("te", "vp", "wa", "rp", "pa"), strict=True))
)


@query(RISK + f""", items AS ({_REASONS}), ranked AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY round(w, 3) DESC, i) AS place FROM items)
    SELECT mesh_id, place::INT AS place, key FROM ranked WHERE place <= 2""")
def risk_reasons_top(spark: SparkSession, d: str) -> DataFrame:
    items = V.reasons({k: F.col(c) for k, c in scoring.COMPONENTS.items()})
    return risk(spark, d).select("mesh_id", F.posexplode(F.slice(items, 1, 2)).alias("p", "r")).select("mesh_id", (F.col("p") + 1).alias("place"), "r.key")


def ranks(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rank_scenarios(risk(spark, d).where("score_status = 'complete'"), scoring.weight_scenarios())


_SCENARIOS = " UNION ALL ".join(
    f"SELECT '{name}' AS scenario, mesh_id, {weighted(weights=tuple(float(x) for x in w.values()))} AS score FROM risk WHERE score_status = 'complete'" for name, w in scoring.weight_scenarios().items()
)
RANKS = RISK + f", scores AS ({_SCENARIOS}), ranks AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY score DESC) AS rank FROM scores)"


@query(RANKS + " SELECT scenario, mesh_id, round(score, 6) AS score FROM ranks")
def weight_scenarios_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranks(spark, d).select("scenario", "mesh_id", r6("score"))


@query(RANKS + " SELECT mesh_id, min(rank) AS best_rank, max(rank) AS worst_rank, max(rank) - min(rank) AS rank_range, median(rank) AS median_rank FROM ranks GROUP BY mesh_id")
def rank_range(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rank_summary(ranks(spark, d))


@query(RANKS + """, placed AS (SELECT mesh_id, row_number() OVER (PARTITION BY scenario ORDER BY rank, mesh_id::VARCHAR) AS p, count(*) OVER (PARTITION BY
        scenario) AS n FROM ranks)
    SELECT mesh_id FROM placed GROUP BY mesh_id HAVING bool_and(p <= greatest(1, ceil(n * 0.1)))""")
def robust_top(spark: SparkSession, d: str) -> DataFrame:
    return scoring.robust_top(ranks(spark, d), share=0.1)


@query(RANKS + """, b AS (SELECT mesh_id, rank AS base FROM ranks WHERE scenario = 'baseline') SELECT scenario, round(corr(rank, base), 6) AS spearman FROM
        ranks JOIN b USING (mesh_id) GROUP BY scenario""")
def rank_corr(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rank_corr(ranks(spark, d)).select("scenario", r6("spearman"))


DELTAS = (100.0, 500.0, 1000.0)
WHATIF = RISK + f""", runs AS (SELECT p.*, delta, assigned_demand_area_weighted / (capacity + delta) AS simulated_pressure FROM pressure p CROSS JOIN (SELECT
        unnest([100.0, 500.0, 1000.0])::DOUBLE AS delta) WHERE capacity > 0),
    sim AS (SELECT runs.delta, runs.shelter_key, runs.capacity_pressure_area_weighted, runs.simulated_pressure,
      greatest(0.0, full_score - {clip(f"(te * 25.0 + vp * 20.0 + wa * 25.0 + rp * 15.0 + ({clip('runs.simulated_pressure * 100')}) * 15.0) / 100.0")}) AS
        reduction, full_score
      FROM runs LEFT JOIN risk r ON r.shelter_key = runs.shelter_key AND score_status = 'complete'),
    whatif AS (SELECT delta, shelter_key, capacity_pressure_area_weighted, simulated_pressure, count(full_score) AS affected_complete_meshes,
      coalesce(sum(reduction) FILTER (WHERE full_score IS NOT NULL), 0) AS total_score_reduction FROM sim GROUP BY ALL)"""


@query(WHATIF + """ SELECT delta, shelter_key, round(simulated_pressure, 6) AS simulated_pressure, affected_complete_meshes, round(total_score_reduction + 1e-8,
        6) AS total_score_reduction,
    capacity_pressure_area_weighted > 1 AND simulated_pressure <= 1 AS resolved_over_capacity FROM whatif""")
def whatif_capacity(spark: SparkSession, d: str) -> DataFrame:
    r = risk(spark, d)
    known = pressures(spark, d)
    w = scoring.what_if_capacity(r, known, DELTAS)
    return w.select("delta", "shelter_key", r6("simulated_pressure"), "affected_complete_meshes", r6("total_score_reduction", F.col("total_score_reduction") + 1e-8), "resolved_over_capacity")


@query(WHATIF + """, o AS (SELECT *, row_number() OVER (PARTITION BY delta ORDER BY round(total_score_reduction, 6) DESC, (capacity_pressure_area_weighted > 1
        AND simulated_pressure <= 1)::INT DESC, simulated_pressure, shelter_key::VARCHAR) AS place FROM whatif)
    SELECT delta, place::INT AS place, round(total_score_reduction + 1e-8, 6) AS total_score_reduction FROM o WHERE place <= 12""")
def whatif_ranking(spark: SparkSession, d: str) -> DataFrame:
    r = risk(spark, d)
    known = pressures(spark, d)
    return scoring.what_if_ranking(scoring.what_if_capacity(r, known, DELTAS)).select("delta", "place", r6("total_score_reduction", F.col("total_score_reduction") + 1e-8))


@query(WHATIF + """, per AS (SELECT delta, count(*) FILTER (WHERE simulated_pressure > 1) AS overloaded FROM whatif GROUP BY delta)
    SELECT delta, overloaded, coalesce(overloaded <= lag(overloaded) OVER (ORDER BY delta), true) AS monotone FROM per""")
def whatif_monotone(spark: SparkSession, d: str) -> DataFrame:
    r = risk(spark, d)
    known = pressures(spark, d)
    per = scoring.what_if_capacity(r, known, DELTAS).groupBy("delta").agg(F.count_if("simulated_over_capacity").alias("overloaded"))
    return per.selectExpr("delta", "overloaded", "coalesce(overloaded <= lag(overloaded) OVER (ORDER BY delta), true) AS monotone")


@query(RISK + """ SELECT 'score_in_bounds' AS gate, 'failure' AS severity, count(*) FILTER (WHERE full_score < 0 OR full_score > 100) AS failures, true AS
        passed FROM risk
    UNION ALL SELECT 'bounds_ordered', 'failure', count(*) FILTER (WHERE core_score_lower > core_score + 1e-9 OR core_score > core_score_upper + 1e-9), count(*)
        FILTER (WHERE core_score_lower > core_score + 1e-9 OR core_score > core_score_upper + 1e-9) <= 0 FROM risk
    UNION ALL SELECT 'no_score_without_route', 'failure', count(*) FILTER (WHERE NOT ready AND core_score IS NOT NULL), true FROM risk
    UNION ALL SELECT 'capacity_known', 'warning', count(*) FILTER (WHERE score_status = 'core_only_missing_capacity'), count(*) FILTER (WHERE score_status =
        'core_only_missing_capacity') <= 0 FROM risk""")
def score_gates(spark: SparkSession, d: str) -> DataFrame:
    r = risk(spark, d)
    c = F.col
    return evaluate(
        [
            Gate("score_in_bounds", r, (c("full_score") < 0) | (c("full_score") > 100)),
            Gate("bounds_ordered", r, (c("core_score_lower") > c("core_score") + 1e-9) | (c("core_score") > c("core_score_upper") + 1e-9)),
            Gate("no_score_without_route", r, ~c("ready") & c("core_score").isNotNull()),
            Gate("capacity_known", r, c("score_status") == "core_only_missing_capacity", severity="warning"),
        ]
    )


# --- spatial


MESH_CODE = "lpad((30 + c_custkey % 30)::VARCHAR, 2, '0') || lpad((22 + c_custkey % 25)::VARCHAR, 2, '0') || (c_custkey % 8) || (c_custkey // 8 % 8) || (c_custkey % 10) || (c_custkey // 10 % 10) || (c_custkey % 4 + 1)"


def mesh_codes(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "customer").selectExpr(
        "c_custkey",
        "concat(30 + c_custkey % 30, 22 + c_custkey % 25, c_custkey % 8, (c_custkey div 8) % 8, c_custkey % 10, (c_custkey div 10) % 10, c_custkey % 4 + 1) AS mesh_id",
    )


@query(f"""WITH t AS (SELECT c_custkey, {MESH_CODE} AS code FROM customer), q AS (SELECT *, code[9]::INT AS quadrant FROM t)
    SELECT c_custkey, round(code[1:2]::INT / 1.5 + code[5]::INT / 12.0 + code[7]::INT / 120.0 + CASE WHEN quadrant IN (2, 4) THEN 1 / 240.0 ELSE 0 END + 1 /
        480.0, 9) AS lat,
      round(100 + code[3:4]::INT + code[6]::INT / 8.0 + code[8]::INT / 80.0 + CASE WHEN quadrant IN (3, 4) THEN 1 / 160.0 ELSE 0 END + 1 / 320.0, 9) AS lon,
        true AS found_again FROM q""")
def mesh_polygon_centroid(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = geo.mesh_centroid(F.col("mesh_id"))
    m = mesh_codes(spark, d).select("c_custkey", "mesh_id", lat.alias("lat"), lon.alias("lon"))
    again = geo.mesh_of_point(F.col("lon"), F.col("lat")) == F.col("mesh_id")
    return m.select("c_custkey", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), again.alias("found_again"))


TILE = """t AS (SELECT vec_id, 130 + embedding[1]::DOUBLE * 5 AS lon, 33 + embedding[2]::DOUBLE * 5 AS lat FROM embeddings),
    f AS (SELECT vec_id, (lon + 180) / 360 * 4096 AS xf, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096 AS yf FROM t)"""


def lonlat(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "embeddings").select("vec_id", (130 + F.col("embedding")[0].cast("double") * 5).alias("lon"), (33 + F.col("embedding")[1].cast("double") * 5).alias("lat"))


@query(f"WITH {TILE} SELECT vec_id, floor(xf)::INT AS x, floor(yf)::INT AS y, floor((xf - floor(xf)) * 256)::INT AS px, floor((yf - floor(yf)) * 256)::INT AS py FROM f")
def tile_address(spark: SparkSession, d: str) -> DataFrame:
    return lonlat(spark, d).select("vec_id", geo.tile_address(F.col("lon"), F.col("lat")).alias("t")).select("vec_id", "t.*")


RGB = "p_partkey, 200 + p_partkey % 56 AS r, 100 + p_partkey * 7 % 156 AS g, 140 + p_partkey * 13 % 116 AS b"
_NEAR = ", ".join(f"{{'d': (r - {c[0]}) * (r - {c[0]}) + (g - {c[1]}) * (g - {c[1]}) + (b - {c[2]}) * (b - {c[2]}), 'k': {k}}}" for k, c in geo.PALETTE.items())


@query(f"WITH t AS (SELECT {RGB} FROM part), n AS (SELECT p_partkey, list_min([{_NEAR}]) AS best FROM t) SELECT p_partkey, CASE WHEN best.d <= 900 THEN best.k END::INT AS depth FROM n")
def palette_class(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "part").selectExpr("p_partkey", "200 + p_partkey % 56 AS r", "100 + p_partkey * 7 % 156 AS g", "140 + p_partkey * 13 % 116 AS b").select(
        "p_partkey", geo.classify_rgb(F.col("r"), F.col("g"), F.col("b")).alias("depth")
    )


@query(S.with_views("t_sample") + """ SELECT route_id, count(*) AS sample_count, count(*) FILTER (WHERE depth_class > 0) AS inundated_sample_count,
        round(count(*) FILTER (WHERE depth_class > 0) / count(*)::DOUBLE, 6) AS inundation_ratio,
    max(CASE WHEN depth_class > 0 THEN depth_class END)::INT AS max_depth_class, round(count(*) FILTER (WHERE depth_class > 0) / count(*)::DOUBLE * 100, 6) AS
        exposure_score FROM t_sample GROUP BY route_id""")
def zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    z = spatial.zonal_stats(S.samples(spark, d), "route_id", "depth_class")
    return z.select("route_id", "sample_count", "inundated_sample_count", r6("inundation_ratio"), "max_depth_class", r6("exposure_score"))


@query(S.with_views("t_sample") + """, s AS (SELECT route_id, sum(sample_length_m) AS t, count(*) AS n, coalesce(sum(sample_length_m) FILTER (WHERE depth_class
        IS NULL), 0) AS u,
      coalesce(sum(sample_length_m) FILTER (WHERE depth_class > 0), 0) AS w, max(CASE WHEN depth_class > 0 THEN depth_class END)::INT AS m FROM t_sample GROUP
        BY route_id)
    SELECT route_id, n AS samples, m AS max_depth_class, round(w / t, 6) AS route_inundation_ratio, round(u / t, 6) AS route_unknown_ratio,
      round(CASE WHEN t - u > 1e-9 THEN w / (t - u) END, 6) AS route_inundation_ratio_classified FROM s""")
def route_samples_exposure(spark: SparkSession, d: str) -> DataFrame:
    e = spatial.route_exposure(S.samples(spark, d))
    return e.select("route_id", "samples", "max_depth_class", *[r6(c) for c in ("route_inundation_ratio", "route_unknown_ratio", "route_inundation_ratio_classified")])


@query(S.with_views("t_sample") + """, m AS (SELECT *, coalesce(depth_class, -1) AS c FROM t_sample), f AS (SELECT *, CASE WHEN c IS DISTINCT FROM lag(c) OVER w
        THEN 1 ELSE 0 END AS change FROM m WINDOW w AS (PARTITION BY route_id ORDER BY ts, event_id)),
      g AS (SELECT *, sum(change) OVER (PARTITION BY route_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
    SELECT route_id, run::BIGINT AS run, c::INT AS depth_class, count(*) AS samples, round(sum(sample_length_m), 6) AS run_length FROM g WHERE c > 0 GROUP BY
        route_id, run, c""")
def inundated_segments(spark: SparkSession, d: str) -> DataFrame:
    return spatial.inundated_segments(S.samples(spark, d)).select("route_id", "run", "depth_class", "samples", r6("run_length"))

@query(
    S.with_views("t_sample")
    + """, m AS (SELECT *, coalesce(depth_class, -1) AS c FROM t_sample),
      f AS (SELECT *, CASE WHEN c IS DISTINCT FROM lag(c) OVER w THEN 1 ELSE 0 END AS change FROM m WINDOW w AS (ORDER BY ts, event_id)),
      g AS (SELECT *, sum(change) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
    SELECT run::BIGINT AS run, c::INT AS depth_class, count(*) AS samples, round(sum(sample_length_m), 6) AS run_length FROM g WHERE c > 0 GROUP BY run, c"""
)
def segments_of_one_route(spark: SparkSession, d: str) -> DataFrame:
    """All samples as one route, which is dealt over slices of time."""
    one = S.samples(spark, d).withColumn("route_id", F.lit("all"))
    return spatial.inundated_segments(one, large=1000).select("run", "depth_class", "samples", r6("run_length"))



@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS tx, embedding[4]::DOUBLE AS ty FROM
        embeddings),
      q AS (SELECT a.vec_id AS point_id, b.vec_id AS target_id, sqrt((a.x - b.tx) ** 2 + (a.y - b.ty) ** 2) AS dist FROM p a CROSS JOIN p b),
      n AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY dist, target_id) AS rn FROM q WHERE dist <= 0.05)
    SELECT point_id, target_id, round(dist, 6) AS distance FROM n WHERE rn = 1""")
def nearest_snap(spark: SparkSession, d: str) -> DataFrame:
    """Points are the first two elements of the vectors, targets the next two."""
    at = lambda i, name: F.col("embedding")[i].cast("double").alias(name)
    e = S.table(spark, d, "embeddings")
    points, targets = e.select(F.col("vec_id").alias("point_id"), at(0, "x"), at(1, "y")), e.select(F.col("vec_id").alias("target_id"), at(2, "x"), at(3, "y"))
    return spatial.nearest(points, targets, 0.05).select("point_id", "target_id", r6("distance"))


@query("""WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS cx, embedding[4]::DOUBLE AS cy FROM
        embeddings)
    SELECT a.vec_id AS point_id, min(b.vec_id) AS polygon_id FROM p a JOIN p b ON abs(a.x - b.cx) + abs(a.y - b.cy) <= 0.02 GROUP BY 1""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Points are the first two elements of the vectors, the next two the middle of a diamond; the first diamond wins."""
    at = lambda i: F.col("embedding")[i].cast("double")
    e = S.table(spark, d, "embeddings")
    corner = lambda dx, dy: F.struct((at(2) + dx).alias("x"), (at(3) + dy).alias("y"))
    diamonds = e.select(
        F.col("vec_id").alias("polygon_id"), F.col("vec_id").alias("place"), F.array(corner(0.02, 0), corner(0, 0.02), corner(-0.02, 0), corner(0, -0.02), corner(0.02, 0)).alias("ring")
    )
    points = e.select(F.col("vec_id").alias("point_id"), at(0).alias("x"), at(1).alias("y"))
    return spatial.covered_by(points, diamonds, 0.05, first_match=True)


# --- graph and allocation


@query(S.with_views("t_edge") + """ SELECT least(u, v) AS u, greatest(u, v) AS v, round(min(length), 6) AS length FROM t_edge GROUP BY 1, 2""")
def graph_collapse(spark: SparkSession, d: str) -> DataFrame:
    e = S.edges(spark, d).withColumn("context", F.lit("all"))
    return graph.collapse_graph(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), (F.col("length") + 5).alias("length"), "context"))).where("u < v").select("u", "v", r6("length"))


GRAPH = S.with_views("t_edge") + """, b AS (SELECT u AS x, v AS y, length FROM t_edge UNION ALL SELECT v, u, length FROM t_edge)"""


def one_graph(spark: SparkSession, d: str) -> DataFrame:
    return S.edges(spark, d).withColumn("context", F.lit("all"))


@query(GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + """, walk AS (SELECT 's0' AS node, 0.0::DOUBLE AS cost, 0 AS hops UNION ALL SELECT b.y, walk.cost +
        b.length, hops + 1 FROM walk JOIN b ON b.x = walk.node WHERE hops < 3)
    SELECT node, round(min(cost), 6) AS cost FROM walk GROUP BY node""")
def bounded_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """Least costs within three hops from one node: three rounds of relaxation, each a join and a minimum."""
    b = graph.collapse_graph(one_graph(spark, d)).select("u", "v", "length")
    labels = spark.sql("SELECT 's0' AS node, 0.0D AS cost")
    for _ in range(3):
        step = labels.join(b, labels["node"] == b["u"]).select(F.col("v").alias("node"), (F.col("cost") + F.col("length")).alias("cost"))
        labels = labels.unionByName(step).groupBy("node").agg(F.min("cost").alias("cost"))
    return labels.select("node", r6("cost"))


# The network of a municipality is one context: the edges of its shelters.
CONTEXTS = S.with_views("t_edge").replace("WITH ", "WITH RECURSIVE ", 1) + """, c AS (SELECT s_nationkey::VARCHAR AS context, u, v, length FROM t_edge JOIN
        supplier ON u = 's' || s_suppkey),
    b AS (SELECT context, u AS x, v AS y, length FROM c UNION ALL SELECT context, v, u, length FROM c),
    seed AS (SELECT DISTINCT context, u AS node, u AS source, 5.0::DOUBLE AS cost FROM c WHERE u[2:]::INT % 3 = 0),
    far(context, node, source, cost) USING KEY (context, node, source) AS (SELECT context, node, source, cost FROM seed
      UNION (SELECT s.context, s.y, s.source, s.cost FROM (SELECT far.context, b.y, far.source, min(far.cost + b.length) AS cost FROM far JOIN b ON b.context =
        far.context AND b.x = far.node GROUP BY ALL) s
        LEFT JOIN recurring.far r ON r.context = s.context AND r.node = s.y AND r.source = s.source WHERE r.cost IS NULL OR s.cost < r.cost - 1e-9))"""


def contexts(spark: SparkSession, d: str) -> DataFrame:
    s = S.table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("u"), F.col("s_nationkey").cast("string").alias("context"))
    return S.edges(spark, d).join(s, "u")


def _seeds(edges: DataFrame) -> DataFrame:
    nodes = edges.where("CAST(substring(u, 2) AS INT) % 3 = 0").select("context", F.col("u").alias("node")).distinct()
    return nodes.select("context", "node", F.col("node").alias("source"), F.lit(5.0).alias("cost"))


@query(CONTEXTS + """ SELECT context, node, arg_min(source, (round(cost, 9), source)) AS source, round(min(cost), 6) AS cost FROM far GROUP BY 1, 2""")
def dijkstra_nearest_owner(spark: SparkSession, d: str) -> DataFrame:
    e = contexts(spark, d)
    return graph.nearest_sources(graph.collapse_graph(e), _seeds(e)).select("context", "node", "source", r6("cost"))


# All edges as one context, which no task holds.
ONE_CONTEXT = S.with_views("t_edge").replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT u AS x, v AS y, length FROM t_edge UNION ALL SELECT v, u, length
        FROM t_edge),
    seed AS (SELECT DISTINCT u AS node, u AS source, 5.0::DOUBLE AS cost FROM t_edge WHERE u[2:]::INT % 3 = 0),
    far(node, source, cost) USING KEY (node, source) AS (SELECT node, source, cost FROM seed
      UNION (SELECT s.y, s.source, s.cost FROM (SELECT b.y, far.source, min(far.cost + b.length) AS cost FROM far JOIN b ON b.x = far.node GROUP BY ALL) s
        LEFT JOIN recurring.far r ON r.node = s.y AND r.source = s.source WHERE r.cost IS NULL OR s.cost < r.cost - 1e-9)),
    best AS (SELECT node, arg_min(source, (round(cost, 9), source)) AS source, min(cost) AS cost FROM far GROUP BY node),
    onward AS (SELECT a.node, arg_min(o.node, (o.cost, o.node)) AS next FROM best a JOIN b ON b.x = a.node JOIN best o ON o.node = b.y AND o.source = a.source
      WHERE round(o.cost + b.length, 9) = round(a.cost, 9) GROUP BY a.node)"""


def _one_context(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = one_graph(spark, d)
    return graph.collapse_graph(e), _seeds(e)


@query(ONE_CONTEXT + """ SELECT best.node, source, round(cost, 6) AS cost, CASE WHEN best.node <> source THEN next END AS next FROM best LEFT JOIN onward USING
        (node)""")
def delta_nearest_owner(spark: SparkSession, d: str) -> DataFrame:
    """Nearest source of every node of one large network, with the next node on the way, by joins."""
    return graph.nearest_by_joins(*_one_context(spark, d)).select("node", "source", r6("cost"), "next")


@query(ONE_CONTEXT + """, k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(cost, 9), source) AS r FROM far)
    SELECT node, source, round(cost, 6) AS cost FROM k WHERE r <= 3""")
def delta_three_nearest(spark: SparkSession, d: str) -> DataFrame:
    return graph.nearest_by_joins(*_one_context(spark, d), k=3).select("node", "source", r6("cost"))


@query(CONTEXTS + """, t AS (SELECT far.context, node AS mesh_id, source, cost + 1 AS total, row_number() OVER (PARTITION BY far.context, node ORDER BY
        round(cost, 9), source) AS k FROM far WHERE node[1] = 'p')
    SELECT context, mesh_id, source, k::INT AS candidate_rank, round(total, 6) AS total FROM t WHERE k <= 3""")
def k_label_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = contexts(spark, d)
    labels = graph.nearest_sources(graph.collapse_graph(e), _seeds(e), k=3)
    # A part may be in several networks: its origin is one for each.
    seeds = e.select(F.concat_ws(" ", "context", "v").alias("mesh_id"), "context", F.col("v").alias("node"), F.lit(1.0).alias("access")).distinct()
    ranked = graph.rank_candidates(seeds, labels, 3)
    return ranked.select(F.split("mesh_id", " ")[0].alias("context"), F.split("mesh_id", " ")[1].alias("mesh_id"), "source", "candidate_rank", r6("total"))


@query(GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + """, reach AS (SELECT DISTINCT x AS node, x AS other FROM b UNION SELECT reach.node, b.y FROM reach JOIN b
        ON b.x = reach.other)
    SELECT node, min(other) AS component FROM reach GROUP BY node""")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(one_graph(spark, d)).select("node", "component")


def _target_candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = scoring.demand(scoring.targets(S.meshes(spark, d)))
    return S.candidates(spark, d).join(base.select("mesh_id"), "mesh_id", "left_semi"), base


def _allocation(spark: SparkSession, d: str, runs: list[tuple[str, str, int, float]]) -> tuple[DataFrame, DataFrame]:
    """(flow, candidates with their capacity).  Targets and candidates are written once: gates, solver and summaries read them a dozen times."""
    base = stored(scoring.demand(scoring.targets(S.meshes(spark, d))), "targets")
    candidates = stored(S.candidates(spark, d).join(base.select("mesh_id"), "mesh_id", "left_semi"), "candidates")
    shelters = S.shelters(spark, d)
    return allocation.allocate(candidates, base, shelters, runs), allocation.prepare_candidates(candidates, shelters)


RUNS = [
    ("area_k10", "demand_area_weighted", 10, 0.0),
    ("area_k5", "demand_area_weighted", 5, 0.0),
    ("full_k10", "demand_full_mesh", 10, 0.0),
    ("full_k5", "demand_full_mesh", 5, 0.0),
]
BUDGETS = [0.0, 100.0, 500.0, 1000.0, 2000.0, 5000.0]
SWEEP = [(f"{name}_{b:05.0f}", column, 10, b) for name, column in (("area", "demand_area_weighted"), ("full", "demand_full_mesh")) for b in BUDGETS]


@query()
def allocation_summary(spark: SparkSession, d: str) -> DataFrame:
    return allocation.allocation_summary(*_allocation(spark, d, RUNS))


@query()
def allocation_flow(spark: SparkSession, d: str) -> DataFrame:
    return allocation.mesh_results(*_allocation(spark, d, RUNS))


@query()
def investment_sweep(spark: SparkSession, d: str) -> DataFrame:
    return allocation.allocation_summary(*_allocation(spark, d, SWEEP))


@query()
def investment_plans(spark: SparkSession, d: str) -> DataFrame:
    return allocation.investment_plan(*_allocation(spark, d, SWEEP))


# With the first candidate alone a shelter takes its nearest meshes first, and a budget the nearest of all that are left.
CURVES = [(name.replace("_", "_first_"), column, 1, b) for name, column, _, b in SWEEP]
FIRST_SQL = S.with_views("t_mesh", "t_candidate", "t_shelter") + """,
    target AS (SELECT mesh_id, total_population AS p, tsunami_inundation_ratio AS w FROM t_mesh WHERE tsunami_inundation_ratio > 0),
    demand AS (SELECT mesh_id, 'area' AS s, round_even(p * w * 10, 0)::BIGINT AS units FROM target UNION ALL SELECT mesh_id, 'full', (p * 10)::BIGINT FROM
        target),
    first AS (SELECT mesh_id, shelter_key, floor(capacity * 10 + 1e-9)::BIGINT AS cap, round_even(total_walking_distance_m * 10, 0)::BIGINT * 100 + 1 AS cost
      FROM t_candidate JOIN t_shelter USING (shelter_key) WHERE candidate_rank = 1 AND capacity > 0),
    queue AS (SELECT *, coalesce(sum(units) OVER (PARTITION BY s, shelter_key ORDER BY cost, mesh_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS
        before
      FROM demand JOIN first USING (mesh_id)),
    fit AS (SELECT *, greatest(0, least(units, cap - before)) AS served FROM queue),
    rest AS (SELECT *, units - served AS r, coalesce(sum(units - served) OVER (PARTITION BY s ORDER BY cost, mesh_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1
        PRECEDING), 0) AS ahead FROM fit),
    base AS (SELECT s, sum(units) AS units FROM demand GROUP BY s),
    run AS (SELECT s, b, s || '_first_' || lpad(b::VARCHAR, 5, '0') AS run_id FROM base, (VALUES (0), (100), (500), (1000), (2000), (5000)) v(b)),
    paid AS (SELECT run_id, any_value(b) AS b, s, sum(served) AS served, sum(greatest(0, least(r, b * 10 - ahead))) AS added,
      sum(served * cost::HUGEINT) AS walked, sum(greatest(0, least(r, b * 10 - ahead)) * (cost + 1)::HUGEINT) AS more FROM run JOIN rest USING (s) GROUP BY
        run_id, s),
    curve AS (SELECT run_id, s, b, added::BIGINT AS added_units, (units - served - added)::BIGINT AS unserved_units,
      ((units - served - added) * 1000000000::HUGEINT + walked + more)::BIGINT AS objective_cost FROM paid JOIN base USING (s))"""


def first_candidate_curves(spark: SparkSession, d: str) -> DataFrame:
    candidates, base = _target_candidates(spark, d)
    return allocation.merged_curves(allocation.capacity_curves(candidates, base, S.shelters(spark, d), CURVES), CURVES)


@query(FIRST_SQL + " SELECT run_id, added_units, unserved_units, objective_cost FROM curve")
def investment_curves(spark: SparkSession, d: str) -> DataFrame:
    """What budgets buy, from the parts' curves merged by what a unit saves."""
    return first_candidate_curves(spark, d).withColumn("objective_cost", F.col("objective_cost").cast("long"))


@query(S.with_views("t_shelter") + """, a AS (SELECT shelter_key, capacity FROM t_shelter WHERE municipality_code < 15 AND capacity > 0), b AS (SELECT
        shelter_key, capacity / 2 AS c2 FROM t_shelter WHERE municipality_code > 8 AND capacity > 0),
    j AS (SELECT a.capacity AS x, b.c2 AS y FROM a FULL JOIN b USING (shelter_key))
    SELECT count(x) AS left_shelters, count(y) AS right_shelters, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS shared_shelters,
      round(count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / count(*)::DOUBLE, 6) AS shelter_jaccard, coalesce(sum(least(x, y)) FILTER (WHERE x IS NOT
        NULL AND y IS NOT NULL), 0) AS shared_capacity,
      round(least(1.0, coalesce(sum(least(x, y)) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL), 0) / 5000.0)::DOUBLE, 6) AS shared_capacity_share FROM j""")
def plan_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = S.shelters(spark, d)
    left = s.where("municipality_code < 15").select("shelter_key", F.col("capacity").alias("added"))
    right = s.where("municipality_code > 8").select("shelter_key", (F.col("capacity") / 2).alias("added"))
    o = relational.plan_overlap(left, right, "shelter_key", "added", 5000.0)
    return o.select("left_shelters", "right_shelters", "shared_shelters", r6("shelter_jaccard"), "shared_capacity", r6("shared_capacity_share"))


# --- explorer


@query("SELECT o_orderstatus AS municipality, 'municipality=' || o_orderstatus AS file, count(*) AS feature_count, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS place FROM orders GROUP BY o_orderstatus")
def export_shards_index(spark: SparkSession, d: str) -> DataFrame:
    """Shards and their index as they are written, in a fixed order of keys."""
    from uuid import uuid4

    from terrafold.session import shared_dir
    from terrafold.sources.files import write_shards

    o = S.table(spark, d, "orders").select(F.col("o_orderstatus").alias("municipality"), "o_orderkey")
    return write_shards(o, f"{shared_dir(spark)}/terrafold/shards-{uuid4().hex}", "municipality", ["P", "O", "F"]).select("municipality", "file", "feature_count", "place")


@query()
def manifest_sha(spark: SparkSession, d: str) -> DataFrame:
    from terrafold.sources.files import file_manifest

    return file_manifest(spark, f"{d}/nation.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "sha256", "bytes")


@query(RISK + """ SELECT count(*) AS meshes, CASE WHEN count(*) > 0 AND count(*) = count(total_population) THEN sum(total_population)::BIGINT END AS population,
    coalesce(sum(total_population) FILTER (WHERE total_walking_distance_m / 60 > 20), 0)::BIGINT AS population_over_20_min, coalesce(sum(total_population)
        FILTER (WHERE NOT ready), 0)::BIGINT AS population_without_route,
    count(DISTINCT CASE WHEN capacity_pressure_area_weighted > 1 THEN shelter_key END) AS over_capacity_shelters FROM risk""")
def ui_kpis(spark: SparkSession, d: str) -> DataFrame:
    return ui.ui_kpis(risk(spark, d))


@query(RISK + " SELECT mesh_id, round(coalesce(capacity_pressure_area_weighted, -1), 6) AS measure FROM risk ORDER BY coalesce(capacity_pressure_area_weighted, -1) DESC, mesh_id LIMIT 8")
def ui_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ui.ui_ranking(risk(spark, d), "capacity").select("mesh_id", r6("measure"))


@query(RISK + """ SELECT m.mesh_id, m.municipality_code, round(full_score, 6) AS full_score, coalesce(score_status, 'not_target') AS score_status, score_status
        IS NOT NULL AS analysis_target FROM t_mesh m LEFT JOIN risk r USING (mesh_id)""")
def ui_map_projection(spark: SparkSession, d: str) -> DataFrame:
    return ui.ui_map(S.meshes(spark, d), risk(spark, d)).select("mesh_id", "municipality_code", r6("full_score"), "score_status", "analysis_target")


_SEVERE = " UNION ALL ".join(
    f"SELECT mesh_id, {i} AS i, '{k}' AS key, {'total_walking_distance_m / 60' if k == 'walking_minutes' else k} / {v!r} AS s FROM risk" for i, (k, v) in enumerate(ui.SEVERITY.items())
)


@query(RISK + f", items AS ({_SEVERE}), o AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY s DESC, i) AS place FROM items WHERE s IS NOT NULL) SELECT mesh_id, place::INT AS place, key, round(s, 6) AS severity FROM o WHERE place <= 3")
def ui_reasons(spark: SparkSession, d: str) -> DataFrame:
    return ui.ui_reasons(risk(spark, d)).select("mesh_id", "place", "key", r6("severity"))
