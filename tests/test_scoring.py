import pytest

from terrafold.operators import relational, scoring

MESH = "mesh_id string, municipality_code int, total_population long, tsunami_inundation_ratio double, aging_rate_65plus double"
NEAR = "mesh_id string, shelter_key string, total_walking_distance_m double, inundation_ratio double, unknown_ratio double, classified_ratio double"


@pytest.fixture(scope="module")
def risk(spark):
    mesh = spark.createDataFrame([("m1", 1, 100, 0.5, 0.2), ("m2", 1, 200, 0.25, 0.3), ("m3", 1, 80, 1.0, 0.4), ("m4", 1, 50, 0.2, 0.25), ("m5", 1, 9, None, 0.1)], MESH)
    near = spark.createDataFrame([("m1", "S1", 400.0, 0.3, 0.2, 0.375), ("m2", "S1", 800.0, 0.0, 0.0, 0.0), ("m3", "01201", 600.0, 0.5, 0.0, 0.5)], NEAR)
    shelters = spark.createDataFrame([("S1", 200.0), ("01201", None)], "shelter_key string, capacity double")
    return scoring.composite(mesh, near, shelters).cache()


def test_pressure_and_status(risk):
    got = {r.mesh_id: r for r in risk.collect()}
    assert set(got) == {"m1", "m2", "m3", "m4"}
    assert got["m1"].assigned_demand_area_weighted == 100.0 and got["m1"].assigned_demand_full_mesh == 300.0
    assert (got["m1"].capacity_pressure_area_weighted, got["m2"].capacity_pressure_full_mesh) == (0.5, 1.5)
    assert got["m3"].capacity_pressure_area_weighted is None and got["m3"].full_score is None and got["m3"].core_score is not None
    assert got["m3"].score_status == "core_only_missing_capacity"
    assert got["m4"].score_status == "route_unavailable" and got["m4"].core_score is None
    bounds = [getattr(got["m1"], f"route_inundation_exposure_component{s}") for s in ("_lower", "", "_upper")]
    assert [round(b, 9) for b in bounds] == [30.0, 37.5, 50.0]


def test_scenarios(risk):
    scenarios = scoring.weight_scenarios()
    assert len(scenarios) == 12
    ranks = scoring.rank_scenarios(risk.where("score_status = 'complete'"), scenarios)
    assert ranks.count() == 24
    assert {r.mesh_id for r in scoring.robust_top(ranks, n=2).collect()} == {"m1", "m2"}


def test_quantiles_match_percentile(spark):
    df = spark.range(1000).selectExpr("CAST(xxhash64(id) % 977 AS DOUBLE) * pow(1.01, id % 500) AS v")
    want = df.selectExpr("percentile(v, array(0.05, 0.5, 0.95)) AS p").first().p
    got = relational.exact_quantiles(df, "v", (0.05, 0.5, 0.95), buckets=16, gather=20)
    assert all(abs(a - b) < 1e-6 * max(1, abs(a)) for a, b in zip(want, got, strict=True))
    assert scoring.quantile_bounds(df.where("v IS NULL"), "v") == (0.0, 1.0)
    assert scoring.quantile_bounds(spark.range(5).selectExpr("3.0D AS v"), "v") == (3.0, 4.0)


def test_what_if_never_raises_scores(risk):
    known = risk.select("shelter_key", "capacity", "assigned_demand_area_weighted", "capacity_pressure_area_weighted").where("shelter_key IS NOT NULL").distinct()
    rows = scoring.what_if_capacity(risk, known, [100.0, 500.0]).collect()
    assert {r.delta for r in rows} == {100.0, 500.0} and all(r.total_score_reduction >= 0 for r in rows)
    assert all(r.shelter_key == "S1" for r in rows)


def test_plan_overlap(spark):
    schema = "shelter_key string, added double"
    a, b = spark.createDataFrame([("a", 60.0), ("b", 40.0)], schema), spark.createDataFrame([("a", 50.0), ("c", 50.0)], schema)
    r = relational.plan_overlap(a, b, "shelter_key", "added", 100.0).first()
    assert (r.shared_shelters, round(r.shelter_jaccard, 9), r.shared_capacity, r.shared_capacity_share) == (1, round(1 / 3, 9), 50.0, 0.5)
    none = relational.plan_overlap(a.where("added > 99"), b.where("added > 99"), "shelter_key", "added", 100.0).first()
    assert none.shelter_jaccard == 1.0 and none.shared_capacity == 0.0


def test_renamed_join_and_its_contract(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, None, 7)], "mesh int, wanted string, n int")
    right = spark.createDataFrame([("a", 50, True)], "key string, n int, known boolean")
    got = relational.join_renamed(left, right, {"wanted": "key"}, "_r", validate="m:1")
    assert got.columns == ["wanted", "mesh", "n", "n_r", "known"]
    assert sorted(tuple(r) for r in got.select("mesh", "n", "n_r", "known").collect()) == [(1, 5, 50, True), (2, 6, None, None), (3, 7, None, None)]
    with pytest.raises(ValueError, match="unique right key: 1"):
        relational.join_renamed(left, right.unionByName(right), {"wanted": "key"}, "_r", validate="m:1")


def test_ranking_by_a_language(spark):
    names = ["zebra", "Ärzte", "apfel", "Birne", "ärzte"]
    rows = spark.createDataFrame([(100.0, n, 1.0, True, 0.5, 2.0, 9.0) for n in names], "delta double, shelter_key string, total_score_reduction double, resolved_over_capacity boolean, simulated_pressure double, capacity_pressure_area_weighted double, assigned_demand_area_weighted double")
    for order in ("text", "demand"):
        bytewise = [r.shelter_key for r in scoring.what_if_ranking(rows, order=order).orderBy("place").collect()]
        german = [r.shelter_key for r in scoring.what_if_ranking(rows, order=order, collation="de").orderBy("place").collect()]
        assert bytewise == sorted(names) and german == ["apfel", "ärzte", "Ärzte", "Birne", "zebra"]
