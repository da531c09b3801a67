from pyspark.sql import functions as F

from terrafold.functions import values as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_capacity_parser(spark):
    df = spark.createDataFrame([(None,), ("",), ("1,200人",), ("0",), ("350",)], "c string")
    got = [tuple(r.p) for r in df.select(V.parse_capacity(F.col("c")).alias("p")).collect()]
    assert got == [(None, "missing"), (None, "unparseable"), (1200.0, "numeric_prefix"), (None, "nonpositive"), (350.0, "numeric")]


def test_snap_classes(spark):
    df = spark.createDataFrame([(d,) for d in (0.0, 100.0, 100.1, 250.0, 250.1, 500.0, 500.1, None)], "d double")
    got = [r[0] for r in df.select(V.snap_status(F.col("d"))).collect()]
    assert got == ["normal", "normal", "review", "review", "warning", "warning", "critical", "missing"]


def test_clip_keeps_null_and_scores_are_all_or_nothing(spark):
    r = one(spark, a=V.clip_keep_null(F.lit(None).cast("double"), 0.0, 100.0), b=V.clip_keep_null(F.lit(140.0), 0.0, 100.0))
    assert r.a is None and r.b == 100.0
    full = {k: F.lit(50.0) for k in V.FULL_WEIGHTS}
    r = one(spark, a=V.weighted_score(full, V.FULL_WEIGHTS), b=V.weighted_score(full | {"walking_accessibility": F.lit(None).cast("double")}, V.FULL_WEIGHTS))
    assert r.a == 50.0 and r.b is None


def test_numbers_and_keys(spark):
    texts = ["12", " 3.5 ", "-", "***", "NaN", "Infinity", "1d", "", None, "1e3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(V.to_number(F.col("t"), V.NULL_TOKENS)).collect()] == [12.0, 3.5, None, None, None, None, None, None, None, 1000.0]
    df = spark.createDataFrame([("E3821400137201",), ("not-standard",)], "c string")
    assert [r[0] for r in df.select(V.code_from_id(F.col("c"))).collect()] == ["38214", None]
    assert one(spark, k=V.norm_key(F.lit("ＡＢＣ　公園（東）"))).k == "abc公園東"
    assert one(spark, k=V.normal_code(F.lit("38201.0")), e=V.normal_code(F.lit(" "))).asDict() == {"k": "38201", "e": None}
    assert one(spark, s=V.id_set(F.lit("b, a,,b"))).s == ["a", "b"]


def test_coordinates_and_reasons(spark):
    df = spark.createDataFrame([("[[1,2],[3,4]]",), ("[[1,2],[3]]",), ("bad",), (None,)], "c string")
    assert [r[0] for r in df.select(V.parse_coordinates(F.col("c"))).collect()] == [[[1.0, 2.0], [3.0, 4.0]], [], [], []]
    c = {k: F.lit(v).cast("double") for k, v in zip(V.FULL_WEIGHTS, (10.0, 90.0, None, 100.0, 100.0), strict=True)}
    assert [x.key for x in one(spark, r=V.reasons(c)).r] == ["vulnerable_population", "route_inundation_exposure", "shelter_capacity_pressure", "tsunami_exposure"]
