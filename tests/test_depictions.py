import json

from pyspark.sql import functions as F

from loamgraph.operators import depictions

SQ = lambda x, n=10: json.dumps({"type": "Polygon", "coordinates": [[[x, 0], [x + n, 0], [x + n, n], [x, n]]]})


def test_place_wins_over_shape(spark):
    rows = [("1.5", "2", SQ(0)), ('{"@value":"3"}', "[4]", None), ("x", "2", SQ(1)), (None, None, " "), ("NaN", "1", SQ(2))]
    df = spark.createDataFrame(rows, "la string, lo string, s string")
    got = [r[0] for r in df.select(depictions.spatial_depiction(F.col("la"), F.col("lo"), F.col("s"))).collect()]
    assert [json.loads(g)["coordinates"] if g and '"Point"' in g else g for g in got] == [[2.0, 1.5], [4.0, 3.0], SQ(1), None, SQ(2)]


def test_outline_is_the_first_region(spark):
    pts = spark.createDataFrame([("p", 5.0, 5.0), ("q", 5.0, 12.0), ("r", 50.0, 50.0)], "id string, lat double, lng double")
    regions = spark.createDataFrame([("b", SQ(0), 2), ("a", SQ(3), 1), ("n", None, 0)], "_id string, s string, at int")
    assert sorted(tuple(r) for r in depictions.outline(pts, regions, "_id", "s").collect()) == [("p", "a"), ("q", "a")]
    assert dict(tuple(r) for r in depictions.outline(pts, regions.withColumn("at", -F.col("at")), "_id", "s", "at").collect())["p"] == "b"


def test_roles_and_union(spark):
    regions = spark.createDataFrame([("a", SQ(0), "g"), ("b", SQ(5), "g"), ("c", "", "h"), (None, SQ(0), None)], "_id string, s string, g string")
    built = {r[0]: json.loads(r[1]) for r in depictions.build_depictions(regions, "_id", "s", {"detail": None, "thumbnail": 0.01, "gone": 50.0}).collect()}
    assert {k: [f["properties"]["bold:depictionRole"] for f in v][:2] for k, v in built.items()} == {"a": ["detail", "thumbnail"], "b": ["detail", "thumbnail"]}
    merged = {r["group"]: r for r in depictions.merge_depictions(regions, "g", "s").collect()}
    assert merged["h"]["shape"] is None and merged["g"]["n_shapes"] == 2
    ring = json.loads(merged["g"]["shape"])["coordinates"][0]
    assert {tuple(p) for p in ring} >= {(0.0, 0.0), (15.0, 0.0), (15.0, 10.0), (0.0, 10.0)} and ring[0] == ring[-1]


def test_settings():
    assert depictions.public_delay_days({"app:publicDataDelayDays": 0}, 5) == 0 and depictions.public_delay_days({"app:publicDataDelayDays": -1}, 5) == 5
    assert depictions.public_delay_days(None, None) == 0 and depictions.app_setting({"x": [1]}, "x") == 1 and depictions.app_setting("bad", "x", 2) == 2
