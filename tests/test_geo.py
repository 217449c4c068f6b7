import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgraph.functions import cells, display, shapes
from loamgraph.operators import ranges, summary, windows
from loamgraph.operators.windows import WindowedCollection, WindowProvider


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_cells(spark):
    df = spark.createDataFrame([("872b98315ffffff",), ("852b9833fffffff",), ("junk",), (None,)], "c string")
    got = [tuple(r) for r in df.select(cells.cell_resolution(F.col("c")), cells.cell_parent(F.col("c"), 5), cells.cell_parent(F.col("c"), 7)).collect()]
    assert got == [(7, "852b9833fffffff", "872b98315ffffff"), (5, "852b9833fffffff", None), (None, None, None), (None, None, None)]
    geo = spark.createDataFrame([(57.64911, 10.40744), (-90.0, -180.0), (90.0, 180.0), (None, 1.0)], "la double, lo double")
    assert [r[0] for r in geo.select(cells.geohash(F.col("la"), F.col("lo"), 6)).collect()] == ["u4pruy", "000000", "zzzzzz", None]
    assert cells.next_prefix("u4z") == "u5" and cells.next_prefix("zz") == "{" and cells.zoom_resolution(12) == 7 and cells.zoom_resolution(float("nan")) == 3 and cells.zoom_resolution(18) == 11
    assert "u4pru" in cells.geohash_cover(10.4, 57.64, 10.41, 57.65, 5) and cells.bbox_precision(-180, -90, 180, 90) == 1
    assert cells.cell_field(15) == "_h3" and cells.cell_field(7) == "_h3_7"
    with pytest.raises(ValueError):
        cells.cell_field(4)


def test_summaries(spark):
    r = [("g", 3, "c1", 1.0, 2.0), ("g", 5, "c2", None, 2.0), ("g", None, "c1", 9.0, 9.0), ("h", None, None, 1.0, 1.0), (None, 1, "c", 1.0, 1.0), ("", 1, "c", 1.0, 1.0)]
    df = spark.createDataFrame(r, "g string, t bigint, c string, la double, lo double")
    s = summary.group_summary(df, "g", "t", F.col("c"), "la", "lo")
    assert rows(s) == [("g", 3, 5, 3, ["c1", "c2"], None, None), ("h", None, None, 1, [], None, None)]
    other = spark.createDataFrame([("g", 1, 4, 2, ["c2", "c3"], 7.0, 8.0), ("k", None, None, 1, [], None, None)], s.schema)
    assert rows(summary.merge_summaries(s, other)) == [("g", 1, 5, 5, ["c1", "c2", "c3"], 7.0, 8.0), ("h", None, None, 1, [], None, None), ("k", None, None, 1, [], None, None)]


def test_buckets_and_clusters(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1, 15, 16, None)] + [("b", 7), ("b", 7)], "k string, t bigint")
    got = rows(summary.time_buckets(df, ["k"], "t"))
    assert got == [("a", 0, 1, 0, 0), ("a", 1, 1, 1, 1), ("a", 15, 2, 15, 16), ("b", 0, 2, 7, 7)]
    pts = spark.createDataFrame([("c", "g1", i, 1.0, 2.0) for i in range(3)] + [("c", "g2", 9, 3.0, 4.0), ("d", None, 1, 1.0, 1.0), (None, "g", 1, 1.0, 1.0)], "cell string, g string, t bigint, la double, lo double")
    args = (F.col("cell"), "g", "t", "la", "lo")
    assert rows(summary.cell_clusters(pts, *args, 2), "cell", "n", "shape") == [("c", 4, "cluster"), ("d", 1, "raw")]
    assert rows(summary.cell_top_groups(pts, *args, top=1), "cell", "group_id", "n") == [("c", "g1", 3), ("d", None, 1)]
    assert summary.cell_raw(pts, F.col("cell"), 2).count() == 1


def test_ladder(spark):
    df = spark.createDataFrame([("g", "872b98315ffffff"), ("g", "872b98314ffffff"), ("g", "872b98301ffffff"), ("h", None)], "g string, c string")
    assert summary.cell_ladder(df, "g", "c", (7, 5, 3), 3) == (7, False)
    assert summary.cell_ladder(df, "g", "c", (7, 5, 3), 1) == (5, False) and summary.cell_ladder(df, "g", "c", (7, 5, 3), 0) == (3, True)
    assert summary.cell_ladder(df.where("false"), "g", "c", (7, 5, 3), 1) == (3, False)


DAY = 86_400_000


def test_window(spark):
    docs = spark.createDataFrame([("1", "a", 5), ("2", "a", 50), ("3", "b", 50), ("4", None, 50), ("5", "a", None), ("6", "c", 20), ("7", "c", 21)], "_id string, g string, t bigint")
    bounds = spark.createDataFrame([("a", 10, None, None), ("c", None, None, 21), ("z", None, None, None)], "individual_id string, start_ms bigint, end_ms bigint, end_before_ms bigint")
    seen = lambda df: [r[0] for r in rows(df, "_id")]
    assert seen(windows.windowed(docs, "g", "t", None, bounds)) == ["2", "3", "4", "6"]
    assert seen(windows.windowed(docs, "g", "t", 20)) == ["1", "6"]
    assert seen(windows.windowed(docs, "g", "t", 20, bounds)) == ["6"]
    many = docs.select("_id", F.when(F.col("g").isNotNull(), F.array("g", F.lit("b"))).alias("g"), "t").union(spark.createDataFrame([("8", ["a", "c"], 15)], "_id string, g array<string>, t bigint"))
    assert seen(windows.windowed(many, "g", "t", None, bounds)) == ["2", "3", "4", "6", "8"]
    # The verdict is that of a row's own groups and time, whatever its id.
    wide = spark.createDataFrame([(None, ["a"], 999), (None, ["a"], 150), ("same", ["a"], 999), ("same", ["a"], 150), ("same", [None], 999), ("e", [], 999), ("n", None, 999), ("u", ["a", "b"], None)], "_id string, g array<string>, t bigint")
    hundred = spark.createDataFrame([("a", 100, 200, None), (None, 1, 2, None)], "individual_id string, start_ms bigint, end_ms bigint, end_before_ms bigint")
    assert sorted(map(str, seen(windows.windowed(wide, "g", "t", None, hundred)))) == ["None", "e", "n", "same", "same"]
    assert sorted((str(r["_id"]), r["t"]) for r in windows.windowed(wide, "g", "t", None, hundred).collect() if r["g"] == ["a"]) == [("None", 150), ("same", 150)]
    clock = [0.0]
    calls = []
    p = WindowProvider(lambda: calls.append(1) or bounds, lambda: 0, clock=lambda: clock[0])
    c = WindowedCollection(docs, p, "g", "t")
    assert c.count_documents({"g": "a"}) == 1 and c.find_one({"_id": "1"}) is None and c.distinct("g").count() == 4
    clock[0] = 59
    assert c.aggregate([{"$group": {"_id": None, "n": {"$sum": 1}}}]).first()["n"] == 4 and len(calls) == 1
    clock[0] = 61
    assert c.find().count() == 4 and len(calls) == 2
    with pytest.raises(NotImplementedError):
        c.estimated_document_count()


def test_bounds_and_cutoff(spark):
    who = spark.createDataFrame([("a", "2024-03-09", "2024-03-10"), ("b", "2024-01-01T00:00:00Z", None), ("c", "soon", None), ("d", None, None), ("f", None, "10 March 2024"), (None, "2024-01-01", None)], "_id string, s string, e string")
    ms = lambda *x: int(dt.datetime(*x, tzinfo=dt.UTC).timestamp() * 1000)
    assert rows(windows.parse_bounds(who, "_id", "s", "e")) == [("a", ms(2024, 3, 9, 8), None, ms(2024, 3, 11, 7)), ("b", ms(2024, 1, 1), None, None), ("f", None, None, ms(2024, 3, 11, 7))]
    assert windows.day_cutoff_ms(ms(2024, 3, 11, 12), 1) == ms(2024, 3, 10, 8) and windows.day_cutoff_ms(5, 0) is None


points = st.lists(st.tuples(st.integers(-30, 30), st.integers(-30, 30)), min_size=3, max_size=40, unique=True)


@settings(max_examples=60, deadline=None)
@given(points, st.sampled_from(["convex", "concave"]), st.sampled_from(["cw", "ccw"]))
def test_hulls_hold_their_points(pts, hull, winding):
    p = np.array(pts, float)
    out = shapes.spatial_range(p, hull, winding=winding)
    if out is None:
        return
    ring = out["ring"]
    assert (ring[0] == ring[-1]).all() and (shapes.signed_area(ring[:-1]) < 0) == (winding == "cw")
    if hull == "convex":
        mid = ring[:-1].mean(axis=0)
        near = p + (mid - p) * 1e-6
        assert shapes.inside_any(near[:, 0], near[:, 1], [[ring[:-1]]]).all()


def square(x, y, n=1.0):
    return np.array([[x, y], [x + n, y], [x + n, y + n], [x, y + n]], float)


def area(polys):
    return sum(abs(shapes.signed_area(p[0])) - sum(abs(shapes.signed_area(h)) for h in p[1:]) for p in polys)


def test_union():
    assert area(shapes.union_polygons([[square(0, 0, 2)], [square(1, 1, 2)]])) == pytest.approx(7)
    assert len(shapes.union_polygons([[square(0, 0)], [square(5, 5)]])) == 2
    assert area(shapes.union_polygons([[square(0, 0)], [square(1, 0)]])) == pytest.approx(2) and len(shapes.union_polygons([[square(0, 0)], [square(1, 0)]])) == 1
    frame = [[square(0, 0, 3)], [square(0, 0, 3)]]
    assert area(shapes.union_polygons(frame)) == pytest.approx(9)
    holed = [[square(0, 0, 3), square(1, 1)]]
    assert area(shapes.union_polygons(holed)) == pytest.approx(8) and area(shapes.union_polygons(holed, 1e18)) == pytest.approx(9)
    assert shapes.union_polygons([]) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 4)), min_size=1, max_size=6))
def test_union_of_squares_equals_raster(sq):
    polys = [[square(x, y, n)] for x, y, n in sq]
    raster = {(i, j) for x, y, n in sq for i in range(x, x + n) for j in range(y, y + n)}
    assert area(shapes.union_polygons(polys, 0)) == pytest.approx(len(raster))


def test_area_and_simplify():
    assert shapes.polygon_area([np.vstack([square(0, 0), square(0, 0)[:1]])]) == pytest.approx(1.2364e10, rel=1e-3)
    t = np.linspace(0, 2 * math.pi, 200, endpoint=False)
    ring = np.column_stack([np.cos(t), np.sin(t)])
    out = shapes.simplify_rings([[ring]], 0.01)
    assert 8 < len(out[0][0]) < 60 and abs(shapes.signed_area(out[0][0])) == pytest.approx(math.pi, rel=0.02)
    again = shapes.simplify_rings(out, 0.01)
    assert len(again[0][0]) <= len(out[0][0])
    assert shapes.simplify_rings([[square(0, 0, 0.001)]], 0.1) == []
    assert shapes.to_geojson(out)["type"] == "Polygon"


def test_depictions():
    f = lambda role: {"properties": {"bold:depictionRole": role} if role else {}}
    assert shapes.pick_depiction([f("a"), f("detail")], "detail") == f("detail")
    assert shapes.pick_depiction([f("a"), f(None)], "detail") == f(None)
    assert shapes.pick_depiction([f("a")], "b") == f("a") and shapes.pick_depiction([f("a")], "b", strict=True) is None and shapes.pick_depiction(None, "a") is None
    assert shapes.with_role({"x": 1}, "r")["properties"] == {"bold:depictionRole": "r"}
    assert shapes.positions_of({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "geometry": None}]}) == [(1.0, 2.0)]


def test_group_hulls(spark):
    rng = np.random.default_rng(0)
    data = [("g", float(a), float(b)) for a, b in rng.normal(size=(3000, 2))] + [("line", 0.0, float(i)) for i in range(5)] + [("two", 1.0, 1.0)] * 4 + [(None, 1.0, 1.0), ("g", None, 1.0)]
    out = ranges.group_hulls(spark.createDataFrame(data, "g string, la double, lo double").repartition(5), "g", "la", "lo").collect()
    whole = shapes.spatial_range(np.array([[b, a] for g, a, b in data[:3000]]))
    assert [(r["g"], r["vertices"], r["area_km2"]) for r in out] == [("g", len(whole["ring"]) - 1, whole["area_km2"])]


def test_display(spark):
    df = spark.createDataFrame([("x:a/b#c", "", "T"), ("x:d", "L", "T"), (None, None, None)], "id string, l string, t string")
    assert [r[0] for r in df.select(display.label(F.col("id"), F.col("l"), type_label=F.col("t"))).collect()] == ["T c", "L", "Unknown"]
    ts = spark.createDataFrame([(dt.datetime(2024, 3, 10, 7, 30),), (dt.datetime(2024, 7, 1, 20, 5),), (None,)], "t timestamp")
    assert [r[0] for r in ts.select(display.format_date_time(F.col("t"))).collect()] == ["3/9/2024 11:30 PM PST", "7/1/2024 1:05 PM PDT", ""]
    assert [r[0] for r in ts.select(display.format_date_time(F.col("t"), "Asia/Kathmandu")).collect()][0] == "3/10/2024 1:15 PM GMT+5:45"
    g = spark.createDataFrame([("b",), ("a",), ("a",), ("",), (None,)], "g string")
    assert rows(display.group_options(g, F.col("g"))) == [("a", "a", "#4e79a7", 2), ("b", "b", "#f28e2c", 1), (None, "No Group", "#cccccc", 2)]
    rise, set_ = display.sunrise_sunset(-0.1278, 51.5074, dt.date(2024, 6, 21))
    assert abs((rise - dt.datetime(2024, 6, 21, 3, 43, tzinfo=dt.UTC)).total_seconds()) < 300 and abs((set_ - dt.datetime(2024, 6, 21, 20, 21, tzinfo=dt.UTC)).total_seconds()) < 300
    assert display.sunrise_sunset(0, 89, dt.date(2024, 6, 21)) is None
    with pytest.raises(ValueError):
        display.sunrise_sunset(200, 0, dt.date(2024, 1, 1))
