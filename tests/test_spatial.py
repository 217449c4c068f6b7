import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.functions.geometry import SlabIndex, polygons_of, slabs_of
from loamgraph.operators.spatial import degrees, distinct_points, near_by_slabs, near_pairs, points_in_regions, relations

R = 6_371_008.8


def brute_near(points, radius):
    out = set()
    for i, (a, la, lo) in enumerate(points):
        for b, lb, lp in points[i + 1 :]:
            h = np.sin(np.radians(lb - la) / 2) ** 2 + np.cos(np.radians(la)) * np.cos(np.radians(lb)) * np.sin(np.radians(lp - lo) / 2) ** 2
            if a != b and 2 * R * np.arcsin(min(1, np.sqrt(h))) <= radius:
                out.add((min(a, b), max(a, b)))
    return out


def even_odd(rings, x, y):
    inside = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, axis=0)):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


def test_near_equals_brute_force_at_poles_and_date_line(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = [(0.0, 180.0), (90.0, 0.0), (-90.0, 10.0), (60.0, -180.0), (45.0, 7.0), (89.9995, 120.0), (-0.0001, 0.0001)]
    points = []
    for la, lo in centres:
        for _ in range(25):
            lat = float(np.clip(la + rng.normal() * 4e-4, -90, 90))
            lng = (lo + rng.normal() * 4e-4 / max(np.cos(np.radians(lat)), 1e-3) + 180) % 360 - 180
            points.append((f"p{len(points):03}", lat, float(lng)))
    points += [("same1", 10.0, 10.0), ("same2", 10.0, 10.0), ("zero", 0.0, 0.0), ("bad", 95.0, 3.0), ("nan", float("nan"), 3.0), (None, 10.0, 10.0), ("half", None, 10.0)]
    df = spark.createDataFrame(points, "id string, lat double, lng double")
    pairs = lambda out: sorted((r[0], r[1]) for r in out.collect())
    want = sorted(brute_near([p for p in points if p[0] not in ("zero", "bad", "nan", "half", None)], 50))
    assert pairs(near_pairs(df, 50, 2)) == want and pairs(near_pairs(df, 50, 5000)) == want
    assert pairs(near_by_slabs(df, 50)) == want
    monkeypatch.setattr("loamgraph.operators.spatial.TILE_POINTS", 7)  # every tile is crowded
    assert pairs(near_by_slabs(df, 50)) == want


def test_near_by_slabs_in_a_crowded_place(spark):
    rng = np.random.default_rng(8)
    points = [(i, 46.0 + float(a), 8.0 + float(b)) for i, (a, b) in enumerate(rng.normal(scale=8e-4, size=(700, 2)))]
    got = near_by_slabs(spark.createDataFrame(points, "id bigint, lat double, lng double"), 50).collect()
    assert {(r["left_id"], r["right_id"]) for r in got} == brute_near(points, 50) and len(got) == len({(r["left_id"], r["right_id"]) for r in got})


def test_relations_and_degrees(spark):
    obs = spark.createDataFrame([("a", 1.0, 1.0, 1), ("b", 1.0001, 1.0, 1), ("c", 1.0002, 1.0, 1), ("c", 50.0, 1.0, 2), ("d", 40.0, 1.0, 1), ("e", None, None, 1)], "_id string, geo_lat double, geo_long double, loaded_at int")
    regions = spark.createDataFrame([("r", json.dumps({"type": "Polygon", "coordinates": [SQUARE]})), ("r", json.dumps({"type": "Polygon", "coordinates": [[[0, 39], [5, 39], [5, 41], [0, 41]]]}))], "_id string, bold_spatialdepiction string")
    assert sorted(tuple(r) for r in relations(obs, regions).collect()) == [("near", "a", "b"), ("near", "a", "c"), ("near", "b", "c"), ("within", "a", "r"), ("within", "b", "r"), ("within", "c", "r"), ("within", "d", "r")]
    assert sorted(tuple(r) for r in degrees(obs, regions).collect()) == [("a", 2, 1), ("b", 2, 1), ("c", 2, 1), ("d", 0, 1)]


def test_near_on_empty(spark):
    for near in (near_pairs, near_by_slabs):
        assert near(spark.createDataFrame([], "id string, lat double, lng double"), 50).count() == 0


def test_first_delivery_counts_and_extra_columns(spark):
    rows = [("a", 1.0, 1.0, 2, "x"), ("a", 2.0, 2.0, 1, "y"), ("b", None, 1.0, 1, None), ("c", 0.0, 0.0, 1, None)]
    df = spark.createDataFrame(rows, "_id string, la double, lo double, at int, id string")
    assert [tuple(r) for r in distinct_points(df, "_id", "la", "lo", "at").collect()] == [("a", 2.0, 2.0)]


star = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=9)


@settings(max_examples=60, deadline=None)
@given(star, star)
def test_slabs_equal_even_odd_even_if_rings_cross(a, b):
    rings = [np.array(r, float) for r in (a, b) if len(set(r)) >= 3]
    if not rings:
        return
    slabs = slabs_of(rings)
    if not slabs:
        return
    edges = np.concatenate([s[2] for s in slabs])
    one = np.zeros(len(slabs), int)
    index = SlabIndex(one, np.array([s[0] for s in slabs]), np.array([s[1] for s in slabs]), np.array([len(s[2]) for s in slabs]), edges)
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-21, 21, 80) + 0.0123, rng.uniform(-21, 21, 80) + 0.0371
    got = set(index.locate(x, y)[0].tolist())
    assert got == {i for i in range(80) if even_odd(rings, x[i], y[i])}


SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10]]
HOLE = [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]
REGIONS = [
    ("holed", json.dumps({"type": "Polygon", "coordinates": [SQUARE, HOLE]})),
    ("two", json.dumps([{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [SQUARE]}}, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [SQUARE]}}])),
    ("multi", json.dumps({"type": "MultiPolygon", "coordinates": [[SQUARE], [[[20, 20], [30, 20], [30, 30]]]]})),
    ("null", None), ("empty", ""), ("junk", "{x"), ("object", "{}"), ("line", json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [0, 0]]]})), ("number", "5"), (None, json.dumps({"type": "Polygon", "coordinates": [SQUARE]})),
]


@pytest.mark.parametrize("edges", [0, 1_000_000])
def test_regions_broadcast_and_by_tiles(spark, edges):
    regions = spark.createDataFrame(REGIONS, "_id string, shape string")
    points = spark.createDataFrame([("mid", 5.0, 5.0), ("in", 2.0, 3.0), ("far", 25.0, 26.0), ("out", -5.0, 3.0), ("none", None, 3.0)], "id string, lat double, lng double")
    got = sorted(tuple(r) for r in points_in_regions(points, regions, "_id", "shape", edges).collect())
    assert got == [("far", "multi"), ("in", "holed"), ("in", "multi"), ("in", "two"), ("mid", "multi"), ("mid", "two")]
    assert points_in_regions(points, regions.where("false"), "_id", "shape", edges).count() == 0


def test_depictions_without_polygons():
    assert [len(polygons_of(t)) for t in (None, "", "[]", "null", '{"type":"Point","coordinates":[1,2]}', '{"type":"Polygon","coordinates":[[[1]]]}')] == [0] * 6
