import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.functions import hexgrid
from loamgraph.functions.geometry import EARTH_RADIUS_M, great_circle_m
from loamgraph.operators.hexcells import add_cells, backfill_counts, cell_centroids, cells_in_box, tag_regions


def sphere_points(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)


def test_published_examples():
    lat, lng = np.array([37.3615593, 0.0, 37.775938728915946]), np.array([-122.0553238, 0.0, -122.41795063018799])
    assert hexgrid.texts(hexgrid.cells_of(lat, lng, 5))[0] == "85283473fffffff"
    assert hexgrid.texts(hexgrid.cells_of(lat, lng, 0))[1] == "8075fffffffffff"
    assert hexgrid.texts(hexgrid.cells_of(lat, lng, 9))[2] == "8928308280fffff"
    a, b = hexgrid.centres_of(hexgrid.numbers(["85283473fffffff"]))
    assert abs(a[0] - 37.345793375368) < 1e-9 and abs(b[0] + 121.976375972551) < 1e-9


@pytest.mark.parametrize("resolution, cells", [(0, 122), (1, 842), (2, 5882)])
def test_all_cells_are_reached(resolution, cells):
    lat, lng = sphere_points(200_000)
    assert len(np.unique(hexgrid.cells_of(lat, lng, resolution))) == cells


@pytest.mark.parametrize("resolution", [1, 2, 3, 4, 7, 8, 15])
def test_centres_lie_in_their_cells_and_near_their_points(resolution):
    lat, lng = sphere_points(20_000, resolution)
    # Positions around the twelve corners too.
    corner = np.flatnonzero(hexgrid.grid().is_corner)
    a, b = hexgrid.centres_of((1 << 59) | (corner << 45) | ((1 << 45) - 1))
    rng = np.random.default_rng(1)
    lat, lng = np.append(lat, np.repeat(a, 500) + rng.normal(0, 0.4, 6000)), np.append(lng, np.repeat(b, 500) + rng.normal(0, 0.4, 6000))
    cells = hexgrid.cells_of(lat, lng, resolution)
    assert hexgrid.valid(cells).all()
    a, b = hexgrid.centres_of(cells)
    assert (hexgrid.cells_of(a, b, resolution) == cells).all()
    step = EARTH_RADIUS_M * hexgrid.UNIT * np.sqrt(7.0) ** -resolution
    assert (great_circle_m(lat, lng, a, b) <= 0.6 * step).all()


def test_disks_and_covers():
    cells = hexgrid.cells_of(*sphere_points(300, 4), 6)
    near = [hexgrid.disk(np.array([c])) for c in cells]
    assert all(len(d) in (6, 7) and c in d for c, d in zip(cells, near)) and all(cells[k] in hexgrid.disk(np.array([x])) for k in range(0, 300, 30) for x in near[k])
    assert len(hexgrid.disk(cells[:1], 3)) == 37
    box = (46.0, 7.0, 46.3, 7.4)
    covered = set(hexgrid.cover(*box, 7).tolist())
    rng = np.random.default_rng(2)
    inside = hexgrid.cells_of(rng.uniform(46, 46.3, 20_000), rng.uniform(7, 7.4, 20_000), 7)
    around = set(hexgrid.disk(np.array(sorted(covered))).tolist())
    assert set(inside.tolist()) <= around and covered <= set(hexgrid.disk(np.unique(inside)).tolist())


def test_what_is_no_cell():
    assert hexgrid.cells_of(np.array([np.nan, 1.0]), np.array([1.0, np.inf]), 7).tolist() == [0, 0]
    odd = hexgrid.numbers([None, "", "zz", "87ffffffffffffff", "8f28308280fffff", "0"])
    assert not hexgrid.valid(odd).any() and np.isnan(hexgrid.centres_of(odd)[0]).all()
    assert len(hexgrid.disk(np.zeros(0, np.int64))) == 0 and len(hexgrid.cells_of(np.zeros(0), np.zeros(0), 5)) == 0


def test_backfill(spark):
    rows = [("a", 46.1, 7.2, None), ("b", 46.1, 7.2, "old"), ("c", None, 7.2, None), ("d", float("nan"), 7.2, None), ("e", 46.1, None, None)]
    df = spark.createDataFrame(rows, "_id string, lat double, lng double, _h3 string")
    assert tuple(backfill_counts(df, "lat", "lng").first()) == (1, 1) and tuple(backfill_counts(df, "lat", "lng", True).first()) == (2, 1)
    got = {r["_id"]: r for r in add_cells(df, "lat", "lng").collect()}
    assert got["a"]["_h3"].startswith("8f") and got["b"]["_h3"] == "old" and got["c"]["_h3"] is got["d"]["_h3"] is got["e"]["_h3"] is None and got["b"]["_h3_7"] is None
    forced = {r["_id"]: r for r in add_cells(df, "lat", "lng", True).collect()}
    assert forced["b"]["_h3"] == got["a"]["_h3"] and [forced["b"][f"_h3_{r}"][:2] for r in (3, 5, 7, 9, 11)] == ["83", "85", "87", "89", "8b"]
    assert [forced["b"][f"_h3_{r}"] for r in (3, 7, 11)] == [hexgrid.texts(hexgrid.cells_of(np.array([46.1]), np.array([7.2]), r))[0] for r in (3, 7, 11)]
    assert add_cells(df.where("false"), "lat", "lng").count() == 0
    assert cells_in_box(add_cells(df, "lat", "lng"), 7, (46.0, 7.1, 46.2, 7.3)).select("_id").collect() == [("a",)]


def test_centroids_and_region_tags(spark):
    df = spark.createDataFrame([("87283472bffffff",), ("87283472bffffff",), ("junk",), (None,)], "cell string")
    got = cell_centroids(df, "cell").collect()
    assert len(got) == 1 and abs(got[0]["lat"] - 37.35) < 0.1
    ring = '{"type":"Polygon","coordinates":[[[-123,37],[-121,37],[-121,38],[-123,38]]]}'
    regions = spark.createDataFrame([("r", ring), ("none", None)], "_id string, shape string")
    assert [tuple(r) for r in tag_regions(df.withColumn("id", F.lit(1)), "cell", regions, "_id", "shape").collect()] == [("87283472bffffff", "r")]
