import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgraph.functions import tracks
from loamgraph.operators import trips
from loamgraph.operators.trips import stops_and_trips, totals, trips_of_reports

MIN, HOUR = 60_000, 3_600_000
SCHEMA = "ping string, device string, collar string, t bigint, lat double, lng double"


def stay(start, n, lat, lng, device="d", collar="c", step=15 * MIN):
    return [(f"{device}{start}{i}", device, collar, start + i * step, lat + (i % 3) * 1e-4, lng - (i % 2) * 1e-4) for i in range(n)]


def move(start, lat0, lat1, n, device="d", collar="c", step=15 * MIN):
    return [(f"m{device}{start}{i}", device, collar, start + i * step, lat0 + (lat1 - lat0) * (i + 1) / (n + 1), 8.0) for i in range(n)]


TRACK = [*stay(0, 6, 50.0, 8.0), *move(6 * 15 * MIN, 50.0, 50.1, 3), *stay(9 * 15 * MIN, 7, 50.1, 8.0)]


def run(spark, rows):
    return sorted((r["kind"], r["device"], r["collar"], r["start_ms"], r["end_ms"]) for r in stops_and_trips(spark.createDataFrame(rows, SCHEMA)).collect())


WANT = [("stop", "d", "c", 0, 5 * 15 * MIN), ("stop", "d", "c", 9 * 15 * MIN, 15 * 15 * MIN), ("trip", "d", "c", 5 * 15 * MIN, 9 * 15 * MIN)]


def test_stops_and_the_trip_between(spark):
    assert run(spark, TRACK) == WANT
    assert run(spark, TRACK[::-1] + TRACK[:4]) == WANT  # any order, delivered twice


def test_noise_nulls_and_bad_positions_are_left_out(spark):
    noise = [("n1", "d", "c", 20 * MIN, -8.0, 50.0), ("n2", "d", "c", 50 * MIN, None, 8.0), ("n3", "d", "c", 51 * MIN, 0.0, 0.0), ("n4", "d", "c", None, 50.0, 8.0), ("n5", None, "c", 5, 50.0, 8.0), ("n6", "d", "c", 52 * MIN, float("nan"), 8.0)]
    assert run(spark, TRACK + noise) == WANT


def test_silence_ends_stop_and_trip(spark):
    late = [(p, d, c, t + (7 * HOUR if t >= 9 * 15 * MIN else 0), la, lo) for p, d, c, t, la, lo in TRACK]
    assert [r[0] for r in run(spark, late)] == ["stop", "stop"]
    rest = stay(0, 3, 50.0, 8.0) + stay(7 * HOUR, 3, 50.0, 8.0)
    assert run(spark, rest) == []


def test_collars_of_a_device_are_apart_and_null_is_one(spark):
    rows = TRACK + [(f"x{p}", d, None, t, la + 1, lo) for p, d, c, t, la, lo in TRACK]
    got = stops_and_trips(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and sum(r["collar"] is None for r in got) == 3
    assert spark.createDataFrame([], SCHEMA).transform(stops_and_trips).count() == 0


@pytest.mark.parametrize("chunk", [5, 40, 10_000])
def test_streaming_in_small_chunks_changes_nothing(chunk, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for d in range(6):
        t, la = 0, 50.0
        for i in range(60):
            t += int(rng.choice([10 * MIN, 20 * MIN, 7 * HOUR], p=[0.6, 0.35, 0.05]))
            la += float(rng.choice([0, 1e-4, 0.02], p=[0.6, 0.3, 0.1]))
            rows.append((f"{d}-{i}", f"d{d}", "c", t, la if rng.random() > 0.03 else -la, 8.0))
    import pyarrow as pa

    rows.sort(key=lambda r: (r[1], r[3]))
    batches = [pa.RecordBatch.from_pylist([{"device": r[1], "collar": r[2], "t": r[3], "p": i, "lat": r[4], "lng": r[5], "stretch": 0, "aside": False}]) for i, r in enumerate(rows)]
    read = lambda: sorted((tuple(x.values())[:5] for b in trips.track_reader(trips.TripRules())(iter(batches)) for x in b.to_pylist()), key=str)
    monkeypatch.setattr(trips, "CHUNK", chunk)
    got = read()
    monkeypatch.setattr(trips, "CHUNK", 10**9)
    assert got and got == read()


def brute_radius(p):
    best = 1e18
    for k in (1, 2, 3):
        for q in itertools.combinations(p, k):
            q = np.array(q)
            if k == 3:
                (ax, ay), (bx, by), (cx, cy) = q
                d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
                if abs(d) < 1e-9:
                    continue
                c = np.array([((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / d, ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / d])
            else:
                c = q.mean(axis=0)
            best = min(best, np.hypot(*(np.array(p) - c).T).max())
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=1, max_size=9))
def test_smallest_circle(points):
    assert math.isclose(tracks.smallest_circle(np.array(points, float)), brute_radius(points), abs_tol=1e-6)


def test_smallest_circle_of_many_points():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(5000, 2))
    r = tracks.smallest_circle(p)
    assert r >= np.hypot(*(p - p.mean(axis=0)).T).max() / 2 and math.isclose(r, tracks.smallest_circle(p[rng.permutation(5000)]), rel_tol=1e-9)


def test_simplified_track_stays_within_tolerance():
    rng = np.random.default_rng(3)
    n = 400
    session = np.sort(rng.integers(0, 9, n))
    t = np.cumsum(rng.integers(1, 1000, n))
    xyz = np.cumsum(rng.normal(size=(n, 3)) * 30, axis=0)
    keep = tracks.simplify(session, t, xyz, 60.0)
    for s in np.unique(session):
        at = np.flatnonzero(session == s)
        k = at[keep[at]]
        assert k[0] == at[0] and k[-1] == at[-1]
        for x in at:
            a, b = k[k <= x][-1], k[k >= x][0]
            assert np.linalg.norm(tracks.interpolate(t, xyz, np.array([x]), np.array([a]), np.array([b]))[0] - xyz[x]) <= 60.0 + 1e-9
    assert not keep.all()


def test_reports(spark):
    rows = [(p, ' ["t:d"]', c, t + 1_700_000_000_000, la, lo, "x") for p, d, c, t, la, lo in TRACK]
    df = spark.createDataFrame(rows, "_id string, bold_animal string, bold_collar string, _when_ms bigint, geo_lat double, geo_long double, device string")
    out = trips_of_reports(df, spark.createDataFrame([("t", "http://x/")], "prefix string, iri string"))
    assert {r["animal_id"] for r in out.collect()} == {"t:d"} and out.count() == 3
    trip = out.where("kind = 'trip'").first()
    assert 11_000 < trip["distance_m"] < 11_200 and trip["duration_s"] == 3600
    assert tuple(totals(out).first())[1:3] == (2, 1)


def test_hot_devices_are_split_at_silences_and_nothing_changes(spark):
    rng = np.random.default_rng(9)
    data = []
    for d, collar in (("hot", "c"), ("hot", None), ("cold", "c")):
        t, la = 0, 50.0
        for i in range(400):
            t += int(rng.choice([10 * MIN, 20 * MIN, 5 * HOUR, 7 * HOUR, 14 * HOUR, 30 * HOUR], p=[0.6, 0.25, 0.05, 0.05, 0.03, 0.02]))
            la += float(rng.choice([0, 1e-4, 0.02], p=[0.6, 0.3, 0.1]))
            data.append((f"{d}{collar}-{i}", d, collar, t, la if rng.random() > 0.06 else -la, 8.0))
    df = spark.createDataFrame(data, SCHEMA)
    slim = df.select("device", "collar", "t", trips.F.xxhash64("ping").alias("p"), "lat", "lng")
    parts = trips.split_hot(slim, 6 * HOUR, 300)
    assert parts.where("not aside").count() == 1200 and parts.select("device", "collar", "stretch").distinct().count() > 20 and parts.where("aside").count() > 20
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    want = key(stops_and_trips(df))
    assert len(want) > 30 and key(stops_and_trips(df, hot_pings=300)) == want


def test_stops_by_segments_alone(spark):
    got = sorted((r["kind"], r["start_ms"], r["end_ms"], r["n_pings"], r["distance_m"]) for r in stops_and_trips(spark.createDataFrame(TRACK, SCHEMA), by_segments=True).collect())
    assert [g[:3] for g in got] == [("stop", 0, 5 * 15 * MIN), ("stop", 9 * 15 * MIN, 15 * 15 * MIN), ("trip", 5 * 15 * MIN, 9 * 15 * MIN)]
    assert abs(got[2][4] - 11_119) < 30
    assert stops_and_trips(spark.createDataFrame([], SCHEMA), by_segments=True).count() == 0


def test_slow_runs_do_not_cross_sessions():
    t = np.arange(8) * HOUR
    xyz = tracks.on_sphere(np.array([50, 50, 50, 50, 50, 50.5, 50.5, 50.5]), np.full(8, 8.0))
    session = np.array([0, 0, 0, 1, 1, 1, 1, 1])
    assert tracks.slow_runs(session, t, xyz, np.ones(8, bool), 0.1, 2, HOUR).tolist() == [[0, 2], [3, 4], [5, 7]]
    assert tracks.slow_runs(session, t, xyz, np.ones(8, bool), 0.1, 3, HOUR).tolist() == [[0, 2], [5, 7]]
