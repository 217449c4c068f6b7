import datetime as dt
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from loamgraph.functions.zones import wall_to_utc, zone_files
from loamgraph.operators.timestamps import clean, normalise_times, to_utc_ms

NY = "America/New_York"


def one(value, zone=NY, day_first=False):
    utc, good, _, _ = to_utc_ms(clean(pa.array([value])), np.array([zone or ""], dtype=object), np.array([np.nan if day_first is None else float(day_first)]))
    return int(utc[0]) if good[0] else None


def ms(*a, zone="UTC", fold=0):
    return int(dt.datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).timestamp() * 1000)


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-02", ms(2024, 1, 2, zone=NY)),
        ("20240102", ms(2024, 1, 2, zone=NY)),
        ("1704153600", 1704153600000),
        ("1704153600123", 1704153600123),
        ("1704153600123999", 1704153600123),
        ("170415360012", None),
        ("2024-01-02T03:04", ms(2024, 1, 2, 3, 4, zone=NY)),
        ("2024-01-02T03:04:05.9999Z", ms(2024, 1, 2, 3, 4, 5) + 999),
        ("2024-01-02 03:04:05z", ms(2024, 1, 2, 3, 4, 5)),
        ("20240102T030405", ms(2024, 1, 2, 3, 4, 5, zone=NY)),
        ("2024-01-02T03:04:05+05:45", ms(2024, 1, 1, 21, 19, 5)),
        ("2024-01-02 03:04:05-0330", ms(2024, 1, 2, 6, 34, 5)),
        ("2024-01-02T03:04:05+10:30[Australia/Adelaide]", ms(2024, 1, 1, 16, 34, 5)),
        ("2024-01-02 03:04:05 Europe/Oslo", ms(2024, 1, 2, 2, 4, 5)),
        ("2024-01-02 03:04 CDT", ms(2024, 1, 2, 8, 4)),
        ("2024-01-02 03:04 XQT", None),
        ("2024-01-02 03:04:05 Europe/Nowhere", None),
        ("Tue, 02 Jan 2024 03:04:05 -0500", ms(2024, 1, 2, 8, 4, 5)),
        ("2 Jan 2024", ms(2024, 1, 2, zone=NY)),
        ("January 2, 2024 at 12:05 AM", ms(2024, 1, 2, 0, 5, zone=NY)),
        ("1/2/2024 12:05 pm", ms(2024, 1, 2, 12, 5, zone=NY)),
        ("13/2/2024", None),
        ("1/2/2024 13:05 pm", None),
        ("02.01.2024 03:04", ms(2024, 1, 2, 3, 4, zone=NY)),
        ('{"@value":"2024-01-02","@type":"xsd:date"}', ms(2024, 1, 2, zone=NY)),
        ("２０２４-０１-０２", ms(2024, 1, 2, zone=NY)),
        ("  2024-01-02 ", ms(2024, 1, 2, zone=NY)),
        ("2024-02-30", None), ("2023-02-29", None), ("0000-00-00", None), ("2024-01-02T24:00", None), ("2024-01-02T10:60", None),
        ("ongoing", None), ("", None), ("{bad", None), ("x" * 100_000, None), ("9" * 100_000, None),
        ("2024-11-03 01:30", ms(2024, 11, 3, 1, 30, zone=NY, fold=0)),
        ("2024-03-10 02:30", ms(2024, 3, 10, 7, 30)),
    ],
)
def test_formats(text, want):
    assert one(text) == want


def test_day_order_and_zone_may_be_unknown():
    assert one("2/1/2024", day_first=True) == ms(2024, 1, 2, zone=NY)
    assert one("1/2/2024", day_first=None) is None
    assert one("25/2/2024", day_first=None) == ms(2024, 2, 25, zone=NY)
    assert one("2024-01-02", zone=None) is None
    assert one("2024-01-02T00:00Z", zone=None) == ms(2024, 1, 2)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([NY, "Europe/London", "Australia/Adelaide", "Asia/Kathmandu", "America/Phoenix"]), st.datetimes(dt.datetime(1950, 1, 1), dt.datetime(2099, 1, 1)))
def test_wall_times_follow_the_zone(zone, when):
    wall = np.array([int((when.replace(microsecond=0) - dt.datetime(1970, 1, 1)).total_seconds())])
    assert wall_to_utc(wall, zone)[0] == int(when.replace(microsecond=0, tzinfo=ZoneInfo(zone), fold=0).timestamp())


def test_unknown_zone_has_no_table():
    wall = np.zeros(1, np.int64)
    assert wall_to_utc(wall, "Nowhere/City") is None and wall_to_utc(wall, "") is None and wall_to_utc(wall, "UTC", {}) is None


def test_every_zone_before_1900_and_after_2100():
    moments = [dt.datetime(y, m, 7, 12, 30) for y in (1850, 1890, 1899, 2101, 2150, 2499, 2505, 2901, 9000) for m in (1, 7)]
    wall = np.array([(t - dt.datetime(1970, 1, 1)).total_seconds() for t in moments]).astype(np.int64)
    for zone in zone_files():
        assert wall_to_utc(wall, zone).tolist() == [int(t.replace(tzinfo=ZoneInfo(zone)).timestamp()) for t in moments], zone


def test_long_values_are_read_whole(spark):
    long = "2024-01-02T03:04:05." + "1" * 500 + "Z"
    assert one(long) == ms(2024, 1, 2, 3, 4, 5) + 111
    df = spark.createDataFrame([("a", long, None)], "_id string, s string, e string")
    out = normalise_times(df.withColumns({"z": F.lit(NY), "o": F.lit(True)}), "_id", {"s": "s", "e": "e"}, "z", "o").collect()
    assert [(r["utc_ms"], r["date_only"], len(r["mask"])) for r in out] == [(ms(2024, 1, 2, 3, 4, 5) + 111, False, 200)]


def test_operator_keeps_values_without_instant(spark):
    df = spark.createDataFrame([("a", "2024-01-02T00:00Z", None, NY, True, "m"), ("a", "2024-01-02T00:00Z", "soon", NY, True, "m"), (None, None, "3/1/2024", NY, True, "m")], "_id string, s string, e string, zone string, df boolean, mask string")
    out = normalise_times(df, "_id", {"s": "start", "e": "end"}, "zone", "df")
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted([tuple(r)[:3] for r in out.collect()], key=key) == sorted([("a", "start", ms(2024, 1, 2)), ("a", "start", ms(2024, 1, 2)), ("a", "end", None), (None, "end", ms(2024, 1, 3, zone=NY))], key=key)
    assert normalise_times(df.where("false"), "_id", {"s": "start"}, "zone", "df").count() == 0
