"""Zone transition tables as arrays, and wall-clock times turned into instants by them.

The compiled zone files (RFC 8536) are read once, on the driver, and travel with
the version of their database; their tables are made from these bytes wherever
they are needed, so that all executors convert alike.
"""

from __future__ import annotations

import datetime as dt
import re
import struct
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, available_timezones

import numpy as np

#: Offsets in hours of the zone abbreviations that name one offset in the sources' use.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
    "AKST": -9, "AKDT": -8, "HST": -10, "AST": -4, "ADT": -3, "NST": -3.5, "NDT": -2.5,
    "BST": 1, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "AWST": 8, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
}

#: The calendar repeats after 400 years, so rules are written out to this year and later years fold back.
_RULE_END = 2500
_PERIOD_S = 146_097 * 86_400


def zone_version() -> str:
    """Version of the zone database that ``zone_files`` reads."""
    for folder in TZPATH:
        try:
            with open(f"{folder}/tzdata.zi") as f:
                return f.readline().strip("# \n")
        except OSError:
            continue
    try:
        import tzdata

        return f"tzdata {tzdata.IANA_VERSION}"
    except ImportError:
        return "system"


def _file(zone: str) -> bytes | None:
    for folder in TZPATH:
        try:
            return Path(folder, zone).read_bytes()
        except OSError:
            continue
    try:
        from importlib import resources

        return resources.files("tzdata.zoneinfo").joinpath(zone).read_bytes()
    except (ImportError, OSError):
        return None


@lru_cache(maxsize=1)
def zone_files() -> dict[str, bytes]:
    """The compiled file of every zone of the database (about 1 MB in all)."""
    return {z: data for z in sorted(available_timezones()) if (data := _file(z)) and data[:4] == b"TZif"}


@lru_cache(maxsize=1024)
def table_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(utc seconds of each change of offset, offsets before, between and after them) of a zone file.

    Before its first change a zone has its first offset; after the last one the
    rule in the file's footer goes on.
    """
    block, width = 0, 4
    if data[4:5] >= b"2":
        block, width = 44 + _size(data, 0, 4), 8
    n_time, n_type = struct.unpack_from(">6I", data, block + 20)[3:5]
    place = block + 44
    at = np.frombuffer(data, f">i{width}", n_time, place).astype(np.int64)
    kind = np.frombuffer(data, np.uint8, n_time, place + n_time * width)
    first = place + n_time * (width + 1)
    of_kind = np.array([struct.unpack_from(">lBB", data, first + 6 * i)[0] for i in range(n_type)], np.int64)
    offsets = np.concatenate([of_kind[:1], of_kind[kind]])
    if width == 8:
        footer = data[block + 44 + _size(data, block, 8) :].strip(b"\n").decode("ascii")
        more_at, more = _by_rule(footer, int(at[-1]) if len(at) else -(1 << 40))
        at, offsets = np.concatenate([at, more_at]), np.concatenate([offsets, more])
    changes = np.flatnonzero(offsets[1:] != offsets[:-1])
    return at[changes], offsets[np.concatenate([[0], changes + 1])]


def _size(data: bytes, block: int, width: int) -> int:
    utc, std, leap, n_time, n_type, chars = struct.unpack_from(">6I", data, block + 20)
    return n_time * (width + 1) + n_type * 6 + chars + leap * (width + 4) + std + utc


_NAME = r"(?:<[^>]+>|[A-Za-z]{3,})"
_RULE = re.compile(rf"{_NAME}([+-]?[\d:]+)(?:{_NAME}([+-]?[\d:]+)?,([^,]+),([^,]+))?$")


def _seconds(text: str) -> int:
    sign = -1 if text.startswith("-") else 1
    h, m, s = ([int(x) for x in text.lstrip("+-").split(":")] + [0, 0])[:3]
    return sign * (h * 3600 + m * 60 + s)


def _by_rule(footer: str, after: int) -> tuple[np.ndarray, np.ndarray]:
    """The changes later than ``after`` that the footer's rule makes; none if the offset stays."""
    m = _RULE.match(footer)
    if not m or not m.group(3):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    standard = -_seconds(m.group(1))
    summer = -_seconds(m.group(2)) if m.group(2) else standard + 3600
    year = max(1970, dt.datetime.fromtimestamp(max(after, 0), dt.UTC).year)
    changes = []
    for y in range(year, _RULE_END):
        changes.append((_rule_day(m.group(3), y) - standard, summer))
        changes.append((_rule_day(m.group(4), y) - summer, standard))
    changes = sorted(c for c in changes if c[0] > after)
    return np.array([c[0] for c in changes], np.int64), np.array([c[1] for c in changes], np.int64)


def _rule_day(rule: str, year: int) -> int:
    """Wall-clock seconds at which a rule of a year falls."""
    day, _, clock = rule.partition("/")
    time = _seconds(clock) if clock else 7200
    if day.startswith("M"):
        month, week, weekday = (int(x) for x in day[1:].split("."))
        first = dt.date(year, month, 1)
        d = 1 + (weekday - first.isoweekday()) % 7 + 7 * (week - 1)
        last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
        date = dt.date(year, month, d if d <= last else d - 7)
    elif day.startswith("J"):
        leap_day = int(day[1:]) >= 60 and year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
        date = dt.date(year, 1, 1) + dt.timedelta(days=int(day[1:]) - 1 + leap_day)
    else:
        date = dt.date(year, 1, 1) + dt.timedelta(days=int(day))
    return (date.toordinal() - dt.date(1970, 1, 1).toordinal()) * 86_400 + time


def wall_to_utc(wall_s: np.ndarray, zone: str, files: dict[str, bytes] | None = None) -> np.ndarray | None:
    """UTC seconds of wall-clock seconds, None for no zone.

    A repeated time is the first of the two; a skipped one is read with the offset before the change.
    """
    data = (zone_files() if files is None else files).get(zone)
    if data is None:
        return None
    at, off = table_of(data)
    end = (dt.date(_RULE_END - 1, 1, 1).toordinal() - dt.date(1970, 1, 1).toordinal()) * 86_400
    fold = np.where(wall_s >= end, -(-(wall_s - end + 1) // _PERIOD_S), 0) * _PERIOD_S
    switch = at + np.maximum(off[:-1], off[1:])
    return wall_s - off[np.searchsorted(switch, wall_s - fold, side="right")]
