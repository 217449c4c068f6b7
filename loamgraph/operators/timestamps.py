"""Timestamps in mixed formats and zones brought to one instant in epoch milliseconds UTC.

Every value is reduced to a mask of character classes (9 a digit, a a letter,
other characters as they are). A mask fixes where each field stands, so a parser
is made once per distinct mask and then runs over arrays of all values of it.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.zones import ABBREVIATIONS, wall_to_utc, zone_files, zone_version
from loamgraph.runtime import table

#: English month names, by their first three letters.
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_FULL = "january february march april may june july august september october november december".split()
_WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()

#: Letters up to which a mask's parser is kept; longer masks are parsed anew.
KEPT_MASK = 200

_DATE = (
    r"(?:(?P<y>9999)-(?P<m>99?)-(?P<d>99?)"
    r"|(?P<y2>9999)(?P<m2>99)(?P<d2>99)"
    r"|(?P<p>99?)/(?P<q>99?)/(?P<y3>9999)"
    r"|(?P<y7>9999)/(?P<m7>99?)/(?P<d7>99?)"
    r"|(?P<d4>99?)\.(?P<m4>99?)\.(?P<y4>9999)"
    r"|(?:(?P<wd>a{3,9}), ?)?(?P<d5>99?)[ -](?P<mon5>a{3,9})[ -](?P<y5>9999)"
    r"|(?:(?P<wd6>a{3,9}), ?)?(?P<mon6>a{3,9}) (?P<d6>99?),? (?P<y6>9999))"
)
_TIME = r"(?:(?:(?P<sep>a)|,? (?P<at>aa )?)(?:(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?|(?P<H2>99)(?P<M2>99)(?P<S2>99)(?:[.,](?P<f2>9+))?))"
_ZONE = r"(?: ?(?P<ap>aa)(?= |$))?(?: ?(?P<z>a{1,5})| ?(?P<sign>[+-])(?P<oh>99):?(?P<om>99)?| (?P<iana>a+(?:[_/+-][a9]+)+))?(?P<br>\[(?P<name>[a9_/+-]+)\])?"
_GRAMMAR = re.compile(rf"{_DATE}(?:{_TIME}{_ZONE})?")


_CLASS_OF = (("[0-9]", "9"), ("[A-Za-z]", "a"))


def clean(values: pa.Array) -> pa.Array:
    """Compatibility forms (full-width digits) made plain, outer blanks and a value object's wrapping off."""
    plain = _trimmed(pc.utf8_normalize(values, form="NFKC"))
    objects = np.flatnonzero(pc.starts_with(plain, "{").to_numpy(zero_copy_only=False))
    if len(objects):
        inner = pa.array([_inner(x) for x in plain.take(pa.array(objects)).to_pylist()], pa.string())
        mask = np.zeros(len(plain), bool)
        mask[objects] = True
        plain = pc.replace_with_mask(plain, pa.array(mask), inner)
    return plain


def _trimmed(values: pa.Array) -> pa.Array:
    return pc.utf8_trim_whitespace(pc.utf8_trim(pc.utf8_trim_whitespace(values), characters="\ufeff\u200b"))


def _inner(text: str) -> str:
    """What a value object holds; other objects are left as they are."""
    try:
        inner = json.loads(text).get("@value")
    except (ValueError, AttributeError, RecursionError):
        return text
    return str(inner).strip() if isinstance(inner, (str, int)) and not isinstance(inner, bool) else ""


def masks_of(values: pa.Array) -> pa.Array:
    """The character classes of each value, place by place."""
    for pattern, letter in _CLASS_OF:
        values = pc.replace_substring_regex(values, pattern, letter)
    return values


@lru_cache(maxsize=20_000)
def _kept_parser(mask: str):
    return _parser(mask)


def parser_of(mask: str):
    """The spans of the fields in values of this mask; a scale for bare epochs; None if it names no instant."""
    return _kept_parser(mask) if len(mask) <= KEPT_MASK else _parser(mask)


def _parser(mask: str):
    if set(mask) == {"9"} and len(mask) != 8:
        return {10: 1000.0, 13: 1.0, 16: 0.001}.get(len(mask))
    m = _GRAMMAR.fullmatch(mask)
    return {k: m.span(k) for k, v in m.groupdict().items() if v is not None} if m else None


def to_utc_ms(values: pa.Array, zones: np.ndarray, day_first: np.ndarray, files: dict[str, bytes] | None = None):
    """(utc milliseconds, whether each value names an instant, whether it is a date alone, masks) of cleaned values.

    ``zones`` holds names ('' for none), ``day_first`` 1, 0 or NaN where it is not known.
    """
    n = len(values)
    out, good, bare = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
    masks = masks_of(values)
    coded = masks.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for k, mask in enumerate(coded.dictionary.to_pylist()):
        plan = parser_of(mask)
        if plan is None:
            continue
        at = order[cuts[k] : cuts[k + 1]]
        chars = np.frombuffer("".join(values.take(pa.array(at)).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), len(mask))
        if isinstance(plan, float):
            number = _number(chars, 0, len(mask))
            out[at], good[at] = (number * int(plan) if plan >= 1 else number // 1000), True
            continue
        out[at], good[at] = _convert(plan, chars, zones[at], day_first[at], files)
        bare[at] = not ("H" in plan or "H2" in plan)
    return out, good, bare, masks


def _number(chars: np.ndarray, a: int, b: int) -> np.ndarray:
    out = np.zeros(len(chars), np.int64)
    for i in range(a, b):
        out = out * 10 + (chars[:, i].astype(np.int64) - 48)
    return out


def _words(chars: np.ndarray, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a column span and each row's place among them."""
    a, b = span
    words = np.ascontiguousarray(chars[:, a:b]).view(f"U{b - a}").ravel()
    return np.unique(words, return_inverse=True)


def _looked(chars: np.ndarray, span, fn) -> np.ndarray:
    words, inverse = _words(chars, span)
    return np.array([fn(str(w)) for w in words])[inverse]


def _month(word: str) -> int:
    w = word.lower()
    k = MONTHS.get(w[:3], 0)
    return k if k and (len(w) == 3 or w == "sept" or w == _FULL[k - 1]) else 0


def _convert(plan: dict, chars: np.ndarray, zones: np.ndarray, day_first: np.ndarray, files) -> tuple[np.ndarray, np.ndarray]:
    n = len(chars)
    get = lambda *names: next((_number(chars, *plan[k]) for k in names if k in plan), None)
    good = np.ones(n, bool)
    year, month, day = get("y", "y2", "y3", "y4", "y5", "y6", "y7"), get("m", "m2", "m4", "m7"), get("d", "d2", "d4", "d5", "d6", "d7")
    for k in ("mon5", "mon6"):
        if k in plan:
            month = _looked(chars, plan[k], _month).astype(np.int64)
    for k in ("wd", "wd6"):
        if k in plan:
            good &= _looked(chars, plan[k], lambda w: w.lower() in _WEEKDAYS or any(d[:3] == w.lower() for d in _WEEKDAYS)).astype(bool)
    if "p" in plan:
        p, q = get("p"), get("q")
        unknown = np.isnan(day_first)
        first = np.where(unknown, p > 12, day_first > 0)
        good &= ~unknown | (p > 12) | (q > 12)
        day, month = np.where(first, p, q), np.where(first, q, p)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where((month >= 1) & (month <= 12), month, 0)] + ((month == 2) & leap)
    good &= (year >= 1) & (day >= 1) & (day <= length)

    hour = minute = second = ms = np.zeros(n, np.int64)
    if "H" in plan or "H2" in plan:
        hour, minute = get("H", "H2"), get("M", "M2")
        second = get("S", "S2") if ("S" in plan or "S2" in plan) else second
        frac = plan.get("f") or plan.get("f2")
        if frac:
            digits = min(3, frac[1] - frac[0])
            ms = _number(chars, frac[0], frac[0] + digits) * 10 ** (3 - digits)
        if "sep" in plan:
            good &= _looked(chars, plan["sep"], lambda w: w in "Tt").astype(bool)
        if "at" in plan:
            good &= _looked(chars, plan["at"], lambda w: w.lower() == "at ").astype(bool)
        if "ap" in plan:
            half = _looked(chars, plan["ap"], lambda w: {"am": 0, "pm": 12}.get(w.lower(), -1))
            good &= (half >= 0) & (hour >= 1) & (hour <= 12)
            hour = hour % 12 + np.maximum(half, 0)
        good &= (hour <= 23) & (minute <= 59) & (second <= 59)

    ok_day = np.where(good, day, 1)
    ok_month = np.where(good, month, 1)
    ok_year = np.where(good, year, 1970)
    days = (ok_year - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (ok_month - 1)
    wall = (days.astype("datetime64[D]").astype(np.int64) + ok_day - 1) * 86400 + hour * 3600 + minute * 60 + second

    if "sign" in plan:
        oh, om = get("oh"), get("om") if "om" in plan else np.zeros(n, np.int64)
        good &= (oh <= 18) & (om <= 59)
        sign = np.where(chars[:, plan["sign"][0]] == ord("-"), -1, 1)
        return (wall - sign * (oh * 3600 + om * 60)) * 1000 + ms, good
    if "z" in plan:
        hours = _looked(chars, plan["z"], lambda w: ABBREVIATIONS.get(w.upper(), np.nan)).astype(float)
        good &= ~np.isnan(hours)
        return (wall - (np.nan_to_num(hours) * 3600).astype(np.int64)) * 1000 + ms, good
    named = plan.get("iana") or plan.get("name")
    if named:
        names, inverse = _words(chars, named)
    else:
        inverse, names = pd.factorize(zones)
    out = np.zeros(n, np.int64)
    for k, name in enumerate(names):
        rows = inverse == k
        utc = wall_to_utc(wall[rows], str(name), files) if len(name) else None
        if utc is None:
            good &= ~rows
        else:
            out[rows] = utc
    return out * 1000 + ms, good


_OUT = "id string, prop string, utc_ms bigint, date_only boolean, mask string, zone_version string"


def normalise_times(df: DataFrame, id_col: str, value_cols: dict[str, str], zone_col: str, day_first_col: str) -> DataFrame:
    """(id, prop, utc_ms, date_only, mask, zone_version) for each non-null value; utc_ms is null where it names no instant.

    ``value_cols`` maps a column to its name in ``prop``. A zone in the value wins
    over ``zone_col``; a null or unknown zone leaves zone-less values without an
    instant. Slashes follow ``day_first_col``; where that is null only dates that
    read one way count. Null ids are kept as null; values of any length are read
    whole, and their masks are reported up to ``KEPT_MASK`` letters; ties and repeated
    rows are kept; an empty table gives no rows.
    """
    cols = list(value_cols)
    slim = df.select(F.col(id_col).cast("string").alias("id"), F.col(zone_col).cast("string").alias("zone"), F.col(day_first_col).cast("boolean").alias("day_first"), *[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)])
    shared = df.sparkSession.sparkContext.broadcast((zone_files(), zone_version()))

    def convert(batches):
        files, version = shared.value
        for b in batches:
            for i, c in enumerate(cols):
                part = b.filter(pc.is_valid(b.column(f"v{i}")))
                if not part.num_rows:
                    continue
                zones = np.array(pc.fill_null(part.column("zone").cast(pa.string()), "").to_pylist(), dtype=object)
                days = pc.cast(part.column("day_first"), pa.float64()).to_numpy(zero_copy_only=False)
                utc, good, bare, masks = to_utc_ms(clean(part.column(f"v{i}").cast(pa.string())), zones, days, files)
                n = len(utc)
                same = lambda v: pa.array([v] * n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.string()), same(value_cols[c]), pa.array(utc, mask=~good), pa.array(bare & good), pc.utf8_slice_codeunits(masks, 0, KEPT_MASK), same(version)],
                    ["id", "prop", "utc_ms", "date_only", "mask", "zone_version"],
                )

    return slim.mapInArrow(convert, _OUT)


def instant_of(value: Column, zone: str) -> Column:
    """Epoch milliseconds of written times, read as ``normalise_times`` reads them, days first where slashes leave no doubt."""
    files = {zone: data for z, data in zone_files().items() if z == zone}

    def of(v: pd.Series) -> pd.Series:
        texts = pa.array(v, pa.string(), from_pandas=True)
        there = np.flatnonzero(pc.is_valid(texts).to_numpy(zero_copy_only=False))
        out = np.full(len(v), None, dtype=object)
        if len(there):
            utc, good, _, _ = to_utc_ms(clean(texts.take(pa.array(there))), np.full(len(there), zone, dtype=object), np.full(len(there), np.nan), files)
            out[there] = np.where(good, utc, None)
        return pd.Series(out, dtype=object)

    of.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "bigint")(value.cast("string"))


#: Text that names wall-clock fields: a date, and perhaps a time, without a zone.
ZONELESS = r"^\s*\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?\s*$"


def zoneless_instant(value: Column, zone: str) -> Column:
    """struct(matched, utc_ms): whether text has the form of a zone-less ISO time, and its instant in ``zone`` if it is a real one."""
    matched = F.coalesce(value.rlike(ZONELESS), F.lit(False))
    return F.struct(matched.alias("matched"), instant_of(F.when(matched, value), zone).alias("utc_ms"))


def publication_bounds(individuals: DataFrame, profiles: DataFrame) -> DataFrame:
    """The bounds of each individual's first delivery, with masks, by its zone and its source's day order."""
    values = F.struct("time_zone", "dcterms_source", "bold_publicdatastart", "bold_publicdataend")
    first = individuals.where("_id is not null").groupBy("_id").agg(F.min_by(values, F.struct("loaded_at", values)).alias("r")).select("_id", "r.*")
    order = profiles.groupBy(F.col("source_id").alias("dcterms_source")).agg(F.first("day_first", ignorenulls=True).alias("day_first"))
    return normalise_times(first.join(order, "dcterms_source", "left"), "_id", {"bold_publicdatastart": "bold:publicDataStart", "bold_publicdataend": "bold:publicDataEnd"}, "time_zone", "day_first")


def bounds_of(spark, sf_dir: str) -> DataFrame:
    return publication_bounds(table(spark, sf_dir, "individual"), table(spark, sf_dir, "source_profile"))


def mask_counts(bounds: DataFrame) -> DataFrame:
    """Values per shape and whether they name an instant, with the zone database used."""
    return bounds.groupBy("prop", "mask", "zone_version").agg(F.count(F.lit(1)).alias("n_values"), F.count("utc_ms").alias("n_instants"))
