"""Stops and trips from location pings, by simplified tracks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loamgraph.functions.tracks import find_stops, great_circle, low_speed, noise, on_sphere, simplify, slow_runs
from loamgraph.operators.heavykeys import epoch_ms
from loamgraph.operators.ids import qname, read_context
from loamgraph.operators.spatial import position_counts
from loamgraph.runtime import BROADCAST_ROWS, materialize, table

#: Pings that a task gathers before it works on the complete sessions among them.
CHUNK = 100_000
#: Pings of one device and collar beyond which its silences are found first and its stretches spread over tasks.
HOT_PINGS = 1_000_000


@dataclass(frozen=True)
class TripRules:
    radius_m: float = 150.0
    min_pings: int = 4
    min_stop_ms: int = 3_600_000
    max_silence_ms: int = 6 * 3_600_000
    max_speed: float = 15.0
    tolerance_m: float = 50.0


_PING = ["device", "collar", "t", "p", "lat", "lng"]


_OUT = "kind string, device string, collar string, start_ms bigint, end_ms bigint, n_pings bigint, distance_m double, lat double, lng double"
_ARROW = pa.schema([("kind", pa.string()), ("device", pa.string()), ("collar", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("n_pings", pa.int64()), ("distance_m", pa.float64()), ("lat", pa.float64()), ("lng", pa.float64())])


def stops_and_trips(pings: DataFrame, rules: TripRules = TripRules(), hot_pings: int = HOT_PINGS, by_segments: bool = False) -> DataFrame:
    """Stops and trips of ``pings(ping, device, collar, t, lat, lng)`` (t in epoch milliseconds).

    Pings are shuffled by device and collar and sorted by time; each task reads its
    partition as a stream and keeps only the session (the pings between two
    silences) it is in, so a device's history is never held as a whole. A session
    is simplified by time-synchronised Douglas-Peucker; stretches that the
    simplified track passes at low speed are checked ping by ping for stops, and
    what it retains between two stops makes the trip and its distance.

    Pings with a null device or time, or a position that does not count, are left
    out; a null collar is a collar of its own. Pings delivered again with the same
    device, collar and time count once; other ties are ordered by ping id. A silence
    ends a session. An empty table gives no rows. A device and collar with more than
    ``hot_pings`` pings are split at silences, see ``split_hot``.

    With ``by_segments`` the simplified track alone decides: stops are the longest
    runs of segments passed no faster than the stop's width in its least time.
    """
    good = F.col("device").isNotNull() & F.col("t").isNotNull() & position_counts(F.col("lat"), F.col("lng"))
    slim = pings.where(good).select(
        F.col("device").cast("string"), F.col("collar").cast("string"), F.col("t").cast("bigint"), F.xxhash64("ping").alias("p"), F.col("lat").cast("double"), F.col("lng").cast("double")
    )
    # Counts of collars alone bound those of devices and collars and read one column.
    crowded = pings.groupBy("collar").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_pings)
    if crowded.isEmpty():
        slim = slim.withColumns({"stretch": F.lit(0), "aside": F.lit(False)})
    else:
        slim = split_hot(slim, rules.max_silence_ms, hot_pings)
    ordered = slim.repartition("device", "collar", "stretch").sortWithinPartitions("device", "collar", "stretch", "t", "p")

    return ordered.mapInArrow(track_reader(rules, by_segments), _OUT)


def track_reader(rules: TripRules, by_segments: bool = False):
    """Turns a stream of batches, sorted by device, collar, stretch and time, into batches of stops and trips."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, want = 0, CHUNK
        before = None  # the last raw ping already dealt with, of the same device and collar
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < want:
                continue
            tab = pa.Table.from_batches(held).combine_chunks()
            out, tab, before = _work(tab, before, rules, False, by_segments)
            if out is not None:
                yield out
            held, rows = tab.to_batches(), tab.num_rows
            want = max(CHUNK, 2 * rows)
        if held:
            out, _, _ = _work(pa.Table.from_batches(held).combine_chunks(), before, rules, True, by_segments)
            if out is not None:
                yield out

    return run


def split_hot(pings: DataFrame, max_silence_ms: int, hot_pings: int) -> DataFrame:
    """``pings`` with ``stretch`` (0 unless the device and collar are hot) and ``aside`` (true for neighbours that only decide on noise).

    Time is cut into buckets as long as a silence; an empty bucket is a silence for
    certain. Which buckets are empty is known from counts, which combine map-side,
    so a hot group is numbered without being gathered. Each stretch also gets the
    last ping before it and the first one after it, as those decide whether its
    outer pings are noise.
    """
    plain = pings.withColumns({"stretch": F.lit(0), "aside": F.lit(False)})
    hot = materialize(pings.groupBy("device", "collar").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_pings).select(F.col("device").alias("h_device"), F.col("collar").alias("h_collar")))
    if hot.isEmpty():
        return plain
    if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    same = lambda other: F.col("device").eqNullSafe(other["h_device"]) & F.col("collar").eqNullSafe(other["h_collar"])
    bucket = F.floor(F.col("t") / max_silence_ms).alias("bucket")
    end = F.struct("t", "p", "lat", "lng")
    filled = pings.join(hot, same(hot), "left_semi").groupBy("device", "collar", bucket).agg(F.min(end).alias("first"), F.max(end).alias("last"))
    order = W.Window.partitionBy("device", "collar").orderBy("bucket")
    filled = filled.withColumn("opens", F.coalesce((F.col("bucket") - F.lag("bucket").over(order) > 1).cast("int"), F.lit(0))).withColumn("stretch", F.sum("opens").over(order))
    filled = materialize(filled)
    ends = filled.groupBy("device", "collar", "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    by = W.Window.partitionBy("device", "collar").orderBy("stretch")
    beside = ends.withColumns({"b": F.lag("last").over(by), "a": F.lead("first").over(by)})
    beside = beside.select("device", "collar", "stretch", F.explode(F.array_compact(F.array("b", "a"))).alias("e"))
    beside = beside.select("device", "collar", "e.*", "stretch", F.lit(True).alias("aside")).select(*_PING, "stretch", "aside")
    number = filled.select(F.col("device").alias("h_device"), F.col("collar").alias("h_collar"), F.col("bucket").alias("h_bucket"), "stretch")
    numbered = pings.join(number, same(number) & (F.floor(F.col("t") / max_silence_ms) == number["h_bucket"])).select(*_PING, "stretch", F.lit(False).alias("aside"))
    rest = plain.join(hot, same(hot), "left_anti").select(*_PING, "stretch", "aside")
    return rest.unionByName(numbered).unionByName(beside)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    code = column.combine_chunks().dictionary_encode(null_encoding="encode")
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    i = code.indices.to_numpy(zero_copy_only=False)
    return i[1:] != i[:-1]


def _work(tab: pa.Table, before, rules: TripRules, final: bool, by_segments: bool):
    """(results, pings still to come back to, the ping before those)."""
    n = tab.num_rows
    if not n:
        return None, tab, before
    t, p = tab.column("t").to_numpy(), tab.column("p").to_numpy()
    lat, lng = tab.column("lat").to_numpy(), tab.column("lng").to_numpy()
    new = np.concatenate([[True], _changes(tab.column("device")) | _changes(tab.column("collar")) | _changes(tab.column("stretch"))])
    again = np.concatenate([[False], ~new[1:] & (t[1:] == t[:-1]) & (p[1:] == p[:-1])])
    row = np.flatnonzero(~again)
    new = np.logical_or.reduceat(new, row) if len(row) < n else new
    t, lat, lng = t[row], lat[row], lng[row]
    group = np.cumsum(new)
    xyz = on_sphere(lat, lng)
    aside = tab.column("aside").to_numpy()[row]
    key = _key(tab, 0)
    if before is not None and before[0] == key:
        g, tt, pos = np.concatenate([[group[0]], group]), np.concatenate([[before[1]], t]), np.vstack([before[2], xyz])
        bad = noise(g, tt, pos, rules.max_speed)[1:]
    else:
        bad = noise(group, t, xyz, rules.max_speed)

    m = len(t)
    cut = m
    if not final:
        start = np.concatenate([[True], group[1:] != group[:-1]])
        silent = np.concatenate([[False], (np.diff(t) > rules.max_silence_ms) & ~bad[1:] & ~bad[:-1]])
        silent[-1:] = False  # whether the last ping is noise is not known yet
        places = np.flatnonzero(start | silent)
        cut = int(places[-1])
        if cut == 0:
            return None, tab, before
    good = np.flatnonzero(~bad[:cut] & ~aside[:cut])
    out = _sessions(tab, row, good, group, t, lat, lng, xyz, rules, by_segments)
    if final:
        return out, None, None
    same = group[cut] == group[cut - 1]
    last = (_key(tab, int(row[cut])), t[cut - 1], xyz[cut - 1]) if same else None
    return out, tab.slice(int(row[cut])), last


def _key(tab: pa.Table, i: int) -> tuple:
    return tuple(tab.column(c)[i].as_py() for c in ("device", "collar", "stretch"))


def _sessions(tab, row, good, group, t, lat, lng, xyz, rules: TripRules, by_segments: bool):
    if not len(good):
        return None
    row, group, t, lat, lng, xyz = row[good], group[good], t[good], lat[good], lng[good], xyz[good]
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (np.diff(t) > rules.max_silence_ms)])
    session = np.cumsum(fresh) - 1
    keep = simplify(session, t, xyz, rules.tolerance_m)
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(t)]])
    if by_segments:
        runs = slow_runs(session, t, xyz, keep, 2000.0 * rules.radius_m / rules.min_stop_ms, rules.min_pings, rules.min_stop_ms)
        where = session[runs[:, 0]]
        found = ((s, (runs[where == s] - first[s]).tolist()) for s in np.unique(where))
    else:
        slow = low_speed(session, t, xyz, keep, rules.min_stop_ms, 2 * (rules.radius_m + rules.tolerance_m))
        look = lambda a, b: find_stops(t[a:b], lat[a:b], lng[a:b], slow[a:b], rules.radius_m, rules.min_pings, rules.min_stop_ms)
        found = ((s, look(first[s], last[s])) for s in np.unique(session[slow]))
    rows = []
    for s, stops in found:
        a = first[s]
        previous = None
        for i, j in stops:
            i, j = a + i, a + j
            if previous is not None:
                via = np.concatenate([[previous], previous + 1 + np.flatnonzero(keep[previous + 1 : i]), [i]])
                rows.append(("trip", row[i], t[previous], t[i], i - previous + 1, great_circle(xyz[via[1:]], xyz[via[:-1]]).sum(), np.nan, np.nan))
            centre = xyz[i : j + 1].mean(axis=0)
            clat = np.degrees(np.arctan2(centre[2], np.hypot(centre[0], centre[1])))
            rows.append(("stop", row[i], t[i], t[j], j - i + 1, 0.0, clat, np.degrees(np.arctan2(centre[1], centre[0]))))
            previous = j
    if not rows:
        return None
    kind, at, start, end, n, dist, la, lo = zip(*rows)
    at = pa.array(np.array(at, np.int64))
    nan_null = lambda v: pa.array(np.array(v, float), from_pandas=True)
    columns = [pa.array(kind), tab.column("device").take(at).combine_chunks(), tab.column("collar").take(at).combine_chunks(), pa.array(np.array(start, np.int64)), pa.array(np.array(end, np.int64)), pa.array(np.array(n, np.int64)), pa.array(np.array(dist, float)), nan_null(la), nan_null(lo)]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=_ARROW)


def trips_of_reports(reports: DataFrame, context: DataFrame, rules: TripRules = TripRules(), by_segments: bool = False) -> DataFrame:
    """(kind, animal_id, collar, start_ms, end_ms, duration_s, n_pings, distance_m, lat, lng) over tracking reports."""
    animal = qname(F.col("bold_animal"), read_context(context))
    pings = reports.select(
        F.col("_id").alias("ping"),
        F.nullif(animal, F.lit("")).alias("device"),
        F.col("bold_collar").alias("collar"),
        epoch_ms(F.col("_when_ms")).alias("t"),
        F.col("geo_lat").alias("lat"),
        F.col("geo_long").alias("lng"),
    )
    out = stops_and_trips(pings, rules, by_segments=by_segments)
    return out.select("kind", F.col("device").alias("animal_id"), "collar", "start_ms", "end_ms", ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration_s"), "n_pings", "distance_m", "lat", "lng")


def trips_of(spark, sf_dir: str, by_segments: bool = False) -> DataFrame:
    return trips_of_reports(table(spark, sf_dir, "tracking_report"), table(spark, sf_dir, "jsonld_context"), by_segments=by_segments)


def totals(trips: DataFrame) -> DataFrame:
    """Stops and trips per animal: how many, how long and how far."""
    stop, trip = F.col("kind") == "stop", F.col("kind") == "trip"
    return trips.groupBy("animal_id").agg(
        F.count_if(stop).alias("n_stops"),
        F.count_if(trip).alias("n_trips"),
        F.sum(F.when(stop, F.col("duration_s"))).alias("stop_s"),
        F.sum(F.when(trip, F.col("duration_s"))).alias("trip_s"),
        F.sum(F.when(trip, F.col("distance_m"))).alias("trip_m"),
    )
