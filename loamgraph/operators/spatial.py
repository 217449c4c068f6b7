"""Points near other points, and the regions that contain them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.geometry import EARTH_RADIUS_M, SlabIndex, circle_slabs, great_circle_m, polygons_of, slabs_of
from loamgraph.runtime import join_checked, materialize, table

#: Points of a grid cell beyond which it is split among several tasks.
HOT_CELL = 5_000
#: Slab edges up to which the slabs are broadcast (40 bytes an edge, 40 MB).
BROADCAST_EDGES = 1_000_000
#: Side of the tiles, in degrees, by which slabs and points meet beyond that.
TILE_DEG = 0.5
#: Points, and polygons, of a tile that meet in one task.
TILE_POINTS = 50_000


def position_counts(lat: Column, lng: Column) -> Column:
    """Both coordinates there, numbers, within ±90 and ±180 and not both zero."""
    good = ~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180) & ~((lat == 0) & (lng == 0))
    return F.coalesce(good, F.lit(False))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def distinct_points(df: DataFrame, id_col: str, lat: str, lng: str, loaded: str | None = None) -> DataFrame:
    """One row (id, lat, lng) a record whose position counts: that of its first delivery.

    Deliveries that tie on the load time are told apart by position, missing ones last.
    """
    la, lo = F.col(lat).cast("double"), F.col(lng).cast("double")
    order = [F.col(loaded)] if loaded else []
    key = F.struct(*order, la.isNull() | lo.isNull(), la, lo)
    out = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min_by(F.struct(la.alias("lat"), lo.alias("lng")), key).alias("p"))
    return out.select("id", "p.lat", "p.lng").where(position_counts(F.col("lat"), F.col("lng")))


def near_pairs(points: DataFrame, radius_m: float, hot_cell: int = HOT_CELL) -> DataFrame:
    """(left_id, right_id, metres) for all pairs of ``points(id, lat, lng)`` within ``radius_m``.

    Bands of latitude as high as the radius are cut into cells at least as wide;
    a point asks the cells its circle can reach and only pairs that share a cell
    are measured, each once (smaller id first). Cells of more than ``hot_cell``
    points are split by a salt on the asked side and copied on the other, so no
    task holds a crowded place. Meridian 180 and the poles are handled; repeated
    ids count once if their position is the same. Rows with null ids or positions
    that do not count give no pairs.
    """
    points = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    points = points.where(F.col("id").isNotNull() & position_counts(F.col("lat"), F.col("lng")))
    step = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)
    bands = F.lit(int(math.ceil(180 / step)))

    def cells(band: Column) -> Column:
        """Cells of a band: as many as fit at its edge nearest to a pole, at least as wide as the radius."""
        edge = F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90))
        return F.greatest(F.lit(1), F.floor(360 / step * F.cos(F.radians(F.least(edge, F.lit(90.0)))))).cast("long")

    def cell(lng: Column, n: Column) -> Column:
        return F.least(F.floor((lng + 180) / 360 * n), n - 1).cast("long")

    band = F.least(F.floor((F.col("lat") + 90) / step), bands - 1).cast("long")
    build = points.withColumn("band", band).withColumn("n", cells(F.col("band"))).withColumn("cell", cell(F.col("lng"), F.col("n")))
    build = build.select("id", "lat", "lng", "band", "cell")

    # The span of longitude that the circle covers; everything where it holds a pole.
    sin_r = math.sin(radius_m / EARTH_RADIUS_M)
    span = F.when(F.abs("lat") + step >= 90, F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sin_r / F.cos(F.radians("lat"))))) * (1 + 1e-9))
    probe = points.withColumns({"span": span, "own": band})
    probe = probe.withColumn("band", F.explode(F.sequence(F.greatest(F.col("own") - 1, F.lit(0)), F.least(F.col("own") + 1, bands - 1))))
    probe = probe.withColumn("n", cells(F.col("band")))
    first, last = F.floor((F.col("lng") - F.col("span") + 180) / 360 * F.col("n")), F.floor((F.col("lng") + F.col("span") + 180) / 360 * F.col("n"))
    last = F.least(last, first + F.col("n") - 1)
    probe = probe.withColumn("c", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("cell", F.pmod("c", "n"))
    probe = probe.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), "band", "cell")

    hot = build.groupBy("band", "cell").count().where(F.col("count") > hot_cell)
    hot = materialize(hot.select("band", "cell", F.ceil(F.col("count") / hot_cell).cast("int").alias("parts")))
    keys = ["band", "cell"]
    if not hot.isEmpty():
        build = join_checked(build, hot, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
        probe = join_checked(probe, hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
        keys = [*keys, "part"]
    pairs = build.join(probe, keys).where("id < id2")
    metres = haversine_m(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))
    return pairs.withColumn("metres", metres).where(F.col("metres") <= radius_m).select(F.col("id").alias("left_id"), F.col("id2").alias("right_id"), "metres")


_SLAB = "region string, part int, x0 double, x1 double, n int, edges array<double>"


def region_slabs(regions: DataFrame, id_col: str, depiction: str) -> DataFrame:
    """The slabs of each polygon of each region, in parallel; ``part`` numbers a region's polygons.

    Depictions that are null, empty, not GeoJSON or without area have no slabs.
    Rows with a null id are left out; repeated regions count once.
    """

    def slabs(batches):
        for pdf in batches:
            rows = []
            for region, texts in zip(pdf["region"], pdf["texts"]):
                for k, rings in enumerate(p for t in sorted(texts) for p in polygons_of(t)):
                    rows += [(region, k, x0, x1, len(e), e.ravel()) for x0, x1, e in slabs_of(rings)]
            yield pd.DataFrame(rows, columns=["region", "part", "x0", "x1", "n", "edges"])

    # Deliveries of one region that differ are polygons of the same region, so their numbers go on.
    texts = regions.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("region")).agg(F.collect_set(depiction).alias("texts"))
    return texts.mapInPandas(slabs, _SLAB)


def _index(region: np.ndarray, part: np.ndarray, x0: np.ndarray, x1: np.ndarray, n: np.ndarray, edges: np.ndarray) -> tuple[SlabIndex, np.ndarray]:
    """The index of all slabs, whose polygons are numbers, and the region of each number."""
    names, regions = pd.factorize(region)
    polygons, which = np.unique(names.astype(np.int64) * (int(part.max(initial=0)) + 1) + part, return_inverse=True)
    return SlabIndex(which, x0, x1, n, edges.reshape(-1, 4)), np.asarray(regions, object)[polygons // (int(part.max(initial=0)) + 1)]


def _index_of(pdf: pd.DataFrame) -> tuple[SlabIndex, np.ndarray]:
    edges = np.concatenate([np.asarray(e, float) for e in pdf["edges"]]) if len(pdf) else np.zeros(0)
    return _index(pdf["region"].to_numpy(), pdf["part"].to_numpy(), pdf["x0"].to_numpy(), pdf["x1"].to_numpy(), pdf["n"].to_numpy(), edges)


def _links(points: pd.DataFrame, at: np.ndarray, regions: np.ndarray) -> pd.DataFrame:
    """Distinct (point, region); several polygons of a region may hold one point."""
    out = pd.DataFrame({"at": at, "right_id": np.asarray(regions, object)}).drop_duplicates()
    ids = points["id"].astype(object).to_numpy()
    return pd.DataFrame({"left_id": ids[out["at"].to_numpy()] if len(out) else np.zeros(0, object), "right_id": out["right_id"].to_numpy()}, dtype=object)


def _tile(c: Column) -> Column:
    return F.floor(c / TILE_DEG).cast("int")


def _meeting(points: DataFrame, slabs: DataFrame, low: Column, high: Column) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points and slabs with the keys under which they meet: tiles of the map, crowded ones cut in parts of points times parts of polygons."""
    tiles = slabs.withColumn("tx", F.explode(F.sequence(_tile(F.greatest("x0", F.lit(-180.0))), _tile(F.least("x1", F.lit(180.0))))))
    tiles = tiles.withColumn("ty", F.explode(F.sequence(_tile(low), _tile(high))))
    placed = points.withColumns({"tx": _tile(F.col("lng")), "ty": _tile(F.col("lat"))})
    parts = lambda c, name: F.ceil(F.coalesce(F.col(c), F.lit(0)) / TILE_POINTS).cast("int").alias(name)
    crowd = placed.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    load = tiles.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("m"))
    crowd = materialize(crowd.join(load, ["tx", "ty"]).select("tx", "ty", parts("n", "p"), parts("m", "s")))
    placed = join_checked(placed, crowd, ["tx", "ty"]).withColumn("pn", F.pmod(F.xxhash64("id"), F.col("p")).cast("int")).withColumn("sn", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    tiles = join_checked(tiles, crowd, ["tx", "ty"]).withColumn("sn", F.pmod(F.xxhash64("region", "part"), F.col("s")).cast("int")).withColumn("pn", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    return placed.drop("p", "s"), tiles.drop("p", "s"), ["tx", "ty", "pn", "sn"]


def points_in_regions(points: DataFrame, regions: DataFrame, id_col: str, depiction: str, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """(left_id, right_id) for every point of ``points(id, lat, lng)`` and region that contains it.

    Slabs up to ``broadcast_edges`` edges go to every task; beyond that slabs and
    points meet by tiles of the map, crowded tiles split on both sides. Either way a
    point's slab and its place among the slab's edges are found by binary search,
    for all points and polygons at once.
    """
    slabs = materialize(region_slabs(regions, id_col, depiction))
    total = slabs.agg(F.sum("n")).first()[0] or 0
    points = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    points = points.where(F.col("id").isNotNull() & position_counts(F.col("lat"), F.col("lng")))
    out = f"left_id {points.schema['id'].dataType.simpleString()}, right_id string"
    if total == 0:
        return points.select(F.col("id").alias("left_id"), F.lit(None).cast("string").alias("right_id")).where("false")

    if total <= broadcast_edges:
        shared = points.sparkSession.sparkContext.broadcast(_index_of(slabs.toPandas()))

        def locate(batches):
            index, names = shared.value
            for pdf in batches:
                i, polygon = index.locate(pdf["lng"].to_numpy(), pdf["lat"].to_numpy())
                yield _links(pdf, i, names[polygon])

        return points.mapInPandas(locate, out)

    ys = F.filter("edges", lambda v, i: i % 2 == 1)
    placed, tiles, keys = _meeting(points, slabs, F.array_min(ys), F.array_max(ys))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index, names = _index_of(right)
        i, polygon = index.locate(left["lng"].to_numpy(), left["lat"].to_numpy())
        return _links(left, i, names[polygon])

    left = placed.select("id", "lat", "lng", *keys).groupBy(*keys)
    found = left.cogroup(tiles.select("region", "part", "x0", "x1", "n", "edges", *keys).groupBy(*keys)).applyInPandas(meet, out)
    return found.distinct()  # polygons of one region may have met a point in different parts


def near_by_slabs(points: DataFrame, radius_m: float) -> DataFrame:
    """(left_id, right_id, metres) for all pairs of ``points(id, lat, lng)`` within ``radius_m``, smaller id first.

    Each point's circle is drawn around by a polygon (``circle_slabs``) and the
    points are located in these by the slabs, as in regions; the great-circle
    distance then settles each pair that is found. Polygons and points meet by
    tiles, crowded tiles are cut on both sides. Meridian 180 and the poles are
    handled; ids are to be distinct; null ids and positions that do not count have
    no pairs.
    """
    points = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    points = points.where(F.col("id").isNotNull() & position_counts(F.col("lat"), F.col("lng")))
    kind = points.schema["id"].dataType.simpleString()

    def draw(batches):
        for pdf in batches:
            lat, lng = pdf["lat"].to_numpy(), pdf["lng"].to_numpy()
            for r, x0, x1, edges, copy in circle_slabs(lat, lng, radius_m):
                yield pd.DataFrame({"region": pdf["id"].to_numpy()[r], "part": copy.astype(np.int32), "x0": x0, "x1": x1, "lat2": lat[r], "lng2": lng[r], "edges": list(edges.reshape(len(r), -1))})

    slabs = materialize(points.mapInPandas(draw, f"region {kind}, part int, x0 double, x1 double, lat2 double, lng2 double, edges array<double>"))
    reach = math.degrees(radius_m / EARTH_RADIUS_M) * 1.02
    placed, tiles, keys = _meeting(points, slabs, F.col("lat2") - reach, F.col("lat2") + reach)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"left_id": [], "right_id": [], "metres": []}, dtype=object)
        edges = np.concatenate(right["edges"].to_numpy())
        index, names = _index(right["region"].to_numpy(), right["part"].to_numpy(), right["x0"].to_numpy(), right["x1"].to_numpy(), np.array([len(e) // 4 for e in right["edges"]]), edges)
        i, polygon = index.locate(left["lng"].to_numpy(), left["lat"].to_numpy())
        centre = right.drop_duplicates("region").set_index("region")[["lat2", "lng2"]]
        other = names[polygon]
        c = centre.loc[other].to_numpy()
        metres = great_circle_m(left["lat"].to_numpy()[i], left["lng"].to_numpy()[i], c[:, 0], c[:, 1])
        mine = left["id"].astype(object).to_numpy()[i]
        kept = np.flatnonzero((metres <= radius_m) & (mine < other)) if len(i) else np.zeros(0, int)
        return pd.DataFrame({"left_id": pd.Series(mine[kept], dtype=object), "right_id": pd.Series(other[kept], dtype=object), "metres": metres[kept]})

    left = placed.select("id", "lat", "lng", *keys).groupBy(*keys)
    return left.cogroup(tiles.select("region", "part", "x0", "x1", "lat2", "lng2", "edges", *keys).groupBy(*keys)).applyInPandas(meet, f"left_id {kind}, right_id {kind}, metres double")


def relations(observations: DataFrame, regions: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """(relation, left_id, right_id): observations near each other and within regions."""
    points = materialize(distinct_points(observations, "_id", "geo_lat", "geo_long", "loaded_at"))
    near = near_by_slabs(points, radius_m).select(F.lit("near").alias("relation"), "left_id", "right_id")
    within = points_in_regions(points, regions, "_id", "bold_spatialdepiction").select(F.lit("within").alias("relation"), "left_id", "right_id")
    return near.unionByName(within)


def relations_of(spark, sf_dir: str) -> DataFrame:
    return relations(table(spark, sf_dir, "observation"), table(spark, sf_dir, "study_region"))


def degrees(observations: DataFrame, regions: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """(observation_id, n_near, n_regions) for every observation whose position counts.

    Pairs come from the grid join and are counted as they arise, map-side first; they are not kept.
    """
    points = materialize(distinct_points(observations, "_id", "geo_lat", "geo_long", "loaded_at"))
    near = near_pairs(points, radius_m)
    n_near = near.select(F.explode(F.array("left_id", "right_id")).alias("observation_id")).groupBy("observation_id").agg(F.count(F.lit(1)).alias("n_near"))
    within = points_in_regions(points, regions, "_id", "bold_spatialdepiction")
    n_regions = within.groupBy(F.col("left_id").alias("observation_id")).agg(F.count(F.lit(1)).alias("n_regions"))
    out = points.select(F.col("id").alias("observation_id"))
    return out.join(n_near, "observation_id", "left").join(n_regions, "observation_id", "left").na.fill(0, ["n_near", "n_regions"])


def degrees_of(spark, sf_dir: str) -> DataFrame:
    return degrees(table(spark, sf_dir, "observation"), table(spark, sf_dir, "study_region"))
