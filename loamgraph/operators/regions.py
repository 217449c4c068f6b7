"""Tables of regions: boxes and areas, simplified shapes, shapes united by group."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import shapes
from loamgraph.functions.geometry import polygons_of


def _each(regions: DataFrame, id_col: str, depiction: str, fn, schema: str) -> DataFrame:
    """The rows that ``fn(id, text)`` makes of each region, in batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([x for i, t in zip(pdf["i"], pdf["t"]) for x in fn(i, t)], columns=names)

    return regions.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(depiction).alias("t")).mapInPandas(run, schema)


def _closed(rings: list[np.ndarray]) -> list[np.ndarray]:
    return [np.vstack([r, r[:1]]) for r in rings]


def region_boxes(regions: DataFrame, id_col: str, depiction: str) -> DataFrame:
    """(region_id, west, south, east, north, area_km2, n_polygons) of each region that has polygons; holes take no area."""

    def box(i, t):
        polygons = polygons_of(t)
        if polygons:
            xy = np.concatenate([p[0] for p in polygons])
            yield (i, *xy.min(axis=0), *xy.max(axis=0), sum(shapes.polygon_area(_closed(p)) for p in polygons) / 1e6, len(polygons))

    return _each(regions, id_col, depiction, box, "region_id string, west double, south double, east double, north double, area_km2 double, n_polygons bigint")


def region_simplified(regions: DataFrame, id_col: str, depiction: str, tolerance: float = shapes.DEFAULT_TOLERANCE_DEG) -> DataFrame:
    """(region_id, vertices_in, vertices_out, shape) of each region of which the tolerance leaves something."""

    def simple(i, t):
        polygons = polygons_of(t)
        out = shapes.simplify_rings(polygons, tolerance)
        if out:
            yield i, sum(len(r) for p in polygons for r in p), sum(len(r) for p in out for r in p), json.dumps(shapes.to_geojson(out))

    return _each(regions, id_col, depiction, simple, "region_id string, vertices_in bigint, vertices_out bigint, shape string")


def united_regions(regions: DataFrame, group: Column, depiction: str) -> DataFrame:
    """(group_id, n_in, n_out, area_km2) of the shapes of each group as one shape; the polygons of a group are a map's regions, not rows."""

    def unite(key, pdf):
        polygons = [p for t in pdf["t"] for p in polygons_of(t)]
        u = shapes.union_polygons(polygons)
        return pd.DataFrame([(key[0], len(polygons), len(u), sum(shapes.polygon_area(_closed(p)) for p in u) / 1e6)], columns=["group_id", "n_in", "n_out", "area_km2"])

    rows = regions.select(group.cast("string").alias("group_id"), F.col(depiction).alias("t"))
    return rows.groupBy("group_id").applyInPandas(unite, "group_id string, n_in bigint, n_out bigint, area_km2 double")


def position_summary(df: DataFrame, group: str, lat: str, lng: str) -> DataFrame:
    """(group_id, lng, lat, n): the mean place of each group and how many places it is the mean of."""
    placed = df.where(F.col(group).isNotNull() & F.col(lat).isNotNull() & F.col(lng).isNotNull())
    return placed.groupBy(F.col(group).alias("group_id")).agg(F.avg(lng).alias("lng"), F.avg(lat).alias("lat"), F.count(F.lit(1)).alias("n"))
