"""How a resource is drawn: its own place, a shape it carries, or the outline of the region it lies in."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import shapes
from loamgraph.functions.geometry import polygons_of
from loamgraph.operators.spatial import points_in_regions


def numeric(c: Column) -> Column:
    """A number from a number, its text, or a JSON value object or one-element array of it; else null."""
    s = F.trim(c.cast("string"))
    inner = F.when(s.startswith("["), F.get_json_object(s, "$[0]")).otherwise(s)
    inner = F.when(inner.startswith("{"), F.get_json_object(inner, "$['@value']")).otherwise(inner)
    value = inner.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def spatial_depiction(lat: Column, lng: Column, *candidates: Column) -> Column:
    """GeoJSON text: a Point where both coordinates are numbers, else the first candidate that is not blank, else null."""
    la, lo = numeric(lat), numeric(lng)
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lo, la).alias("coordinates")))
    return F.coalesce(F.when(la.isNotNull() & lo.isNotNull(), point), *[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def outline(points: DataFrame, regions: DataFrame, id_col: str, depiction: str, order: str | None = None) -> DataFrame:
    """(id, region): for every point the first region, by ``order`` or id, that contains it; points in none have no row."""
    found = points_in_regions(points, regions, id_col, depiction)
    rank = regions.groupBy(F.col(id_col).alias("right_id")).agg(F.min(F.col(order or id_col)).alias("__rank"))
    return found.join(rank, "right_id").groupBy(F.col("left_id").alias("id")).agg(F.min_by("right_id", F.struct("__rank", "right_id")).alias("region"))


def build_depictions(regions: DataFrame, id_col: str, depiction: str, roles: dict[str, float | None]) -> DataFrame:
    """(id, depictions): a JSON array with one feature a role; a role's tolerance (degrees) simplifies, None keeps the detail.

    Shapes without area, or that a tolerance leaves nothing of, have no feature for that role.
    """

    def build(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"]):
                polys = polygons_of(text)
                made = []
                for role, tolerance in roles.items():
                    geometry = shapes.to_geojson(polys if tolerance is None else shapes.simplify_rings(polys, tolerance))
                    if geometry:
                        made.append(shapes.with_role({"type": "Feature", "properties": {}, "geometry": geometry}, role))
                if made:
                    out.append((i, json.dumps(made, separators=(",", ":"))))
            yield pd.DataFrame(out, columns=["id", "depictions"], dtype=object)

    return regions.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(depiction).alias("text")).mapInPandas(build, "id string, depictions string")


def merge_depictions(regions: DataFrame, group: str, depiction: str, min_hole_m2: float = shapes.MIN_HOLE_AREA_M2, winding: str = "ccw") -> DataFrame:
    """(group, shape, n_shapes): the union of each group's depictions as GeoJSON; groups without area have a null shape.

    A group's shapes meet in one task: regions are few and large. Null groups are a group.
    """

    def unite(key, pdf):
        polys = [p for t in pdf["text"] for p in polygons_of(t)]
        shape = shapes.to_geojson(shapes.union_polygons(polys, min_hole_m2), winding)
        return pd.DataFrame([(key[0], json.dumps(shape, separators=(",", ":")) if shape else None, len(pdf))], columns=["group", "shape", "n_shapes"], dtype=object)

    return regions.select(F.col(group).cast("string").alias("group"), F.col(depiction).alias("text")).groupBy("group").applyInPandas(unite, "group string, shape string, n_shapes bigint")


def app_setting(settings: dict | None, name: str, default=None):
    """A property of the application's settings resource; never raises."""
    value = settings.get(name) if isinstance(settings, dict) else None
    return default if value is None else value[0] if isinstance(value, list) and value else value


def public_delay_days(settings: dict | None, option=None, name: str = "app:publicDataDelayDays") -> float:
    """The setting if it is a number of at least 0, else the option if positive, else 0."""
    value = app_setting(settings, name)
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value >= 0:
        return value
    return option if isinstance(option, (int, float)) and option > 0 else 0
