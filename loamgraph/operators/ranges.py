"""Spatial ranges of groups: hulls combined on the way, so a hot group never meets as a whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import shapes
from loamgraph.functions.tracks import _hull

#: Points of a group that a task holds before it reduces them to their hull.
REDUCE_AT = 256
#: Corners that a task sends on at a time.
FRAME_ROWS = 20_000


def group_hulls(df: DataFrame, group: str, lat: str, lng: str, winding: str = "cw") -> DataFrame:
    """(group, vertices, area_km2, ring) of each group's convex hull, ``ring`` as GeoJSON text.

    Each task keeps per group only the corners of what it has seen: the hull of
    hulls is the hull. Groups with fewer than three places, or with all on one
    line, have no row; null groups and positions are left out.
    """
    slim = df.where(F.col(group).isNotNull() & F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(lat).cast("double").alias("y"), F.col(lng).cast("double").alias("x"))
    schema = "g string, y double, x double"

    def corners(batches):
        names, parts, n = [], [], 0
        for name, xy in _reduced(batches):
            names.append(name)
            parts.append(xy)
            n += len(xy)
            if n >= FRAME_ROWS:
                yield _frame(names, parts)
                names, parts, n = [], [], 0
        if parts:
            yield _frame(names, parts)

    def hull(batches):
        rows = []
        for name, xy in _reduced(batches):
            out = shapes.spatial_range(xy, winding=winding)
            if out:
                rows.append((name, len(out["ring"]) - 1, out["area_km2"], shapes.depiction_text({"type": "Polygon", "coordinates": [out["ring"].tolist()]})))
        yield pd.DataFrame(rows, columns=["g", "vertices", "area_km2", "ring"])

    out = slim.mapInPandas(corners, schema).repartition("g").mapInPandas(hull, "g string, vertices bigint, area_km2 double, ring string")
    return out.withColumnRenamed("g", group)


def _reduced(batches):
    """(group, corners) of all rows of a stream, of which only corners are held."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for pdf in batches:
        codes, names = pd.factorize(pdf["g"])
        order = np.argsort(codes, kind="stable")
        xy = pdf[["x", "y"]].to_numpy()[order]
        cuts = np.searchsorted(codes[order], np.arange(len(names) + 1)).tolist()
        for k, name in enumerate(names):
            held.setdefault(name, []).append(xy[cuts[k] : cuts[k + 1]])
            size[name] = size.get(name, 0) + cuts[k + 1] - cuts[k]
            if size[name] > REDUCE_AT:
                held[name] = [_corners(held[name])]
                size[name] = len(held[name][0])
    for name, parts in held.items():
        yield name, _corners(parts)


def _corners(parts: list[np.ndarray]) -> np.ndarray:
    p = np.unique(np.concatenate(parts), axis=0)
    return _hull(p) if len(p) > 8 else p


def _frame(names: list, parts: list[np.ndarray]) -> pd.DataFrame:
    xy = np.concatenate(parts)
    return pd.DataFrame({"g": np.repeat(np.array(names, dtype=object), [len(p) for p in parts]), "y": xy[:, 1], "x": xy[:, 0]})


def update_ranges(individuals: DataFrame, ranges: DataFrame, id_col: str, property_name: str, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(individuals with the property set or, without a hull, unset; what became of each).

    The second table is (id, outcome): ``set``, ``unset`` (the individual had one and
    has no hull now), ``kept`` (nothing changes) or ``unmatched`` (a group that names
    nobody). With ``dry_run`` the individuals come back as they are.
    """
    had = F.col(property_name) if property_name in individuals.columns else F.lit(None).cast("string")
    r = ranges.select(F.col("group_id").alias(id_col), F.col("ring").alias("__ring")).dropDuplicates([id_col])
    both = individuals.withColumn("__had", had).join(r, id_col, "left")
    outcome = F.when(F.col("__ring").eqNullSafe(F.col("__had")), "kept").when(F.col("__ring").isNull(), "unset").otherwise("set")
    told = both.select(F.col(id_col).alias("id"), outcome.alias("outcome")).unionByName(r.join(individuals, id_col, "left_anti").select(F.col(id_col).alias("id"), F.lit("unmatched").alias("outcome")))
    if dry_run:
        return individuals, told
    return both.drop("__had", *([property_name] if property_name in individuals.columns else [])).withColumnRenamed("__ring", property_name), told
