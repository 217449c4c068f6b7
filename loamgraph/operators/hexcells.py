"""Hexagonal cells of rows: backfill from positions, centres, neighbours and the regions that hold them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import hexgrid
from loamgraph.functions.cells import FINEST, STORED_RESOLUTIONS, cell_field, cell_parent
from loamgraph.operators.spatial import points_in_regions

#: Fixed value: decimals of centres that are given out (about 11 m).
CENTRE_DIGITS = 4


def cell_of(lat: Column, lng: Column, resolution: int) -> Column:
    """The cell id of a position; null where a coordinate is missing or no number."""

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(hexgrid.texts(hexgrid.cells_of(a.to_numpy(float, na_value=float("nan")), b.to_numpy(float, na_value=float("nan")), resolution)), dtype=object)

    of.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "string")(lat.cast("double"), lng.cast("double"))


def cell_centre(cell: Column) -> Column:
    """struct(lat, lng) of a cell's centre; null fields for what is no cell id."""

    def of(c: pd.Series) -> pd.DataFrame:
        lat, lng = hexgrid.centres_of(hexgrid.numbers(c.tolist()))
        return pd.DataFrame({"lat": pd.Series(lat).astype(object).where(~pd.isna(lat), None), "lng": pd.Series(lng).astype(object).where(~pd.isna(lng), None)})

    of.__annotations__ = {"c": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(of, "lat double, lng double")(cell)


def add_cells(df: DataFrame, lat: str, lng: str, force: bool = False) -> DataFrame:
    """``df`` with the finest cell of each position and its stored parents.

    Rows that have a finest cell keep theirs unless ``force``; rows without two
    numbers get none. Only missing cells are computed, in Arrow batches; parents
    follow from the bits of the finest.
    """
    finest = cell_field(FINEST)
    had = F.col(finest) if finest in df.columns else F.lit(None).cast("string")
    open_ = F.lit(True) if force else had.isNull()
    made = cell_of(F.when(open_, F.col(lat)), F.col(lng), FINEST)
    out = df.withColumn(finest, F.coalesce(made, had))
    for r in STORED_RESOLUTIONS:
        name = cell_field(r)
        kept = F.col(name) if name in df.columns else F.lit(None).cast("string")
        fresh = cell_parent(F.col(finest), r)
        out = out.withColumn(name, fresh if force else F.coalesce(kept, fresh))
    return out


def backfill_counts(df: DataFrame, lat: str, lng: str, force: bool = False) -> DataFrame:
    """(updated, skipped) of a backfill: rows given a cell, and rows with both coordinates there that are no numbers."""
    finest = cell_field(FINEST)
    a, b = F.col(lat).cast("double"), F.col(lng).cast("double")
    there = F.col(lat).isNotNull() & F.col(lng).isNotNull()
    if finest in df.columns and not force:
        there = there & F.col(finest).isNull()
    good = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    return df.agg(F.count_if(there & good).alias("updated"), F.count_if(there & ~F.coalesce(good, F.lit(False))).alias("skipped"))


def cell_centroids(df: DataFrame, cell: str, digits: int = CENTRE_DIGITS) -> DataFrame:
    """(cell, lat, lng) of the distinct cells of a column; what is no cell id is left out."""
    cells = df.select(F.col(cell).alias("cell")).where("cell is not null").distinct()
    placed = cells.withColumn("c", cell_centre(F.col("cell"))).where("c.lat is not null")
    return placed.select("cell", F.round("c.lat", digits).alias("lat"), F.round("c.lng", digits).alias("lng"))


def tag_regions(df: DataFrame, cell: str, regions: DataFrame, id_col: str, depiction: str) -> DataFrame:
    """(cell, region_id): the regions that hold the centre of each distinct cell of a column."""
    centres = cell_centroids(df, cell).withColumnRenamed("cell", "id")
    return points_in_regions(centres, regions, id_col, depiction).select(F.col("left_id").alias("cell"), F.col("right_id").alias("region_id"))


def cells_in_box(df: DataFrame, resolution: int, box: tuple[float, float, float, float], margin: int = 1) -> DataFrame:
    """The rows whose stored cell of a resolution covers a box (south, west, north, east) or lies ``margin`` cells around it.

    The cells of a box are few at the resolution of its zoom; they filter the scan.
    """
    wanted = hexgrid.disk(hexgrid.cover(*box, resolution), margin) if margin else hexgrid.cover(*box, resolution)
    return df.where(F.col(cell_field(resolution)).isin(hexgrid.texts(wanted)))
