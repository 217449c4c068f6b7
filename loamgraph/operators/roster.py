"""The summary of groups as one read: facts per group, places, regions, and the resources that the groups name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from loamgraph.functions.cells import STORED_RESOLUTIONS, cell_field, cell_parent
from loamgraph.operators.hexcells import cell_centroids
from loamgraph.operators.spatial import points_in_regions
from loamgraph.operators.summary import MAX_CELLS, group_summary, merge_summaries
from loamgraph.runtime import materialize


@dataclass
class Source:
    """Data of a query, and the resources among which its groups are looked up."""

    data: DataFrame
    resources: DataFrame


@dataclass
class RegionSet:
    """Regions under a key; ``load`` may fail, and then the set is not available."""

    key: str
    load: Callable[[], DataFrame] | None
    id_col: str = "_id"
    depiction: str = "bold_spatialdepiction"
    label: str | None = None


def region_sets(given) -> list[RegionSet]:
    """One set or several, by key: the first of each key that has something to load."""
    sets = [given] if isinstance(given, RegionSet) else list(given or [])
    out: dict[str, RegionSet] = {}
    for s in sets:
        if s.load is not None:
            out.setdefault(s.key, s)
    return list(out.values())


def first_suppliers(ids: DataFrame, tables: list[DataFrame], id_col: str = "_id") -> DataFrame:
    """The rows of several tables that ``ids`` names, each id from the first table that has it, with all columns of any."""
    parts = [t.join(ids.select(id_col).distinct(), id_col, "left_semi").withColumn("__nth", F.lit(k)) for k, t in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    order = W.Window.partitionBy(id_col).orderBy("__nth")
    return rows.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank", "__nth")


@dataclass
class GroupReport:
    """The tables of a read and what is to be known about it."""

    summary: DataFrame  # group_id, first_ms, last_ms, n, cells (centres), [last_lat, last_lng]
    tags: DataFrame  # group_id, set_key, region_id
    resources: DataFrame
    regions: DataFrame  # set_key, region_id, label
    meta: dict


def group_report(sources: list[Source], group: str, when: str, resolution: int = 7, max_cells: int = MAX_CELLS, regions=None, lat: str | None = None, lng: str | None = None, id_col: str = "_id") -> GroupReport:
    """Facts of every group over all sources, with the centres of its cells and the regions that hold them.

    Rows are reduced to groups and cells once, at the finest stored resolution up to
    ``resolution``; if that gives more than ``max_cells`` cells in all, the same
    reduced rows are coarsened, down to the coarsest. Region sets are read each on
    its own: one that fails is left out and marked. Groups are looked up among the
    sources' resources in order. Rows without a group count for none; without
    sources there is nothing to report and ``ValueError`` is raised.
    """
    if not sources:
        raise ValueError("a report needs a source")
    ladder = sorted((r for r in STORED_RESOLUTIONS if r <= resolution), reverse=True) or [STORED_RESOLUTIONS[0]]
    fine = cell_field(ladder[0])
    parts = [group_summary(s.data, group, when, F.col(fine), lat, lng) for s in sources]
    merged = materialize(merge_summaries(*parts))
    pairs = merged.select("group_id", F.explode("cells").alias("cell"))
    every = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), cell_parent(F.col("cell"), r).alias("p")) for r in ladder]))
    counts = {r["r"]: r["n"] for r in pairs.select("group_id", every.alias("s")).select("group_id", "s.*").where("p is not null").distinct().groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = next((r for r in ladder if counts.get(r, 0) <= max_cells), ladder[-1])
    cells = materialize(pairs.select("group_id", cell_parent(F.col("cell"), chosen).alias("cell")).where("cell is not null").distinct())

    centres = materialize(cell_centroids(cells, "cell"))
    placed = cells.join(centres, "cell")
    places = placed.groupBy("group_id").agg(F.array_sort(F.collect_set(F.array("lat", "lng"))).alias("cells"))
    summary = merged.drop("cells").join(places, "group_id", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<array<double>>")))

    spark = merged.sparkSession
    tags = spark.createDataFrame([], "group_id string, set_key string, region_id string")
    known = spark.createDataFrame([], "set_key string, region_id string, label string")
    available = {}
    for s in region_sets(regions):
        try:
            table = s.load()
            rows = materialize(table.select(F.col(s.id_col).cast("string").alias("region_id"), F.col(s.depiction).cast("string").alias("shape"), (F.col(s.label) if s.label else F.lit(None)).cast("string").alias("label")))
        except Exception:  # noqa: BLE001 - a set that can not be read must not fail the report
            available[s.key] = False
            continue
        available[s.key] = not rows.where("length(shape) > 0").isEmpty()
        held = points_in_regions(centres.withColumnRenamed("cell", "id"), rows, "region_id", "shape").select(F.col("left_id").alias("cell"), F.col("right_id").alias("region_id"))
        tags = tags.unionByName(cells.join(held, "cell").select("group_id", F.lit(s.key).alias("set_key"), "region_id").distinct())
        known = known.unionByName(rows.select(F.lit(s.key).alias("set_key"), "region_id", F.coalesce(F.nullif("label", F.lit("")), "region_id").alias("label")).distinct())

    ids = merged.select(F.col("group_id").alias(id_col))
    facts = merged.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("first_ms").isNotNull() | F.col("last_ms").isNotNull()).alias("timed")).first()
    meta = {
        "cell_property": cell_field(chosen), "cell_resolution": chosen, "groups": facts["groups"], "cells_available": not centres.isEmpty(), "time_available": facts["timed"] > 0,
        "regions_available": any(available.values()), "region_sets": available, "truncated": counts.get(ladder[0], 0) > max_cells,
    }
    return GroupReport(summary, tags, first_suppliers(ids, [s.resources for s in sources], id_col), known, meta)


def unmatched_groups(groups: DataFrame, group: str, known: DataFrame, id_col: str = "_id") -> DataFrame:
    """(group_id, n): groups of rows that name no known resource, with their rows; an array names several, blank names none.

    Groups are counted map-side first, so the known side meets distinct groups only.
    """
    many = isinstance(groups.schema[group].dataType, T.ArrayType)
    each = groups.select((F.explode(F.array_distinct(group)) if many else F.col(group)).alias("group_id")).where("length(group_id) > 0")
    return each.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).join(known.select(F.col(id_col).alias("group_id")), "group_id", "left_anti")
