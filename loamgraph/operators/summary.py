"""Per-group summaries, cell ladders and raw-or-cluster reads of cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loamgraph.functions.cells import cell_parent

#: Fixed values of the read API: documents up to which a cell is given raw, groups of a cluster, buckets of a group, cells of a summary.
MAX_RAW = 1000
TOP_GROUPS = 10
BUCKETS = 16
MAX_CELLS = 20_000
LADDER = (11, 9, 7, 5, 3)


def group_summary(df: DataFrame, group: str, when: str, cell: Column, lat: str | None = None, lng: str | None = None) -> DataFrame:
    """(group_id, first_ms, last_ms, n, cells[, last_lat, last_lng]) for each non-empty group.

    Rows are reduced per group and cell first, so a group that holds most rows is
    no larger than its cells when its set is made. The newest point is that of the
    row with the latest time; ties take the greatest position. Null cells count as
    rows only.
    """
    g = F.col(group)
    slim = df.where(g.isNotNull() & (g != "")).select(g.alias("group_id"), F.col(when).alias("t"), cell.alias("cell"), *([F.col(lat).alias("lat"), F.col(lng).alias("lng")] if lat else []))
    newest = [F.max(F.when(F.col("t").isNotNull(), F.struct("t", "lat", "lng"))).alias("newest")] if lat else []
    part = slim.groupBy("group_id", "cell").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"), *newest)
    last = [F.max("newest").alias("newest")] if lat else []
    out = part.groupBy("group_id").agg(F.min("lo").alias("first_ms"), F.max("hi").alias("last_ms"), F.sum("n").alias("n"), F.array_sort(F.collect_list("cell")).alias("cells"), *last)
    if lat:
        both = F.col("newest.lat").isNotNull() & F.col("newest.lng").isNotNull()
        out = out.withColumns({"last_lat": F.when(both, F.col("newest.lat")), "last_lng": F.when(both, F.col("newest.lng"))}).drop("newest")
    return out


def merge_summaries(*summaries: DataFrame) -> DataFrame:
    """One row a group over several summaries: null-safe bounds, summed counts, united cells, newest point."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summaries)
    rows = rows.where(F.length("group_id") > 0)
    aggs = [F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("n").alias("n")]
    cells = rows.select("group_id", F.explode("cells").alias("c")).where(F.length("c") > 0).distinct().groupBy("group_id").agg(F.array_sort(F.collect_list("c")).alias("cells"))
    if "last_lat" in rows.columns:
        point = F.when(F.col("last_lat").isNotNull() & F.col("last_lng").isNotNull(), F.struct(F.coalesce("last_ms", F.lit(-(2**62))).alias("t"), "last_lat", "last_lng"))
        aggs.append(F.max(point).alias("p"))
    out = rows.groupBy("group_id").agg(*aggs).join(cells, "group_id", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<string>")))
    return out.withColumns({"last_lat": F.col("p.last_lat"), "last_lng": F.col("p.last_lng")}).drop("p") if "last_lat" in rows.columns else out


def cell_ladder(df: DataFrame, group: str, cell: str, resolutions=LADDER, max_cells: int = MAX_CELLS) -> tuple[int, bool]:
    """(resolution, truncated): the finest resolution at which groups have at most ``max_cells`` cells in all.

    One job counts the distinct cells of every resolution: cells are made distinct
    at the finest one and only those are coarsened.
    """
    fine = df.where(F.col(group).isNotNull() & F.col(cell).isNotNull()).select(F.col(group).alias("g"), F.col(cell).alias("c")).distinct()
    steps = fine.select("g", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), cell_parent(F.col("c"), r).alias("p")) for r in resolutions])).alias("s")).select("g", "s.*")
    counts = dict(steps.where("p is not null").distinct().groupBy("r").count().collect())
    for r in resolutions:
        if 0 < counts.get(r, 0) <= max_cells:
            return r, False
    coarsest = [r for r in resolutions if counts.get(r)]
    return (coarsest[-1], True) if coarsest else (resolutions[-1], False)


def _cluster(by: list[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg("lat").alias("avg_lat"), F.avg("lng").alias("avg_lng"), F.min("t").alias("min_ms"), F.max("t").alias("max_ms")]


def _slim(df: DataFrame, cell: Column, group: str, when: str, lat: str, lng: str) -> DataFrame:
    return df.select(cell.alias("__cell"), F.col(group).alias("__group"), F.col(when).alias("t"), F.col(lat).alias("lat"), F.col(lng).alias("lng")).where("__cell is not null")


def cell_clusters(df: DataFrame, cell: Column, group: str, when: str, lat: str, lng: str, max_raw: int = MAX_RAW) -> DataFrame:
    """(cell, n, shape, avg_lat, avg_lng, min_ms, max_ms) of all cells; ``shape`` is raw up to ``max_raw`` documents."""
    out = _slim(df, cell, group, when, lat, lng).groupBy(F.col("__cell").alias("cell")).agg(*_cluster(["cell"]))
    return out.withColumn("shape", F.when(F.col("n") <= max_raw, "raw").otherwise("cluster"))


def cell_raw(df: DataFrame, cell: Column, max_raw: int = MAX_RAW) -> DataFrame:
    """The documents of the cells that are small enough to be given raw."""
    placed = df.withColumn("__cell", cell).where("__cell is not null")
    small = placed.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= max_raw)
    return placed.join(small, "__cell", "left_semi").withColumnRenamed("__cell", "cell")


def cell_top_groups(df: DataFrame, cell: Column, group: str, when: str, lat: str, lng: str, top: int = TOP_GROUPS) -> DataFrame:
    """The ``top`` groups of every cell by documents, ties by group id, null last."""
    by = _slim(df, cell, group, when, lat, lng).groupBy(F.col("__cell").alias("cell"), F.col("__group").alias("group_id")).agg(*_cluster(["cell", "group_id"]))
    order = W.Window.partitionBy("cell").orderBy(F.desc("n"), F.asc_nulls_last("group_id"))
    return by.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def bucket_index(t: Column, lo: Column, hi: Column, buckets: int = BUCKETS) -> Column:
    """Equal buckets over [lo, hi], the last one closed; a span of no length is one bucket."""
    width = (hi - lo) / F.lit(float(buckets))
    return F.when(hi <= lo, F.lit(0)).when(t >= hi, buckets - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((t - lo) / width)))).cast("int")


def time_buckets(df: DataFrame, keys: list[str], when: str, buckets: int = BUCKETS, empty: bool = False) -> DataFrame:
    """(keys, bucket, n, min_ms, max_ms): what each of a group's time buckets holds.

    Empty buckets have no row, or with ``empty`` one of n 0 and null times; a group
    whose times are all one has a single bucket either way.

    The bounds of a group come from one aggregate and return by a join, not by a
    window over the group, so that a large group stays in many tasks.
    """
    timed = df.where(F.col(when).isNotNull()).select(*keys, F.col(when).alias("t"))
    bounds = timed.groupBy(*keys).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    named = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    bounds = bounds.select(*[F.col(k).alias(f"b_{k}") for k in keys], "lo", "hi")
    placed = timed.join(bounds, reduce(lambda a, b: a & b, named)).withColumn("bucket", bucket_index(F.col("t"), F.col("lo"), F.col("hi"), buckets))
    held = placed.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("min_ms"), F.max("t").alias("max_ms"))
    if not empty:
        return held
    every = bounds.select(*[F.col(f"b_{k}").alias(k) for k in keys], F.explode(F.when(F.col("lo") < F.col("hi"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.lit(0)))).alias("bucket"))
    lacking = every.select(*keys, "bucket", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("min_ms"), F.lit(None).cast("bigint").alias("max_ms"))
    return held.unionByName(lacking).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"))


def type_counts(collections: dict[str, DataFrame], types: str = "at_type", located: Column | None = None, by_collection: bool = True) -> DataFrame:
    """Rows per type (and collection), with those that have a location."""
    parts = []
    for name, df in collections.items():
        has = located(df) if callable(located) else F.lit(False)
        parts.append(df.select(F.lit(name).alias("collection"), F.explode(F.array_distinct(types)).alias("type"), has.alias("has_location")))
    keys = ["type", "collection"] if by_collection else ["type"]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("has_location").alias("n_located"))
