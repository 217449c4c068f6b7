"""The relational test tables lifted to resources, by formulas that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.runtime import table


def event_documents(spark: SparkSession, d: str) -> DataFrame:
    """Events as geo documents: id, types, group, time and a place from the event number."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    return e.select(
        F.concat(F.lit("event:"), k).alias("_id"),
        F.array(F.concat(F.lit("ev:"), "event_type"), F.lit("ev:Event")).alias("at_type"),
        F.concat(F.lit("user:"), "user_id").alias("group_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("when_ms"),
        ((k * 7919) % 17000 / 100.0 - 85.0).alias("lat"),
        ((k * 104729) % 36000 / 100.0 - 180.0).alias("lng"),
        "value",
    )


EVENTS_SQL = "(select 'event:' || event_id _id, ['ev:' || event_type, 'ev:Event'] at_type, 'user:' || user_id group_id, epoch_us(ts) // 1000 when_ms, (event_id * 7919) % 17000 / 100.0 - 85.0 lat, (event_id * 104729) % 36000 / 100.0 - 180.0 lng, value from events)"


def square_cell(lat, lng, size: float):
    return F.concat(F.floor((lat + 90) / size).cast("string"), F.lit(":"), F.floor((lng + 180) / size).cast("string"))


def square_cell_sql(size: float) -> str:
    return f"floor((lat + 90) / {size})::bigint || ':' || floor((lng + 180) / {size})::bigint"


def class_edges(spark: SparkSession, d: str) -> DataFrame:
    """customer -> nation -> region -> World as subclass edges (child, parent)."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    one = c.select(F.concat(F.lit("customer:"), "c_custkey").alias("child"), F.concat(F.lit("nation:"), "c_nationkey").alias("parent"))
    two = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("child"), F.concat(F.lit("region:"), "n_regionkey").alias("parent"))
    three = r.select(F.concat(F.lit("region:"), "r_regionkey").alias("child"), F.lit("x:World").alias("parent"))
    short = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("child"), F.lit("x:World").alias("parent"))
    return one.unionByName(two).unionByName(three).unionByName(short)


EDGES_SQL = """edges as (
  select 'customer:' || c_custkey child, 'nation:' || c_nationkey parent from customer
  union all select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation
  union all select 'region:' || r_regionkey, 'x:World' from region
  union all select 'nation:' || n_nationkey, 'x:World' from nation)"""


def customer_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Publication bounds of all users, of which two thirds have none: start by key, a bare-date end or an instant."""
    c = table(spark, d, "customer")
    third = F.col("c_custkey") % 3 == 0
    k = F.col("c_custkey")
    start = F.unix_millis(F.to_timestamp(F.lit("2024-01-03"))) + (k % 7) * 86_400_000
    end = F.unix_millis(F.to_timestamp(F.lit("2024-01-15"))) + (k % 11) * 86_400_000
    return c.select(
        F.concat(F.lit("user:"), k).alias("individual_id"),
        F.when(third & (k % 2 == 0), start).alias("start_ms"),
        F.when(third & (k % 5 == 0), end).alias("end_ms"),
        F.when(third & (k % 5 == 1), end).alias("end_before_ms"),
    )


BOUNDS_SQL = """bounds as (
  select 'user:' || c_custkey who, case when c_custkey % 2 = 0 then 1704240000000 + (c_custkey % 7) * 86400000 end s,
    case when c_custkey % 5 = 0 then 1705276800000 + (c_custkey % 11) * 86400000 end e, case when c_custkey % 5 = 1 then 1705276800000 + (c_custkey % 11) * 86400000 end x
  from customer where c_custkey % 3 = 0 and (c_custkey % 2 = 0 or c_custkey % 5 in (0, 1)))"""
