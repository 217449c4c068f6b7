"""Session helpers shared by all operators: materialising, size checks, numbering."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Rows and bytes up to which a table is broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's spark.checkpoint.dir; a temporary folder only on one machine, where none is named."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = _named_folder(spark)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir: a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loamgraph-checkpoint-"))


def _named_folder(spark: SparkSession) -> str | None:
    """The shared folder that the session or its context names."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage through a reliable checkpoint that every executor can read again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with 1, 2, ... in ``order``, in as many tasks as a shuffle has.

    Rows are sorted by ranges; only the sizes of the ranges are brought together,
    so no task sorts or numbers them all, as a window without partitions would.
    Ties have any order among themselves.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    low = (1 << 33) - 1
    placed = ranges.withColumns({"__id": F.monotonically_increasing_id()})
    placed = materialize(placed.withColumns({"__range": F.shiftright("__id", 33), "__row": F.col("__id").bitwiseAND(F.lit(low).cast("bigint"))}).drop("__id"))
    sizes = placed.groupBy("__range").count()
    before = W.Window.orderBy("__range").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select(F.col("__range").alias("__r"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    out = placed.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    return out.withColumn(name, F.col("__start") + F.col("__row") + 1).drop("__range", "__row", "__r", "__start")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, nbytes: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table may be broadcast: at most so many rows and bytes."""
    size = F.lit(0)
    for f in df.schema.fields:
        text = isinstance(f.dataType, (T.StringType, T.BinaryType))
        wide = F.octet_length(f"`{f.name}`") if text else F.octet_length(F.to_json(F.struct(f"`{f.name}`"))) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.lit(0)
        size = size + F.coalesce(wide, F.lit(0)) + 16
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= rows and total <= nbytes


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a materialised ``right``: broadcast if it is ``small``, else shuffled.

    Beyond the bound AQE splits skewed partitions of the shuffled join.
    """
    return left.join(F.broadcast(right) if small(right, bound) else right, on, how)


def arrow_udf(fn, kind: str):
    """``fn`` of one value (or of several columns' values) as a function of columns that runs over Arrow batches."""

    def run(*columns):
        return pd.Series([fn(*row) for row in zip(*columns)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    for f in (one, two):
        f.__annotations__ = {k: pd.Series for k in f.__annotations__}
    single, double = F.pandas_udf(one, kind), F.pandas_udf(two, kind)
    return lambda *columns: single(*columns) if len(columns) == 1 else double(*columns)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    shared = (_named_folder(spark) or "").removeprefix("file://")
    if shared.startswith("/"):
        Path(shared).mkdir(parents=True, exist_ok=True)
    target = Path(tempfile.mkdtemp(prefix="loamgraph-package-", dir=shared if shared.startswith("/") else None)) / "loamgraph.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
