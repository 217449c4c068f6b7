"""Incremental forms of the batch operators as Structured Streaming jobs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.documents import upsert
from loamgraph.operators.rdf import upsert_statements
from loamgraph.sources.files import Files, written

#: Parts of a table by hash of the id, each rewritten only by batches that touch it.
BUCKETS = 64
#: Versions whose files stay for readers that began with them.
KEPT_VERSIONS = 2


class ParquetTable:
    """A table of buckets by id and versions: a batch rewrites the buckets it touches, then names them in a new manifest.

    Readers see whole versions. Files that no kept manifest names are removed. The
    folder must be one that all executors share; it is used through Hadoop's client.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, id_col: str = "_id", buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.id_col, self.buckets = spark, path.rstrip("/"), schema, id_col, buckets
        self.files = Files(spark, path)

    def _manifest(self) -> dict:
        """The newest manifest: its version, the last batch written and the folder of each bucket."""
        versions = [int(n.removeprefix("manifest-")) for n in self.files.names(self.root) if n.startswith("manifest-") and not n.endswith(".tmp")]
        if not versions:
            return {"version": 0, "batch": -1, "parts": {}, "buckets": self.buckets}
        return json.loads(self.files.read(f"{self.root}/manifest-{max(versions):012d}"))

    def _frame(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._frame(sorted(self._manifest()["parts"].values()))

    def write(self, changes: DataFrame, batch: int, combine=lambda old, new: new) -> bool:
        """Writes ``combine(old, changes)`` of the buckets that ``changes`` touch; a batch that was written before is not written again."""
        now = self._manifest()
        if batch <= now["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(self.id_col), F.lit(now["buckets"])).cast("int")
        touched = sorted(r[0] for r in changes.select(bucket.alias("b")).distinct().collect())
        if not touched:
            return False
        version = now["version"] + 1
        old = self._frame([now["parts"][str(b)] for b in touched if str(b) in now["parts"]])
        combine(old, changes).withColumn("bucket__", bucket).repartition("bucket__").write.mode("overwrite").partitionBy("bucket__").parquet(f"{self.root}/v{version:012d}")
        there = set(self.files.names(f"{self.root}/v{version:012d}"))
        parts = {k: v for k, v in now["parts"].items() if int(k) not in touched}
        parts |= {str(b): f"v{version:012d}/bucket__={b}" for b in touched if f"bucket__={b}" in there}
        with written(self.spark, f"{self.root}/manifest-{version:012d}") as put:
            put(json.dumps({"version": version, "batch": batch, "parts": parts, "buckets": now["buckets"]}))
        self._vacuum(version)
        return True

    def _vacuum(self, version: int) -> None:
        """Removes manifests before the kept ones, and data that only those name."""
        manifests = [n for n in self.files.names(self.root) if n.startswith("manifest-") and not n.endswith(".tmp")]
        for name in manifests[:-KEPT_VERSIONS]:
            self.files.delete(f"{self.root}/{name}")
        named = {f for name in manifests[-KEPT_VERSIONS:] for f in json.loads(self.files.read(f"{self.root}/{name}"))["parts"].values()}
        whole = {f.split("/")[0] for f in named}
        for folder in self.files.names(self.root):
            if folder.startswith("v") and int(folder[1:]) <= version:
                if folder not in whole:
                    self.files.delete(f"{self.root}/{folder}")
                    continue
                for part in self.files.names(f"{self.root}/{folder}"):
                    if f"{folder}/{part}" not in named:
                        self.files.delete(f"{self.root}/{folder}/{part}")


def upsert_stream(source: DataFrame, target: ParquetTable, checkpoint: str, order: str, id_col: str = "_id", merge: bool = False, first_wins: tuple[str, ...] = ()):
    """Resources of a stream into a table, by id; the latest by ``order`` within a batch. Replays change nothing."""

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy(id_col).agg(F.max_by(F.struct(*[c for c in df.columns if c != id_col]), F.col(order)).alias("r")).select(id_col, "r.*")
        target.write(last, number, lambda old, new: upsert(old, new, id_col, merge, first_wins))

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statement_stream(source: DataFrame, target: ParquetTable, checkpoint: str):
    """Statements of a stream into a table; the first time of a statement stays."""

    def batch(df: DataFrame, number: int) -> None:
        target.write(df, number, lambda old, new: upsert_statements(old, new)[0])

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def group_summary_stream(source: DataFrame, group: str, when: str, cell: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts, first and last time and approximate cells per group and window of event time; late rows beyond ``delay`` are left out."""
    timed = source.withColumn("event_time", F.timestamp_millis(F.col(when))).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", window), F.col(group).alias("group_id")).agg(F.min(when).alias("first_ms"), F.max(when).alias("last_ms"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct(cell).alias("n_cells"))


def session_stream(source: DataFrame, group: str, when: str, gap_ms: int, delay: str = "1 hour") -> DataFrame:
    """(group_id, start_ms, end_ms, n) of sessions, which a silence of more than ``gap_ms`` ends.

    Rows may come in any order within ``delay`` of the latest time seen; a late row
    joins, bridges or opens the session it belongs to by its own time, later ones
    are left out. A session comes out, and leaves the state, once the watermark has
    passed its end by the gap; null times belong to none.
    """
    timed = source.where(F.col(when).isNotNull()).withColumn("event_time", F.timestamp_millis(F.col(when))).withWatermark("event_time", delay)
    sessions = timed.groupBy(F.session_window("event_time", f"{gap_ms + 1} milliseconds"), F.col(group).alias("group_id"))
    return sessions.agg(F.min(when).alias("start_ms"), F.max(when).alias("end_ms"), F.count(F.lit(1)).alias("n")).select("group_id", "start_ms", "end_ms", "n")
