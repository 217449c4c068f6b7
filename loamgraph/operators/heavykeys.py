"""Per-key results where a few keys hold most rows.

Every task counts its own input split: keys are dictionary-encoded and their
counts, first and last values are gathered in dense arrays (bincount and
scatter-reduce over codes). What leaves a task is at most one row a key and
split, however many rows the key has, so the second reduction - again dense
arrays, over blocks of keys by hash - has no hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.ids import qname, read_context
from loamgraph.runtime import table

#: Distinct keys that a task holds before it hands its arrays on and starts anew.
FLUSH_KEYS = 500_000

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class DenseAccumulator:
    """Counts, minima and maxima of keys in arrays indexed by dictionary code."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.codes: dict = {}
        self.n, self.lo, self.hi = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _grow(self) -> None:
        more = len(self.codes) - len(self.n)
        if more > 0:
            more = max(more, len(self.n))
            self.n = np.concatenate([self.n, np.zeros(more, np.int64)])
            self.lo = np.concatenate([self.lo, np.full(more, _HIGH)])
            self.hi = np.concatenate([self.hi, np.full(more, _LOW)])

    def add(self, keys: pa.Array, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray | None = None) -> None:
        """``lo`` is ``_HIGH`` and ``hi`` is ``_LOW`` where a row has no value."""
        coded = keys.dictionary_encode(null_encoding="encode")
        local = coded.indices.to_numpy(zero_copy_only=False)
        if not len(local):
            return
        m = len(coded.dictionary)
        n = np.bincount(local, minlength=m) if weight is None else _weighted(local, weight, m)
        low, high = np.full(m, _HIGH), np.full(m, _LOW)
        np.minimum.at(low, local, lo)
        np.maximum.at(high, local, hi)
        at = np.array([self.codes.setdefault(k, len(self.codes)) for k in coded.dictionary.to_pylist()])
        self._grow()
        self.n[at] += n
        self.lo[at] = np.minimum(self.lo[at], low)
        self.hi[at] = np.maximum(self.hi[at], high)

    def batch(self, name: str, type_: pa.DataType) -> pa.RecordBatch:
        k = len(self.codes)
        lo, hi = self.lo[:k], self.hi[:k]
        none = lo == _HIGH
        return pa.RecordBatch.from_arrays([pa.array(list(self.codes), type_), pa.array(self.n[:k]), pa.array(lo, mask=none), pa.array(hi, mask=none)], [name, "n", "lo", "hi"])


def _weighted(codes: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros(m, np.int64)
    np.add.at(out, codes, weight)
    return out


def _ints(column: pa.Array, missing: int) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)


def dense_profile(df: DataFrame, key: str, value: str, rekey=None, flush_keys: int = FLUSH_KEYS) -> DataFrame:
    """(key, n, lo, hi): rows, least and greatest ``value`` (a bigint) per string key.

    ``rekey`` maps a written key to the key that counts, as a Column expression; it
    runs between the two reductions, once a distinct key and split. Null keys are
    a key of their own; null values count as rows only; an empty table has no keys.
    """

    def local(batches):
        acc = DenseAccumulator()
        for b in batches:
            acc.add(b.column(0).cast(pa.string()), _ints(b.column(1), _HIGH), _ints(b.column(1), _LOW))
            if len(acc.codes) > flush_keys:
                yield acc.batch("key", pa.string())
                acc.clear()
        yield acc.batch("key", pa.string())

    def merge(batches):
        acc = DenseAccumulator()
        for b in batches:
            acc.add(b.column(0).cast(pa.string()), _ints(b.column(2), _HIGH), _ints(b.column(3), _LOW), _ints(b.column(1), 0))
        yield acc.batch("key", pa.string())

    schema = "key string, n bigint, lo bigint, hi bigint"
    partial = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("bigint").alias("value")).mapInArrow(local, schema)
    if rekey is not None:
        partial = partial.withColumn("key", rekey(F.col("key")))
    return partial.repartition("key").mapInArrow(merge, schema)


def dense_distinct(df: DataFrame, key: str, value: str, rekey=None, flush_keys: int = FLUSH_KEYS) -> DataFrame:
    """(key, n_distinct): distinct non-null values per key, without gathering a key's values.

    Pairs are coded and made unique per split, then counted by blocks of pairs -
    a hot key's pairs spread over all blocks - and the blocks' counts summed.
    """

    def local(batches):
        seen: set = set()
        for b in batches:
            k, v = (b.column(i).cast(pa.string()).dictionary_encode(null_encoding="encode") for i in (0, 1))
            code = np.unique(k.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(v.dictionary)) + v.indices.to_numpy(zero_copy_only=False))
            ks, vs = k.dictionary.to_pylist(), v.dictionary.to_pylist()
            seen.update((ks[c // len(vs)], vs[c % len(vs)]) for c in code.tolist())
            if len(seen) > flush_keys:
                yield _pairs(seen)
                seen = set()
        yield _pairs(seen)

    slim = df.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    pairs = slim.mapInArrow(local, "key string, value string")
    if rekey is not None:
        pairs = pairs.withColumn("key", rekey(F.col("key")))
    return pairs.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_distinct"))


def _pairs(seen: set) -> pa.RecordBatch:
    rows = list(seen)
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["key", "value"])


#: Epoch values below this are seconds (in milliseconds it is 1973).
SECONDS_BELOW = 100_000_000_000


def epoch_ms(c):
    """Epoch milliseconds of a value that may be in seconds."""
    return F.when(F.abs(c) < SECONDS_BELOW, c * 1000).otherwise(c)


def animal_profile(reports: DataFrame, context: DataFrame) -> DataFrame:
    """(animal_id, n_rows, first_ms, last_ms) for all animals; rows that name none are under null."""
    ctx = read_context(context)
    named = lambda c: F.nullif(qname(c, ctx), F.lit(""))
    timed = reports.select("bold_animal", epoch_ms(F.col("_when_ms")).alias("t"))
    out = dense_profile(timed, "bold_animal", "t", named)
    return out.select(F.col("key").alias("animal_id"), F.col("n").alias("n_rows"), F.col("lo").alias("first_ms"), F.col("hi").alias("last_ms"))


def animal_cells(reports: DataFrame, context: DataFrame) -> DataFrame:
    """(animal_id, n_cells): distinct stored cells per animal."""
    ctx = read_context(context)
    out = dense_distinct(reports, "bold_animal", "_h3_7", lambda c: F.nullif(qname(c, ctx), F.lit("")))
    return out.select(F.col("key").alias("animal_id"), F.col("n_distinct").alias("n_cells"))


def heavy_animals(profile: DataFrame, total_rows: int, per_mille: int = 45) -> DataFrame:
    """Animals named by at least ``per_mille`` of all rows."""
    return profile.where(F.col("animal_id").isNotNull() & (F.col("n_rows") * 1000 >= F.lit(total_rows * per_mille))).select("animal_id")


def heavy_of(spark, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "tracking_report")
    return heavy_animals(animal_profile(reports, table(spark, sf_dir, "jsonld_context")), reports.count())


def profile_of(spark, sf_dir: str) -> DataFrame:
    reports, context = table(spark, sf_dir, "tracking_report"), table(spark, sf_dir, "jsonld_context")
    profile, cells = animal_profile(reports, context), animal_cells(reports, context)
    named = profile.where("animal_id is not null").join(cells, "animal_id", "left")
    return named.withColumn("n_cells", F.coalesce("n_cells", F.lit(0)))
