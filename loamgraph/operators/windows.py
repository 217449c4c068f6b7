"""The publication window: which rows may be shown, by age and by each individual's bounds."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.operators.timestamps import normalise_times
from loamgraph.plans.selector import aggregate, find
from loamgraph.runtime import BROADCAST_ROWS

DEFAULT_ZONE = "America/Los_Angeles"


def day_cutoff_ms(now_ms: int, delay_days: float, zone: str = DEFAULT_ZONE) -> int | None:
    """Midnight in ``zone`` of the day ``delay_days`` before now; None if there is no delay."""
    if not delay_days or delay_days <= 0:
        return None
    day = dt.datetime.fromtimestamp(now_ms / 1000, ZoneInfo(zone)).date() - dt.timedelta(days=int(delay_days))
    return int(dt.datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).timestamp() * 1000)


def parse_bounds(individuals: DataFrame, id_col: str, start: str, end: str, zone: str = DEFAULT_ZONE) -> DataFrame:
    """(individual_id, start_ms, end_ms, end_before_ms), only for individuals with a bound that can be read.

    An end that is a bare date keeps its whole day public: ``end_before_ms`` is the
    next midnight in ``zone``. Individuals whose bounds all name nothing are not
    bounded and have no row.
    """
    values = individuals.select(F.col(id_col).alias("id"), F.col(start).cast("string").alias("s"), F.col(end).cast("string").alias("e"), F.lit(zone).alias("z"), F.lit(None).cast("boolean").alias("o"))
    read = normalise_times(values, "id", {"s": "s", "e": "e"}, "z", "o").where("utc_ms is not null and length(id) > 0")
    date = F.col("date_only")
    next_day = F.unix_millis(F.to_utc_timestamp(F.date_add(F.from_utc_timestamp(F.timestamp_millis("utc_ms"), zone).cast("date"), 1).cast("timestamp"), zone))
    side = lambda p, v: F.max(F.when(F.col("prop") == p, v))
    return read.groupBy(F.col("id").alias("individual_id")).agg(
        side("s", F.col("utc_ms")).alias("start_ms"), side("e", F.when(~date, F.col("utc_ms"))).alias("end_ms"), side("e", F.when(date, next_day)).alias("end_before_ms")
    )


def windowed(df: DataFrame, group: str, when: str, cutoff_ms: int | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """The rows that may be shown.

    With a cutoff, rows at or before it (a null time never passes). With bounds, a
    row of a bounded individual must lie inside its bounds; rows that name no
    bounded individual pass. A row with several groups passes if any bounded one
    admits it. That depends on a row's groups and time only, so arrays are judged
    once per distinct pair of these and every row gets the verdict of its own pair,
    whatever its id; bounds of one individual given twice must both admit a row's
    time to count. Bounds up to ``BROADCAST_ROWS`` are broadcast, more are shuffled.
    """
    out = df
    if cutoff_ms is not None:
        out = out.where(F.coalesce(F.col(when) <= F.lit(cutoff_ms), F.lit(False)))
    if bounds is None:
        return out
    b = bounds.where("individual_id is not null and (start_ms is not null or end_ms is not null or end_before_ms is not null)")
    b = b.groupBy(F.col("individual_id").alias("__who")).agg(F.max("start_ms").alias("__s"), F.min("end_ms").alias("__e"), F.min("end_before_ms").alias("__x"))
    if b.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        b = F.broadcast(b)

    def inside(t):
        held = (F.col("__s").isNull() | (t >= F.col("__s"))) & (F.col("__e").isNull() | (t <= F.col("__e"))) & (F.col("__x").isNull() | (t < F.col("__x")))
        return F.coalesce(held, F.lit(False))

    if not isinstance(df.schema[group].dataType, T.ArrayType):
        return out.join(b, F.col(group) == F.col("__who"), "left").where(F.col("__who").isNull() | inside(F.col(when))).drop("__who", "__s", "__e", "__x")
    pairs = out.where(F.size(group) > 0).select(F.col(group).alias("__groups"), F.col(when).alias("__t")).distinct()
    each = pairs.select("__groups", "__t", F.explode(F.array_distinct("__groups")).alias("__g"))
    verdict = each.join(b, F.col("__g") == F.col("__who")).groupBy("__groups", "__t").agg(F.max(inside(F.col("__t"))).alias("__ok"))
    judged = out.join(verdict, F.col(group).eqNullSafe(F.col("__groups")) & F.col(when).eqNullSafe(F.col("__t")), "left")
    # Only rows that name no bounded individual have no verdict.
    return judged.where(F.coalesce("__ok", F.lit(True))).drop("__groups", "__t", "__ok")


@dataclass
class WindowProvider:
    """Bounds and delay of a deployment, kept for a time; what fails is not kept and shows nothing."""

    load_bounds: Callable[[], DataFrame]
    delay_days: Callable[[], float]
    zone: str = DEFAULT_ZONE
    ttl_s: float = 60.0
    clock: Callable[[], float] = time.time

    def __post_init__(self):
        self._kept: tuple[float, DataFrame, float] | None = None

    def window(self) -> tuple[int | None, DataFrame]:
        now = self.clock()
        if self._kept is None or now - self._kept[0] >= self.ttl_s:
            self._kept = (now, self.load_bounds(), self.delay_days())
        return day_cutoff_ms(int(now * 1000), self._kept[2], self.zone), self._kept[1]


class WindowedCollection:
    """Reads of a collection behind the window; the filter stands below every group and cannot be bypassed."""

    def __init__(self, df: DataFrame, provider: WindowProvider, group: str, when: str):
        self._df, self._provider, self._group, self._when = df, provider, group, when

    def frame(self) -> DataFrame:
        cutoff, bounds = self._provider.window()
        return windowed(self._df, self._group, self._when, cutoff, bounds)

    def find(self, spec=None, **options) -> DataFrame:
        return find(self.frame(), spec, **options)

    def find_one(self, spec=None, **options):
        return self.find(spec, **options).first()

    def count_documents(self, spec=None) -> int:
        return self.find(spec).count()

    def distinct(self, field: str, spec=None) -> DataFrame:
        return self.find(spec).select(field).distinct()

    def aggregate(self, pipeline: list[dict]):
        return aggregate(self.frame(), pipeline)

    def estimated_document_count(self):
        raise NotImplementedError("an estimate would count rows outside the window")
