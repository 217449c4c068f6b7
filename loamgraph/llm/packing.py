"""Items of varying size combined into containers of fixed capacity.

Sizes are reduced to one global histogram. Dynamic programming over it chooses
the length buckets that need least padding, and token-budget batches are planned
from whole buckets. Only these plans - bounded by the capacity and the number of
buckets, not by the items - come to the driver; every item then finds its
container from its rank in its bucket.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from loamgraph.runtime import materialize, table

#: Length buckets of each capacity.
BUCKETS = 128
#: Capacities up to this are planned: a task holds 4 bytes a size and bucket (100 MB) and the driver 24 bytes a size.
MAX_CAPACITY = 200_000
#: Containers of different capacity that are planned together.
MAX_CONTAINERS = 1_000
#: Parts of equal size into which items of one size are ranked.
RANK_PARTS = 256


def byt5_size(text):
    """Tokens of the byte-level tokenizer: one a UTF-8 byte and one end token."""
    return F.octet_length(text) + F.lit(1)


def optimal_buckets(sizes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Upper bounds of at most ``k`` buckets over ascending ``sizes`` with least total padding.

    A bucket of sizes a..b pads every item to b. The best start of a last bucket
    never falls as b grows, so each layer is filled by halving: the middle of every
    open stretch is settled among the starts that its neighbours leave, all
    stretches of a level at once.
    """
    m = len(sizes)
    if m <= k:
        return sizes.copy()
    n = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    s = np.concatenate([[0], np.cumsum(sizes * counts)]).astype(np.int64)
    x = sizes.astype(np.int64)
    best = x * n[1:] - s[1:]
    back = np.zeros((k, m), np.int32)
    for layer in range(1, k):
        new, choice = best.copy(), np.zeros(m, np.int64)
        # Stretches lo..hi of last sizes, whose starts lie in from_..to.
        lo, hi, from_, to = (np.array([v]) for v in (1, m - 1, 1, m - 1))
        while len(lo):
            mid = (lo + hi) // 2
            last = np.minimum(to, mid)
            width = last - from_ + 1
            row = np.repeat(np.arange(len(mid)), width)
            head = np.cumsum(width) - width
            start = np.arange(len(row)) - head[row] + from_[row]
            b = mid[row]
            cost = best[start - 1] + x[b] * (n[b + 1] - n[start]) - (s[b + 1] - s[start])
            least = np.minimum.reduceat(cost, head)
            hit = np.flatnonzero(cost == least[row])
            at = np.zeros(len(mid), np.int64)
            at[row[hit[::-1]]] = start[hit[::-1]]
            better = least < new[mid]
            new[mid[better]], choice[mid[better]] = least[better], at[better]
            left, right = lo < mid, mid < hi
            lo, hi, from_, to = (np.concatenate(v) for v in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (from_[left], at[right]), (at[left], to[right])))
        back[layer] = choice
        if new[-1] >= best[-1]:
            k = layer
            break
        best = new
    bounds, b = [], m - 1
    for layer in range(k - 1, -1, -1):
        bounds.append(sizes[b])
        b = back[layer][b] - 1
        if b < 0:
            break
    return np.array(bounds[::-1])


@dataclass
class Plan:
    """Runs of equal containers: per bucket, items ``start`` onwards go ``per`` at a time to containers ``base`` onwards."""

    bounds: np.ndarray
    runs: dict[int, list[tuple[int, int, int]]]
    containers: int


def plan_batches(bounds: np.ndarray, counts: np.ndarray, capacity: int, across: bool = True) -> Plan:
    """Token-budget batches: each opens with the largest bucket left and repeats while the buckets last.

    Inside a bucket a batch takes as many items as its padded length allows; with
    ``across`` the room that is left is offered to the next smaller buckets.
    """
    left = counts.astype(np.int64).copy()
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(len(bounds), np.int64)
    base = 0
    for top in range(len(bounds) - 1, -1, -1):
        while left[top] > 0:
            room, recipe = capacity, []
            b = top
            while b >= 0 and room >= bounds[0]:
                b = min(b, int(np.searchsorted(bounds, room, side="right")) - 1)
                if b < 0:
                    break
                if left[b] > 0:
                    c = int(min(left[b], room // bounds[b]))
                    recipe.append((b, c))
                    room -= c * int(bounds[b])
                    if not across:
                        break
                b -= 1
            times = min(int(left[b] // c) for b, c in recipe)
            for b, c in recipe:
                runs.setdefault(b, []).append((int(used[b]), c, base))
                used[b] += c * times
                left[b] -= c * times
            base += times
    return Plan(bounds, runs, base)


def _plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, buckets: int, across: bool) -> dict:
    """What places an item: per size its bucket and the items before it there, and the runs of each bucket."""
    bounds = optimal_buckets(sizes, counts, buckets)
    of = np.searchsorted(bounds, sizes)
    plan = plan_batches(bounds, np.bincount(of, weights=counts, minlength=len(bounds)).astype(np.int64), capacity, across)
    start = np.cumsum(counts) - counts
    return {"sizes": sizes, "of": of, "before": start - start[np.searchsorted(of, of)], "runs": {b: np.array(r, np.int64) for b, r in plan.runs.items()}, "containers": plan.containers}


def _bins(plan: dict, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    at = np.searchsorted(plan["sizes"], size)
    bucket, index = plan["of"][at], plan["before"][at] + rank
    out = np.zeros(len(size), np.int64)
    for b in np.unique(bucket):
        rows = np.flatnonzero(bucket == b)
        runs = plan["runs"][int(b)]
        run = runs[np.searchsorted(runs[:, 0], index[rows], side="right") - 1]
        out[rows] = run[:, 2] + (index[rows] - run[:, 0]) // run[:, 1]
    return out


def pack(items: DataFrame, id_col: str, size_col: str, specs: DataFrame, container_col: str, capacity_col: str, buckets: int = BUCKETS, across: bool = True) -> DataFrame:
    """(container_id, id, piece, pieces, tokens, bin): every item in a container of each capacity.

    An item is split only if it exceeds the capacity: into full pieces with a
    container each, and a rest that is packed like an item. Bins count from 0
    within a container id, full pieces after the packed bins, by item. Items with a
    null id or size are left out; sizes below 1 count as 1 and repeated rows are
    items of their own, with any rank among equals. Null or non-positive capacities
    and an empty table give no rows.

    Sizes are written once (an id and a number an item), so the items are read once
    whatever their width. Each capacity is planned from the histogram in a task of its own.
    """
    rows = specs.select(container_col, capacity_col).where(F.col(capacity_col) > 0).where(F.col(container_col).isNotNull()).distinct().limit(MAX_CONTAINERS + 1).collect()
    if len(rows) > MAX_CONTAINERS or any(r[1] > MAX_CAPACITY for r in rows):
        raise ValueError(f"at most {MAX_CONTAINERS} containers of at most {MAX_CAPACITY}")
    id_type, spec_type = items.schema[id_col].dataType, specs.schema[container_col].dataType
    caps = F.array(*[F.struct(F.lit(r[0]).cast(spec_type).alias("container_id"), F.lit(int(r[1])).cast("bigint").alias("cap")) for r in rows]) if rows else F.array().cast(T.ArrayType(T.StructType([T.StructField("container_id", spec_type), T.StructField("cap", T.LongType())])))
    slim = items.where(F.col(size_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.greatest(F.col(size_col).cast("bigint"), F.lit(1).cast("bigint")).alias("size"))
    slim = materialize(slim)
    each = slim.select("id", "size", F.explode(caps).alias("c")).select("id", "size", "c.*")
    each = each.withColumn("full", F.when(F.col("size") > F.col("cap"), F.floor(F.col("size") / F.col("cap"))).otherwise(0))
    each = each.withColumn("rest", F.col("size") - F.col("full") * F.col("cap")).withColumn("pieces", F.col("full") + (F.col("rest") > 0).cast("bigint"))

    # Rank of each rest among those of its size: parts by hash, then offsets of parts.
    open_ = each.where("rest > 0").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(RANK_PARTS)).cast("int"))
    groups = materialize(open_.groupBy("container_id", "cap", "rest", "part").agg(F.count(F.lit(1)).alias("n")))
    before = W.Window.partitionBy("container_id", "rest").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = groups.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("container_id", "rest", "part", "offset")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf.groupby("rest", sort=True)["n"].sum()
        made = _plan(h.index.to_numpy(np.int64), h.to_numpy(np.int64), int(pdf["cap"].iloc[0]), buckets, across)
        return pd.DataFrame({"container_id": pdf["container_id"].iloc[:1], "plan": [pickle.dumps(made)]})

    histogram = groups.groupBy("container_id", "cap", "rest").agg(F.sum("n").alias("n"))
    made = histogram.groupBy("container_id").applyInPandas(plan, f"container_id {spec_type.simpleString()}, plan binary").collect()
    plans = {r["container_id"]: pickle.loads(bytes(r["plan"])) for r in made}
    shared = items.sparkSession.sparkContext.broadcast(plans)

    rank = W.Window.partitionBy("container_id", "rest", "part").orderBy("id")
    ranked = open_.withColumn("rank", F.row_number().over(rank) - 1).join(offsets, ["container_id", "rest", "part"]).withColumn("rank", F.col("rank") + F.col("offset"))
    out = f"container_id {spec_type.simpleString()}, id {id_type.simpleString()}, piece bigint, pieces bigint, tokens bigint, bin bigint"

    def place(batches):
        for pdf in batches:
            bins = np.zeros(len(pdf), np.int64)
            cid, rest, rank = pdf["container_id"].to_numpy(), pdf["rest"].to_numpy(), pdf["rank"].to_numpy()
            for c in pd.unique(cid):
                mine = np.flatnonzero(cid == c)
                bins[mine] = _bins(shared.value[c], rest[mine], rank[mine])
            yield pd.DataFrame({"container_id": cid, "id": pdf["id"], "piece": pdf["pieces"], "pieces": pdf["pieces"], "tokens": rest, "bin": bins})

    packed = ranked.select("container_id", "id", "rest", "pieces", "rank").mapInPandas(place, out)

    # Full pieces have containers of their own, numbered after the packed ones by parts of the items.
    split = each.where("full > 0").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(RANK_PARTS)).cast("int"))
    per_part = split.groupBy("container_id", "part").agg(F.sum("full").alias("n"))
    part_before = W.Window.partitionBy("container_id").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("offset", F.coalesce(F.sum("n").over(part_before), F.lit(0))).select("container_id", "part", "offset")
    used = F.lit(0).cast("bigint")
    for cid, made in plans.items():
        used = F.when(F.col("container_id") == F.lit(cid), F.lit(made["containers"]).cast("bigint")).otherwise(used)
    inside = W.Window.partitionBy("container_id", "part").orderBy("id", "size").rowsBetween(W.Window.unboundedPreceding, -1)
    split = split.withColumn("inside", F.coalesce(F.sum("full").over(inside), F.lit(0))).join(per_part, ["container_id", "part"])
    fulls = split.withColumn("piece", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("full"))))
    fulls = fulls.select("container_id", "id", "piece", "pieces", F.col("cap").alias("tokens"), (used + F.col("offset") + F.col("inside") + F.col("piece") - 1).cast("bigint").alias("bin"))
    return packed.unionByName(fulls)


def pack_documents(documents: DataFrame, specs: DataFrame, buckets: int = BUCKETS, across: bool = True) -> DataFrame:
    """Documents by their ByT5 size; a null text is no document to pack, an empty one takes its end token."""
    sized = documents.select("doc_id", byt5_size(F.col("text")).alias("size"))
    return pack(sized, "doc_id", "size", specs, "container_id", "capacity_tokens", buckets, across).withColumnRenamed("id", "doc_id")


def packed_of(spark, sf_dir: str, across: bool = True) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_spec"), across=across)


def oversize(packed: DataFrame) -> DataFrame:
    """Documents that had to be split, from the packing itself."""
    return packed.where((F.col("pieces") > 1) & (F.col("piece") == 1)).select("container_id", "doc_id")


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, items and share of capacity used, per container id."""
    used = packed.groupBy("container_id").agg(F.sum("tokens").alias("tokens"), (F.max("bin") + 1).alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"))
    caps = specs.groupBy("container_id").agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    return used.join(caps, "container_id").withColumn("fill", F.col("tokens") / (F.col("n_containers") * F.col("capacity")))
