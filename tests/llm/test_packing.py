import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgraph.llm.packing import fill, optimal_buckets, oversize, pack, pack_documents, plan_batches


def padding(sizes, counts, bounds):
    return sum(c * (bounds[np.searchsorted(bounds, s)] - s) for s, c in zip(sizes, counts))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 9)), min_size=1, max_size=9, unique_by=lambda x: x[0]), st.integers(1, 4))
def test_buckets_have_least_padding(hist, k):
    hist.sort()
    sizes, counts = np.array([s for s, _ in hist]), np.array([c for _, c in hist])
    got = optimal_buckets(sizes, counts, k)
    assert len(got) <= k and got[-1] == sizes[-1]
    best = min(padding(sizes, counts, np.array(sorted({*pick, sizes[-1]}))) for n in range(k) for pick in itertools.combinations(sizes[:-1], min(n, len(sizes) - 1)))
    assert padding(sizes, counts, got) == best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 30)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.booleans())
def test_plans_place_every_item_once(hist, across):
    hist.sort()
    bounds, counts = np.array([s for s, _ in hist]), np.array([c for _, c in hist])
    plan = plan_batches(bounds, counts, 50, across)
    load = np.zeros(plan.containers)
    for b, runs in plan.runs.items():
        for n, (start, per, base) in enumerate(runs):
            end = runs[n + 1][0] if n + 1 < len(runs) else counts[b]
            assert (end - start) % per == 0
            for i in range(start, end):
                load[base + (i - start) // per] += bounds[b]
    assert load.max() <= 50 and load.min() > 0 and load.sum() == (bounds * counts).sum()


SPEC = "container_id int, capacity_tokens int, id string"


@pytest.mark.parametrize("across", [True, False])
def test_no_container_overflows_and_nothing_is_lost(spark, across):
    rng = np.random.default_rng(1)
    items = [(i, int(s), "x") for i, s in enumerate(rng.integers(1, 130, 400))] + [(900, 100, "x"), (900, 100, "x"), (901, 250, None), (902, 0, None), (None, 5, None), (903, None, None)]
    df = spark.createDataFrame(items, "doc bigint, size bigint, bin string")
    specs = spark.createDataFrame([(1, 100, "a"), (2, 64, "b"), (2, 64, "b"), (3, 0, "c"), (4, None, "d"), (None, 9, "e")], SPEC)
    out = pack(df, "doc", "size", specs, "container_id", "capacity_tokens", 16, across).toPandas()
    assert out.columns.tolist() == ["container_id", "id", "piece", "pieces", "tokens", "bin"]
    for cid, cap in ((1, 100), (2, 64)):
        o = out[out.container_id == cid]
        assert o.groupby("bin").tokens.sum().max() <= cap
        assert sorted(o.bin.unique()) == list(range(o.bin.max() + 1))
        want = {}
        for i, s, _ in items:
            if i is not None and s is not None:
                want[i] = want.get(i, 0) + max(1, s)
        assert o.groupby("id").tokens.sum().to_dict() == want
        single = o[o.pieces == 1]
        assert (single.tokens <= cap).all() and set(o[o.pieces > 1].id) == {i for i, s, _ in items if i is not None and s is not None and s > cap}
    assert set(out.container_id) == {1, 2}


def test_documents_and_fill(spark):
    docs = spark.createDataFrame([(1, "é" * 4), (2, ""), (3, None), (4, "x" * 50_000), (5, "abc")], "doc_id bigint, text string")
    specs = spark.createDataFrame([(1, 9, None), (2, 60_000, None)], SPEC)
    out = pack_documents(docs, specs)
    assert {(r[0], r[1]) for r in oversize(out).collect()} == {(1, 4)}
    sums = {(r[0], r[1]): r[2] for r in out.groupBy("container_id", "doc_id").agg(F.sum("tokens")).collect()}
    assert sums == {(c, d): n for c in (1, 2) for d, n in ((1, 9), (2, 1), (4, 50_001), (5, 4))}
    assert all(0 < r["fill"] <= 1 for r in fill(out, specs).collect())
    assert pack_documents(docs.where("false"), specs).count() == 0
    assert pack_documents(docs, specs.where("false")).count() == 0


def test_many_sizes_are_planned_like_few():
    rng = np.random.default_rng(4)
    sizes = np.unique(rng.integers(1, 16_000, 6000))
    counts = rng.integers(1, 50, len(sizes))
    got = optimal_buckets(sizes, counts, 128)
    # No single bound can be moved to the next smaller or larger size for less padding.
    cost = padding(sizes, counts, got)
    places = np.searchsorted(sizes, got)
    for i in range(len(got) - 1):
        for step in (-1, 1):
            moved = got.copy()
            moved[i] = sizes[places[i] + step]
            assert (np.diff(moved) <= 0).any() or padding(sizes, counts, moved) >= cost


def test_method_and_default_split_the_same_items(spark):
    df = spark.createDataFrame([(i, 1 + (i * 37) % 300) for i in range(500)], "doc bigint, size bigint")
    specs = spark.createDataFrame([(1, 128)], "c int, cap int")
    both = [pack(df, "doc", "size", specs, "c", "cap", 32, a).where("pieces > 1 and piece = 1").select("id").collect() for a in (True, False)]
    assert sorted(both[0]) == sorted(both[1]) and len(both[0]) == sum(1 + (i * 37) % 300 > 128 for i in range(500))
