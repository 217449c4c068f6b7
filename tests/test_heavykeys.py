import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.operators.heavykeys import animal_cells, animal_profile, dense_distinct, dense_profile, epoch_ms, heavy_animals


@pytest.mark.parametrize("flush", [1, 500_000])
def test_profile_equals_group_by(spark, flush):
    rng = np.random.default_rng(2)
    rows = [(None if k == 7 else f"k{k if k > 3 else 0}", None if v % 5 == 0 else int(v), "n") for k, v in zip(rng.integers(0, 40, 3000), rng.integers(-50, 50, 3000))]
    df = spark.createDataFrame(rows, "key string, value bigint, n string").repartition(6)
    got = {tuple(r) for r in dense_profile(df, "key", "value", flush_keys=flush).collect()}
    want = {tuple(r) for r in df.groupBy("key").agg(F.count(F.lit(1)), F.min("value"), F.max("value")).collect()}
    assert got == want
    got = {tuple(r) for r in dense_distinct(df, "key", "value", flush_keys=flush).collect()}
    assert got == {tuple(r) for r in df.where("value is not null").groupBy("key").agg(F.countDistinct("value")).collect()}


def test_written_forms_join_and_nobody_is_apart(spark):
    rows = [("t:a", 1, "c1"), (" t:a", 5, "c1"), ('["t:a"]', 3, None), ("", 2, "c2"), (None, 2, "c2"), ("t:b", None, "c9")]
    df = spark.createDataFrame(rows, "bold_animal string, _when_ms bigint, _h3_7 string")
    ctx = spark.createDataFrame([("t", "http://x/")], "prefix string, iri string")
    got = {r[0]: tuple(r)[1:] for r in animal_profile(df, ctx).collect()}
    assert got == {"t:a": (3, 1000, 5000), None: (2, 2000, 2000), "t:b": (1, None, None)}
    assert {r[0]: r[1] for r in animal_cells(df, ctx).collect()} == {"t:a": 1, None: 1, "t:b": 1}
    assert [r[0] for r in heavy_animals(animal_profile(df, ctx), 6, 500).collect()] == ["t:a"]


def test_empty_and_units(spark):
    df = spark.createDataFrame([], "key string, value bigint")
    assert dense_profile(df, "key", "value").count() == 0
    assert dense_distinct(df, "key", "value").count() == 0
    assert [r[0] for r in spark.createDataFrame([(1704649229,), (1704649229000,), (None,)], "t bigint").select(epoch_ms(F.col("t"))).collect()] == [1704649229000, 1704649229000, None]
