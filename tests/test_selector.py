import pytest

from loamgraph.plans.selector import UnsupportedOperator, aggregate, find


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", ["x:A", "x:B"], 1.0, "k1", '{"q":1,"r":null}'), ("b", ["x:B"], 2.0, None, '{"q":"s"}'), ("c", None, None, "k2", '{"q":["s","t"]}'), ("d", [], 4.0, "k1", None)]
    return spark.createDataFrame(rows, "_id string, at_type array<string>, geo_lat double, bold_animal string, doc string")


def ids(df):
    return sorted(r["_id"] for r in df.collect())


@pytest.mark.parametrize(
    "spec, want",
    [
        ({}, "abcd"), (None, "abcd"), ({"@type": "x:B"}, "ab"), ({"bold:animal": "k1"}, "ad"), ({"bold:animal": None}, "b"), ({"bold:animal": {"$in": ["k2", None]}}, "bc"),
        ({"bold:animal": {"$nin": ["k1"]}}, "bc"), ({"@type": {"$in": ["x:A", "x:Z"]}}, "a"), ({"@type": {"$nin": ["x:A"]}}, "bcd"), ({"@type": {"$nin": []}}, "abcd"),
        ({"geo:lat": {"$gte": 2}}, "bd"), ({"geo:lat": {"$gt": 1, "$lt": 4}}, "b"), ({"geo:lat": {"$lte": 1}}, "a"), ({"geo:lat": {"$exists": False}}, "c"), ({"nowhere": {"$exists": False}}, "abcd"),
        ({"r": {"$exists": True}}, "a"), ({"q": "s"}, "bc"), ({"q": {"$gte": 1}}, "a"), ({"$or": [{"_id": "a"}, {"geo:lat": 4}]}, "ad"), ({"$and": [{"@type": "x:B"}, {"geo:lat": {"$lt": 2}}]}, "a"), ({"_id": {"$in": [str(i) for i in range(2000)] + ["b"]}}, "b"), ({"@type": ["x:B"]}, "b"),
    ],
)
def test_selectors(docs, spec, want):
    assert ids(find(docs, spec)) == list(want)


@pytest.mark.parametrize("spec", [{"$where": "1"}, {"a": {"$regex": "x"}}, {"$or": []}])
def test_unknown_operators_are_refused(docs, spec):
    with pytest.raises(UnsupportedOperator):
        find(docs, spec)


def test_options(docs):
    out = find(docs, {}, ["geo:lat"], [("geo:lat", -1)], 2)
    assert out.columns == ["_id", "geo_lat"] and [r["_id"] for r in out.collect()] == ["d", "b"]
    assert "doc" not in find(docs, {}, {"doc": 0}).columns
    assert find(docs, {}, {"_id": 0, "doc": 1}).columns == ["doc"]
    assert [r["_id"] for r in find(docs, {}, sort={"geo:lat": 1}).collect()] == list("cabd")


def test_pipelines(docs):
    out = aggregate(docs, [{"$unwind": "$@type"}, {"$group": {"_id": "$@type", "n": {"$sum": 1}, "ids": {"$addToSet": "$_id"}}}, {"$sort": {"n": -1}}, {"$limit": 1}])
    assert [tuple(r) for r in out.collect()] == [("x:B", 2, ["a", "b"])]
    both = aggregate(docs, [{"$match": {"bold:animal": {"$exists": True}}}, {"$facet": {"all": [{"$group": {"_id": None, "n": {"$sum": 1}, "avg": {"$avg": "$geo:lat"}, "sum": {"$sum": "$geo:lat"}}}], "by": [{"$group": {"_id": "$bold:animal", "newest": {"$top": {"sortBy": {"geo:lat": -1}, "output": ["$_id", "$bold:animal"]}}, "lats": {"$push": "$geo:lat"}}}]}}])
    assert [tuple(r) for r in both["all"].collect()] == [(None, 3, 2.5, 5.0)]
    assert {r["_id"]: r["newest"] for r in both["by"].collect()} == {"k1": ["d", "k1"], "k2": None}
    kept = aggregate(docs, [{"$unwind": {"path": "$@type", "preserveNullAndEmptyArrays": True}}])
    assert kept.count() == 5
    for bad in ([{"$lookup": {}}], [{"$group": {"_id": 1, "n": {"$first": "$x"}}}], [{"$facet": {}}, {"$limit": 1}], [{"$match": {}, "$limit": 1}]):
        with pytest.raises(UnsupportedOperator):
            aggregate(docs, bad)


def test_top_by_several_fields_and_facets(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 7, "y"), ("a", 2, 1, "z"), ("a", 2, 3, "w"), ("b", None, 1, "n"), ("b", 4, None, "m")], "g string, p int, q int, v string")
    top = lambda sort: {r["_id"]: r["t"] for r in aggregate(df, [{"$group": {"_id": "$g", "t": {"$top": {"sortBy": sort, "output": "$v"}}}}]).collect()}
    assert top({"p": -1, "q": -1}) == {"a": "w", "b": "m"} and top({"p": -1, "q": 1}) == {"a": "z", "b": "m"}
    assert top({"p": 1, "q": -1}) == {"a": "y", "b": "n"} and top({"p": 1, "q": 1}) == {"a": "x", "b": "n"}
    with pytest.raises(UnsupportedOperator):
        top({"p": 1, "v": -1})
    out = aggregate(df, [{"$match": {"p": {"$gte": 1}}}, {"$facet": {"n": [{"$group": {"_id": None, "n": {"$sum": 1}}}], "g": [{"$group": {"_id": "$g", "n": {"$sum": 1}}}]}}])
    assert out["n"].first()["n"] == 5 and {r["_id"]: r["n"] for r in out["g"].collect()} == {"a": 4, "b": 1}
