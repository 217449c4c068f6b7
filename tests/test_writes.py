import json
import threading

import pytest

from loamgraph.catalog import CachedLookup, Catalog, Collection, handle_request
from loamgraph.operators import reasoning
from loamgraph.operators.documents import Routing
from loamgraph.plans.selector import UnsupportedOperator

RES = "collection string, _id string, types array<string>, partitions array<string>, doc string"


def resource(collection, id_, types=(), partitions=(), **values):
    doc = {"_id": id_, "@type": list(types), **values}
    if partitions:
        doc["dcterms:isPartOf"] = list(partitions)
    return collection, id_, list(types), list(partitions), json.dumps(doc)


def docs(df):
    return {r["_id"]: json.loads(r["doc"]) for r in df.collect()}


TRI = "s string, p string, o string"


def test_merge_and_update_writes_once(spark):
    store = spark.createDataFrame([resource("things", "x:1", ["x:A"], v="a"), resource("things", "x:2", ["x:B"], v=1), resource("things", "x:3", [], **{"bold:reasoned": "then"})], RES)
    inferred = spark.createDataFrame([("x:1", "rdf:type", "x:B"), ("x:1", "v", "b"), ("x:1", "v", "b"), ("x:9", "rdf:type", "x:B"), ("x:2", "rdf:type", "x:B"), (None, "v", "z"), ("x:3", "v", None)], TRI)
    out, written = reasoning.merge_and_update(store, inferred, "now")
    got = docs(out)
    assert sorted(r[0] for r in written.collect()) == ["x:1", "x:2"] and set(got) == {"x:1", "x:2", "x:3"}
    assert got["x:1"] == {"_id": "x:1", "@type": ["x:A", "x:B"], "v": ["a", "b"], "bold:reasoned": "now"} and got["x:2"]["v"] == 1 and got["x:3"]["bold:reasoned"] == "then"
    assert {r["_id"]: r["types"] for r in out.collect()}["x:1"] == ["x:A", "x:B"]
    again, none = reasoning.merge_and_update(out, inferred, "later")
    assert none.count() == 0 and docs(again) == got
    more, added = reasoning.merge_and_update(store, inferred, "now", Routing(default="new"), update_only=False)
    assert {r["_id"]: r["collection"] for r in more.collect()}["x:9"] == "new" and docs(more)["x:9"] == {"_id": "x:9", "@type": ["x:B"], "bold:reasoned": "now"} and added.count() == 3
    assert reasoning.merge_and_update(store.where("false"), inferred.where("false"), "now")[0].count() == 0


TBOX = [("x:A", "rdfs:subClassOf", "x:B"), ("x:knows", "rdfs:range", "x:P"), ("x:knows", "owl:inverseOf", "x:knownBy")]


def test_update_one_reasons_and_keeps_its_statements(spark):
    store = spark.createDataFrame([resource("things", "x:1", ["x:Q"], ["x:part"], label="one", tags=["t"]), resource("things", "x:2", ["x:Q"]), resource("ontology", "x:3", ["owl:Class"])], RES)
    tbox = spark.createDataFrame(TBOX, TRI)
    out, result = reasoning.update_one(store, "x:1", {"_id": "x:other", "@type": ["x:A"], "label": "uno", "tags": ["u"], "x:knows": {"@id": "x:2"}}, "now", tbox, all_subjects=True)
    one = result["resource"]
    assert one["_id"] == "x:1" and one["@type"] == ["x:Q", "x:A", "x:B"] and one["label"] == "uno" and one["tags"] == ["t", "u"] and one["bold:reasoned"] == "now"
    assert result["collection"] == "things" and result["subjects"] == ["x:2"] and result["inferred"] == 3
    stored = docs(out)
    assert stored["x:1"] == one and stored["x:2"]["@type"] == ["x:Q", "x:P"] and stored["x:2"]["x:knownBy"] == ["x:1"] and len(stored) == 3
    ids = lambda r: sorted(x["_id"] for x in r["statements"].collect())
    _, twice = reasoning.update_one(store, "x:1", {"@type": ["x:A"], "label": "uno", "tags": ["u"], "x:knows": {"@id": "x:2"}}, "later", tbox, all_subjects=True)
    assert ids(twice) == ids(result)
    alone, result = reasoning.update_one(store, "x:1", {"@type": ["x:A"], "x:knows": {"@id": "x:2"}}, "now", tbox)
    assert result["subjects"] == [] and docs(alone)["x:2"]["@type"] == ["x:Q"] and result["inferred"] == 1
    plain, result = reasoning.update_one(store, "x:3", {"label": "c"}, "now")
    assert result == {"resource": {"_id": "x:3", "@type": ["owl:Class"], "label": "c", "bold:reasoned": "now"}, "collection": "ontology", "inferred": 0, "subjects": [], "statements": None} and plain.count() == 3
    with pytest.raises(LookupError):
        reasoning.update_one(store, "x:none", {}, "now")


def test_collection_writes(spark):
    c = Collection(spark.createDataFrame([("a", 1, ["t"]), ("b", 2, None)], "_id string, n int, at_type array<string>"))
    assert c.update_one({"_id": "a"}, {"$set": {"n": 5}, "$unset": {"@type": 1}}) == {"matched": 1, "modified": 1, "upserted": 0}
    assert tuple(c.find_one({"_id": "a"})) == ("a", 5, None) and c.update_one({"_id": "a"}, {"$set": {"n": 5}})["modified"] == 0
    assert c.update_one({"_id": "z"}, {"$set": {"n": 1}}) == {"matched": 0, "modified": 0, "upserted": 0} and c.count() == 2
    assert c.update_one({"_id": "z"}, {"$set": {"n": 1}, "$setOnInsert": {"@type": ["new"]}}, upsert=True)["upserted"] == 1 and tuple(c.find_one({"_id": "z"})) == ("z", 1, ["new"])
    assert c.replace_one({"_id": "b"}, {"_id": "q", "n": 9})["modified"] == 1 and tuple(c.find_one({"_id": "b"})) == ("b", 9, None)
    assert c.replace_one({"_id": "k"}, {"n": 3}, upsert=True)["upserted"] == 1 and c.find_one({"_id": "k"})["n"] == 3
    total = c.bulk_write([{"insertOne": {"document": {"_id": "i", "n": 0}}}, {"updateOne": {"filter": {"_id": "i"}, "update": {"$set": {"n": 7}}}}, {"replaceOne": {"filter": {"_id": "j"}, "replacement": {"n": 8}, "upsert": True}}, {"deleteMany": {"filter": {"n": {"$lt": 4}}}}])
    assert total == {"matched": 1, "modified": 1, "upserted": 1, "inserted": 1, "deleted": 2} and c.count() == 4
    for bad in (lambda: c.insert_one({"_id": "a"}), lambda: c.insert_many([{"_id": "m"}, {"_id": "m"}]), lambda: c.insert_one({"n": 1}), lambda: c.insert_one({"_id": "m", "none": 1})):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: c.update_one({"_id": "a"}, {"$push": {"n": 1}}), lambda: c.bulk_write([{"dropAll": {}}])):
        with pytest.raises(UnsupportedOperator):
            bad()


def test_requests_for_one_document_share_a_fetch():
    calls, gate = [], threading.Event()

    def fetch(key):
        calls.append(key)
        gate.wait(5)
        if key == "bad":
            raise OSError("down")
        return {"_id": key}

    c, got = CachedLookup(fetch), []
    threads = [threading.Thread(target=lambda: got.append(c.find_one({"_id": "a"}))) for _ in range(4)]
    for t in threads:
        t.start()
    while not calls:
        pass
    gate.set()
    for t in threads:
        t.join()
    assert calls == ["a"] and got == [{"_id": "a"}] * 4
    for _ in range(2):
        with pytest.raises(OSError):
            c.find_one({"_id": "bad"})
    assert calls == ["a", "bad", "bad"] and c.seed_all(lambda: [{"_id": "s"}]) == 1 and c.find_one({"_id": "s"}) == {"_id": "s"}
    assert CachedLookup.path("my docs", "x:a/b") == "doc/my%20docs/x%3Aa%2Fb"


def test_encoded_paths_and_large_answers(spark, monkeypatch):
    cat = Catalog({"docs": spark.createDataFrame([("x:a/b",), ("c",)], "_id string")})
    assert handle_request(cat, {"docs"}, "GET", CachedLookup.path("docs", "x:a/b"))[0] == 200
    monkeypatch.setattr("loamgraph.catalog.MAX_ANSWER", 1)
    assert handle_request(cat, {"docs"}, "GET", "docs/docs")[0] == 413
