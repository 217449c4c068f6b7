import json

import pytest

from loamgraph.catalog import CachedLookup, Catalog, Query, handle_request
from loamgraph.operators.documents import Routing
from loamgraph.operators.windows import WindowProvider
from loamgraph.sources import jsonld

CTX = {"x": "http://x/", "xy": "http://x/y/", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "x:knows": {"@type": "@id"}, "x:tags": {"@container": "@set"}, "x:raw": {"@type": "@json"}}


def test_expand_and_compact_round_trip():
    doc = {"@id": "x:1", "@type": "x:T", "x:knows": "x:2", "x:tags": ["a"], "x:raw": {"k": [1]}, "x:n": 3, "x:child": {"@id": "x:3", "x:n": 4}, "//c": "gone"}
    e = jsonld.expand(doc, CTX)
    assert e["@id"] == "http://x/1" and e["http://x/knows"] == [{"@id": "http://x/2"}] and e["http://x/raw"] == [{"@value": {"k": [1]}, "@type": "@json"}]
    c = jsonld.compact(e, CTX, "_id")
    assert c == {"_id": "x:1", "@type": ["x:T"], "x:knows": "x:2", "x:tags": ["a"], "x:raw": {"k": [1]}, "x:n": 3, "x:child": {"@id": "x:3", "x:n": 4}}
    assert jsonld.compact_name("http://x/y/z", CTX) == "xy:z" and jsonld.expand_name("_:b", CTX) == "_:b" and jsonld.expand_name("q:z", CTX) == "q:z"


def test_contexts():
    assert list(jsonld.merge_contexts({"x": "a", "@vocab": "v"}, {"x:p": {"@type": "@id"}, "b": "c"})) == ["@vocab", "b", "x", "x:p"]
    assert jsonld.merge_contexts({"t": {"a": [1]}}, {"t": {"a": [2]}})["t"] == {"a": [1, 2]}
    with pytest.raises(ValueError):
        jsonld.merge_contexts({"x": "a"}, {"x": "b"})
    assert jsonld.property_term({"@type": ["owl:DatatypeProperty"], "rdfs:range": "xsd:date", "bold:container": "@set"}) == {"@type": "http://www.w3.org/2001/XMLSchema#date", "@container": "@set"}
    assert jsonld.is_json_property("bui:schema", {}) and not jsonld.is_json_property("x:p", {})


DATA = [
    {"@context": {"x": "http://x/"}},
    {"@id": "x:onto", "@type": "owl:Ontology"},
    {"@id": "x:p", "@type": "owl:ObjectProperty"},
    {"@id": "x:1", "@type": ["x:T"], "x:p": {"@id": "x:2"}, "x:n": 1},
    {"@id": "http://x/1", "@type": "x:U", "x:n": 2},
    {"@type": "x:T"},
    {"@id": "x:s", "rdf:subject": {"@id": "x:1"}, "rdf:predicate": {"@id": "x:p"}, "rdf:object": {"@id": "x:2"}},
]


def test_import_export(spark, tmp_path):
    out, ctx = jsonld.import_data(spark, DATA, routing=Routing(default="things"), add_partitions=True)
    got = {r["_id"]: r for r in out.collect()}
    assert {k: r["collection"] for k, r in got.items()} == {"x:onto": "ontology", "x:p": "ontology", "x:1": "things", "x:s": "statements", None: None}
    one = json.loads(got["x:1"]["doc"])
    assert one["@type"] == ["x:U"] and one["x:n"] == 2 and "x:p" not in one and got["x:1"]["partitions"] == ["x:onto"] and got["x:onto"]["partitions"] == []
    assert tuple(jsonld.import_stats(out).first()) == (5, 4, 1, 2, 1, 1)
    assert jsonld.export_file(out.where("collection = 'things'"), ctx, str(tmp_path / "one.jsonld")) == 1
    assert json.loads((tmp_path / "one.jsonld").read_text())["@id"] == "x:1"
    assert jsonld.export_file(out, ctx, str(tmp_path / "all.jsonld")) == 4
    back, _ = jsonld.import_data(spark, json.loads((tmp_path / "all.jsonld").read_text()), routing=Routing(default="things"))
    assert {r["_id"] for r in back.collect()} == {"x:onto", "x:p", "x:1", "x:s"}
    kept, _ = jsonld.import_data(spark, DATA, before_save=lambda d: d if d["_id"] == "x:1" else None)
    assert {r["_id"] for r in kept.collect()} == {"x:1", None}
    assert jsonld.load_documents(spark, str(tmp_path / "*.jsonld")).count() == 2


def test_last_delivery_replaces_and_the_ontology_merges(spark):
    docs = lambda *v: [{"@context": {"x": "http://x/"}}] + [{"@id": "x:1", "@type": "x:T", "x:v": t} for t in v]
    for values in (("zzz", "aaa"), ("aaa", "zzz"), ("b", "a", "c")):
        out, _ = jsonld.import_data(spark, docs(*values), routing=Routing(default="things"))
        assert [json.loads(r["doc"])["x:v"] for r in out.collect()] == [values[-1]]
    cls = [{"@id": "x:C", "@type": "owl:Class", "rdfs:label": "one", "x:l": ["a", "c"]}, {"@id": "x:C", "x:l": ["b", "a"]}, {"@id": "x:C", "@type": ["owl:Class"], "rdfs:label": "two"}]
    out, _ = jsonld.import_data(spark, [{"@context": {"x": "http://x/"}}, *cls], routing=Routing(default="things"))
    row = out.first()
    assert row["collection"] == "ontology" and out.count() == 1 and json.loads(row["doc"]) == {"_id": "x:C", "@type": ["owl:Class"], "rdfs:label": "two", "x:l": ["a", "c", "b"]}


def test_save_over_stored_resources(spark):
    schema = "collection string, _id string, types array<string>, partitions array<string>, doc string"
    stored = spark.createDataFrame([("ontology", "x:C", ["owl:Class"], [], '{"_id":"x:C","l":["a"],"o":{"k":1}}'), ("things", "x:1", ["x:T"], ["p"], '{"_id":"x:1","a":1}'), ("things", "x:2", [], [], '{"_id":"x:2"}')], schema)
    new = spark.createDataFrame([("ontology", "x:C", ["x:M"], ["q"], '{"_id":"x:C","l":["b"],"o":{"m":2}}', None), ("things", "x:1", ["x:U"], [], '{"_id":"x:1","b":2}', None), (None, None, None, None, "bad", "no id")], schema + ", error string")
    out = {(r["collection"], r["_id"]): r for r in jsonld.save(stored, new, share_tbox="things").collect()}
    assert set(out) == {("ontology", "x:C"), ("things", "x:1"), ("things", "x:2"), ("things", "x:C")}
    assert json.loads(out["ontology", "x:C"]["doc"]) == {"_id": "x:C", "l": ["a", "b"], "o": {"k": 1, "m": 2}} and out["ontology", "x:C"]["types"] == ["owl:Class", "x:M"]
    assert json.loads(out["things", "x:1"]["doc"]) == {"_id": "x:1", "b": 2} and out["things", "x:1"]["types"] == ["x:U"] and out["things", "x:1"]["partitions"] == []
    assert json.loads(out["things", "x:C"]["doc"])["l"] == ["b"]


def test_bootstrap(spark, tmp_path):
    good, bad = tmp_path / "a.jsonld", tmp_path / "b.jsonld"
    good.write_text(json.dumps({"@context": {"x": "http://x/"}, "@graph": [{"@id": "x:1"}]}))
    bad.write_text("{")
    out, _, failed = jsonld.bootstrap(spark, [str(good), str(bad)])
    assert out.count() == 1 and failed[0][0] == str(bad)
    later = tmp_path / "c.jsonld"
    later.write_text(json.dumps({"@context": {"x": "http://x/", "y": "http://y/"}, "@graph": [{"@id": "x:1", "y:n": 5}, {"@id": "y:p", "@type": "owl:DatatypeProperty", "rdfs:range": "xsd:integer"}]}))
    clash = tmp_path / "d.jsonld"
    clash.write_text(json.dumps({"@context": {"x": "http://other/"}, "@graph": [{"@id": "x:9"}]}))
    out, ctx, failed = jsonld.bootstrap(spark, [str(good), str(later), str(clash), str(tmp_path / "none.jsonld")])
    assert {r["_id"]: json.loads(r["doc"]).get("y:n") for r in out.collect()} == {"x:1": 5, "y:p": None} and ctx["y:p"]["@type"].endswith("#integer")
    assert sorted(f[0] for f in failed) == sorted([str(clash), str(tmp_path / "none.jsonld")])
    with pytest.raises(OSError):
        jsonld.bootstrap(spark, [str(tmp_path / "none.jsonld")])
    with pytest.raises(ValueError):
        jsonld.bootstrap(spark, [str(bad)])


def test_archive(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "_id string")
    assert jsonld.dump_archive({"old.t": df}, str(tmp_path / "arc")) > 0
    assert set(jsonld.restore_archive(spark, str(tmp_path / "arc"), ("old", "new"))) == {"new.t"}
    assert jsonld.dump_archive({"old.t": df}, str(tmp_path / "arc")) > 0
    assert jsonld.restore_archive(spark, str(tmp_path / "arc"), into=str(tmp_path / "live"))["old.t"].count() == 1 and spark.read.parquet(str(tmp_path / "live" / "old.t")).count() == 1
    with pytest.raises(ValueError):
        jsonld.restore_archive(spark, str(tmp_path / "arc"), ("old", ""))


def test_embedded(spark):
    doc = json.dumps({"_id": "a", "@type": "x:T", "x:c": [{"@type": ["x:U"], "x:d": {"@type": "x:V"}}, {"@type": "rdf:Statement"}], "@context": {"@type": "no"}})
    assert sorted(r["type"] for r in jsonld.embedded(spark.createDataFrame([("a", doc), ("b", "bad")], "_id string, doc string")).collect()) == ["x:U", "x:V"]


def test_catalog(spark):
    df = spark.createDataFrame([("a", "g", 1), ("b", "h", 2)], "_id string, g string, t bigint")
    bounds = spark.createDataFrame([("g", 5, None, None)], "individual_id string, start_ms bigint, end_ms bigint, end_before_ms bigint")
    cat = Catalog({"docs": df, "free": df}, WindowProvider(lambda: bounds, lambda: 0), {"docs": ("g", "t")})
    assert cat.public("docs").count_documents() == 1 and cat.public("free").count_documents() == 2
    with pytest.raises(KeyError, match="docs, free"):
        cat["nothing"]
    with pytest.raises(PermissionError):
        Catalog({"docs": df}, None, {"docs": ("g", "t")}).public("docs")
    q = Query.of(Query("q", "docs", {}, {"sort": [("t", -1)], "limit": 1}).to_document())
    assert [r["_id"] for r in q.run(cat).collect()] == ["b"] and [r["_id"] for r in q.run(cat, public=False).collect()] == ["b"]
    ask = lambda m, p: handle_request(cat, {"docs"}, m, p)[0]
    assert [ask("GET", "doc/docs/b"), ask("GET", "doc/docs/a"), ask("GET", "docs/docs"), ask("GET", "docs/free"), ask("GET", "doc"), ask("POST", "docs/docs")] == [200, 404, 200, 403, 400, 405]
    assert cat["free"].delete_many({"_id": "a"}) == 1 and cat["free"].count() == 1


def test_cached_lookup():
    calls = []
    c = CachedLookup(lambda k: calls.append(k) or ({"_id": k} if k != "no" else None))
    c.seed({"_id": "s", "v": 1})
    assert [c.find_one({"_id": k}) for k in ("a", "a", "no", "no", "s")] == [{"_id": "a"}, {"_id": "a"}, None, None, {"_id": "s", "v": 1}] and calls == ["a", "no"]
    with pytest.raises(ValueError):
        c.find_one({"x": 1})
    with pytest.raises(NotImplementedError):
        c.find({})
