import json
import time

import pytest
from pyspark.sql import functions as F

from loamgraph.engine import Engine
from loamgraph.functions import display
from loamgraph.operators import documents, explore, ranges, rdf, reasoning, summary
from loamgraph.operators.documents import Routing
from loamgraph.operators.roster import RegionSet, Source, first_suppliers, group_report, region_sets
from loamgraph.operators.timestamps import zoneless_instant

DATA = [
    {"@context": {"x": "http://x/"}},
    {"@id": "x:A", "@type": "owl:Class", "rdfs:subClassOf": {"@id": "x:B"}},
    {"@id": "x:B", "@type": "owl:Class", "rdfs:subClassOf": {"@id": "x:C"}},
    {"@id": "x:1", "@type": "x:A", "x:n": 1},
    {"@id": "x:2", "@type": "x:Q"},
    {"x:n": 1},
]


def test_engine(spark, tmp_path):
    e = Engine(spark, Routing(default="things"))
    with pytest.raises(RuntimeError):
        e.ld()
    assert not e.ready() and e.get("x:1") is None
    assert e.import_data(DATA) == {"total": 5, "processed": 4, "errors": 1, "tbox": 2, "statements": 0, "abox": 2}
    assert e.ready() and e.ld().expand_name("x:1") == "http://x/1" and e.ld().compact_name("http://x/q") == "x:q"
    assert e.get("x:1")["x:n"] == 1 and e.find("things", {"@type": "x:A"}).count() == 1
    made, totals = e.reason("now", provenance="r")
    assert totals["written"] == 1 and totals["inferred"] == 2 and sorted(r["object"] for r in made.collect()) == ["x:B", "x:C"] and e.get("x:1")["bold:reasoned"] == "now" and "bold:reasoned" not in e.get("x:2")
    assert e.reason("later")[1]["written"] == 0
    assert e.update_one("x:2", {"@type": ["x:B"]}, "then")["resource"]["@type"] == ["x:Q", "x:B", "x:C"] and e.get("x:2")["bold:reasoned"] == "then"
    assert e.export("things", str(tmp_path / "out.jsonld")) == 2 and e.delete_many(["things"]) == 2 and e.get("x:1") is None and e.get("x:A") is not None
    f = tmp_path / "in.jsonld"
    f.write_text(json.dumps(DATA[:4]))
    assert e.initialize([str(f), str(tmp_path / "none")], clear=["ontology"])[0][0].endswith("none") and e.get("x:1")["x:n"] == 1


def test_bootstrap_of_the_reasoner_replaces_its_statements(spark):
    e = Engine(spark)
    e.import_data(DATA[:3])
    old = rdf.statements(spark.createDataFrame([("s", "p", "o")], "subject string, predicate string, object string"), None, "keep", 1).unionByName(rdf.statements(spark.createDataFrame([("s", "p", "q")], "subject string, predicate string, object string"), None, "boot", 1))
    onto, made = reasoning.bootstrap_reasoner(e.resources, old, "boot", "now", 2)
    got = sorted((r["subject"], r["predicate"], r["object"], r["provenance"]) for r in made.collect())
    assert got == [("s", "p", "o", "keep"), ("x:A", "rdfs:subClassOf", "x:C", "boot")]
    assert json.loads({r["_id"]: r["doc"] for r in onto.collect()}["x:A"])["rdfs:subClassOf"] == [{"@id": "x:B"}, "x:C"]
    again = reasoning.bootstrap_reasoner(onto, made, "boot", "now", 3)[1]
    assert sorted(r["_id"] for r in again.collect()) == sorted(r["_id"] for r in made.collect())


def test_order_and_background(spark):
    assert reasoning.reasoning_order(["a", "statements", "b", "c"], ["c", "none", "c", "statements"]) == ["c", "a", "b"]
    state, seen = reasoning.RunState(), []

    def once(scope):
        seen.append(scope)
        time.sleep(0.1)
        return {"n": 1}

    first = reasoning.start_reasoning(state, once, "x")
    second = reasoning.start_reasoning(state, once, "y")
    assert first.get("started") and second.get("queued")
    for _ in range(100):
        if not state.running:
            break
        time.sleep(0.05)
    assert seen == ["x", "y"] and state.snapshot()["n"] == 2
    reasoning.start_reasoning(state, lambda s: 1 / 0)
    time.sleep(0.3)
    assert "division" in state.snapshot()["error"] and not state.running


RING = '{"type":"Polygon","coordinates":[[[7,46],[8,46],[8,47],[7,47]]]}'


def test_group_report(spark):
    from loamgraph.operators.hexcells import add_cells

    rows = [("a", 5, 46.5, 7.5), ("a", 9, 46.5001, 7.5001), ("a", None, 46.9, 7.9), ("b", 3, 10.0, 10.0), ("", 1, 46.5, 7.5), (None, 1, 46.5, 7.5), ("c", 4, None, None)]
    data = add_cells(spark.createDataFrame(rows, "g string, t bigint, lat double, lng double"), "lat", "lng")
    one = spark.createDataFrame([("a", "first"), ("z", "no")], "_id string, name string")
    two = spark.createDataFrame([("a", "second", 1), ("b", "only", 2)], "_id string, name string, extra int")
    regions = spark.createDataFrame([("r1", RING, "Land"), ("r2", None, None)], "_id string, bold_spatialdepiction string, label string")
    sets = [RegionSet("land", lambda: regions, label="label"), RegionSet("land", lambda: 1 / 0), RegionSet("down", lambda: spark.read.parquet("/none")), RegionSet("none", None)]
    assert [s.key for s in region_sets(sets)] == ["land", "down"] and [s.key for s in region_sets(sets[0])] == ["land"]
    r = group_report([Source(data, one), Source(data.limit(0), two)], "g", "t", regions=sets, lat="lat", lng="lng")
    s = {x["group_id"]: x for x in r.summary.collect()}
    assert set(s) == {"a", "b", "c"} and (s["a"]["first_ms"], s["a"]["last_ms"], s["a"]["n"], len(s["a"]["cells"])) == (5, 9, 3, 2) and s["c"]["cells"] == []
    assert s["a"]["last_lat"] == 46.5001 and abs(s["b"]["cells"][0][0] - 10) < 0.02
    assert sorted(tuple(x) for x in r.tags.collect()) == [("a", "land", "r1")] and sorted(tuple(x) for x in r.regions.collect()) == [("land", "r1", "Land"), ("land", "r2", "r2")]
    assert sorted((x["_id"], x["name"]) for x in r.resources.collect()) == [("a", "first"), ("b", "only")]
    assert r.meta == {"cell_property": "_h3_7", "cell_resolution": 7, "groups": 3, "cells_available": True, "time_available": True, "regions_available": True, "region_sets": {"land": True, "down": False}, "truncated": False}
    coarse = group_report([Source(data, one)], "g", "t", max_cells=2)
    assert coarse.meta["cell_resolution"] == 3 and coarse.meta["truncated"] and not coarse.meta["regions_available"]
    empty = group_report([Source(data.limit(0), one)], "g", "t")
    assert empty.meta["groups"] == 0 and not empty.meta["cells_available"] and empty.resources.count() == 0
    with pytest.raises(ValueError):
        group_report([], "g", "t")
    assert first_suppliers(two, [one, two]).count() == 2


def test_labels_and_descriptions(spark):
    docs = [
        ("x:1", ["x:T"], {"rdfs:label": ["eins", "one"], "foaf:name": "", "rdfs:comment": "about"}), ("x:2", ["x:S", "x:T"], {"x:nick": {"@value": "Nick"}, "rdfs:label": "no"}), ("x:3", ["x:T"], {}),
        ("x:4", [], {}), ("x:5", ["x:F"], {"rdfs:label": "lost"}), ("", [], {}),
    ]
    res = spark.createDataFrame([(i, t, json.dumps({"_id": i, **d})) for i, t, d in docs], "_id string, types array<string>, doc string")
    settings = spark.createDataFrame([("x:S", None, ["x:nick"], ["x:d"]), ("x:F", "Fixed", None, None)], "class string, label string, label_properties array<string>, description_properties array<string>")
    kinds = spark.createDataFrame([("x:T", "Thing")], "class string, label string")
    got = {r["_id"]: tuple(r)[1:] for r in display.resource_labels(res, settings, kinds).collect()}
    assert got["x:1"] == ("eins", "rdfs:label", "about", "rdfs:comment") and got["x:2"] == ("Nick", "x:nick", "", "x:d")
    assert got["x:3"][0] == "Thing 3" and got["x:4"][0] == "4" and got["x:5"][0] == "Fixed" and got[""][0] == "Unknown"
    plain = {r["_id"]: r["label"] for r in display.resource_labels(res, resolver=F.concat(F.lit("r-"), "_id")).collect()}
    assert plain["x:2"] == "no" and plain["x:3"] == "r-x:3"
    ids = spark.createDataFrame([("x:1",), ("x:9",), (None,), ("x:1",)], "_id string")
    assert sorted(tuple(r) for r in display.labels_of_ids(ids, display.resource_labels(res)).collect()) == [("x:1", "eins"), ("x:9", "x:9")]


def test_groups_and_written_dates(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), ("0",), ("false",), ("a",)], "g string")
    assert display.grouped(df, F.col("g")).where("group_id is null").count() == 4 and display.grouped(df, F.col("g"), False).count() == 2
    values = ["2024-03-10", "2024-03-10T23:30:00", "2024-03-10T07:30:00Z", '{"@value":"2024-02-30"}', "1710084600000", "soon", None, '{"@value":"10 March 2024"}']
    d = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = [r["d"] for r in d.select("i", display.format_text_date(F.col("v")).alias("d")).orderBy("i").collect()]
    assert got == ["3/10/2024", "3/10/2024", "3/9/2024", "", "3/10/2024", "", "", "3/10/2024"]
    z = [(r["z"]["matched"], r["z"]["utc_ms"]) for r in d.select("i", zoneless_instant(F.col("v"), "UTC").alias("z")).orderBy("i").collect()]
    assert z[0] == (True, 1710028800000) and z[2] == (False, None) and z[6] == (False, None)
    bad = spark.createDataFrame([("2024-02-30",)], "v string").select(zoneless_instant(F.col("v"), "UTC").alias("z")).first()["z"]
    assert (bad["matched"], bad["utc_ms"]) == (True, None)


def test_empty_buckets(spark):
    df = spark.createDataFrame([("a", 0), ("a", 160), ("b", 5), ("b", 5), (None, 1)], "k string, t bigint")
    got = sorted(((str(r["k"]), r["bucket"], r["n"], r["min_ms"]) for r in summary.time_buckets(df, ["k"], "t", 16, True).collect()), key=str)
    assert len(got) == 18 and ("a", 0, 1, 0) in got and ("a", 15, 1, 160) in got and ("a", 7, 0, None) in got and ("b", 0, 2, 5) in got and ("None", 0, 1, 1) in got


def test_statement_ids_and_metadata(spark):
    s = {"rdf:subject": {"@id": "s"}, "rdf:predicate": "p", "rdf:object": {"@value": "o"}}
    docs = [{**s, "dcterms:isPartOf": [{"@id": "b"}, "a"], "bold:provenance": "r"}, {**s, "bold:provenance": "r"}, {"rdf:subject": "s"}, s]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, doc string")
    got = [r["id"] for r in df.select("i", rdf.statement_id_of(F.col("doc")).alias("id")).orderBy("i").collect()]
    want = lambda *src: spark.range(1).select(rdf.statement_id(F.lit("s"), F.lit("p"), F.lit("o"), F.array(*map(F.lit, src)).cast("array<string>"))).first()[0]
    assert got == [want("a", "b"), want("r"), None, want()]
    facts = spark.createDataFrame([("s", "p", "o", "cax-sco", "x"), ("s", "p", "o", "prp-dom", "a"), ("s", "q", "o", None, None)], "subject string, predicate string, object string, rule string, inferred_from string")
    rows = {r["predicate"]: r for r in rdf.statements(facts, meta={"*": {"by": "me"}, "q": {"note": "n"}}).collect()}
    assert rows["p"]["rule"] == "cax-sco" and rows["p"]["inferred_from"] == "a" and rows["p"]["meta"] == {"by": "me"} and rows["q"]["meta"] == {"by": "me", "note": "n"}


def test_json_helpers(spark):
    df = spark.createDataFrame([('{"//c":1,"a":[1,{"b":2}],"n":null,"s":"x"}',), (None,)], "doc string")
    got = [tuple(r) for r in df.select(documents.without_comments(F.col("doc")), documents.with_arrays(F.col("doc"), ["s", "a", "n"])).collect()]
    assert got == [('{"a":[1,{"b":2}],"n":null,"s":"x"}', '{"//c":1,"a":[1,{"b":2}],"n":null,"s":["x"]}'), (None, None)]


def test_instances_by_type(spark):
    res = spark.createDataFrame([("1", ["A", "A"], '{"_id":"1","p":1,"q":2}'), ("2", ["B"], '{"p":1}'), ("3", ["C"], "{}"), ("4", None, '{"p":1}')], "_id string, types array<string>, doc string")
    edges = spark.createDataFrame([("A", "B"), ("B", "D")], "child string, parent string")
    rows = lambda **k: sorted((tuple(r) for r in explore.instances(res, **k).collect()), key=str)
    assert rows() == [("A", "p", 1, 1), ("A", "q", 1, 1), ("B", "p", 1, 1), ("C", None, 0, 1)]
    assert rows(edges=edges, class_filter=["B", "D"]) == [("B", "p", 2, 2), ("B", "q", 1, 2), ("D", "p", 2, 2), ("D", "q", 1, 2)]


def test_update_ranges(spark):
    who = spark.createDataFrame([("a", None), ("b", "old"), ("c", "same"), ("d", None)], "_id string, range string")
    hulls = spark.createDataFrame([("a", "new"), ("c", "same"), ("z", "ring")], "group_id string, ring string")
    out, told = ranges.update_ranges(who, hulls, "_id", "range")
    assert {r["_id"]: r["range"] for r in out.collect()} == {"a": "new", "b": None, "c": "same", "d": None}
    assert sorted(tuple(r) for r in told.collect()) == [("a", "set"), ("b", "unset"), ("c", "kept"), ("d", "kept"), ("z", "unmatched")]
    same, _ = ranges.update_ranges(who, hulls, "_id", "range", dry_run=True)
    assert same.collect() == who.collect()
