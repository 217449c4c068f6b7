import json

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import documents, hierarchy, rdf, reasoning
from loamgraph.operators.reasoning import RunState, run_reasoning


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_closure_depth_and_direct_parents_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), (None, "c"), ("a", "b")], "child string, parent string")
    assert rows(hierarchy.closure(e)) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("x", "x", 2), ("x", "y", 1), ("y", "x", 1), ("y", "y", 2)]
    assert rows(hierarchy.depths(e)) == [("a", 2), ("b", 1), ("c", 0), ("x", 0), ("y", 0)]
    assert rows(hierarchy.direct_parents(e)) == [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")]
    assert hierarchy.closure(e.where("false")).count() == 0


def test_depths_with_cycles_below_a_root_and_long_chains(spark):
    frame = lambda pairs: spark.createDataFrame(pairs, "child string, parent string")
    assert rows(hierarchy.depths(frame([("a", "b"), ("b", "a"), ("a", "root"), ("c", "a"), ("c", "c")]))) == [("a", 1), ("b", 1), ("c", 2), ("root", 0)]
    assert rows(hierarchy.depths(frame([("x", "y"), ("y", "x"), ("z", "x"), ("p", "q")]))) == [("p", 1), ("q", 0), ("x", 0), ("y", 0), ("z", 1)]
    chain = frame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("n00", "n18")])
    assert {r["node"]: r["depth"] for r in hierarchy.depths(chain).collect()} == {f"n{i:02d}": 20 - i for i in range(21)}
    up = {(r["node"], r["ancestor"]): r["distance"] for r in hierarchy.closure(chain).collect()}
    assert len(up) == 210 and up["n00", "n20"] == 3 and up["n01", "n20"] == 19
    assert rows(hierarchy.depths(frame([]))) == [] and rows(hierarchy.closure(frame([]))) == []
    assert [r["rank"] for r in hierarchy.class_order(frame([("b", "a"), ("_:k", "a"), ("c", "b")])).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_types_by_specificity(spark):
    depth = spark.createDataFrame([("a", 2), ("b", 1), ("_:z", 9)], "node string, depth int")
    t = spark.createDataFrame([("i", "b"), ("i", "_:z"), ("i", "a"), ("i", "q"), ("i", "a")], "_id string, type string")
    assert rows(hierarchy.types_by_specificity(t, "_id", "type", depth)) == [("i", ["a", "b", "q", "_:z"])]


def test_schemas():
    onto = {"x:A": {"rdfs:subClassOf": "x:B", "bui:schema": {"properties": {"x:p": {"hidden": True, "tags": ["a"]}}}}, "x:B": {"rdfs:subClassOf": ["x:A", "x:C"], "bui:schema": {"properties": {"x:p": {"hidden": False, "width": 3, "tags": "b"}}}}, "x:C": {}, "x:p": {"bui:schema": {"label": "P"}, "bold:container": "@set"}}
    assert hierarchy.property_schema(onto, "x:p", {"@type": "x:A"}) == {"label": "P", "hidden": True, "width": 3, "tags": ["b", "a"]}
    assert hierarchy.group_strategies({"groups": [{"property": "p", "n": 1}, {"property": "p"}, {"x": 1}]}) == [{"property": "p", "n": 1}]
    assert hierarchy.is_array_property("x:p", {}, ontology=onto) and not hierarchy.is_array_property("x:p", {"x:p": {"@container": "@index"}}, ontology=onto)
    assert not hierarchy.is_array_property("7") and not hierarchy.is_array_property("__proto__")


def test_fold_and_deep_merge():
    a = {"_id": "x", "t": ["a"], "s": 1, "o": [{"@id": "q"}], "n": None}
    b = {"_id": "x", "t": "b", "s": 2, "o": {"@id": "q", "z": 1}, "m": [1], "n": {"k": 1}}
    assert documents.fold([a, b]) == {"_id": "x", "t": ["a", "b"], "s": 2, "o": [{"@id": "q"}], "m": [1], "n": {"k": 1}}
    assert documents.fold([a]) == a
    for bad in ([], [{"s": 1}], [a, {"_id": "y"}]):
        with pytest.raises(ValueError):
            documents.fold(bad)
    assert documents.deep_merge({"a": [1], "b": {"c": 1, "d": 2}, "e": 1}, {"a": 2, "b": {"c": 3}, "f": None}) == {"a": [1, 2], "b": {"c": 3, "d": 2}, "e": 1, "f": None}


def test_merge_json_and_columns(spark):
    docs = [("x", json.dumps({"_id": "x", "t": ["a"], "s": 1}), 1), ("x", json.dumps({"_id": "x", "t": ["b"], "s": 2}), 2), ("y", json.dumps({"_id": "y"}), 1)]
    out = documents.merge_json(spark.createDataFrame(docs, "_id string, doc string, o int"), "_id", "doc", "o")
    assert {r[0]: json.loads(r[1]) for r in out.collect()} == {"x": {"_id": "x", "t": ["a", "b"], "s": 2}, "y": {"_id": "y"}}
    df = spark.createDataFrame([("x", ["b"], None, 2), ("x", ["a", "b"], "p", 1), ("y", None, "q", 1)], "_id string, t array<string>, s string, at int")
    assert rows(documents.merge_columns(df, "_id", ["at"]), "_id", "t", "s") == [("x", ["a", "b"], "p"), ("y", None, "q")]


def test_upsert_replaces_or_merges_and_repeats_safely(spark):
    old = spark.createDataFrame([("a", ["x"], "1", "t0"), ("b", None, "2", "t0")], "_id string, tags array<string>, v string, since string")
    new = spark.createDataFrame([("a", ["y"], None, "t1"), ("c", ["z"], "3", "t1"), ("c", ["z"], "3", "t1")], "_id string, tags array<string>, v string, since string")
    once = documents.upsert(old, new, merge=True, first_wins=("since",))
    assert rows(once) == [("a", ["x", "y"], "1", "t0"), ("b", None, "2", "t0"), ("c", ["z"], "3", "t1")]
    assert rows(documents.upsert(once, new, merge=True, first_wins=("since",))) == rows(once)
    assert rows(documents.upsert(old, new)) == [("a", ["y"], None, "t1"), ("b", None, "2", "t0"), ("c", ["z"], "3", "t1")]


def test_every_ontology_type_is_routed_to_the_ontology(spark):
    kinds = ("AllDisjointProperties", "AsymmetricProperty", "ReflexiveProperty", "IrreflexiveProperty", "AllDifferent", "DataRange")
    df = spark.createDataFrame([(k, [f"http://www.w3.org/2002/07/owl#{k}"]) for k in kinds], "_id string, types array<string>")
    got = {r["_id"]: r["c"] for r in df.select("_id", documents.Routing(default="other").collection(F.col("_id"), F.col("types")).alias("c")).collect()}
    assert got == {**dict.fromkeys(kinds[:4], "ontology"), **dict.fromkeys(kinds[4:], "other")}


def test_routing_order(spark):
    route = documents.Routing(types={"x:T": "typed"}, id_patterns={"^ns:report-": "reports"}, namespaces={"ns": "space"}, default="rest")
    data = [("ns:report-1", ["x:T"]), ("ns:report-1", ["x:Q"]), ("ns:a", []), ("zz:a", None), ("ns:c", ["owl:Class"]), ("ns:s", ["rdf:Statement", "x:T"]), ("_id", ["x:Q"])]
    df = spark.createDataFrame(data, "_id string, types array<string>")
    got = [r[0] for r in df.select(route.collection(F.col("_id"), F.col("types"))).collect()]
    assert got == ["typed", "reports", "space", "rest", "ontology", "statements", "ontology"]
    assert route.search_order("ns:report-1", ["ontology", "space", "rest", "reports", "statements"]) == ["reports", "ontology", "space", "rest", "statements"]
    cols = {"ontology": spark.createDataFrame([("ns:a", "o")], "_id string, v string"), "space": spark.createDataFrame([("ns:a", "s"), ("ns:b", "s")], "_id string, v string"), "reports": spark.createDataFrame([("ns:report-1", "r")], "_id string, v string")}
    found = documents.lookup(spark.createDataFrame([("ns:a",), ("ns:b",), ("ns:report-1",), ("no",)], "_id string"), cols, route)
    assert rows(found, "_id", "collection") == [("ns:a", "ontology"), ("ns:b", "space"), ("ns:report-1", "reports")]


def test_triples_terms_and_literals(spark):
    df = spark.createDataFrame([("a", ["x:T", None], "l", 1.0, True, None), (None, ["x:T"], "m", 2.5, None, None)], "_id string, at_type array<string>, `rdfs:label` string, n double, flag boolean, `//note` string")
    assert rows(rdf.triples(df)) == [("a", "flag", "true", "boolean"), ("a", "n", "1", "number"), ("a", "rdf:type", "x:T", "string"), ("a", "rdfs:label", "l", "string")]
    t = spark.createDataFrame([("x:a", 'say "hi"\n', "string"), ("http://a.b/c", "http://a.b/c d", "string"), ("x:a", "file:y", "string"), ("x:a", "x:b:c", "string"), ("x:a", "4", "number"), ("x:a", "x:", "string")], "s string, o string, kind string").withColumn("p", F.lit("x:p"))
    assert [r[0] for r in rdf.sparql_lines(t).collect()] == ['x:a x:p "say \\"hi\\"\\n"', '<http://a.b/c> x:p "http://a.b/c d"', 'x:a x:p "file:y"', 'x:a x:p "x:b:c"', "x:a x:p 4", "x:a x:p x:"]
    lit = spark.createDataFrame([('"5"^^<http://www.w3.org/2001/XMLSchema#integer>',), ('"true"^^<http://www.w3.org/2001/XMLSchema#boolean>',), ('"x"@en',), ("plain",), ('"q"',), ('"1.5e2"^^<http://www.w3.org/2001/XMLSchema#double>',)], "v string")
    assert [r[0] for r in lit.select(rdf.convert_literal(F.col("v"))).collect()] == ["5", "true", "x", "plain", "q", "1.5e2"]
    xs = [tuple(r[0]) for r in lit.select(rdf.convert_xsd(F.col("v"))).collect()]
    assert xs[0] == ("5", "number", 5.0, None) and xs[1] == ("true", "boolean", None, True) and xs[5][2] == 150.0 and xs[3] == ("plain", "string", None, None)
    assert rdf.sparql_prefixes({"x": "http://x/", "@vocab": "http://v/", "_id": "@id", "t": {"@id": "x:t"}}) == "PREFIX x: <http://x/>\n"


def test_json_triples(spark):
    doc = {"_id": "x:1", "@type": ["x:T"], "x:p": [{"@id": "x:2"}, {"@value": "v"}], "x:q": 3, "//c": "no", "@context": {}}
    out = rdf.json_triples(spark.createDataFrame([(json.dumps(doc),), ("[]",), (None,)], "doc string"))
    assert rows(out) == [("x:1", "rdf:type", "x:T"), ("x:1", "x:p", "v"), ("x:1", "x:p", "x:2"), ("x:1", "x:q", "3")]


def test_statements_do_not_depend_on_order_and_upsert_is_idempotent(spark):
    facts = spark.createDataFrame([("s", "p", "o", False), ("s", "p", "o", False), ("s", "p", "known", True), ("t", "p", "o", False)], "subject string, predicate string, object string, explicit boolean")
    parts = lambda p: spark.createDataFrame([("s", p)], "subject string, partitions array<string>")
    one, two = rdf.statements(facts, parts(["b", "a"]), None, 5), rdf.statements(facts, parts(["a", "b"]), None, 6)
    assert rows(one, "_id") == rows(two, "_id") and one.count() == 2 and one.first()["_id"].startswith("bold:stmt-")
    slim = lambda d: d.drop("partitions")
    every, changed = rdf.upsert_statements(slim(one), slim(two))
    assert changed.count() == 0 and rows(every, "when_ms") == [(5,), (5,)]
    lines = spark.createDataFrame([("I(a, b, c, d)",), ('E(a, b, "x"@en)',), ("I(IFALSE, b, c)",), ('I("lit", b, c)',), ("junk",)], "value string")
    assert rows(rdf.parse_facts(lines)) == [("a", "b", "c, d", False), ("a", "b", "x", True)]
    assert rdf.strip_embedded_statements({"a": {"@type": "rdf:Statement"}, "b": [{"@type": ["rdf:Statement"]}, 1]}) == {"b": [1]}


TBOX = [("A", "rdfs:subClassOf", "B"), ("B", "rdfs:subClassOf", "C"), ("p", "rdfs:subPropertyOf", "q"), ("p", "rdfs:domain", "A"), ("q", "rdfs:range", "R"), ("p", "owl:inverseOf", "ip"), ("t", "rdf:type", "owl:TransitiveProperty"), ("y", "rdf:type", "owl:SymmetricProperty"), ("Re", "owl:allValuesFrom", "Fi"), ("Re", "owl:onProperty", "h"), ("I", "owl:intersectionOf", "A"), ("I", "owl:intersectionOf", "R2"), ("U", "owl:unionOf", "A"), ("A", "owl:disjointWith", "D"), ("irr", "rdf:type", "owl:IrreflexiveProperty")]


def test_rules(spark):
    tri = "s string, p string, o string"
    tbox = spark.createDataFrame(TBOX, tri)
    abox = spark.createDataFrame([("x", "p", "z"), ("a", "t", "b"), ("b", "t", "c"), ("c", "t", "d"), ("m", "y", "n"), ("k", "rdf:type", "Re"), ("k", "h", "l"), ("x", "rdf:type", "R2"), (None, "p", "z"), ("_:b", "p", "w")], tri)
    got = {(s, p, o) for s, p, o, _ in rows(reasoning.infer(abox, tbox))}
    assert got == {("x", "rdf:type", "A"), ("x", "rdf:type", "B"), ("x", "rdf:type", "C"), ("x", "q", "z"), ("z", "rdf:type", "R"), ("z", "ip", "x"), ("a", "t", "c"), ("b", "t", "d"), ("a", "t", "d"), ("n", "y", "m"), ("l", "rdf:type", "Fi"), ("x", "rdf:type", "I"), ("x", "rdf:type", "U"), ("w", "rdf:type", "R")}
    assert reasoning.infer(abox.where("false"), tbox).count() == 0 and reasoning.infer(abox, tbox.where("false")).count() == 0
    bad = spark.createDataFrame([("v", "rdf:type", "A"), ("v", "rdf:type", "D"), ("v", "irr", "v")], tri)
    assert rows(reasoning.inconsistencies(bad, tbox)) == [("v", "cax-dw", "A|D"), ("v", "prp-irp", "irr")]
    with pytest.raises(ValueError):
        reasoning.infer(abox, tbox, ("no-rule",))
    more = spark.createDataFrame([("ax", "rdf:type", "owl:AllDisjointClasses"), *(("ax", "owl:members", c) for c in "ABC"), ("par", "rdf:type", "owl:AsymmetricProperty"), ("likes", "owl:propertyDisjointWith", "hates")], tri)
    worse = spark.createDataFrame([("v", "rdf:type", "A"), ("v", "rdf:type", "C"), ("u", "rdf:type", "B"), ("v", "par", "w"), ("w", "par", "v"), ("v", "par", "u"), ("v", "likes", "u"), ("v", "hates", "u"), ("u", "hates", "v"), ("v", "hates", None)], tri)
    assert rows(reasoning.inconsistencies(worse, more)) == [("v", "cax-adc", "A|C"), ("v", "prp-asyp", "par|w"), ("v", "prp-pdw", "hates|likes|u"), ("w", "prp-asyp", "par|v")]
    assert rows(reasoning.inconsistencies(worse.where("false"), more)) == []


def test_only_subjects_with_inferences_are_stamped(spark):
    res = spark.createDataFrame([("x", None), ("y", None), ("z", 5)], "_id string, r int").select("_id", F.timestamp_millis(F.col("r").cast("bigint")).alias("reasoned_at"))
    tri = spark.createDataFrame([("x", "rdf:type", "A"), ("y", "rdf:type", "Q"), ("z", "rdf:type", "A")], "s string, p string, o string")
    inferred, stamped = reasoning.reason_collection(res, tri, spark.createDataFrame(TBOX[:2], "s string, p string, o string"), 1000)
    assert rows(inferred, "s", "o") == [("x", "B"), ("x", "C")]
    assert {r[0]: r[1] is not None for r in stamped.collect()} == {"x": True, "y": False, "z": True}


def test_run_state():
    s = RunState()
    seen = []

    def once(scope):
        seen.append(scope)
        if len(seen) == 1:
            assert not s.begin("a") and not s.begin("a") and s.pending_scope == "a"
            assert not s.begin("b") and s.pending_scope is None
        return {"written": 2}

    assert run_reasoning(s, once, "first")["written"] == 4 and seen == ["first", None] and not s.running
    with pytest.raises(RuntimeError):
        run_reasoning(s, lambda _: (_ for _ in ()).throw(RuntimeError("x")))
    assert s.error == "x" and not s.running and not s.pending


def test_status_and_detail(spark):
    df = spark.createDataFrame([("1", "c1", ["a"], 1), ("2", "c1", ["a"], None), ("3", "c2", ["b"], None), ("4", "c2", ["b"], None)], "_id string, collection string, types array<string>, r int").withColumn("reasoned_at", F.timestamp_millis(F.col("r").cast("bigint")))
    assert sorted((r[0] or "", r[1], r[2], r[3]) for r in documents.reasoning_status(df).collect()) == [("", 4, 1, 3), ("c1", 2, 1, 1), ("c2", 2, 0, 2)]
    assert rows(documents.unreasoned_detail(df, F.col("collection"), F.col("types"), examples=1)) == [("c1", "a", 1, "2"), ("c2", "b", 2, "3")]
