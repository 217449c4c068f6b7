import json

import pytest

from loamgraph.functions.jsonpath import find_all, parse, path_values
from loamgraph.operators import explore


def test_report(spark):
    tbox = spark.createDataFrame(
        [
            ("x:A", ["owl:Class"], ["x:B", "x:C", "_:r"], None), ("x:B", ["owl:Class"], ["x:C"], None), ("x:C", ["owl:Class"], None, None), ("_:r", ["owl:Class"], None, None),
            ("x:p", ["owl:DatatypeProperty", "owl:ObjectProperty"], None, ["x:A", "x:B"]), ("x:q", ["rdf:Property"], None, None), ("x:o", ["owl:Ontology"], None, None),
        ],
        "_id string, types array<string>, parents array<string>, domain array<string>",
    )
    data = {"one": spark.createDataFrame([(["x:A", "x:Z"],), (["x:A"],), (None,)], "at_type array<string>"), "two": spark.createDataFrame([(["x:A"],)], "at_type array<string>")}
    r = explore.report(tbox, data)
    assert list(r["Classes"]) == ["x:C", "x:B", "x:A", "x:Z"]
    a = r["Classes"]["x:A"]
    assert (a["subClassOf"], a["properties"], a["count"]) == (["x:B"], ["x:p"], 3) and {q["collection"] for q in a["queries"]} == {"one", "two"}
    assert {k: {p: sorted(d) for p, d in v.items()} for k, v in r["Properties"].items()} == {"owl:ObjectProperty": {"x:p": ["x:A", "x:B"]}, "rdf:Property": {"x:q": []}}
    assert r["Ontologies"] == ["x:o"]
    docs = spark.createDataFrame([(["x:A"], json.dumps({"_id": "1", "@type": [], "x:p": 1, "x:u": 2}))], "types array<string>, doc string")
    defs = spark.createDataFrame([("x:p", "xsd:int")], "_id string, range string")
    assert sorted(tuple(x) for x in explore.property_usage(docs, defs).collect()) == [("x:p", "x:A", 1, "xsd:int"), ("x:u", "x:A", 1, "No ontology definition found")]


DOC = {"a": {"b": [1, 2, {"k": 3}], "k": 4}, "k": [5], "x:y": 6, "q.r": 7}


@pytest.mark.parametrize(
    "path, want",
    [("$", [DOC]), ("$.a.k", [4]), ("$..['k']", [[5], 4, 3]), ("$['x:y']", [6]), ("$.a.b[0]", [1]), ("$.a.b[-1].k", [3]), ("$.a.b[0,1]", [1, 2]), ("$.a.b[:2]", [1, 2]), ("$.a.*", [[1, 2, {"k": 3}], 4]), ("$['q.r','x:y']", [7, 6]), ("$.no.where", []), ("$..*['k']", [4, 3])],
)
def test_paths(path, want):
    assert find_all(DOC, path) == want


@pytest.mark.parametrize("path", ["a.b", "$[?(@.x)]", "$[(1)]", "$."])
def test_no_scripts(path):
    with pytest.raises(ValueError):
        parse(path)


def test_column(spark):
    df = spark.createDataFrame([('{"a":{"k":"v"}}',), ("bad",), (None,)], "doc string")
    assert [r[0] for r in df.select(path_values(df.doc, "$..k")).collect()] == [['"v"'], [], []]
