from pyspark.sql import functions as F

from loamgraph.operators.ids import qname, read_context, split_qname

CTX = [("track", "http://legacy.example.org/ns/track#"), ("track", "https://data.example.org/track/"), ("data", "https://data.example.org/")]


def test_written_forms(spark):
    forms = {
        "track:a-1": "track:a-1",
        " track:a-1 ": "track:a-1",
        "https://data.example.org/track/a-1": "track:a-1",
        "https://data.example.org/x": "data:x",
        "http://legacy.example.org/ns/track#a-1": "track:a-1",
        '{"@id":"track:a-1"}': "track:a-1",
        '{ "@id" : "https://data.example.org/track/a-1" }': "track:a-1",
        '["track:a-1"]': "track:a-1",
        '[{"@id":"track:a-1"}]': "track:a-1",
        '["a:1","a:2"]': '["a:1","a:2"]',
        "{broken": "{broken",
        "[": "[",
        "Track:A-1": "Track:A-1",
        "https://elsewhere.example/a": "https://elsewhere.example/a",
        "": "",
        "  ": "",
        "x" * 100_000: "x" * 100_000,
    }
    df = spark.createDataFrame([(k,) for k in forms] + [(None,)], "raw string")
    got = {r[0]: r[1] for r in df.select("raw", qname(F.col("raw"), CTX)).collect()}
    assert got == {**forms, None: None}


def test_split(spark):
    df = spark.createDataFrame([("a:b:c",), ("bare",), (":x",), ("a:",), (None,)], "q string")
    prefix, local = split_qname(F.col("q"))
    assert [tuple(r) for r in df.select(prefix, local).collect()] == [("a", "b:c"), (None, "bare"), (None, ":x"), ("a", None), (None, None)]


def test_context_longest_iri_first(spark):
    df = spark.createDataFrame([("a", "http://x/"), ("b", "http://x/y/"), ("a", "http://x/"), (None, "q"), ("c", "")], "prefix string, iri string")
    assert read_context(df) == [("b", "http://x/y/"), ("a", "http://x/")]
