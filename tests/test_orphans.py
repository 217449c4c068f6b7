import datetime as dt

import pytest
from pyspark.sql import functions as F

from loamgraph.operators.orphans import fact, orphan_counts, orphan_references, resolve_references

REFS = [("r0", "a", "x"), ("r1", "a", None), ("r2", None, "x"), ("r3", None, None), ("r4", "b", "x"), ("r5", "zz", None), ("r0", "a", "x")]


def resolved(spark, match, keys=(("a", "x", 1), ("a", "y", 2), ("a", "x", 3), (None, "x", 9), ("c", None, 4))):
    refs = spark.createDataFrame(REFS, "id string, ns string, local string")
    known = spark.createDataFrame(list(keys), "ns string, local string, id int")
    out = resolve_references(refs, ["ns", "local"], known, ["ns", "local"], match, {"least": fact(F.min, "id")})
    return sorted((r["id"], r["found"], r["least"]) for r in out.collect())


def test_match_rules_by_null_mask(spark):
    base = [("r0", True, 1), ("r0", True, 1)]
    assert resolved(spark, "simple") == base + [("r1", None, None), ("r2", None, None), ("r3", None, None), ("r4", False, None), ("r5", None, None)]
    assert resolved(spark, "full") == base + [("r1", False, None), ("r2", False, None), ("r3", None, None), ("r4", False, None), ("r5", False, None)]
    assert resolved(spark, "exact") == base + [("r1", False, None), ("r2", True, 9), ("r3", None, None), ("r4", False, None), ("r5", False, None)]
    assert resolved(spark, "partial") == base + [("r1", True, 1), ("r2", True, 1), ("r3", None, None), ("r4", False, None), ("r5", False, None)]


def test_empty_keys_and_bad_arguments(spark):
    assert all(not r[1] for r in resolved(spark, "full", ()) if r[1] is not None)
    with pytest.raises(ValueError):
        resolved(spark, "fuzzy")


T = lambda day, month=1: dt.datetime(2024, month, day)


def tables(spark, reports, imports, individuals, observations):
    c = spark.createDataFrame
    return (
        c(reports, "_id string, bold_animal string, loaded_at timestamp, target_id string"),
        c(imports, "run_id string, errors array<struct<resource:string,error:string>>, finished_at timestamp"),
        c(individuals, "_id string, loaded_at timestamp, deleted_at timestamp, bold_animal string"),
        c(observations, "_id string, loaded_at timestamp"),
        c([("t", "http://x/")], "prefix string, iri string"),
    )


def test_orphans_of_reports_and_imports(spark):
    reports = [
        ("p:1", "t:good", T(5), None), ("p:2", "t:none", T(5), None), ("p:2", "t:none", T(9), None), ("p:3", "t:late", T(5), None), ("p:3", "t:late", T(20), None),
        ("p:4", "t:gone", T(5), None), ("p:5", "t:gone", T(3), None), ("p:6", None, T(5), None), ("p:7", " ", T(5), None), ("p:8", "bare", T(5), None),
    ]
    errors = [("http://x/good", "e"), ("p:1", "e"), ("o:1", "e"), ("nobody:1", "e"), (None, "e"), ("unknown", "e"), ("", "e"), ("t:late", None)]
    imports = [("run1", errors, T(6)), ("run1", errors, T(6)), ("run2", [], T(6)), ("run3", None, T(6))]
    individuals = [("t:good", T(1), None, "x"), ("t:good", T(30), None, "x"), ("t:late", T(10), None, None), ("t:gone", T(1), T(4), None), (None, T(1), None, None)]
    observations = [("o:1", T(7)), ("o:1", T(8))]
    out = orphan_references(*tables(spark, reports, imports, individuals, observations))
    assert out.columns == ["ref_table", "record_id", "target_id", "reason", "ref_month"]
    assert sorted(tuple(r)[:4] for r in out.collect()) == sorted(
        [
            ("tracking_report", "p:2", "t:none", "missing"), ("tracking_report", "p:3", "t:late", "later"), ("tracking_report", "p:4", "t:gone", "deleted"), ("tracking_report", "p:8", "bare", "missing"),
            ("import_result", "run1", "o:1", "later"), ("import_result", "run1", "nobody:1", "missing"), ("import_result", "run1", "t:late", "later"),
        ]
    )
    assert orphan_counts(out).agg(F.sum("n_references")).first()[0] == 7


def test_ids_without_prefix_and_records_told_again(spark):
    reports = [("p:1", "bare", T(5), None), ("p:2", "none", T(5), None), ("p:3", "t:a", T(5), None), ("p:3", "t:late", T(20), None), ("bare:x", "t:a", T(2), None)]
    imports = [("run1", [("bare", "e"), ("plain", "e"), ("x", "e")], T(6))]
    individuals = [("bare", T(1), None, None), ("t:a", T(1), None, None), ("t:late", T(10), None, None)]
    out = orphan_references(*tables(spark, reports, imports, individuals, [("plain", T(1))]))
    # The report told again names an individual that was there by then, but not when the record was first seen.
    assert sorted(tuple(r)[1:4] for r in out.collect()) == [("p:2", "none", "missing"), ("p:3", "t:late", "later"), ("run1", "x", "missing")]


def test_empty_tables(spark):
    assert orphan_references(*tables(spark, [], [], [], [])).count() == 0
