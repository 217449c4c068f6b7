"""Queries of the operators that keep, change and read resources, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loamgraph import lift
from loamgraph.functions import display
from loamgraph.functions.jsonpath import path_values
from loamgraph.operators import documents, explore, hexcells, hierarchy, orphans, ranges, rdf, reasoning, roster, summary, windows
from loamgraph.operators.depictions import outline
from loamgraph.operators.ids import qname, read_context, split_qname
from loamgraph.operators.spatial import distinct_points
from loamgraph.plans.selector import aggregate
from loamgraph.queries.records import _EDGES, _ID, _POINTS, _WITHIN
from loamgraph.runtime import table
from loamgraph.sources import jsonld

_joined = lambda c: F.array_join(F.array_sort(c), ",")
CONTEXT = {**jsonld.DEFAULT_CONTEXT, "x": "http://example.org/x#", "c": "http://example.org/c#"}


def _doc(**fields):
    """A JSON document of columns; names are given as they are to be written."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _customers(s, d):
    return table(s, d, "customer")


def _customer_id():
    return F.concat(F.lit("c:"), "c_custkey")


def _deliveries(s, d, kind):
    """Customers delivered twice in one import: by name, and then with another name and only for odd keys a segment."""
    c = _customers(s, d)
    odd = F.col("c_custkey") % 2 == 1
    one = c.select(F.lit(0).alias("delivery"), F.col("c_custkey").alias("position"), _doc(**{"@id": _customer_id(), "@type": F.lit(kind), "x:name": F.col("c_name"), "x:tags": F.array(F.lit("old"), F.lit("both"))}).alias("value"))
    two = c.select(F.lit(1).alias("delivery"), F.col("c_custkey").alias("position"), _doc(**{"@id": F.concat(F.lit("http://example.org/c#"), "c_custkey"), "@type": F.lit(kind), "x:name": F.lower("c_name"), "x:segment": F.when(odd, F.col("c_mktsegment")), "x:tags": F.array(F.lit("both"), F.lit("new"))}).alias("value"))
    return two.unionByName(one).withColumns({"kind": F.lit("resource"), "partitions": F.array().cast("array<string>")})


def _imported(s, d, kind):
    out = jsonld.normalise(_deliveries(s, d, kind), CONTEXT, documents.Routing(default="people"))
    field = lambda name: F.get_json_object("doc", f"$['{name}']")
    return out.select("collection", "_id", field("x:name").alias("name"), field("x:segment").alias("segment"), _joined(F.from_json(field("x:tags"), "array<string>")).alias("tags"))


_IMPORT_SQL = "select '{kind}' collection, 'c:' || c_custkey _id, lower(c_name) \"name\", case when c_custkey % 2 = 1 then c_mktsegment end segment, '{tags}' tags from customer"


def _exported(s, d):
    """Customers exported as expanded JSON-LD, read back and compacted."""
    rows = _customers(s, d).select(F.lit("people").alias("collection"), _customer_id().alias("_id"), F.array(F.lit("x:Customer")).alias("types"), F.array().cast("array<string>").alias("partitions"), _doc(**{"_id": _customer_id(), "@type": F.array(F.lit("x:Customer")), "x:name": F.col("c_name"), "x:balance": F.col("c_acctbal")}).alias("doc"))
    lines = jsonld.export_documents(rows, CONTEXT, expanded=True)
    back = lines.select(F.lit(0).alias("delivery"), F.monotonically_increasing_id().alias("position"), F.lit("resource").alias("kind"), "value", F.array().cast("array<string>").alias("partitions"))
    out = jsonld.normalise(back, CONTEXT, documents.Routing(default="people"))
    return out.select("_id", F.get_json_object("doc", "$['x:name']").alias("name"), F.get_json_object("doc", "$['x:balance']").cast("double").alias("balance"))


def _stored(s, d, names):
    """(collection, _id, types, partitions, doc) of suppliers."""
    p = table(s, d, "supplier")
    id_ = F.concat(F.lit("x:s"), "s_suppkey")
    kind = F.array(F.concat(F.lit("x:N"), "s_nationkey"))
    return p.select(F.when(F.col("s_suppkey") % 3 == 0, "ontology").otherwise("people").alias("collection"), id_.alias("_id"), kind.alias("types"), F.array(F.lit("x:src")).alias("partitions"), _doc(**{"_id": id_, "@type": kind, "name": names, "tags": F.array(F.lit("a"))}).alias("doc"))


def _saved(s, d):
    """Suppliers saved again: in the ontology they merge with what is stored, elsewhere they replace it."""
    stored = _stored(s, d, F.col("s_name"))
    new = _stored(s, d, F.lower("s_name")).withColumn("doc", F.replace("doc", F.lit('["a"]'), F.lit('["b"]'))).withColumn("error", F.lit(None).cast("string"))
    out = jsonld.save(stored, new, share_tbox="shared")
    return out.select("collection", "_id", F.get_json_object("doc", "$.name").alias("name"), _joined(F.from_json(F.get_json_object("doc", "$.tags"), "array<string>")).alias("tags"))


def _nation_tbox(s, d):
    n = table(s, d, "nation")
    return n.select(F.concat(F.lit("x:N"), "n_nationkey").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.concat(F.lit("x:R"), "n_regionkey").alias("o"))


def _written_back(s, d, runs):
    """Suppliers with the classes that follow from their nation merged in; a second run writes nothing."""
    store = _stored(s, d, F.col("s_name"))
    written = None
    for _ in range(runs):
        inferred = reasoning.infer(rdf.json_triples(store), _nation_tbox(s, d))
        store, written = reasoning.merge_and_update(store, inferred, "now")
    return store, written


def _merge_and_update(s, d):
    return _written_back(s, d, 1)[0].select("_id", _joined(F.col("types")).alias("types"), F.get_json_object("doc", "$['bold:reasoned']").alias("stamp"))


def _rerun(s, d):
    first, second = _written_back(s, d, 1)[1], _written_back(s, d, 2)[1]
    return first.agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(1)).unionByName(second.agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(2)))


def _updated(s, d):
    store = _stored(s, d, F.col("s_name"))
    out, result = reasoning.update_one(store, "x:s1", {"name": "new", "tags": ["z"]}, "now", _nation_tbox(s, d), provenance="x:r")
    return out.select("_id", F.get_json_object("doc", "$.name").alias("name"), _joined(F.col("types")).alias("types"), F.coalesce(_joined(F.from_json(F.get_json_object("doc", "$.tags"), "array<string>")), F.lit("")).alias("tags")).withColumn("n_inferred", F.lit(result["inferred"]))


KINDS = (*documents.TBOX_TYPES, "owl:NamedIndividual", "owl:AllDifferent", "owl:DataRange", "owl:DeprecatedClass")


def _routing_types(s, d):
    """Parts as resources of all the ontology's types, and some that are none, by QName and IRI."""
    qnames = F.array(*[F.lit(k) for k in KINDS])
    prefixes = F.create_map(*[F.lit(x) for kv in documents.NAMESPACES.items() for x in kv])
    name = F.get(qnames, (F.col("p_partkey") % len(KINDS)).cast("int"))
    full = F.concat(F.try_element_at(prefixes, F.substring_index(name, ":", 1)), F.substring_index(name, ":", -1))
    rows = table(s, d, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("_id"), name.alias("type"), F.array(F.lit("x:Any"), F.when(F.col("p_size") % 2 == 0, full).otherwise(name)).alias("types"))
    return rows.select("type", documents.Routing(default="other").collection(F.col("_id"), F.col("types")).alias("collection")).groupBy("type", "collection").agg(F.count(F.lit(1)).alias("n"))


_TBOX_SQL = "owl:Class rdfs:Class rdfs:Datatype owl:ObjectProperty owl:DatatypeProperty owl:AnnotationProperty rdf:Property owl:Ontology owl:Restriction owl:FunctionalProperty owl:InverseFunctionalProperty owl:AllDisjointClasses owl:AllDisjointProperties owl:TransitiveProperty owl:SymmetricProperty owl:AsymmetricProperty owl:ReflexiveProperty owl:IrreflexiveProperty".split()


def _array_window(s, d):
    """Events of two users each, many of them without an id of their own."""
    e = lift.event_documents(s, d)
    k = F.regexp_extract("_id", "[0-9]+", 0).cast("bigint")
    other = F.concat(F.lit("user:"), k % 160)
    rows = e.select(F.when(k % 4 > 0, F.concat(F.lit("e"), k % 50)).alias("_id"), F.when(k % 7 > 0, F.array("group_id", other)).alias("groups"), "when_ms")
    return windows.windowed(rows, "groups", "when_ms", None, lift.customer_bounds(s, d))


def _parsed_bounds(s, d):
    c = _customers(s, d)
    day = lambda n: F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), (F.col("c_custkey") % n).cast("int")), "yyyy-MM-dd")
    rows = c.select(_customer_id().alias("_id"), F.when(F.col("c_custkey") % 2 == 0, day(20)).alias("s"), F.when(F.col("c_custkey") % 3 == 0, day(31)).when(F.col("c_custkey") % 3 == 1, F.concat(day(31), F.lit("T10:00:00Z"))).alias("e"))
    return windows.parse_bounds(rows, "_id", "s", "e").na.fill(-1)


def _partial(s, d, match):
    """The animals that reports name, as prefix and local part, matched on the parts that they have."""
    ctx = read_context(table(s, d, "jsonld_context"))
    named = table(s, d, "tracking_report").select(qname(F.col("bold_animal"), ctx).alias("target_id")).where("length(target_id) > 0").distinct()
    ns, local = split_qname(F.col("target_id"))
    refs = named.select("target_id", ns.alias("ns"), local.alias("local"))
    ns, local = split_qname(F.col("_id"))
    keys = table(s, d, "individual").select(ns.alias("ns"), local.alias("local"), "loaded_at")
    return orphans.resolve_references(refs, ["ns", "local"], keys, ["ns", "local"], match, {"first_loaded": orphans.fact(F.min, "loaded_at")}).select("target_id", "found", F.coalesce(F.unix_micros(F.col("first_loaded").cast("timestamp")), F.lit(-1)).alias("first_us"))


_PARTS_SQL = _ID % "select distinct bold_animal raw from tracking_report where bold_animal is not null"


def _facets(s, d):
    out = aggregate(table(s, d, "orders"), [{"$match": {"o_totalprice": {"$gte": 1000}}}, {"$facet": {"status": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}], "priority": [{"$group": {"_id": "$o_orderpriority", "n": {"$sum": 1}}}]}}])
    return out["status"].withColumn("facet", F.lit("status")).unionByName(out["priority"].withColumn("facet", F.lit("priority")))


def _sets(s, d):
    out = aggregate(_customers(s, d), [{"$group": {"_id": "$c_mktsegment", "nations": {"$addToSet": "$c_nationkey"}, "keys": {"$push": "$c_custkey"}}}])
    return out.select("_id", F.array_join("nations", ",").alias("nations"), F.size("keys").alias("n_keys"), F.array_join(F.array_sort("keys"), ",").alias("keys"))


def _lookup(s, d):
    """Ids of orders' customers looked up among customers, suppliers and parts."""
    named = lambda t, k, c: table(s, d, t).select(F.concat(F.lit("x:"), k).alias("_id"), F.col(c).alias("name"))
    ids = table(s, d, "orders").select(F.concat(F.lit("x:"), "o_custkey").alias("_id"))
    found = documents.lookup(ids, {"suppliers": named("supplier", "s_suppkey", "s_name"), "parts": named("part", "p_partkey", "p_name"), "customers": named("customer", "c_custkey", "c_name")}, documents.Routing(id_patterns={"5$": "customers"}))
    return found.select("_id", "collection", "name")


def _fact_lines(s, d):
    p = table(s, d, "supplier")
    i = p.select(F.concat(F.lit("I(x:s"), "s_suppkey", F.lit(", rdf:type, x:N"), "s_nationkey", F.lit(")")).alias("value"))
    e = p.select(F.concat(F.lit("E(x:s"), "s_suppkey", F.lit(', rdfs:label, "'), "s_name", F.lit('"@en)')).alias("value"))
    bad = p.select(F.concat(F.lit('I("lit", p, '), "s_suppkey", F.lit(")")).alias("value")).unionByName(p.select(F.concat(F.lit("(x, y, z"), "s_suppkey").alias("value")))
    return rdf.parse_facts(i.unionByName(e).unionByName(bad))


def _cyclic_edges(s, d):
    """The hierarchy of customers, with a ring of all regions above the nations."""
    ring = table(s, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("child"), F.concat(F.lit("region:"), (F.col("r_regionkey") + 1) % 5).alias("parent"))
    return lift.class_edges(s, d).unionByName(ring)


def _tbox(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    kind = F.array(F.lit("owl:Class"))
    one = n.select(F.concat(F.lit("x:N"), "n_nationkey").alias("_id"), kind.alias("types"), F.array(F.concat(F.lit("x:R"), "n_regionkey"), F.lit("x:World")).alias("parents"), F.lit(None).cast("array<string>").alias("domain"))
    two = r.select(F.concat(F.lit("x:R"), "r_regionkey").alias("_id"), kind.alias("types"), F.array(F.lit("x:World")).alias("parents"), F.lit(None).cast("array<string>").alias("domain"))
    top = r.select(F.lit("x:World").alias("_id"), kind.alias("types"), F.lit(None).cast("array<string>").alias("parents"), F.lit(None).cast("array<string>").alias("domain")).distinct()
    props = n.select(F.concat(F.lit("x:p"), "n_nationkey").alias("_id"), F.array(F.lit("owl:DatatypeProperty"), F.when(F.col("n_nationkey") % 2 == 0, "owl:ObjectProperty").otherwise("x:Other")).alias("types"), F.lit(None).cast("array<string>").alias("parents"), F.when(F.col("n_nationkey") > 4, F.array(F.concat(F.lit("x:R"), "n_regionkey"))).alias("domain"))
    return one.unionByName(two).unionByName(top).unionByName(props)


_TRADE = [("x:near", "rdf:type", "owl:SymmetricProperty"), ("x:in", "rdf:type", "owl:TransitiveProperty"), ("x:Home", "owl:onProperty", "x:in"), ("x:Home", "owl:allValuesFrom", "x:Place"), ("x:Both", "owl:intersectionOf", "x:Place"), ("x:Both", "owl:intersectionOf", "x:Near"), ("x:Any", "owl:unionOf", "x:Near"), ("x:near", "rdfs:domain", "x:Near"), ("x:near", "rdfs:range", "x:Near"), ("x:in", "owl:inverseOf", "x:has"), ("x:near", "rdfs:subPropertyOf", "x:about"), ("x:Near", "rdfs:subClassOf", "x:Thing")]


def _all_rules(s, d):
    """Nations in regions in a world, each next to the one of the next number: an instance of every rule."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    tri = lambda df, a, p, b: df.select(a.alias("s"), F.lit(p).alias("p"), b.alias("o"))
    nation = lambda k: F.concat(F.lit("n:"), k)
    abox = tri(n, nation(F.col("n_nationkey")), "x:in", F.concat(F.lit("r:"), "n_regionkey")).unionByName(tri(r, F.concat(F.lit("r:"), "r_regionkey"), "x:in", F.lit("w:0")))
    abox = abox.unionByName(tri(n.where("n_nationkey < 24"), nation(F.col("n_nationkey")), "x:near", nation(F.col("n_nationkey") + 1))).unionByName(tri(n, nation(F.col("n_nationkey")), "rdf:type", F.lit("x:Home"))).unionByName(tri(n, nation(F.col("n_nationkey")), "rdf:type", F.lit("x:Place")))
    return reasoning.infer(abox, s.createDataFrame(_TRADE, "s string, p string, o string")).select("s", "p", "o")


_ALL_RULES_SQL = """with n as (select n_nationkey k, n_regionkey r, 'n:' || n_nationkey me from nation), near as (select me a, 'n:' || (k + 1) b from n where k < 24), both_ways as (select a, b from near union select b, a from near)
  select me s, 'x:in' p, 'w:0' o from n union select o, 'x:has', s from (select me s, 'r:' || r o from n union select 'r:' || r_regionkey, 'w:0' from region union select me, 'w:0' from n)
  union select b, 'x:near', a from near union select a, 'x:about', b from both_ways union select me, 'rdf:type', unnest(['x:Near', 'x:Thing', 'x:Any', 'x:Both']) from n
  union select 'r:' || r_regionkey, 'rdf:type', 'x:Place' from region union select 'w:0', 'rdf:type', 'x:Place'"""


def _inconsistent(s, d):
    """Customers that are of two segments by their number, know themselves, or know each other one way only."""
    c = _customers(s, d)
    me, k = _customer_id(), F.col("c_custkey")
    tri = lambda df, p, o: df.select(me.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    rows = tri(c, "rdf:type", F.concat(F.lit("x:"), "c_mktsegment")).unionByName(tri(c, "rdf:type", F.when(k % 10 == 0, "x:BUILDING").when(k % 10 == 1, "x:MACHINERY").otherwise("x:Any")))
    rows = rows.unionByName(tri(c, "x:knows", F.concat(F.lit("c:"), F.when(k % 20 == 0, k).otherwise(k + 1)))).unionByName(tri(c, "x:leads", F.concat(F.lit("c:"), F.when(k % 30 == 1, k - 1).otherwise(k + 1)))).unionByName(tri(c, "x:likes", F.lit("c:7"))).unionByName(tri(c, "x:hates", F.concat(F.lit("c:"), k % 9)))
    tbox = [("x:BUILDING", "owl:disjointWith", "x:MACHINERY"), ("ax", "rdf:type", "owl:AllDisjointClasses"), *(("ax", "owl:members", f"x:{m}") for m in ("AUTOMOBILE", "BUILDING", "FURNITURE")), ("x:knows", "rdf:type", "owl:IrreflexiveProperty"), ("x:leads", "rdf:type", "owl:AsymmetricProperty"), ("x:likes", "owl:propertyDisjointWith", "x:hates")]
    return reasoning.inconsistencies(rows, s.createDataFrame(tbox, "s string, p string, o string"))


_INCONSISTENT_SQL = """with c as (select 'c:' || c_custkey me, c_custkey k, 'x:' || c_mktsegment g, case when c_custkey % 10 = 0 then 'x:BUILDING' when c_custkey % 10 = 1 then 'x:MACHINERY' else 'x:Any' end h from customer),
  t as (select me, g from c union select me, h from c), leads as (select me a, 'c:' || case when k % 30 = 1 then k - 1 else k + 1 end b from c)
  select me s, 'cax-dw' rule, 'x:BUILDING|x:MACHINERY' detail from t where g in ('x:BUILDING', 'x:MACHINERY') group by me having count(distinct g) = 2
  union all select me, 'cax-adc', array_to_string(list_sort(list(distinct g)), '|') from t where g in ('x:AUTOMOBILE', 'x:BUILDING', 'x:FURNITURE') group by me having count(distinct g) > 1
  union all select me, 'prp-irp', 'x:knows' from c where k % 20 = 0
  union all select distinct l.a, 'prp-asyp', 'x:leads|' || l.b from leads l join leads m on l.a = m.b and l.b = m.a
  union all select me, 'prp-pdw', 'x:hates|x:likes|c:7' from c where k % 9 = 7"""


def _labels(s, d):
    c = _customers(s, d)
    kind = F.array(F.concat(F.lit("x:"), "c_mktsegment"))
    k = F.col("c_custkey")
    rows = c.select(_customer_id().alias("_id"), kind.alias("types"), _doc(**{"_id": _customer_id(), "rdfs:label": F.when(k % 3 > 0, F.array(F.col("c_name"), F.lit("other"))), "x:nick": F.when(k % 2 == 0, F.concat(F.lit("nick "), k)), "rdfs:comment": F.when(k % 5 == 0, F.lit("a comment"))}).alias("doc"))
    settings = s.createDataFrame([("x:BUILDING", None, ["x:nick"], None), ("x:MACHINERY", "Machine", None, ["x:d"])], "class string, label string, label_properties array<string>, description_properties array<string>")
    kinds = s.createDataFrame([("x:FURNITURE", "Furniture")], "class string, label string")
    return display.resource_labels(rows, settings, kinds)


def _report(s, d, what):
    e = lift.event_documents(s, d)
    data = hexcells.add_cells(e, "lat", "lng")
    people = _customers(s, d).select(F.concat(F.lit("user:"), "c_custkey").alias("_id"), F.col("c_name").alias("name"))
    others = table(s, d, "supplier").select(F.concat(F.lit("user:"), "s_suppkey").alias("_id"), F.col("s_name").alias("name"))
    out = roster.group_report([roster.Source(data.where("value < 50"), others), roster.Source(data.where("value >= 50"), people)], "group_id", "when_ms", lat="lat", lng="lng", max_cells=10_000_000)
    return out.resources.select("_id", "name") if what == "resources" else out.summary.select("group_id", "first_ms", "last_ms", "n", F.round("last_lat", 6).alias("last_lat"), F.round("last_lng", 6).alias("last_lng"))


def _buckets(s, d):
    e = lift.event_documents(s, d).where("value > 0").withColumn("kind", F.element_at("at_type", 1))
    return summary.time_buckets(e, ["group_id", "kind"], "when_ms", empty=True).groupBy("kind", "bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_buckets"), F.count_if(F.col("min_ms").isNull()).alias("n_empty"))


def _instances(s, d):
    c = _customers(s, d).select(_customer_id().alias("_id"), F.array(F.concat(F.lit("x:N"), "c_nationkey")).alias("types"), _doc(**{"_id": _customer_id(), "name": F.col("c_name"), "rich": F.when(F.col("c_acctbal") > 5000, F.lit(True))}).alias("doc"))
    edges = _nation_tbox(s, d).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    return explore.instances(c, edges)


def _usage(s, d):
    c = _customers(s, d).select(F.array(F.concat(F.lit("x:"), "c_mktsegment")).alias("types"), _doc(**{"_id": _customer_id(), "x:name": F.col("c_name"), "x:rich": F.when(F.col("c_acctbal") > 5000, F.lit(True))}).alias("doc"))
    defs = s.createDataFrame([("x:name", "xsd:string")], "_id string, range string")
    return explore.property_usage(c, defs)


def _outcomes(s, d):
    c = _customers(s, d).select(_customer_id().alias("_id"), F.when(F.col("c_custkey") % 2 == 0, "old").alias("shape"))
    hulls = table(s, d, "part").select(F.concat(F.lit("c:"), "p_partkey").alias("group_id"), F.when(F.col("p_partkey") % 4 == 0, "old").when(F.col("p_partkey") % 4 < 3, "new").alias("ring")).where("ring is not null")
    out, told = ranges.update_ranges(c, hulls, "_id", "shape")
    return told.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).unionByName(out.groupBy(F.concat(F.lit("shape "), F.coalesce("shape", F.lit("none"))).alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


def _outlined(s, d):
    points = distinct_points(table(s, d, "observation"), "_id", "geo_lat", "geo_long", "loaded_at")
    return outline(points, table(s, d, "study_region"), "_id", "bold_spatialdepiction")


def _folded(s, d):
    """Deliveries of the orders of each customer as one resource: lists unite, of single values the last stays."""
    o = table(s, d, "orders").select(F.concat(F.lit("c:"), "o_custkey").alias("_id"), F.col("o_orderkey").alias("at"), _doc(**{"_id": F.concat(F.lit("c:"), "o_custkey"), "status": F.array("o_orderstatus"), "last": F.col("o_orderkey")}).alias("doc"))
    return documents.merge_json(o, "_id", "doc", "at").select("_id", _joined(F.from_json(F.get_json_object("doc", "$.status"), "array<string>")).alias("status"), F.get_json_object("doc", "$.last").cast("bigint").alias("last"))


def _statements(s, d):
    facts = table(s, d, "supplier").select(F.concat(F.lit("x:s"), "s_suppkey").alias("subject"), F.when(F.col("s_suppkey") % 2 == 0, "x:in").otherwise("x:of").alias("predicate"), F.concat(F.lit("x:N"), "s_nationkey").alias("object"), F.lit("prp-dom").alias("rule"), F.lit(None).cast("string").alias("inferred_from"))
    out = rdf.statements(facts, None, "x:r", 5, meta={"*": {"bold:scope": "all"}, "x:in": {"bold:scope": "place", "note": "n"}})
    doc = _doc(**{"rdf:subject": F.struct(F.col("subject").alias("@id")), "rdf:predicate": F.col("predicate"), "rdf:object": F.col("object"), "bold:provenance": F.col("provenance")})
    return out.select("subject", "predicate", "object", "rule", F.element_at("meta", "bold:scope").alias("scope"), F.try_element_at("meta", F.lit("note")).alias("note"), (F.col("_id") == rdf.statement_id_of(doc)).alias("same_id"))


def _written_dates(s, d):
    o = table(s, d, "orders")
    ts = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd")).when(k == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 2, F.to_json(F.struct(F.date_format(ts, "yyyy-MM-dd").alias("@value")))).otherwise("never")
    return o.select("o_orderkey", display.format_text_date(text).alias("day"))


def _import_counts(s, d):
    rows = _deliveries(s, d, "owl:Class").unionByName(_deliveries(s, d, "x:Person").withColumn("value", F.replace("value", F.lit("/c#"), F.lit("/x#"))))
    nameless = _deliveries(s, d, "x:P").withColumn("value", F.lit('{"x:name":1}'))
    return jsonld.import_stats(jsonld.normalise(rows.unionByName(nameless), CONTEXT, documents.Routing(default="people")))


def queries() -> dict:
    return {
        "import_replace": lambda s, d: _imported(s, d, "x:Person"),
        "import_merge": lambda s, d: _imported(s, d, "owl:Class"),
        "import_counts": _import_counts,
        "export_import": _exported,
        "save_resources": _saved,
        "merge_and_update": _merge_and_update,
        "merge_and_update_again": _rerun,
        "update_one": _updated,
        "merge_json": _folded,
        "routing_types": _routing_types,
        "window_bounds_array": _array_window,
        "window_parse_bounds": _parsed_bounds,
        "p1_partial": lambda s, d: _partial(s, d, "partial"),
        "p1_simple": lambda s, d: _partial(s, d, "simple"),
        "pipeline_facet": _facets,
        "pipeline_sets": _sets,
        "lookup": _lookup,
        "parse_facts": _fact_lines,
        "class_depth_cycles": lambda s, d: hierarchy.depths(_cyclic_edges(s, d)),
        "class_order": lambda s, d: hierarchy.class_order(lift.class_edges(s, d)),
        "explore_classes": lambda s, d: explore.classes(_tbox(s, d)).select("class", "depth", "parents"),
        "explore_properties": lambda s, d: explore.properties(_tbox(s, d)),
        "explore_instances": _instances,
        "explore_usage": _usage,
        "infer_all_rules": _all_rules,
        "inconsistencies": _inconsistent,
        "resource_labels": _labels,
        "individual_labels": lambda s, d: display.labels_of_ids(table(s, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey") * 2).alias("_id")), _customers(s, d).select(_customer_id().alias("_id"), F.col("c_name").alias("label"))),
        "group_resources": lambda s, d: display.grouped(table(s, d, "part"), F.col("p_size") % 5).groupBy("group_id").agg(F.count(F.lit(1)).alias("n")),
        "group_report": lambda s, d: _report(s, d, "summary"),
        "group_report_roster": lambda s, d: _report(s, d, "resources"),
        "cell_time_buckets_all": _buckets,
        "cell_backfill_counts": lambda s, d: hexcells.backfill_counts(table(s, d, "tracking_report"), "geo_lat", "geo_long"),
        "add_cells": lambda s, d: hexcells.add_cells(table(s, d, "observation").select("_id", "geo_lat", "geo_long"), "geo_lat", "geo_long").groupBy("_h3_5").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_h3_9").alias("n_cells")),
        "cell_centroids": lambda s, d: hexcells.cell_centroids(table(s, d, "tracking_report"), "_h3_7"),
        "range_outcomes": _outcomes,
        "outline": _outlined,
        "statement_metadata": _statements,
        "format_text_date": _written_dates,
        "json_paths": lambda s, d: table(s, d, "orders").select("o_orderkey", F.array_join(path_values(F.to_json(F.struct(F.struct(F.col("o_custkey").alias("id"), F.array("o_orderkey", "o_custkey").alias("ks")).alias("a"))), "$.a.ks[*]"), ",").alias("ks")),
        "embedded_types": lambda s, d: jsonld.embedded(_customers(s, d).select(_customer_id().alias("_id"), _doc(**{"_id": _customer_id(), "x:home": F.struct(F.concat(F.lit("x:N"), "c_nationkey").alias("@type"), F.array(F.struct(F.lit("x:In").alias("@type"))).alias("x:in"))}).alias("doc"))).groupBy("type").agg(F.count(F.lit(1)).alias("n")),
    }


def oracle_sql() -> dict[str, str]:
    ev = lift.EVENTS_SQL
    kinds = json.dumps(list(KINDS)).replace('"', "'")
    routed = json.dumps(_TBOX_SQL).replace('"', "'")
    parts = f"names as (select distinct id target_id, case when instr(id, ':') > 1 then split_part(id, ':', 1) end ns, nullif(case when instr(id, ':') > 1 then substr(id, instr(id, ':') + 1) else id end, '') l from ({_PARTS_SQL}) where id <> ''), keys as (select case when instr(_id, ':') > 1 then split_part(_id, ':', 1) end ns, nullif(case when instr(_id, ':') > 1 then substr(_id, instr(_id, ':') + 1) else _id end, '') l, epoch_us(loaded_at) t from individual)"
    found = "count(keys.t) > 0 found, coalesce(min(keys.t), -1) first_us"
    return {
        "import_replace": _IMPORT_SQL.format(kind="people", tags="both,new"),
        "import_merge": _IMPORT_SQL.format(kind="ontology", tags="both,new,old"),
        "import_counts": "select 5 * n total, 3 * n processed, 2 * n errors, n tbox, 0 statements, 2 * n abox from (select count(*) n from customer)",
        "export_import": "select 'c:' || c_custkey _id, c_name \"name\", c_acctbal balance from customer",
        "save_resources": "with p as (select *, 'x:s' || s_suppkey _id from supplier) select case when s_suppkey % 3 = 0 then 'ontology' else 'people' end collection, _id, lower(s_name) \"name\", case when s_suppkey % 3 = 0 then 'a,b' else 'b' end tags from p union all select 'shared', _id, lower(s_name), 'b' from p where s_suppkey % 3 = 0",
        "merge_and_update": "select 'x:s' || s_suppkey _id, 'x:N' || n_nationkey || ',x:R' || n_regionkey types, 'now' stamp from supplier join nation on s_nationkey = n_nationkey",
        "merge_and_update_again": "select count(*) n, 1 run from supplier union all select 0, 2",
        "update_one": "select 'x:s' || s_suppkey _id, case when s_suppkey = 1 then 'new' else s_name end \"name\", 'x:N' || n_nationkey || case when s_suppkey = 1 then ',x:R' || n_regionkey else '' end types, case when s_suppkey = 1 then 'a,z' else 'a' end tags, 1 n_inferred from supplier join nation on s_nationkey = n_nationkey",
        "merge_json": "select 'c:' || o_custkey _id, array_to_string(list_sort(list(distinct o_orderstatus)), ',') status, max(o_orderkey) \"last\" from orders group by o_custkey",
        "routing_types": f"with k as (select ({kinds})[p_partkey % {len(KINDS)} + 1] type from part) select type, case when list_contains({routed}, type) then 'ontology' else 'other' end collection, count(*) n from k group by 1",
        "window_bounds_array": f"with {lift.BOUNDS_SQL}, e as (select regexp_extract(_id, '[0-9]+')::bigint k, group_id, when_ms from {ev}), r as (select k, case when k % 4 > 0 then 'e' || k % 50 end _id, case when k % 7 > 0 then [group_id, 'user:' || k % 160] end \"groups\", when_ms from e) "
        "select _id, \"groups\", when_ms from r where \"groups\" is null or not exists (select 1 from bounds where list_contains(\"groups\", who)) or exists (select 1 from bounds where list_contains(\"groups\", who) and (s is null or when_ms >= s) and (e is null or when_ms <= e) and (x is null or when_ms < x))",
        "window_parse_bounds": "with d as (select 'c:' || c_custkey individual_id, c_custkey k, date '2024-03-01' + (c_custkey % 20)::int s, date '2024-03-01' + (c_custkey % 31)::int e from customer), z as (select individual_id, case when k % 2 = 0 then epoch_ms(timezone('America/Los_Angeles', s::timestamp)) end start_ms, case when k % 3 = 1 then epoch_ms(e::timestamp + interval 10 hour) end end_ms, case when k % 3 = 0 then epoch_ms(timezone('America/Los_Angeles', (e + 1)::timestamp)) end end_before_ms from d) select individual_id, coalesce(start_ms, -1) start_ms, coalesce(end_ms, -1) end_ms, coalesce(end_before_ms, -1) end_before_ms from z where start_ms is not null or end_ms is not null or end_before_ms is not null",
        "p1_partial": f"with {parts} select target_id, {found} from names left join keys on (names.ns is null or names.ns = keys.ns) and (names.l is null or names.l = keys.l) group by target_id",
        "p1_simple": f"with {parts} select target_id, case when names.ns is not null and names.l is not null then count(keys.t) > 0 end found, coalesce(min(keys.t), -1) first_us from names left join keys on names.ns = keys.ns and names.l = keys.l group by target_id, names.ns, names.l",
        "pipeline_facet": "select 'status' facet, o_orderstatus _id, count(*) n from orders where o_totalprice >= 1000 group by 2 union all select 'priority', o_orderpriority, count(*) from orders where o_totalprice >= 1000 group by 2",
        "pipeline_sets": "select c_mktsegment _id, array_to_string(list_sort(list(distinct c_nationkey)), ',') nations, count(*)::int n_keys, array_to_string(list_sort(list(c_custkey)), ',') keys from customer group by 1",
        "lookup": "with ids as (select distinct o_custkey k from orders) select 'x:' || k _id, case when k % 10 = 5 then 'customers' when s_suppkey is not null then 'suppliers' when p_partkey is not null then 'parts' else 'customers' end collection, case when k % 10 = 5 then c_name when s_suppkey is not null then s_name when p_partkey is not null then p_name else c_name end \"name\" from ids left join supplier on k = s_suppkey left join part on k = p_partkey left join customer on k = c_custkey",
        "parse_facts": "select 'x:s' || s_suppkey subject, 'rdf:type' predicate, 'x:N' || s_nationkey \"object\", false explicit from supplier union all select 'x:s' || s_suppkey, 'rdfs:label', s_name, true from supplier",
        "class_depth_cycles": "select 'x:World' node, 0 \"depth\" union all select 'region:' || r_regionkey, 1 from region union all select 'nation:' || n_nationkey, 2 from nation union all select 'customer:' || c_custkey, 3 from customer",
        "class_order": "with d as (select 'x:World' node, 0 \"depth\" union all select 'region:' || r_regionkey, 1 from region union all select 'nation:' || n_nationkey, 2 from nation union all select 'customer:' || c_custkey, 3 from customer) select *, row_number() over (order by \"depth\", node) rank from d",
        "explore_classes": "select 'x:N' || n_nationkey class, 2 \"depth\", 'x:R' || n_regionkey parents from nation union all select 'x:R' || r_regionkey, 1, 'x:World' from region union all select 'x:World', 0, ''",
        "explore_properties": "select 'x:p' || n_nationkey property, case when n_nationkey % 2 = 0 then 'owl:ObjectProperty' else 'owl:DatatypeProperty' end kind, case when n_nationkey > 4 then 'x:R' || n_regionkey end \"domain\" from nation",
        "explore_instances": "with c as (select c.*, unnest(['x:N' || n_nationkey, 'x:R' || n_regionkey]) type from customer c join nation on c_nationkey = n_nationkey), t as (select type, count(*) n_resources, count(*) filter (c_acctbal > 5000) rich from c group by 1) select type, 'name' property, n_resources n, n_resources from t union all select type, 'rich', rich, n_resources from t where rich > 0",
        "explore_usage": "select 'x:' || c_mktsegment type, 'x:name' property, count(*) n, 'xsd:string' \"range\" from customer group by 1 union all select 'x:' || c_mktsegment, 'x:rich', count(*), 'No ontology definition found' from customer where c_acctbal > 5000 group by 1",
        "infer_all_rules": _ALL_RULES_SQL,
        "inconsistencies": _INCONSISTENT_SQL,
        "resource_labels": "with c as (select 'c:' || c_custkey _id, c_custkey k, c_name, c_mktsegment g from customer) select _id, case when g = 'MACHINERY' then 'Machine' when g = 'BUILDING' and k % 2 = 0 then 'nick ' || k when k % 3 > 0 then c_name when g = 'FURNITURE' then 'Furniture ' || k else k::varchar end \"label\", case when g = 'BUILDING' and k % 2 = 0 then 'x:nick' else 'rdfs:label' end label_property, case when k % 5 = 0 and g <> 'MACHINERY' then 'a comment' else '' end description, case when g = 'MACHINERY' then 'x:d' else 'rdfs:comment' end description_property from c",
        "individual_labels": "select distinct 'c:' || o_custkey * 2 _id, coalesce(c_name, 'c:' || o_custkey * 2) \"label\" from orders left join customer on c_custkey = o_custkey * 2",
        "group_resources": "select case when p_size % 5 > 0 then (p_size % 5)::varchar end group_id, count(*) n from part group by 1",
        "group_report": f"select group_id, min(when_ms) first_ms, max(when_ms) last_ms, count(*) n, round(max_by(lat, (when_ms, lat, lng)), 6) last_lat, round(max_by(lng, (when_ms, lat, lng)), 6) last_lng from {ev} where value is not null group by 1",
        "group_report_roster": f"with g as (select distinct group_id from {ev} where value is not null) select group_id _id, coalesce(s_name, c_name) \"name\" from g left join supplier on group_id = 'user:' || s_suppkey left join customer on group_id = 'user:' || c_custkey where coalesce(s_name, c_name) is not null",
        "cell_time_buckets_all": f"with v as (select group_id, at_type[1] kind, when_ms t from {ev} where value > 0), b as (select group_id, kind, min(t) lo, max(t) hi from v group by 1, 2), slots as (select group_id, kind, unnest(range(0, case when lo < hi then 16 else 1 end))::int bucket from b), held as (select group_id, kind, (case when hi <= lo then 0 when t >= hi then 15 else greatest(0, least(15, floor((t - lo) / ((hi - lo) / 16.0)))) end)::int bucket, count(*) n from v join b using (group_id, kind) group by 1, 2, 3) select kind, bucket, sum(coalesce(n, 0))::bigint n, count(*) n_buckets, count(*) filter (n is null) n_empty from slots left join held using (group_id, kind, bucket) group by 1, 2",
        "cell_backfill_counts": "with r as (select geo_lat::varchar || ' ' || geo_long::varchar v from tracking_report) select count(*) filter (v not like '%nan%') updated, count(*) filter (v like '%nan%') skipped from r where v is not null",
        "range_outcomes": "with j as (select c_custkey k, p_partkey p, case when c_custkey % 2 = 0 then 'old' end had, case when p_partkey % 4 = 0 then 'old' when p_partkey % 4 < 3 then 'new' end ring from customer full join (select * from part where p_partkey % 4 <> 3) on c_custkey = p_partkey), o as (select *, case when k is null then 'unmatched' when ring is not distinct from had then 'kept' when ring is null then 'unset' else 'set' end outcome from j) select outcome, count(*) n from o group by 1 union all select 'shape ' || coalesce(ring, 'none'), count(*) from o where k is not null group by 1",
        "outline": f"with {_POINTS}, {_EDGES}, held as ({_WITHIN}) select left_id id, min(right_id) region from held group by 1",
        "statement_metadata": "select 'x:s' || s_suppkey subject, case when s_suppkey % 2 = 0 then 'x:in' else 'x:of' end predicate, 'x:N' || s_nationkey \"object\", 'prp-dom' rule, case when s_suppkey % 2 = 0 then 'place' else 'all' end scope, case when s_suppkey % 2 = 0 then 'n' end note, true same_id from supplier",
        "format_text_date": "select o_orderkey, case o_orderkey % 4 when 3 then '' when 1 then strftime(timezone('America/Los_Angeles', timezone('UTC', date_trunc('second', o_orderdate))), '%-m/%-d/%Y') else strftime(o_orderdate, '%-m/%-d/%Y') end \"day\" from orders",
        "json_paths": "select o_orderkey, o_orderkey || ',' || o_custkey ks from orders",
        "embedded_types": "select 'x:N' || c_nationkey type, count(*) n from customer group by 1 union all select 'x:In', count(*) from customer",
    }
