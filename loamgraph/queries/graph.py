"""Queries of the document, graph and geo operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgraph import lift
from loamgraph.functions import cells, display
from loamgraph.functions.jsonpath import path_values
from loamgraph.operators import documents, hexcells, hierarchy, ranges, rdf, reasoning, regions, roster, summary, windows
from loamgraph.operators.ids import qname, read_context
from loamgraph.operators.spatial import position_counts
from loamgraph.plans.selector import aggregate, find
from loamgraph.queries.records import _EDGES, _ID
from loamgraph.runtime import table

SHAPE = "bold_spatialdepiction"
COLLECTIONS = ("tracking_report", "individual", "observation", "study_region")
CUTOFF_MS = 1705622400000  # 2024-01-19
GEO = "geo_lat", "geo_long"


def _t(name):
    return lambda s, d: table(s, d, name)


_reports, _orders, _customers, _regions = _t("tracking_report"), _t("orders"), _t("customer"), _t("study_region")
_sorted_join = lambda c: F.array_join(F.array_sort(c), ",")


def _rounded(name):
    """Six digits; the push settles averages that lie half way between two."""
    return F.round(F.col(name) + 1e-9, 6).alias(name)


def _located(df):
    if "geo_lat" in df.columns:
        return F.col("geo_lat").isNotNull() | F.col("geo_long").isNotNull()
    return F.col("bold_spatialdepiction").isNotNull() if "bold_spatialdepiction" in df.columns else F.lit(False)


def _type_counts(s, d, by_collection):
    return summary.type_counts({n: table(s, d, n) for n in COLLECTIONS}, located=_located, by_collection=by_collection)


_LOCATED = {"tracking_report": "geo_lat is not null or geo_long is not null", "observation": "geo_lat is not null or geo_long is not null", "study_region": "bold_spatialdepiction is not null", "individual": "false"}
_TYPES_SQL = "(" + " union all ".join(f"select '{n}' collection, unnest(list_distinct(at_type)) type, ({_LOCATED[n]}) located from {n}" for n in COLLECTIONS) + ")"

_CELL7 = "_h3_7"  # resolved in each query, as a Column needs a running session


def _summary(s, d):
    out = summary.group_summary(_reports(s, d), "bold_animal", "_when_ms", F.col(_CELL7))
    return out.select("group_id", "first_ms", "last_ms", "n", _sorted_join(F.col("cells")).alias("cells"))


def _event_summary(s, d):
    e = lift.event_documents(s, d)
    out = summary.group_summary(e, "group_id", "when_ms", lift.square_cell(F.col("lat"), F.col("lng"), 5.0), "lat", "lng")
    return out.select("group_id", "first_ms", "last_ms", "n", F.size("cells").alias("n_cells"), F.round("last_lat", 6).alias("last_lat"), F.round("last_lng", 6).alias("last_lng"))


def _merged(s, d):
    r = _reports(s, d)
    one = summary.group_summary(r, "bold_animal", "_when_ms", F.col(_CELL7))
    two = summary.group_summary(table(s, d, "observation").select(F.element_at("at_type", 1).alias("bold_animal"), "_when_ms", "_h3_7"), "bold_animal", "_when_ms", F.col(_CELL7))
    return summary.merge_summaries(one, two).select("group_id", "first_ms", "last_ms", "n", F.size("cells").alias("n_cells"))


_SUMMARY_SQL = "select bold_animal group_id, min(_when_ms) first_ms, max(_when_ms) last_ms, count(*) n, {cells} from {rows} where bold_animal <> '' group by 1"


def _parents(s, d):
    r = _reports(s, d).where("_h3_7 is not null").select(F.col("_h3_7").alias("c")).distinct()
    return r.select("c", *[cells.cell_parent(F.col("c"), k).alias(f"p{k}") for k in (5, 3)])


_PARENT = lambda r: f"case when regexp_matches(c, '^0?[0-9a-f]{{15}}$') and ((('0x' || c)::bigint >> 52) & 15) >= {r} then printf('%x', (('0x' || c)::bigint & {~(15 << 52)}) | {(r << 52) | ((1 << 3 * (15 - r)) - 1)}) end"


def _ladder(s, d):
    r = _reports(s, d)
    out = []
    for most in (1000, 20_000, 10):
        res, cut = summary.cell_ladder(r, "bold_animal", "_h3_7", (7, 5, 3), most)
        out.append((most, res, cut))
    return s.createDataFrame(out, "max_cells int, resolution int, truncated boolean")


_clusters = lambda s, d: summary.cell_clusters(_reports(s, d), F.col(_CELL7), "bold_animal", "_when_ms", *GEO).select("cell", "n", _rounded("avg_lat"), _rounded("avg_lng"), "min_ms", "max_ms", "shape")
_top = lambda s, d: summary.cell_top_groups(_reports(s, d), F.col(_CELL7), "bold_animal", "_when_ms", *GEO).select("cell", "group_id", "n", "min_ms", "max_ms", "rank")


def _windowed(s, d, cutoff=None, bounds=True):
    return windows.windowed(lift.event_documents(s, d), "group_id", "when_ms", cutoff, lift.customer_bounds(s, d) if bounds else None)


_WINDOW = f"from {lift.EVENTS_SQL} v left join bounds on group_id = who where (who is null or ((s is null or when_ms >= s) and (e is null or when_ms <= e) and (x is null or when_ms < x)))"


def _unmatched(s, d):
    ctx = read_context(table(s, d, "jsonld_context"))
    named = _reports(s, d).select(qname(F.col("bold_animal"), ctx).alias("animal_id"))
    return roster.unmatched_groups(named, "animal_id", table(s, d, "individual")).select(F.col("group_id").alias("animal_id"), F.col("n").alias("n_rows"))


def _roster(s, d):
    """Customers named by orders; the first table that has an id supplies it."""
    ids = _orders(s, d).select(F.concat(F.lit("customer:"), "o_custkey").alias("_id"))
    people = _customers(s, d).select(F.concat(F.lit("customer:"), "c_custkey").alias("_id"), "c_name")
    again = table(s, d, "supplier").select(F.concat(F.lit("customer:"), "s_suppkey").alias("_id"), F.col("s_name").alias("c_name"))
    return roster.first_suppliers(ids, [people, again])


def _triples(s, d):
    n = table(s, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("_id"), F.array(F.lit("x:Nation")).alias("at_type"), F.col("n_name").alias("rdfs:label"), F.concat(F.lit("region:"), "n_regionkey").alias("x:region"))
    p = table(s, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("_id"), F.array(F.lit("x:Supplier"), F.lit("x:Party")).alias("at_type"), F.col("s_name").alias("rdfs:label"), F.concat(F.lit("nation:"), "s_nationkey").alias("x:nation"), F.round("s_acctbal").alias("x:balance"))
    return rdf.triples(n).unionByName(rdf.triples(p))


_TRIPLES = """triples as (
  select 'nation:' || n_nationkey s, 'rdf:type' p, 'x:Nation' o, 'string' kind from nation union all
  select 'nation:' || n_nationkey, 'rdfs:label', n_name, 'string' from nation union all
  select 'nation:' || n_nationkey, 'x:region', 'region:' || n_regionkey, 'string' from nation union all
  select 'supplier:' || s_suppkey, 'rdf:type', unnest(['x:Supplier', 'x:Party']), 'string' from supplier union all
  select 'supplier:' || s_suppkey, 'rdfs:label', s_name, 'string' from supplier union all
  select 'supplier:' || s_suppkey, 'x:nation', 'nation:' || s_nationkey, 'string' from supplier union all
  select 'supplier:' || s_suppkey, 'x:balance', round(s_acctbal)::bigint::varchar, 'number' from supplier)"""


def _facts(s, d):
    return _triples(s, d).select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), (F.col("p") == "rdfs:label").alias("explicit"))


def _statements(s, d):
    parts = table(s, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("subject"), F.array(F.concat(F.lit("x:src-"), F.col("s_suppkey") % 4), F.lit("x:all")).alias("partitions"))
    return rdf.statements(_facts(s, d), parts, "x:reasoner", 7).select("_id", "subject", "predicate", "object")


_STATEMENT_SQL = f"""with {_TRIPLES} select 'bold:stmt-' || substr(sha1(s || '|' || p || '|' || o || '|' || case when starts_with(s, 'supplier:') then 'x:all,x:src-' || (replace(s, 'supplier:', '')::int % 4) else 'x:reasoner' end), 1, 16) _id, s subject, p predicate, o "object" from triples where p <> 'rdfs:label'"""


def _upsert(s, d):
    new = rdf.statements(_facts(s, d), None, "x:new", 9).drop("partitions")
    old = new.where(F.pmod(F.length("object"), F.lit(2)) == 0).withColumn("when_ms", F.lit(1).cast("bigint"))
    every, changed = rdf.upsert_statements(old, new)
    return every.groupBy("when_ms").agg(F.count(F.lit(1)).alias("n")).unionByName(changed.agg(F.lit(-1).cast("bigint").alias("when_ms"), F.count(F.lit(1)).alias("n")))


def _assembled(s, d):
    out = rdf.assemble(_facts(s, d))
    return out.select("subject", F.array_join(F.transform(F.array_sort(F.map_keys("properties")), lambda k: F.concat(k, F.lit("="), F.array_join(F.element_at("properties", k), ","))), ";").alias("properties"))


def _sparql(s, d):
    return rdf.sparql_lines(_triples(s, d))


def _json_triples(s, d):
    docs = table(s, d, "individual").select("_id", F.to_json(F.struct(F.col("_id"), F.col("at_type").alias("@type"), F.col("rdfs_label").alias("rdfs:label"), "species")).alias("doc"))
    return rdf.json_triples(docs).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("n_subjects"), F.countDistinct("o").alias("n_objects"))


def _inherited(s, d):
    c = _customers(s, d).select(F.concat(F.lit("person:"), "c_custkey").alias("_id"), F.array(F.concat(F.lit("nation:"), "c_nationkey")).alias("types"))
    return hierarchy.inherited_types(c, "_id", "types", lift.class_edges(s, d).where("child not like 'customer:%'"))


def _inferred(s, d):
    tbox = lift.class_edges(s, d).where("child not like 'customer:%'").select(F.col("child").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.col("parent").alias("o"))
    more = s.createDataFrame([("x:placedBy", "rdfs:range", "x:Person"), ("x:placedBy", "rdfs:domain", "x:Order"), ("x:placedBy", "rdfs:subPropertyOf", "x:about"), ("x:placedBy", "owl:inverseOf", "x:placed")], "s string, p string, o string")
    types = _customers(s, d).select(F.concat(F.lit("person:"), "c_custkey").alias("s"), F.lit("rdf:type").alias("p"), F.concat(F.lit("nation:"), "c_nationkey").alias("o"))
    placed = _orders(s, d).select(F.concat(F.lit("order:"), "o_orderkey").alias("s"), F.lit("x:placedBy").alias("p"), F.concat(F.lit("person:"), "o_custkey").alias("o"))
    return reasoning.infer(types.unionByName(placed), tbox.unionByName(more)).select("s", "p", "o", "rule")


def _routed(s, d):
    parts = []
    for n in COLLECTIONS:
        parts.append(table(s, d, n).select("_id", F.col("at_type").alias("types")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    route = documents.Routing(types={"bold:CameraRecord": "cameras", "bold:StudyRegion": "regions"}, id_patterns={"^track:report-": "tracks"}, namespaces={"track": "wild"}, default="other")
    return rows.select(route.collection(F.col("_id"), F.col("types")).alias("collection")).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def _merged_individuals(s, d):
    rows = table(s, d, "individual").select("_id", "at_type", "rdfs_label", "species", "loaded_at")
    return documents.merge_columns(rows, "_id", ["loaded_at"]).select("_id", _sorted_join(F.col("at_type")).alias("types"), "rdfs_label", "species")


def _outer_merge(s, d):
    """Customers with parts of the same numbers over them; some part names are missing."""
    old = _customers(s, d).select(F.concat(F.lit("c:"), "c_custkey").alias("_id"), F.col("c_name").alias("name"), F.lit("old").alias("since"))
    new = table(s, d, "part").select(F.concat(F.lit("c:"), "p_partkey").alias("_id"), F.when(F.col("p_size") % 9 != 0, F.upper("p_name")).alias("name"), F.lit("new").alias("since"))
    return documents.upsert(old, new, merge=True, first_wins=("since",))


def _status(s, d):
    o = _orders(s, d).select(F.col("o_orderstatus").alias("collection"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("timestamp")).alias("reasoned_at"))
    return documents.reasoning_status(o)


def _detail(s, d):
    o = _orders(s, d).select(F.format_string("order:%010d", "o_orderkey").alias("_id"), F.concat(F.lit("x:src-"), F.col("o_orderkey") % 4).alias("part"), F.array(F.lit("x:Order"), F.concat(F.lit("x:"), "o_orderstatus")).alias("types"), F.when(F.col("o_orderkey") % 3 == 0, F.current_timestamp()).alias("reasoned_at"))
    return documents.unreasoned_detail(o, F.col("part"), F.col("types"))


def _region_tags(s, d):
    """Cells of reports tagged with the regions that hold their centres."""
    tags = hexcells.tag_regions(_reports(s, d), "_h3_7", _regions(s, d), "_id", SHAPE)
    return tags.groupBy("region_id").agg(F.count(F.lit(1)).alias("n_cells"))


def _boxes(s, d):
    return regions.region_boxes(_regions(s, d), "_id", SHAPE).withColumn("area_km2", F.round("area_km2", 3))


def _united(s, d):
    """Regions in six groups by the hash of their id, each as one shape."""
    return regions.united_regions(_regions(s, d), F.pmod(F.crc32("_id"), F.lit(6)), SHAPE)


def _placed(s, d):
    return _reports(s, d).where(position_counts(*map(F.col, GEO)) & (F.length("bold_animal") > 0)).select(F.col("bold_animal").alias("group_id"), *[F.col(c) for c in GEO])


def _hulls(s, d):
    """Hull, centroid and area of each animal's places."""
    r = _placed(s, d)
    stats = regions.position_summary(r, "group_id", *GEO)
    return ranges.group_hulls(r, "group_id", *GEO).join(stats, "group_id").select("group_id", "vertices", "area_km2", _rounded("lng"), _rounded("lat"), "n")


def _labels(s, d):
    i = table(s, d, "individual")
    return i.select("_id", display.label(F.col("_id"), F.col("rdfs_label"), type_label=F.element_at(F.split(F.element_at("at_type", 1), ":"), -1)).alias("label"), display.id_tail(F.col("_id")).alias("tail")).distinct()


def _dates(s, d):
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", display.format_date(F.col("ts")).alias("day"), display.format_date_time(F.col("ts")).alias("moment"))


def _options(s, d):
    return display.group_options(_reports(s, d), F.get("at_type", F.lit(1)))


def _json_props(s, d):
    e = table(s, d, "events").select(F.get(path_values(F.col("props"), "$.k"), F.lit(0)).alias("k"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


_CLOSURE = f"with recursive {lift.EDGES_SQL}, up as (select child node, parent ancestor, 1 distance from edges union select up.node, edges.parent, distance + 1 from up join edges on up.ancestor = edges.child)"
_INDIVIDUAL_FIRST = "select _id, arg_max(rdfs_label, loaded_at) filter (rdfs_label is not null) rdfs_label, arg_max(species, loaded_at) filter (species is not null) species from individual group by 1"


def queries() -> dict:
    return {
        "type_counts": lambda s, d: _type_counts(s, d, False),
        "type_counts_by_collection": lambda s, d: _type_counts(s, d, True),
        "location_counts": lambda s, d: _type_counts(s, d, True).select("type", "collection", "n_located").where("n_located > 0"),
        "group_summary": _summary,
        "group_summary_last_point": _event_summary,
        "merged_summaries": _merged,
        "cell_parents": _parents,
        "cell_ladder": _ladder,
        "cell_cluster": _clusters,
        "cell_top_groups": _top,
        "cell_raw": lambda s, d: summary.cell_raw(_reports(s, d), F.col(_CELL7)).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_id").alias("n_ids")),
        "cell_time_buckets": lambda s, d: summary.time_buckets(lift.event_documents(s, d).withColumn("kind", F.element_at("at_type", 1)), ["kind"], "when_ms"),
        "geohash_cells": lambda s, d: lift.event_documents(s, d).select("_id", cells.geohash(F.col("lat"), F.col("lng"), 5).alias("cell")).groupBy(F.substring("cell", 1, 2).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell").alias("n_cells")),
        "window_cutoff": lambda s, d: _windowed(s, d, CUTOFF_MS, False).select("_id", "when_ms"),
        "window_bounds": lambda s, d: _windowed(s, d).select("_id", "group_id", "when_ms"),
        "window_count": lambda s, d: _windowed(s, d, CUTOFF_MS).agg(F.count(F.lit(1)).alias("n")),
        "window_distinct": lambda s, d: _windowed(s, d, CUTOFF_MS).select("group_id").distinct(),
        "window_aggregate": lambda s, d: aggregate(_windowed(s, d, CUTOFF_MS), [{"$group": {"_id": "$group_id", "n": {"$sum": 1}, "last": {"$max": "$when_ms"}}}]),
        "find_eq": lambda s, d: find(_reports(s, d), {"@type": "bold:Fact"}).select("_id").distinct(),
        "find_in": lambda s, d: find(_orders(s, d), {"o_orderstatus": {"$in": ["F", "P"]}}).select("o_orderkey"),
        "find_nin": lambda s, d: find(table(s, d, "individual"), {"species": {"$nin": ["marsh hare", "dusk owl"]}}).select("_id").distinct(),
        "find_exists": lambda s, d: find(table(s, d, "individual"), {"$or": [{"deleted_at": {"$exists": True}}, {"rdfs:label": {"$exists": False}}]}).select("_id").distinct(),
        "find_range": lambda s, d: find(_reports(s, d), {"$and": [{"geo:lat": {"$gte": 44.0, "$lt": 45.0}}, {"_when_ms": {"$lte": 1735689600000}}]}).select("_id").distinct(),
        "find_sort_limit": lambda s, d: find(_orders(s, d).withColumn("_id", F.concat(F.lit("order:"), "o_orderkey")), {"o_orderstatus": "O"}, ["o_totalprice"], [("o_totalprice", -1)], 25),
        "find_project": lambda s, d: find(table(s, d, "individual"), {"time_zone": "Europe/Oslo"}, {"rdfs:label": 1}).distinct(),
        "pipeline_unwind_group": lambda s, d: aggregate(table(s, d, "observation"), [{"$unwind": "$@type"}, {"$group": {"_id": "$@type", "n": {"$sum": 1}, "first": {"$min": "$_when_ms"}, "lat": {"$avg": "$geo:lat"}}}]).withColumn("lat", _rounded("lat")),
        "pipeline_top": lambda s, d: aggregate(lift.event_documents(s, d), [{"$match": {"value": {"$gte": 10}}}, {"$group": {"_id": "$group_id", "newest": {"$top": {"sortBy": {"when_ms": -1}, "output": "$_id"}}, "n": {"$sum": 1}}}, {"$sort": {"n": -1}}, {"$limit": 40}]),
        "semi_roster": _roster,
        "unmatched_keys": _unmatched,
        "outer_merge": _outer_merge,
        "triples": _triples,
        "json_triples": _json_triples,
        "sparql_lines": _sparql,
        "statement_ids": _statements,
        "statement_upsert": _upsert,
        "assemble_facts": _assembled,
        "subclass_closure": lambda s, d: hierarchy.closure(lift.class_edges(s, d)),
        "class_depth": lambda s, d: hierarchy.depths(lift.class_edges(s, d)),
        "direct_superclasses": lambda s, d: hierarchy.direct_parents(lift.class_edges(s, d)),
        "inherited_types": _inherited,
        "type_order": lambda s, d: hierarchy.types_by_specificity(_inherited(s, d), "_id", "type", hierarchy.depths(lift.class_edges(s, d).where("child not like 'customer:%'"))).select("_id", F.array_join("types", ",").alias("types")),
        "domain_properties": lambda s, d: hierarchy.domain_properties(table(s, d, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("_id"), F.array(F.col("p_brand"), F.element_at(F.split("p_type", " "), 1)).alias("domain"), "p_type"), "_id", "domain", "p_type").select("class", "n_properties"),
        "infer_types": _inferred,
        "routing": _routed,
        "merge_resources": _merged_individuals,
        "is_part_of_union": lambda s, d: documents.union_partitions(_reports(s, d).select("_id", F.array("is_part_of").alias("partitions")), "partitions", ["x:onto", "track:src-1"]).select("_id", F.array_join("partitions", ",").alias("partitions")).distinct(),
        "reasoning_status": _status,
        "unreasoned_detail": _detail,
        "region_tags": _region_tags,
        "region_bbox": lambda s, d: _boxes(s, d).drop("area_km2"),
        "region_boxes": _boxes,
        "region_simplified": lambda s, d: regions.region_simplified(_regions(s, d), "_id", SHAPE, 0.02),
        "group_centroids": lambda s, d: regions.position_summary(_placed(s, d), "group_id", *GEO).select("group_id", _rounded("lng"), _rounded("lat"), "n"),
        "region_union": _united,
        "spatial_range": _hulls,
        "label_fallback": _labels,
        "format_date": _dates,
        "group_options": _options,
        "json_props": _json_props,
    }


def oracle_sql() -> dict[str, str]:
    ev, cell = lift.EVENTS_SQL, lift.square_cell_sql(5.0)
    return {
        "type_counts": f"select type, count(*) n, count_if(located) n_located from {_TYPES_SQL} group by 1",
        "type_counts_by_collection": f"select type, collection, count(*) n, count_if(located) n_located from {_TYPES_SQL} group by 1, 2",
        "location_counts": f"select type, collection, count_if(located) n_located from {_TYPES_SQL} group by 1, 2 having count_if(located) > 0",
        "group_summary": _SUMMARY_SQL.format(rows="tracking_report", cells="coalesce(array_to_string(list_sort(list(distinct _h3_7) filter (_h3_7 is not null)), ','), '') cells"),
        "group_summary_last_point": f"select group_id, min(when_ms) first_ms, max(when_ms) last_ms, count(*) n, count(distinct {cell}) n_cells, round(max_by(lat, (when_ms, lat, lng)), 6) last_lat, round(max_by(lng, (when_ms, lat, lng)), 6) last_lng from {ev} group by 1",
        "merged_summaries": _SUMMARY_SQL.format(rows="(select bold_animal, _when_ms, _h3_7 from tracking_report union all select at_type[1], _when_ms, _h3_7 from observation)", cells="count(distinct _h3_7) n_cells"),
        "cell_parents": f"select c, {_PARENT(5)} p5, {_PARENT(3)} p3 from (select distinct _h3_7 c from tracking_report where _h3_7 is not null)",
        "cell_cluster": "select _h3_7 cell, count(*) n, round(avg(geo_lat) + 1e-9, 6) avg_lat, round(avg(geo_long) + 1e-9, 6) avg_lng, min(_when_ms) min_ms, max(_when_ms) max_ms, case when count(*) <= 1000 then 'raw' else 'cluster' end shape from tracking_report where _h3_7 is not null group by 1",
        "cell_top_groups": "select * from (select _h3_7 cell, bold_animal group_id, count(*) n, min(_when_ms) min_ms, max(_when_ms) max_ms, row_number() over (partition by _h3_7 order by count(*) desc, bold_animal nulls last) rank from tracking_report where _h3_7 is not null group by 1, 2) where rank <= 10",
        "cell_raw": "select _h3_7 cell, count(*) n, count(distinct _id) n_ids from tracking_report where _h3_7 is not null group by 1 having count(*) <= 1000",
        "cell_time_buckets": f"with v as (select at_type[1] kind, when_ms t from {ev}), b as (select kind, min(t) lo, max(t) hi from v group by 1) select kind, (case when hi <= lo then 0 when t >= hi then 15 else greatest(0, least(15, floor((t - lo) / ((hi - lo) / 16.0)))) end)::int bucket, count(*) n, min(t) min_ms, max(t) max_ms from v join b using (kind) group by 1, 2",
        "window_cutoff": f"select _id, when_ms from {ev} where when_ms <= {CUTOFF_MS}",
        "window_bounds": f"with {lift.BOUNDS_SQL} select _id, group_id, when_ms {_WINDOW}",
        "window_count": f"with {lift.BOUNDS_SQL} select count(*) n {_WINDOW} and when_ms <= {CUTOFF_MS}",
        "window_distinct": f"with {lift.BOUNDS_SQL} select distinct group_id {_WINDOW} and when_ms <= {CUTOFF_MS}",
        "window_aggregate": f"with {lift.BOUNDS_SQL} select group_id _id, count(*) n, max(when_ms) \"last\" {_WINDOW} and when_ms <= {CUTOFF_MS} group by 1",
        "find_eq": "select distinct _id from tracking_report where list_contains(at_type, 'bold:Fact')",
        "find_in": "select o_orderkey from orders where o_orderstatus in ('F', 'P')",
        "find_nin": "select distinct _id from individual where coalesce(species not in ('marsh hare', 'dusk owl'), true)",
        "find_exists": "select distinct _id from individual where deleted_at is not null or rdfs_label is null",
        "find_range": "select distinct _id from tracking_report where geo_lat >= 44 and geo_lat < 45 and _when_ms <= 1735689600000",
        "find_sort_limit": "select 'order:' || o_orderkey _id, o_totalprice from orders where o_orderstatus = 'O' order by o_totalprice desc, 'order:' || o_orderkey limit 25",
        "find_project": "select distinct _id, rdfs_label from individual where time_zone = 'Europe/Oslo'",
        "pipeline_unwind_group": 'select t _id, count(*) n, min(_when_ms) "first", round(avg(geo_lat) + 1e-9, 6) lat from (select unnest(at_type) t, * from observation) group by 1',
        "pipeline_top": f"select group_id _id, max_by(_id, when_ms) newest, count(*) n from {ev} where value >= 10 group by 1 order by n desc, group_id limit 40",
        "semi_roster": "select 'customer:' || c_custkey _id, c_name from customer where c_custkey in (select o_custkey from orders)",
        "unmatched_keys": f"with named as ({_ID % 'select bold_animal raw from tracking_report'}) select id animal_id, count(*) n_rows from named where id <> '' and id not in (select _id from individual) group by 1",
        "region_boxes": f"""with {_EDGES}, closed as (select *, [list_extract(r, (i - 1) % len(r) + 1) for i in range(1, len(r) + 3)] c from rings), areas as (
          select _id, poly, r = o outer_ring, abs(list_sum([(radians(c[k + 2][1]) - radians(c[k][1])) * sin(radians(c[k + 1][2])) for k in range(1, len(r) + 1)])) * 6371008.8 * 6371008.8 / 2 a from (select closed.*, polygons.rings[1] o from closed join polygons using (_id, poly))),
          per_poly as (select _id, poly, abs(sum(case when outer_ring then a else -a end)) a from areas group by 1, 2), areas_of as (select _id, sum(a) / 1e6 area from per_poly group by 1),
          boxes as (select _id, min(p[1]) west, min(p[2]) south, max(p[1]) east, max(p[2]) north, count(distinct poly) n_polygons from (select _id, poly, unnest(rings[1]) p from polygons) group by 1)
          select _id region_id, west, south, east, north, round(area, 3) area_km2, n_polygons from boxes join areas_of using (_id)""",
        "group_centroids": "select bold_animal group_id, round(avg(geo_long) + 1e-9, 6) lng, round(avg(geo_lat) + 1e-9, 6) lat, count(*) n from tracking_report where bold_animal <> '' and geo_lat between -90 and 90 and geo_long between -180 and 180 and not isnan(geo_lat) and not isnan(geo_long) and not (geo_lat = 0 and geo_long = 0) group by 1",
        "cell_ladder": "with c as (select distinct bold_animal g, _h3_7 c from tracking_report where bold_animal is not null and _h3_7 is not null), n as (select 7 r, count(distinct (g, p7)) n from (select g, " + _PARENT(7) + " p7 from c) where p7 is not null union all select 5, count(distinct (g, p5)) from (select g, " + _PARENT(5) + " p5 from c) where p5 is not null union all select 3, count(distinct (g, p3)) from (select g, " + _PARENT(3) + " p3 from c) where p3 is not null), m as (select unnest([1000, 20000, 10])::int max_cells) select max_cells, coalesce(max(r) filter (n <= max_cells), 3)::int resolution, count(*) filter (n <= max_cells) = 0 truncated from m, n group by 1",
        "geohash_cells": f"with v as (select floor((lng + 180) / 360 * 8192)::bigint x, floor((lat + 90) / 180 * 4096)::bigint y from {ev}), h as (select array_to_string([('0123456789bcdefghjkmnpqrstuvwxyz')[1 + list_sum([((case when (5 * c + k) % 2 = 0 then least(x, 8191) >> (12 - (5 * c + k) // 2) else least(y, 4095) >> (11 - (5 * c + k) // 2) end) & 1) << (4 - k) for k in range(5)])::int] for c in range(5)], '') cell from v) select substr(cell, 1, 2) prefix, count(*) n, count(distinct cell) n_cells from h group by 1",
        "region_bbox": f"with {_EDGES} select _id region_id, min(p[1]) west, min(p[2]) south, max(p[1]) east, max(p[2]) north, count(distinct poly) n_polygons from (select _id, poly, unnest(rings[1]) p from polygons) group by 1",
        "outer_merge": "select 'c:' || coalesce(c_custkey, p_partkey) _id, coalesce(case when p_size % 9 <> 0 then upper(p_name) end, c_name) \"name\", case when c_custkey is not null then 'old' else 'new' end since from customer full join part on c_custkey = p_partkey",
        "triples": f"with {_TRIPLES} select * from triples",
        "json_triples": "with t as (select _id s, unnest(list_distinct(['at:' || x for x in at_type])) o, 'rdf:type' p from individual union select _id, rdfs_label, 'rdfs:label' from individual where rdfs_label is not null union select _id, species, 'species' from individual where species is not null) "
        "select p, (select count(*) from (select unnest(case p when 'rdf:type' then at_type when 'rdfs:label' then [rdfs_label] else [species] end) v from individual) where v is not null) n, count(distinct s) n_subjects, count(distinct o) n_objects from t group by 1",
        "sparql_lines": f"with {_TRIPLES} select s || ' ' || p || ' ' || case when kind = 'number' or regexp_full_match(o, '[a-zA-Z_][a-zA-Z0-9_]*:[a-zA-Z0-9_.-]*') then o else '\"' || o || '\"' end line from triples",
        "statement_ids": _STATEMENT_SQL,
        "statement_upsert": f"with {_TRIPLES}, f as (select distinct s, p, o, length(o) % 2 m from triples where p <> 'rdfs:label') select 1::bigint when_ms, count(*) n from f where m = 0 union all select 9, count(*) from f where m = 1 union all select -1, count(*) from f where m = 1",
        "assemble_facts": f"with {_TRIPLES}, a as (select s, p, array_to_string(list_sort(list(distinct o)), ',') os from triples group by 1, 2) select s subject, array_to_string(list_sort(list(p || '=' || os)), ';') properties from a group by 1",
        "subclass_closure": f"{_CLOSURE} select node, ancestor, min(distance) distance from up group by 1, 2",
        "class_depth": f"{_CLOSURE} select node, max(distance)::int \"depth\" from up group by 1 union all select 'x:World', 0",
        "direct_superclasses": f"with {lift.EDGES_SQL} select distinct child, parent from edges e where not exists (select 1 from edges a join edges b on a.parent = b.child where a.child = e.child and b.parent = e.parent)",
        "inherited_types": f"{_CLOSURE}, own as (select 'person:' || c_custkey _id, 'nation:' || c_nationkey type from customer) select _id, type, false inferred from own union all select distinct _id, ancestor, true from own join up on own.type = up.node",
        "type_order": "select 'person:' || c_custkey _id, 'nation:' || c_nationkey || ',region:' || n_regionkey || ',x:World' types from customer join nation on c_nationkey = n_nationkey",
        "domain_properties": "select class, count(distinct p) n_properties from (select p_partkey p, unnest([p_brand, string_split(p_type, ' ')[1]]) class from part) where class is not null group by 1",
        "infer_types": f"""{_CLOSURE}, t as (select 'person:' || c_custkey s, 'nation:' || c_nationkey o from customer), o as (select 'order:' || o_orderkey s, 'person:' || o_custkey o from orders)
          select s, 'rdf:type' p, ancestor o, 'cax-sco' rule from t join (select distinct node, ancestor from up) on o = node
          union select s, 'rdf:type', 'x:Order', 'prp-dom' from o union select o, 'rdf:type', 'x:Person', 'prp-rng' from o union select s, 'x:about', o, 'prp-spo1' from o union select o, 'x:placed', s, 'prp-inv' from o""",
        "routing": "with r as (" + " union all ".join(f"select _id, at_type from {n}" for n in COLLECTIONS) + ") select case when list_contains(at_type, 'bold:CameraRecord') then 'cameras' when list_contains(at_type, 'bold:StudyRegion') then 'regions' when starts_with(_id, 'track:report-') then 'tracks' when starts_with(_id, 'track:') then 'wild' else 'other' end collection, count(*) n from r group by 1",
        "merge_resources": f"with f as ({_INDIVIDUAL_FIRST}), t as (select _id, array_to_string(list_sort(list(distinct x)), ',') types from (select _id, unnest(at_type) x from individual) group by 1) select * from f join t using (_id)",
        "is_part_of_union": "select distinct _id, array_to_string(list_concat(case when is_part_of is null then [] else [is_part_of] end, case when is_part_of = 'track:src-1' then ['x:onto'] else ['x:onto', 'track:src-1'] end), ',') partitions from tracking_report",
        "reasoning_status": "select o_orderstatus collection, count(*) total, count_if(o_orderkey % 3 = 0) reasoned, count_if(o_orderkey % 3 <> 0) unreasoned from orders group by rollup (o_orderstatus)",
        "unreasoned_detail": "with u as (select printf('order:%010d', o_orderkey) _id, 'x:src-' || o_orderkey % 4 part, 'x:Order,x:' || o_orderstatus types from orders where o_orderkey % 3 <> 0) select part \"partition\", types, count(*) n, array_to_string(list_sort(list(_id))[1:5], ',') examples from u group by 1, 2",
        "label_fallback": "select distinct _id, coalesce(nullif(rdfs_label, ''), string_split(at_type[1], ':')[-1] || ' ' || regexp_extract(_id, '[^#/:]*$')) \"label\", regexp_extract(_id, '[^#/:]*$') tail from individual",
        "format_date": "with l as (select event_id, timezone('America/Los_Angeles', timezone('UTC', ts)) w, ts from events) select event_id, strftime(w, '%-m/%-d/%Y') \"day\", strftime(w, '%-m/%-d/%Y %-I:%M %p') || case when date_diff('minute', w, ts) = 480 then ' PST' else ' PDT' end moment from l",
        "group_options": "with c as (select nullif(at_type[2], '') group_id, count(*) n from tracking_report group by 1), o as (select *, (row_number() over (order by group_id) - 1) % 8 + 1 k from c where group_id is not null) "
        f"select group_id, string_split(group_id, ':')[-1] \"label\", {list(display.COLOURS)}[k] colour, n from o union all select null, 'No Group', '#cccccc', n from c where group_id is null",
        "json_props": "select json_extract_string(props, '$.k') k, count(*) n from events group by 1",
    }
