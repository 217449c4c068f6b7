"""The structure of a set of collections: classes, properties, ontologies and how many resources there are of each type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.catalog import Query
from loamgraph.operators.documents import both_forms
from loamgraph.operators.hierarchy import class_order, closure, direct_parents
from loamgraph.operators.summary import type_counts

CLASS_TYPES = ("owl:Class", "rdfs:Class")
#: Property types, the one that decides first.
PROPERTY_TYPES = ("owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty", "rdf:Property")
#: Classes and properties of a report; an ontology with more is read with the frames below.
MAX_REPORT = 50_000


def _of(tbox: DataFrame, kinds) -> DataFrame:
    return tbox.where(F.arrays_overlap("types", F.array(*[F.lit(k) for k in both_forms(kinds)])))


def classes(tbox: DataFrame) -> DataFrame:
    """(class, depth, rank, parents): named classes in an order with parents first, their direct parents joined by comma.

    ``tbox`` has ``_id``, ``types`` and ``parents`` (array of superclasses).
    """
    named = _of(tbox, CLASS_TYPES).where(~F.col("_id").startswith("_:")).select("_id", "parents")
    edges = named.select(F.col("_id").alias("child"), F.explode("parents").alias("parent")).where(~F.col("parent").startswith("_:"))
    up = direct_parents(edges).groupBy("child").agg(F.array_join(F.array_sort(F.collect_list("parent")), ",").alias("parents"))
    order = class_order(edges)
    out = named.select(F.col("_id").alias("class")).distinct()
    out = out.join(order.withColumnRenamed("node", "class"), "class", "left").join(up.withColumnRenamed("child", "class"), "class", "left")
    return out.select("class", F.coalesce("depth", F.lit(0)).alias("depth"), "rank", F.coalesce("parents", F.lit("")).alias("parents"))


def properties(tbox: DataFrame) -> DataFrame:
    """(property, kind, domain): one row a domain; the kind is the first of ``PROPERTY_TYPES`` that a property has."""
    kind = F.lit(None).cast("string")
    for k in reversed(PROPERTY_TYPES):
        kind = F.when(F.arrays_overlap("types", F.array(*[F.lit(x) for x in both_forms([k])])), k).otherwise(kind)
    rows = _of(tbox, PROPERTY_TYPES).select(F.col("_id").alias("property"), kind.alias("kind"), F.explode_outer("domain").alias("domain"))
    return rows.distinct()


def individual_queries(counts: DataFrame) -> DataFrame:
    """Counts with the stored query that reads each type, by the collection's own name."""
    return counts.withColumn("query", F.to_json(F.struct(F.concat_ws(" in ", "type", "collection").alias("name"), "collection", F.struct(F.col("type").alias("@type")).alias("selector"), "n")))


def report(tbox: DataFrame, collections: dict[str, DataFrame], types: str = "at_type", located=None) -> dict:
    """Classes, properties and ontologies with counts, as one nested value for the driver."""
    names = _of(tbox, (*CLASS_TYPES, *PROPERTY_TYPES, "owl:Ontology")).limit(MAX_REPORT + 1).count()
    if names > MAX_REPORT:
        raise ValueError(f"the ontology has more than {MAX_REPORT} entries; read classes() and properties() instead")
    counts: dict = {}
    for r in type_counts(collections, types, located).collect():
        c = counts.setdefault(r["type"], {"count": 0, "located": 0, "queries": []})
        c["count"] += r["n"]
        c["located"] += r["n_located"]
        c["queries"].append(Query(f"{r['type']} in {r['collection']}", r["collection"], {"@type": r["type"]}, {}, r["n"]).to_document())
    props: dict = {}
    for r in properties(tbox).collect():
        props.setdefault(r["kind"], {}).setdefault(r["property"], []).extend([r["domain"]] if r["domain"] else [])
    by_domain: dict = {}
    for kind in props.values():
        for p, domains in kind.items():
            for d in domains:
                by_domain.setdefault(d, []).append(p)
    out: dict = {}
    for r in classes(tbox).orderBy(F.asc_nulls_last("rank"), "class").collect():
        out[r["class"]] = {"subClassOf": [x for x in r["parents"].split(",") if x], "properties": sorted(by_domain.get(r["class"], [])), **counts.get(r["class"], {"count": 0, "located": 0, "queries": []})}
    for t, c in counts.items():
        out.setdefault(t, {"subClassOf": [], "properties": sorted(by_domain.get(t, [])), **c})
    return {"Classes": out, "Properties": props, "Ontologies": sorted(r["_id"] for r in _of(tbox, ("owl:Ontology",)).select("_id").distinct().collect())}


def property_usage(instances: DataFrame, definitions: DataFrame) -> DataFrame:
    """(type, property, n, range): properties that resources of a type carry, with their definition or a note that there is none.

    ``instances`` has ``types`` and a JSON text ``doc``.
    """
    keys = instances.select(F.explode(F.array_distinct("types")).alias("type"), F.explode(F.json_object_keys("doc")).alias("property")).where(~F.col("property").startswith("@") & (F.col("property") != "_id"))
    used = keys.groupBy("type", "property").agg(F.count(F.lit(1)).alias("n"))
    known = definitions.select(F.col("_id").alias("property"), F.col("range")).dropDuplicates(["property"])
    return used.join(known, "property", "left").withColumn("range", F.coalesce("range", F.lit("No ontology definition found")))


def instances(resources: DataFrame, edges: DataFrame | None = None, class_filter: list[str] | None = None) -> DataFrame:
    """(type, property, n, n_resources): how often resources of each type carry each property, over all collections.

    ``resources`` has ``types`` and a JSON text ``doc``. With ``edges`` (child, parent)
    a resource counts for the superclasses of its types too; ``class_filter`` keeps
    only these types. Resources are exploded and counted map-side, never gathered.
    """
    each = resources.withColumn("type", F.explode(F.array_distinct("types")))
    if edges is not None:
        up = closure(edges).where("node <> ancestor").select(F.col("node").alias("type"), F.col("ancestor"))
        more = each.join(up, "type").withColumn("type", F.col("ancestor")).drop("ancestor")
        each = each.unionByName(more).dropDuplicates(["type", "_id"])
    if class_filter is not None:
        each = each.where(F.col("type").isin(class_filter))
    total = each.groupBy("type").agg(F.count(F.lit(1)).alias("n_resources"))
    keys = each.select("type", F.explode(F.json_object_keys("doc")).alias("property")).where(~F.col("property").startswith("@") & (F.col("property") != "_id"))
    used = keys.groupBy("type", "property").agg(F.count(F.lit(1)).alias("n"))
    return total.join(used, "type", "left").select("type", "property", F.coalesce("n", F.lit(0)).alias("n"), "n_resources")
