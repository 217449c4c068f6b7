"""Class and property hierarchies: closure, depth, direct parents, order by specificity, inherited schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.runtime import materialize, numbered

#: Rounds after which a closure that still grows is refused: paths of 2**40 edges.
MAX_ROUNDS = 40
#: Levels after which a depth that still grows is searched for cycles.
CYCLE_CHECK = 8


def _edges(edges: DataFrame, child: str, parent: str) -> DataFrame:
    return edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.col(child).alias("child"), F.col(parent).alias("parent")).distinct()


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor, distance): every ancestor at its shortest distance; a node on a cycle is its own ancestor.

    Each round doubles the distances known: paths of just the greatest length so
    far are continued by all known ones. Rounds are therefore the logarithm of the
    depth, and a round writes only the pairs it found, never those known before.
    """
    direct = _edges(edges, child, parent)
    known = materialize(direct.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    fresh = known
    for k in range(MAX_ROUNDS):
        longest = fresh.where(F.col("distance") == 1 << k)
        if longest.isEmpty():
            return known
        go_on = known.select(F.col("node").alias("via"), F.col("ancestor").alias("end"), F.col("distance").alias("more"))
        step = longest.join(go_on, longest["ancestor"] == go_on["via"]).groupBy("node", F.col("end").alias("ancestor")).agg((F.min("more") + (1 << k)).alias("distance"))
        fresh = materialize(step.join(known, ["node", "ancestor"], "left_anti"))
        known = known.unionByName(fresh)
    raise RuntimeError(f"the hierarchy is deeper than 2**{MAX_ROUNDS}")


def cycles(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, component): the nodes that reach themselves, named by the least node of their cycle."""
    up = materialize(closure(edges, child, parent).select("node", "ancestor"))
    looped = up.where("node = ancestor").select("node")
    inside = up.join(looped, "node", "left_semi").join(looped.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi")
    back = inside.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("node"))
    return inside.join(back, ["node", "ancestor"], "left_semi").groupBy("node").agg(F.min("ancestor").alias("component"))


def depths(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, depth): the longest path up to a root, where roots have 0.

    A cycle counts as one node: all its nodes are one below the deepest parent
    outside it, at 0 if there is none. Rounds push the depth down one level at a
    time; only if levels do not end soon, or leave nodes out, are cycles sought
    (``cycles``) and drawn together.
    """
    direct = materialize(_edges(edges, child, parent))
    nodes = direct.select(F.col("child").alias("node")).union(direct.select("parent")).distinct()
    found = _levels(direct, nodes, CYCLE_CHECK)
    if found is not None and nodes.join(found, "node", "left_anti").isEmpty():
        return found
    component = materialize(cycles(direct))
    drawn = _drawn(_drawn(direct, component, "child"), component, "parent").where("child <> parent").distinct()
    heads = _drawn(nodes, component, "node").distinct()
    found = _levels(materialize(drawn), heads, None)
    named = nodes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return named.join(found.withColumnRenamed("node", "component"), "component").select("node", "depth")


def _drawn(df: DataFrame, component: DataFrame, name: str) -> DataFrame:
    """``df`` with the nodes of a column replaced by their component."""
    c = component.select(F.col("node").alias("__node"), "component")
    return df.join(c, F.col(name) == F.col("__node"), "left").withColumn(name, F.coalesce("component", name)).drop("__node", "component")


def _levels(direct: DataFrame, nodes: DataFrame, most: int | None) -> DataFrame | None:
    """(node, depth) of all nodes below a root; None if there are more than ``most`` levels."""
    parts = [materialize(nodes.join(direct.select(F.col("child").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0)))]
    while most is None or len(parts) <= most:
        level = parts[-1].select(F.col("node").alias("parent")).join(direct, "parent").select(F.col("child").alias("node")).distinct().withColumn("depth", F.lit(len(parts)))
        level = materialize(level)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.max("depth").alias("depth"))
        parts.append(level)
    return None


def direct_parents(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Parents that are not themselves a listed parent of another parent of the same child."""
    e = _edges(edges, child, parent)
    via = e.alias("a").join(e.alias("b"), F.col("a.parent") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.parent").alias("parent")).where("child <> parent").distinct()
    return e.join(via, ["child", "parent"], "left_anti")


def domain_properties(properties: DataFrame, id_col: str, domain: str, range_: str) -> DataFrame:
    """(class, n_properties, properties): the properties whose domain names a class."""
    rows = properties.select(F.explode(domain).alias("class"), F.col(id_col).alias("property"), F.col(range_).alias("range")).distinct()
    return rows.groupBy("class").agg(F.countDistinct("property").alias("n_properties"), F.array_join(F.array_sort(F.collect_set("property")), ",").alias("properties"))


def inherited_types(instances: DataFrame, id_col: str, types: str, edges: DataFrame) -> DataFrame:
    """(_id, type, inferred): each instance's own types and all their ancestors.

    The instances are exploded once and joined with the closure; types that a few
    classes dominate are split by AQE, as the closure side is small per class.
    """
    own = instances.select(F.col(id_col).alias("_id"), F.explode(types).alias("type")).distinct()
    up = closure(edges)
    more = own.join(up, own["type"] == up["node"]).select("_id", F.col("ancestor").alias("type")).distinct().join(own, ["_id", "type"], "left_anti")
    return own.withColumn("inferred", F.lit(False)).unionByName(more.withColumn("inferred", F.lit(True)))


def types_by_specificity(rows: DataFrame, id_col: str, type_col: str, depth: DataFrame) -> DataFrame:
    """(_id, types): named types before blank ones, deepest first, ties by name."""
    d = rows.select(F.col(id_col).alias("_id"), F.col(type_col).alias("type")).distinct().join(depth.withColumnRenamed("node", "type"), "type", "left")
    key = F.struct(F.col("type").startswith("_:").alias("blank"), (-F.coalesce("depth", F.lit(0))).alias("up"), F.col("type"))
    return d.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda s: s["type"]).alias("types"))


def class_order(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, depth, rank): parents before children, then by name; blank nodes last."""
    d = depths(edges, child, parent).withColumn("__blank", F.col("node").startswith("_:"))
    return numbered(d, ["__blank", "depth", "node"], "rank").drop("__blank")


def merge_schemas(base, other):
    """Deep merge of two schema values: arrays on either side unite, objects merge, the rest is replaced."""
    if isinstance(base, list) or isinstance(other, list):
        out = []
        for v in [*_listed(base), *_listed(other)]:
            if v not in out:
                out.append(v)
        return out
    if isinstance(base, dict) and isinstance(other, dict):
        out = dict(base)
        for k, v in other.items():
            out[k] = merge_schemas(base[k], v) if k in base else v
        return out
    return other


def _listed(v) -> list:
    return [] if v is None else v if isinstance(v, list) else [v]


def class_schema(classes: dict[str, dict], class_id: str, schema_key: str = "bui:schema", parents_key: str = "rdfs:subClassOf") -> dict:
    """The schema of a class of an ontology on the driver: its ancestors', the farthest first, then its own."""
    seen: dict[str, int] = {}
    todo = [(class_id, 0)]
    while todo:
        node, depth = todo.pop()
        if node in seen or node not in classes or node.startswith("_:"):
            continue
        seen[node] = depth
        todo += [(p, depth + 1) for p in reversed(_listed(classes[node].get(parents_key))) if isinstance(p, str)]
    out: dict = {}
    for node in sorted(seen, key=lambda n: -seen[n]):
        out = merge_schemas(out, classes[node].get(schema_key) or {})
    return out


def property_schema(ontology: dict[str, dict], prop: str, resource: dict | None = None) -> dict:
    """A property's own schema, then what the resource's classes say of it from general to special, then the resource."""
    out = dict(ontology.get(prop, {}).get("bui:schema") or {})
    for cls in _listed((resource or {}).get("@type")):
        inherited = class_schema(ontology, cls)
        out = merge_schemas(out, (inherited.get("properties") or {}).get(prop) or {})
    own = (resource or {}).get("bui:schema") or {}
    return merge_schemas(out, (own.get("properties") or {}).get(prop) or {})


def group_strategies(schema: dict) -> list[dict]:
    """The schema's groups, the first for each property."""
    out: dict = {}
    for g in _listed(schema.get("groups")):
        if isinstance(g, dict) and g.get("property"):
            out.setdefault(g["property"], g)
    return list(out.values())


def is_array_property(prop: str, *contexts: dict, ontology: dict | None = None, resource: dict | None = None) -> bool:
    """Whether a property holds many values: the contexts in order, then the resource, then the ontology."""
    if prop.isdigit() or prop == "__proto__":
        return False
    for ctx in contexts:
        term = (ctx or {}).get(prop)
        if isinstance(term, dict) and "@container" in term:
            return term["@container"] in ("@list", "@set")
    for doc in (resource, (ontology or {}).get(prop)):
        if doc and "bold:container" in doc:
            return doc["bold:container"] in ("@list", "@set")
    return False
