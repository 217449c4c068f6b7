"""Resources as rows: routing to collections, merging of deliveries, upserts, JSON values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from loamgraph.runtime import arrow_udf

#: Types whose resources belong to the ontology, by QName and IRI.
TBOX_TYPES = (
    "owl:Class", "rdfs:Class", "rdfs:Datatype", "owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty", "rdf:Property",
    "owl:Ontology", "owl:Restriction", "owl:FunctionalProperty", "owl:InverseFunctionalProperty", "owl:AllDisjointClasses", "owl:AllDisjointProperties",
    "owl:TransitiveProperty", "owl:SymmetricProperty", "owl:AsymmetricProperty", "owl:ReflexiveProperty", "owl:IrreflexiveProperty",
)
NAMESPACES = {"owl": "http://www.w3.org/2002/07/owl#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
STATEMENT_KEYS = ("rdf:subject", "rdf:predicate", "rdf:object")


def both_forms(names) -> list[str]:
    """QNames and the IRIs they stand for."""
    return [*names, *(NAMESPACES[n.split(":")[0]] + n.split(":")[1] for n in names)]


@dataclass
class Routing:
    """Where a resource is kept: by type, by id pattern, by namespace, else the default, else the ontology."""

    ontology: str = "ontology"
    statements: str = "statements"
    types: dict[str, str] = field(default_factory=dict)
    id_patterns: dict[str, str] = field(default_factory=dict)
    namespaces: dict[str, str] = field(default_factory=dict)
    default: str | None = None

    def collection(self, id_: Column, types: Column, is_statement: Column | None = None, in_ontology: Column | None = None) -> Column:
        """The collection a resource is written to; the first type in the resource's order decides."""
        tbox = F.arrays_overlap(types, F.array(*[F.lit(t) for t in both_forms(TBOX_TYPES)]))
        untyped = F.coalesce(F.size(types) <= 0, F.lit(True)) if in_ontology is not None else F.lit(False)
        statement = F.array_contains(types, "rdf:Statement") | F.array_contains(types, NAMESPACES["rdf"] + "Statement")
        if is_statement is not None:
            statement = F.coalesce(statement, F.lit(False)) | is_statement
        out = F.when(statement, self.statements).when(tbox | types_contain_id(types, id_), self.ontology)
        if in_ontology is not None:
            out = out.when(untyped & in_ontology, self.ontology)
        if self.types:
            known = F.create_map(*[F.lit(x) for kv in self.types.items() for x in kv])
            chosen = F.get(F.filter(F.transform(types, lambda t: F.try_element_at(known, t)), lambda c: c.isNotNull()), F.lit(0))
            out = out.when(chosen.isNotNull(), chosen)
        for pattern, name in self.id_patterns.items():
            out = out.when(id_.rlike(pattern), name)
        for prefix, name in self.namespaces.items():
            out = out.when(F.regexp_extract(id_, "^([^:]+):", 1) == prefix, name)
        return out.otherwise(F.lit(self.default if self.default is not None else self.ontology))

    def search_order(self, id_: str, collections: list[str]) -> list[str]:
        """Where a resource is looked for: matching id patterns (the last first), the ontology, its namespace, the rest, statements last."""
        import re

        order = [self.ontology]
        prefix = id_.split(":")[0] if ":" in id_ else None
        if prefix in self.namespaces:
            order.append(self.namespaces[prefix])
        for pattern, name in self.id_patterns.items():
            if re.search(pattern, id_):
                order.insert(0, name)
        order += [c for c in collections if c != self.statements]
        return list(dict.fromkeys([*order, self.statements]))


def types_contain_id(types: Column, id_: Column) -> Column:
    return F.coalesce(id_.isin("@type", "_id"), F.lit(False))


def lookup(ids: DataFrame, collections: dict[str, DataFrame], routing: Routing) -> DataFrame:
    """(_id, collection, ...) for each wanted id from the first collection that has it.

    Collections are ranked once; ids meet them in one shuffled join, so a list of
    ids of any length is looked up in one job.
    """
    names = list(collections)
    rows = None
    for name in names:
        part = collections[name].withColumn("collection", F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    found = rows.join(ids.select("_id").distinct(), "_id")
    prefix = F.regexp_extract("_id", "^([^:]+):", 1)
    rank = F.when(F.col("collection") == routing.ontology, 100).when(F.col("collection") == routing.statements, 10_000).otherwise(200)
    for i, name in enumerate(n for n in names if n not in (routing.ontology, routing.statements)):
        rank = F.when(F.col("collection") == name, 200 + i).otherwise(rank)
    for p, name in routing.namespaces.items():
        rank = F.when((F.col("collection") == name) & (prefix == p), 150).otherwise(rank)
    for i, (pattern, name) in enumerate(routing.id_patterns.items()):
        rank = F.when((F.col("collection") == name) & F.col("_id").rlike(pattern), 50 - i).otherwise(rank)
    w = W.Window.partitionBy("_id").orderBy(rank)
    return found.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def _same(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        for k in ("@id", "@value"):
            if a.get(k) and b.get(k):
                return a[k] == b[k]
        return json.dumps(a) == json.dumps(b)
    return type(a) is type(b) and a == b


def _union(a, b) -> list:
    out = list(a) if isinstance(a, list) else [a]
    for v in b if isinstance(b, list) else [b]:
        if not any(_same(x, v) for x in out):
            out.append(v)
    return out


def fold(resources: list[dict]) -> dict:
    """Deliveries of one resource in order: a new property is taken, arrays unite, of two scalars the later stays.

    Raises if there is none, if one has no id or if ids differ.
    """
    if not resources:
        raise ValueError("nothing to merge")
    key = lambda r: r.get("_id") or r.get("@id")
    first = key(resources[0])
    if not first or any(key(r) and key(r) != first for r in resources):
        raise ValueError("resources to merge must have one and the same id")
    out = dict(resources[0])
    for r in resources[1:]:
        for k, v in r.items():
            if k in ("_id", "@id"):
                continue
            if k not in out:
                out[k] = v
            elif isinstance(out[k], list) or isinstance(v, list):
                out[k] = _union(out[k], v)
            else:
                out[k] = v
    return out


def deep_merge(old, new):
    """What saving over a stored resource gives: arrays on either side unite, objects merge, scalars are replaced."""
    if isinstance(old, list) or isinstance(new, list):
        wrap = lambda v: [] if v is None else v if isinstance(v, list) else [v]
        out = []
        for v in [*wrap(old), *wrap(new)]:
            if v not in out:
                out.append(v)
        return out
    if isinstance(old, dict) and isinstance(new, dict):
        return {**old, **{k: deep_merge(old[k], v) if k in old else v for k, v in new.items()}}
    return new


def merge_columns(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """``fold`` for typed columns without Python: array columns unite, of scalars the latest non-null stays.

    Later is greater by ``order``. Scalars reduce map-side; arrays are reduced to
    distinct elements before they are gathered.
    """
    scalars = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType) and f.name != id_col]
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    when = F.struct(*order)
    out = df.groupBy(id_col).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(c) for c in scalars] or [F.count(F.lit(1)).alias("__n")])
    for c in arrays:
        part = df.select(id_col, F.explode(c).alias("v")).distinct().groupBy(id_col).agg(F.array_sort(F.collect_list("v")).alias(c))
        out = out.join(part, id_col, "left")
    return out.select([c for c in df.columns])


def _folded(docs) -> str:
    return json.dumps(fold([json.loads(d) for d in docs]), ensure_ascii=False, separators=(",", ":"))


def merge_json(df: DataFrame, id_col: str, doc: str, order: str) -> DataFrame:
    """``fold`` of JSON texts per id, in ascending ``order``; a resource's deliveries are few, its rows meet in one group."""
    g = df.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(doc).alias("d"))))["d"].alias("docs"))
    return g.select(id_col, F.when(F.size("docs") == 1, F.get("docs", F.lit(0))).otherwise(arrow_udf(_folded, "string")(F.col("docs"))).alias(doc))


def upsert(old: DataFrame, new: DataFrame, id_col: str = "_id", merge: bool = False, first_wins: tuple[str, ...] = ()) -> DataFrame:
    """Old rows with new ones over them, by id: replaced, or merged column by column.

    With ``merge`` arrays unite and a null never overwrites; columns in
    ``first_wins`` keep their stored value.
    """
    names = [f.name for f in old.schema.fields if f.name != id_col]
    n = new.dropDuplicates([id_col]).select(id_col, *[F.col(c).alias(f"n_{c}") if c in new.columns else F.lit(None).alias(f"n_{c}") for c in names], F.lit(True).alias("__new"))
    both = old.withColumn("__old", F.lit(True)).join(n, id_col, "full_outer")
    out = []
    for f in old.schema.fields:
        if f.name == id_col:
            continue
        o, v = F.col(f.name), F.col(f"n_{f.name}")
        if f.name in first_wins:
            value = F.when(F.col("__old"), o).otherwise(v)
        elif not merge:
            value = F.when(F.col("__new"), v).otherwise(o)
        elif isinstance(f.dataType, T.ArrayType):
            value = F.coalesce(F.array_union(o, v), o, v)
        else:
            value = F.coalesce(v, o)
        out.append(value.alias(f.name))
    return both.select(id_col, *out)


def union_partitions(df: DataFrame, partitions: str, names: list[str]) -> DataFrame:
    """Adds ontologies to the partitions of every row, each once."""
    return df.withColumn(partitions, F.array_union(F.coalesce(F.col(partitions), F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]).cast("array<string>")))


def _uncommented(doc: str | None) -> str | None:
    if doc is None:
        return None
    value = json.loads(doc)
    return json.dumps({k: v for k, v in value.items() if not k.startswith("//")}, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else doc


def without_comments(doc: Column) -> Column:
    """A JSON object without its keys that begin with ``//``, other keys in their order."""
    return arrow_udf(_uncommented, "string")(doc)


def with_arrays(doc: Column, properties: list[str]) -> Column:
    """A JSON object whose values of some properties are lists, a single value as a list of one; null and missing stay."""
    names = set(properties)

    def wrap(text: str | None) -> str | None:
        if text is None:
            return None
        value = json.loads(text)
        return json.dumps({k: [v] if k in names and v is not None and not isinstance(v, list) else v for k, v in value.items()}, ensure_ascii=False, separators=(",", ":"))

    return arrow_udf(wrap, "string")(doc)


def has_key(doc: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def reasoning_status(df: DataFrame, collection: str = "collection", reasoned: str = "reasoned_at") -> DataFrame:
    """Rows, reasoned and unreasoned, per collection and in all (collection null)."""
    done = F.col(reasoned).isNotNull()
    return df.rollup(collection).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("reasoned"), F.count_if(~done).alias("unreasoned"))


def unreasoned_detail(df: DataFrame, partition: Column, types: Column, id_col: str = "_id", reasoned: str = "reasoned_at", examples: int = 5) -> DataFrame:
    """(partition, types, n, examples) of the rows not yet reasoned over, the most first.

    All rows are counted; the examples are the least ids, kept by rank and not by
    gathering a group.
    """
    slim = df.where(F.col(reasoned).isNull()).select(partition.alias("partition"), F.array_join(types, ",").alias("types"), F.col(id_col).alias("id"))
    counts = slim.groupBy("partition", "types").agg(F.count(F.lit(1)).alias("n"))
    w = W.Window.partitionBy("partition", "types").orderBy("id")
    least = slim.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= examples).groupBy("partition", "types").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples"))
    on = counts["partition"].eqNullSafe(least["partition"]) & counts["types"].eqNullSafe(least["types"])
    return counts.join(least, on).select(counts["partition"], counts["types"], "n", "examples")
