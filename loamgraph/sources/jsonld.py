"""JSON-LD documents: contexts, a subset of compaction and expansion, import, export and archives."""

from __future__ import annotations

import json
from functools import reduce
from itertools import chain, islice

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.documents import NAMESPACES, STATEMENT_KEYS, Routing, both_forms, deep_merge
from loamgraph.runtime import arrow_udf, materialize
from loamgraph.sources.files import Files, written

XSD = "http://www.w3.org/2001/XMLSchema#"
DEFAULT_CONTEXT = {**NAMESPACES, "xsd": XSD, "_id": "@id"}
#: Ranges whose values are kept as native JSON.
JSON_RANGES = ("bold:JSON", "bui:Schema", "bold:GeoJson", "bold:GeoJSON", "bold:GeoPoint")
PROPERTY_TYPES = ("owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty", "rdf:Property")


def listed(v) -> list:
    return [] if v is None else v if isinstance(v, list) else [v]


def prefixes(context: dict) -> dict[str, str]:
    return {k: v for k, v in context.items() if isinstance(v, str) and not k.startswith("@") and k != "_id"}


def expand_name(name: str, context: dict) -> str:
    """The IRI of a QName or term; keywords, IRIs and blank nodes stay."""
    if name.startswith(("@", "_:")) or "://" in name:
        return name
    term = context.get(name)
    if isinstance(term, str) and term.startswith("@"):
        return term
    if isinstance(term, dict) and "@id" in term:
        return expand_name(term["@id"], context)
    prefix, colon, local = name.partition(":")
    if colon:
        base = prefixes(context).get(prefix)
        return base + local if base else name
    if isinstance(term, str):
        return term
    return context["@vocab"] + name if "@vocab" in context else name


def compact_name(iri: str, context: dict) -> str:
    """The QName of an IRI by the longest namespace that begins it, else the vocabulary's local name, else the IRI."""
    best = max(((p, b) for p, b in prefixes(context).items() if b and iri.startswith(b)), key=lambda x: (len(x[1]), x[0]), default=None)
    if best:
        return f"{best[0]}:{iri[len(best[1]):]}"
    vocab = context.get("@vocab")
    return iri[len(vocab) :] if vocab and iri.startswith(vocab) else iri


def expand(doc: dict, context: dict) -> dict:
    """A resource with IRIs for keys and lists of value objects; typed terms turn text into ids or typed values."""
    ctx = {**context, **(doc.get("@context") if isinstance(doc.get("@context"), dict) else {})}
    out: dict = {}
    for k, v in doc.items():
        if k == "@context" or k.startswith("//"):
            continue
        name = expand_name(k, ctx)
        if name == "@id":
            out["@id"] = expand_name(v, ctx) if isinstance(v, str) else v
        elif name == "@type":
            out["@type"] = [expand_name(t, ctx) for t in listed(v)]
        elif not name.startswith("@"):
            term = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            out.setdefault(name, []).extend(_expand_value(x, term, ctx) for x in (listed(v) if term.get("@type") != "@json" else [v]) if x is not None)
    return out


def _expand_value(v, term: dict, ctx: dict):
    kind = term.get("@type")
    if kind == "@json":
        return {"@value": v, "@type": "@json"}
    if isinstance(v, dict):
        if "@value" in v:
            return {**v, **({"@type": expand_name(v["@type"], ctx)} if "@type" in v else {})}
        return expand(v, ctx)
    if kind == "@id" and isinstance(v, str):
        return {"@id": expand_name(v, ctx)}
    return {"@value": v, "@type": expand_name(kind, ctx)} if kind and isinstance(v, str) else {"@value": v}


def compact(doc: dict, context: dict, id_key: str = "@id") -> dict:
    """An expanded resource with QNames; single values are bare unless the term is a list or set."""
    out: dict = {}
    for k, v in doc.items():
        if k == "@id":
            out[id_key] = compact_name(v, context)
        elif k == "@type":
            out["@type"] = [compact_name(t, context) for t in listed(v)]
        else:
            name = compact_name(k, context)
            term = context.get(name) if isinstance(context.get(name), dict) else {}
            values = [_compact_value(x, term, context) for x in listed(v)]
            out[name] = values if len(values) != 1 or term.get("@container") in ("@set", "@list") else values[0]
    return out


def _compact_value(v, term: dict, ctx: dict):
    if not isinstance(v, dict):
        return v
    if "@value" in v:
        kind = v.get("@type")
        if kind == "@json" or kind is None and "@language" not in v or (kind and term.get("@type") and expand_name(term["@type"], ctx) == kind):
            return v["@value"]
        return {**v, **({"@type": compact_name(kind, ctx)} if kind else {})}
    if set(v) == {"@id"}:
        name = compact_name(v["@id"], ctx)
        return name if term.get("@type") == "@id" else {"@id": name}
    return compact(v, ctx)


#: What becomes of prefixes that sources define differently.
_CANONICAL_DCTERMS = "http://purl.org/dc/terms/"


def merge_contexts(old: dict, new: dict) -> dict:
    """Two contexts as one, sorted; raises where a name has two meanings.

    The known exceptions: ``dc`` takes its elements namespace, ``dcterms`` the
    canonical one, ``bold`` the new value; term definitions merge.
    """
    out = dict(old)
    for k, v in new.items():
        had = out.get(k)
        if not had or had == v:
            out[k] = v
        elif k == "dc" and v == "http://purl.org/dc/elements/1.1/" or k == "bold":
            out[k] = v
        elif k == "dcterms":
            out[k] = _CANONICAL_DCTERMS
        elif isinstance(had, dict) and isinstance(v, dict):
            out[k] = deep_merge(had, v)
        else:
            raise ValueError(f"namespace conflict for {k}: {had!r} and {v!r}")
    return sort_context(out)


def sort_context(context: dict) -> dict:
    """Keywords first, then namespaces, then terms with a prefix, each by name."""
    return {k: context[k] for k in sorted(context, key=lambda k: (":" in k, not k.startswith("@"), k))}


def property_term(prop: dict) -> dict:
    """The context term of a property from its range and container."""
    term: dict = {}
    kinds, ranges = listed(prop.get("@type")), [r.get("@id") if isinstance(r, dict) else r for r in listed(prop.get("rdfs:range"))]
    if prop.get("bold:isJsonProperty") or any(r in JSON_RANGES for r in ranges):
        term["@type"] = "@json"
    elif any(isinstance(r, str) and r.startswith("xsd:") for r in ranges):
        term["@type"] = next(XSD + r[4:] for r in ranges if isinstance(r, str) and r.startswith("xsd:"))
    elif "owl:ObjectProperty" in kinds:
        term["@type"] = "@id"
    if prop.get("bold:container") in ("@list", "@set"):
        term["@container"] = prop["bold:container"]
    return term


def is_json_property(prop: str, ontology: dict[str, dict]) -> bool:
    return prop == "bui:schema" or property_term(ontology.get(prop, {})).get("@type") == "@json"


def context_and_resources(data) -> tuple[dict, list[dict]]:
    """(context, resources) of a document: an array with contexts among its items, an ``@graph``, or one resource."""
    if isinstance(data, list):
        context: dict = {}
        for x in data:
            if isinstance(x, dict) and isinstance(x.get("@context"), dict):
                context.update(x["@context"])
        return context, [x for x in data if isinstance(x, dict) and "@context" not in x]
    if isinstance(data, dict) and isinstance(data.get("@graph"), list):
        return data.get("@context") if isinstance(data.get("@context"), dict) else {}, [x for x in data["@graph"] if isinstance(x, dict)]
    return {}, [data] if isinstance(data, dict) else []


RESOURCE_SCHEMA = "collection string, _id string, types array<string>, partitions array<string>, doc string, error string"
ROW_SCHEMA = "delivery int, position bigint, kind string, value string, partitions array<string>"
#: Terms that the ontology may add to a context, which is a document of the driver.
MAX_TERMS = 200_000


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of JSON-LD files, each read whole, in parallel over files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _rows_of(data, delivery: int) -> list[tuple]:
    """The context and the resources of a document as rows; leading ontologies are the partitions of the others."""
    context, resources = context_and_resources(data)
    leading = []
    for r in resources:
        if "owl:Ontology" not in listed(r.get("@type")):
            break
        leading.append(r.get("@id") or r.get("_id"))
    rows = [(delivery, -1, "context", json.dumps(context, ensure_ascii=False), [])] if context else []
    return rows + [(delivery, k, "resource", json.dumps(r, ensure_ascii=False), leading) for k, r in enumerate(resources)]


def read_resources(documents: DataFrame) -> DataFrame:
    """``ROW_SCHEMA`` rows of documents (delivery, value), parsed where they are; a document that is no JSON is one row of kind error."""

    def parse(batches):
        for pdf in batches:
            rows = []
            for delivery, text in zip(pdf["delivery"], pdf["value"]):
                try:
                    rows += _rows_of(json.loads(text), int(delivery))
                except (ValueError, RecursionError) as e:
                    rows.append((int(delivery), -1, "error", str(e)[:500], []))
            yield pd.DataFrame(rows, columns=["delivery", "position", "kind", "value", "partitions"])

    return documents.select("delivery", "value").mapInPandas(parse, ROW_SCHEMA)


def settle_context(rows: DataFrame, context: dict) -> tuple[dict, dict[int, str]]:
    """(context, deliveries that can not be merged into it and why): all contexts in order, then the terms of the ontology's properties.

    Only contexts and terms come to the driver, at most ``MAX_TERMS``.
    """
    ctx, refused = dict(context), {}
    for r in rows.where("kind <> 'resource'").orderBy("delivery").collect():
        try:
            if r["kind"] == "error":
                raise ValueError(r["value"])
            ctx = merge_contexts(ctx, json.loads(r["value"]))
        except ValueError as e:
            refused[r["delivery"]] = str(e)
    kinds = set(both_forms(PROPERTY_TYPES))

    def terms(batches):
        for pdf in batches:
            out = []
            for delivery, position, text in zip(pdf["delivery"], pdf["position"], pdf["value"]):
                r = json.loads(text)
                if set(map(str, listed(r.get("@type")))) & kinds and isinstance(r.get("@id") or r.get("_id"), str) and (term := property_term(r)):
                    out.append((delivery, position, r.get("@id") or r.get("_id"), json.dumps(term)))
            yield pd.DataFrame(out, columns=["delivery", "position", "id", "term"])

    likely = rows.where("kind = 'resource'").where(F.col("value").contains("Property"))
    found = likely.select("delivery", "position", "value").mapInPandas(terms, "delivery int, position bigint, id string, term string").limit(MAX_TERMS + 1).collect()
    if len(found) > MAX_TERMS:
        raise ValueError(f"the ontology has more than {MAX_TERMS} terms")
    for r in sorted(found):
        if r["delivery"] not in refused:
            name = compact_name(expand_name(r["id"], ctx), ctx)
            if not isinstance(ctx.get(name), str):
                ctx[name] = {**json.loads(r["term"]), **(ctx.get(name) or {})}
    return sort_context(ctx), refused


def import_data(spark: SparkSession, data, context: dict | None = None, routing: Routing = Routing(), add_partitions: bool = False, before_save=None, stored: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """(resources, context) of one document that the caller holds; see ``import_rows``."""
    rows = spark.createDataFrame(_rows_of(data, 0), ROW_SCHEMA)
    ctx, refused = settle_context(rows, {**DEFAULT_CONTEXT, **(context or {})})
    if refused:
        raise ValueError(next(iter(refused.values())))
    return normalise(rows, ctx, routing, add_partitions, before_save, stored), ctx


def normalise(rows: DataFrame, context: dict, routing: Routing = Routing(), add_partitions: bool = False, before_save=None, stored: DataFrame | None = None) -> DataFrame:
    """``ROW_SCHEMA`` rows made resources: expanded and compacted in batches, routed, and joined by collection and id.

    Errors stay as rows with ``error`` set. Deliveries of one resource take effect
    in order of (delivery, position): in the ontology and among statements they
    merge, elsewhere the last replaces those before it. A resource without types
    belongs to the ontology if its id stands there, in this import or in ``stored``.
    The context is settled before, so it does not depend on that order.
    """
    shared = rows.sparkSession.sparkContext.broadcast(context)

    def one(text: str, partitions):
        try:
            doc = compact(expand(json.loads(text), shared.value), shared.value, "_id")
            if not isinstance(doc.get("_id"), str) or not doc["_id"]:
                return None, None, None, text, "a resource needs an id"
            doc["@type"] = listed(doc.get("@type"))
            if all(k in doc for k in STATEMENT_KEYS) and "rdf:Statement" not in doc["@type"]:
                doc["@type"].append("rdf:Statement")
            if len(partitions) and "owl:Ontology" not in doc["@type"]:
                doc["dcterms:isPartOf"] = list(dict.fromkeys([*(p.get("@id", p) if isinstance(p, dict) else p for p in listed(doc.get("dcterms:isPartOf"))), *partitions]))
            doc = before_save(doc) if before_save else doc
            if not doc:
                return None
            parts = [p.get("@id") if isinstance(p, dict) else p for p in listed(doc.get("dcterms:isPartOf"))]
            return doc["_id"], doc["@type"], [p for p in parts if isinstance(p, str)], json.dumps(doc, ensure_ascii=False, separators=(",", ":")), None
        except (ValueError, TypeError, AttributeError, KeyError) as e:
            return None, None, None, text, f"{type(e).__name__}: {e}"[:500]

    def batch(batches):
        for pdf in batches:
            out = [(d, p, *x) for d, p, t, parts in zip(pdf["delivery"], pdf["position"], pdf["value"], pdf["partitions"]) if (x := one(t, parts if add_partitions else ())) is not None]
            yield pd.DataFrame(out, columns=["delivery", "position", "_id", "types", "partitions", "doc", "error"], dtype=object)

    flat = rows.where("kind = 'resource'").mapInPandas(batch, "delivery int, position bigint, _id string, types array<string>, partitions array<string>, doc string, error string")
    flat = materialize(flat)
    errors = flat.where("error is not null").select(F.lit(None).cast("string").alias("collection"), "_id", "types", "partitions", "doc", "error")
    good = flat.where("error is null").withColumn("collection", routing.collection(F.col("_id"), F.col("types")))
    if not flat.where("error is null and size(types) = 0").isEmpty():
        tbox = good.where((F.col("collection") == routing.ontology) & (F.size("types") > 0)).select("_id")
        if stored is not None:
            tbox = tbox.unionByName(stored.where(F.col("collection") == routing.ontology).select("_id"))
        good = good.join(tbox.distinct().withColumn("__known", F.lit(True)), "_id", "left")
        good = good.withColumn("collection", F.when((F.size("types") == 0) & F.col("__known"), routing.ontology).otherwise(F.col("collection")))
    when = F.struct("delivery", "position")
    united = lambda c: F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct(when.alias("w"), F.col(c).alias("v"))))["v"])).alias(c)
    merges = F.col("collection").isin(routing.ontology, routing.statements)
    last = good.where(~merges).groupBy("collection", "_id").agg(F.max_by(F.struct("types", "partitions", "doc"), when).alias("r")).select("collection", "_id", "r.*")
    merged = good.where(merges).groupBy("collection", "_id").agg(united("types"), united("partitions"), F.array_sort(F.collect_list(F.struct(when.alias("w"), F.col("doc").alias("v"))))["v"].alias("docs"))
    merged = merged.withColumn("doc", F.when(F.size("docs") == 1, F.get("docs", F.lit(0))).otherwise(arrow_udf(deep_folded, "string")(F.col("docs")))).drop("docs")
    return last.unionByName(merged).withColumn("error", F.lit(None).cast("string")).unionByName(errors)


def deep_folded(docs) -> str:
    """JSON texts saved one over the other."""
    return json.dumps(reduce(deep_merge, [json.loads(d) for d in docs]), ensure_ascii=False, separators=(",", ":"))


def save(stored: DataFrame, incoming: DataFrame, routing: Routing = Routing(), share_tbox: str | None = None, share_statements: str | None = None) -> DataFrame:
    """The stored resources with the incoming ones saved over them, by collection and id.

    Ontology and statements merge with what is stored, other resources replace it.
    With ``share_tbox`` or ``share_statements`` the incoming ontology or statements
    are also written to that collection, where they replace. Rows with an error are
    not saved.
    """
    new = incoming.where("error is null").drop("error")
    for source, target in ((routing.ontology, share_tbox), (routing.statements, share_statements)):
        if target:
            new = new.unionByName(incoming.where("error is null").drop("error").where(F.col("collection") == source).withColumn("collection", F.lit(target)))
    n = new.select("collection", "_id", F.struct("types", "partitions", "doc").alias("n"))
    both = stored.select("collection", "_id", F.struct("types", "partitions", "doc").alias("o")).join(n, ["collection", "_id"], "full_outer")
    merges = F.col("collection").isin(routing.ontology, routing.statements) & F.col("o").isNotNull() & F.col("n").isNotNull()
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    united = lambda c: F.when(merges, F.array_union(f"o.{c}", f"n.{c}")).otherwise(pick(c)).alias(c)
    docs = F.when(merges, F.array("o.doc", "n.doc")).otherwise(F.array(pick("doc")))
    return both.select("collection", "_id", united("types"), united("partitions"), F.when(F.size(docs) == 1, F.get(docs, F.lit(0))).otherwise(arrow_udf(deep_folded, "string")(docs)).alias("doc"))


def import_stats(resources: DataFrame) -> DataFrame:
    """Counters of an import in one row."""
    ok = F.col("error").isNull()
    return resources.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("errors"), F.count_if(ok & (F.col("collection") == "ontology")).alias("tbox"), F.count_if(ok & (F.col("collection") == "statements")).alias("statements"), F.count_if(ok & ~F.col("collection").isin("ontology", "statements")).alias("abox"))


def bootstrap(spark: SparkSession, paths: list[str], routing: Routing = Routing(), add_partitions: bool = False, stored: DataFrame | None = None) -> tuple[DataFrame | None, dict, list[tuple[str, str]]]:
    """(resources, context, failures) of files imported in order as deliveries of one table, read and parsed by the executors.

    A failure of the first file is fatal, later ones are recorded and skipped.
    """
    documents, failed = None, []
    for k, p in enumerate(paths):
        try:
            part = load_documents(spark, p).select(F.lit(k).alias("delivery"), "value")
        except AnalysisException as e:  # no such file
            if k == 0:
                raise OSError(f"{p}: {e}") from e
            failed.append((p, str(e)[:500]))
            continue
        documents = part if documents is None else documents.unionByName(part)
    if documents is None:
        return None, {}, failed
    rows = materialize(read_resources(documents))
    context, refused = settle_context(rows, DEFAULT_CONTEXT)
    if 0 in refused:
        raise ValueError(f"{paths[0]}: {refused[0]}")
    failed += [(paths[k], why) for k, why in sorted(refused.items())]
    kept = rows.where(~F.col("delivery").isin(list(refused))) if refused else rows
    return normalise(kept, context, routing, add_partitions, None, stored), context, failed


def export_documents(resources: DataFrame, context: dict, expanded: bool = False) -> DataFrame:
    """One JSON text a resource, ``_id`` as ``@id``, compact or expanded; stays distributed for ``df.write.text``."""
    shared = resources.sparkSession.sparkContext.broadcast(context)

    def one(doc: str) -> str:
        d = json.loads(doc)
        d = {("@id" if k == "_id" else k): v for k, v in d.items()}
        return json.dumps(expand(d, shared.value) if expanded else d, ensure_ascii=False, separators=(",", ":"))

    good = resources.where("error is null") if "error" in resources.columns else resources
    return good.where("doc is not null").select(arrow_udf(one, "string")(F.col("doc")).alias("value"))


def export_file(resources: DataFrame, context: dict, path: str) -> int:
    """One file: a single resource with its context inside, several under ``@graph``; rows are streamed to it.

    The path may be of any file system the session knows; it appears only when complete.
    """
    rows = export_documents(resources.orderBy("_id"), context).toLocalIterator()
    head = list(islice(rows, 2))
    with written(resources.sparkSession, path) as put:
        if len(head) == 1:
            put(json.dumps({"@context": context, **json.loads(head[0]["value"])}, ensure_ascii=False))
            return 1
        put('{"@context":' + json.dumps(context, ensure_ascii=False) + ',"@graph":[')
        n = 0
        for row in chain(head, rows):
            put(("," if n else "") + "\n" + row["value"])
            n += 1
        put("\n]}\n")
    return n


def dump_archive(tables: dict[str, DataFrame], path: str) -> int:
    """All tables as parquet, written beside and then renamed, so an archive is whole or not there; bytes written."""
    fs = Files(SparkSession.active(), path)
    fs.delete(f"{path}.tmp")
    for name, df in tables.items():
        df.write.parquet(f"{path}.tmp/{name}")
    fs.delete(path)
    fs.rename(f"{path}.tmp", path)
    return fs.size(path)


def restore_archive(spark: SparkSession, path: str, rename: tuple[str, str] | None = None, into: str | None = None) -> dict[str, DataFrame]:
    """The tables of an archive, a name's leading part replaced if asked (both parts or neither).

    With ``into`` each table also replaces the one of its name in that folder.
    """
    if rename and not all(rename):
        raise ValueError("give both names or neither")
    out = {}
    for name in Files(spark, path).names(path):
        a, b = rename or ("", "")
        target = b + name[len(a) :] if rename and name.startswith(a) else name
        out[target] = spark.read.parquet(f"{path}/{name}")
        if into:
            out[target].write.mode("overwrite").parquet(f"{into}/{target}")
            out[target] = spark.read.parquet(f"{into}/{target}")
    return out


def embedded(doc: DataFrame, col: str = "doc") -> DataFrame:
    """(_id, type) of resources nested in documents (objects with a type that are no statement)."""

    def walk(text):
        out = []

        def go(v, top):
            if isinstance(v, list):
                for x in v:
                    go(x, False)
            elif isinstance(v, dict):
                kinds = listed(v.get("@type"))
                if kinds and not top and "rdf:Statement" not in kinds:
                    out.extend(str(k) for k in kinds)
                for k, x in v.items():
                    if k != "@context":
                        go(x, False)

        try:
            go(json.loads(text), True)
        except (ValueError, TypeError):
            pass
        return out

    return doc.select("_id", F.explode(arrow_udf(walk, "array<string>")(F.col(col))).alias("type"))
