"""Triples, statements with content-hash ids, facts and SPARQL text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.operators.ids import let

RDF_TYPE = "rdf:type"
XSD = "http://www.w3.org/2001/XMLSchema#"

#: Schemes that look like a prefix but are none.
NON_PREFIXES = ("file", "ftp", "mailto", "tel", "urn", "data", "javascript", "about")


def js_string(c: Column, kind: T.DataType) -> Column:
    """A scalar as a script would write it: whole numbers without a fraction, booleans in lower case."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def is_qname(term: Column) -> Column:
    """One colon, a plain prefix that is no other scheme, and a local name of letters, digits, ``_``, ``.`` and ``-``."""
    return term.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*:[a-zA-Z0-9_.-]*$") & ~F.lower(F.substring_index(term, ":", 1)).isin(*NON_PREFIXES)


def sparql_term(value: Column, kind: Column) -> Column:
    """A term of a query text: numbers and booleans bare, IRIs in angles, QNames bare, other text quoted.

    ``kind`` is the object's kind: string, number or boolean.
    """
    quoted = value
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(escaped))
    iri = value.rlike(r"^https?://[^\s<>\"{}|\\^`\[\]]+$")
    return F.when(kind.isin("number", "boolean"), value).when(iri, F.concat(F.lit("<"), value, F.lit(">"))).when(is_qname(value), value).otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))


def sparql_lines(triples: DataFrame) -> DataFrame:
    """One ``s p o`` line a triple; the sink joins them with `` .`` so that this stays distributed."""
    text = F.lit("string")
    return triples.select(F.concat_ws(" ", sparql_term(F.col("s"), text), sparql_term(F.col("p"), text), sparql_term(F.col("o"), F.col("kind"))).alias("line"))


def sparql_prefixes(context: dict) -> str:
    """PREFIX lines of the context's namespaces (text values that are http or https IRIs)."""
    names = {k: v for k, v in context.items() if not k.startswith("@") and k != "_id" and isinstance(v, str) and v.startswith(("http://", "https://"))}
    return "".join(f"PREFIX {k}: <{v}>\n" for k, v in names.items())


def write_sparql(triples: DataFrame, context: dict, path: str) -> None:
    """INSERT DATA texts as a folder of files, one a partition; an empty partition writes a comment."""
    head = sparql_prefixes(context)

    def render(rows):
        lines = [r["line"] for r in rows]
        yield ("# No triples to insert" if not lines else head + "\nINSERT DATA {\n  " + " .\n  ".join(lines) + "\n}\n",)

    sparql_lines(triples).rdd.mapPartitions(render).toDF("value string").write.mode("overwrite").text(path)


_ENTRY = "array<struct<p:string,o:string,kind:string>>"


def _entries(col: Column, pred: str, kind: str, inner: T.DataType, many: bool) -> Column:
    """The (p, o, kind) entries of one column's values."""

    def make(v):
        return F.struct(F.lit(pred).alias("p"), js_string(v, inner).alias("o"), F.lit(kind).alias("kind"))

    got = F.transform(F.filter(col, lambda v: v.isNotNull()), make) if many else F.when(col.isNotNull(), F.array(make(col)))
    return F.coalesce(got, F.array().cast(_ENTRY))


def triples(df: DataFrame, id_col: str = "_id", skip: tuple[str, ...] = ()) -> DataFrame:
    """(s, p, o, kind): one row a value of each property column of typed resources.

    Arrays give one triple an element, nulls none; ``at_type`` becomes rdf:type and
    other columns that begin with ``at_`` or ``//``, JSON-valued ones in ``skip`` and
    structs are left out. Rows are unpivoted with one explode, in a single pass.
    """
    entries = []
    for f in df.schema.fields:
        if f.name == id_col or f.name in skip or f.name.startswith("//") or (f.name.startswith("at_") and f.name != "at_type"):
            continue
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(inner, (T.StructType, T.MapType, T.ArrayType)):
            continue
        kind = "boolean" if isinstance(inner, T.BooleanType) else "number" if isinstance(inner, T.NumericType) else "string"
        pred = RDF_TYPE if f.name == "at_type" else f.name
        entries.append(_entries(F.col(f"`{f.name}`"), pred, kind, inner, isinstance(f.dataType, T.ArrayType)))
    if not entries:
        return df.select(F.col(id_col).alias("s"), F.lit("").alias("p"), F.lit("").alias("o"), F.lit("").alias("kind")).where("false")
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("s"), F.explode(F.flatten(F.array(*entries))).alias("t")).select("s", "t.*")


def json_triples(df: DataFrame, doc: str = "doc", id_key: str = "_id") -> DataFrame:
    """Triples of resources kept as JSON text; value objects are unwrapped, embedded resources give their id."""
    values = F.from_json(doc, "map<string,string>")
    flat = df.select(F.coalesce(F.get_json_object(doc, f"$['{id_key}']"), F.get_json_object(doc, "$['@id']")).alias("s"), F.explode(values).alias("p", "v"))
    flat = flat.where(~F.col("p").isin("_id", "@id", "@context") & ~F.col("p").startswith("//") & (~F.col("p").startswith("@") | (F.col("p") == "@type")) & F.col("v").isNotNull())
    items = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    flat = flat.select("s", "p", F.explode(items).alias("o")).where("s is not null and o is not null")
    unwrapped = let(F.col("o"), lambda o: F.when(o.startswith("{"), F.coalesce(F.get_json_object(o, "$['@id']"), F.get_json_object(o, "$['_id']"), F.get_json_object(o, "$['@value']"))).otherwise(o))
    return flat.select("s", F.when(F.col("p") == "@type", RDF_TYPE).otherwise(F.col("p")).alias("p"), unwrapped.alias("o")).where("o is not null")


def statement_id(s: Column, p: Column, o: Column, sources: Column) -> Column:
    """``bold:stmt-`` and 16 hex digits of the hash of ``s|p|o|source``; sources are sorted, so their order does not matter."""
    src = F.coalesce(F.array_join(F.array_sort(sources), ","), F.lit(""))
    return F.concat(F.lit("bold:stmt-"), F.substring(F.sha1(F.concat_ws("|", F.coalesce(s, F.lit("")), F.coalesce(p, F.lit("")), F.coalesce(o, F.lit("")), src)), 1, 16))


def statement_id_of(doc: Column) -> Column:
    """The id of a statement kept as JSON: its source is its partitions, else its provenance; null if a part of it is missing."""
    part = lambda name: unwrap_json(F.get_json_object(doc, f"$['{name}']"))
    s, p, o = (part(f"rdf:{n}") for n in ("subject", "predicate", "object"))
    raw = F.get_json_object(doc, "$['dcterms:isPartOf']")
    many = F.transform(F.from_json(raw, "array<string>"), unwrap_json)
    sources = F.when(raw.startswith("["), many).when(raw.isNotNull(), F.array(unwrap_json(raw))).otherwise(F.array_compact(F.array(part("bold:provenance"))))
    return F.when(s.isNotNull() & p.isNotNull() & o.isNotNull(), statement_id(s, p, o, sources))


def unwrap_json(value: Column) -> Column:
    """What a JSON value stands for: the id or value of an object, else itself."""
    return F.when(value.startswith("{"), F.coalesce(F.get_json_object(value, "$['@id']"), F.get_json_object(value, "$['_id']"), F.get_json_object(value, "$['@value']"))).otherwise(value)


def statements(facts: DataFrame, partitions: DataFrame | None = None, provenance: str | None = None, when_ms: int | None = None, only_subjects: DataFrame | None = None, meta: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Reified statements of inferred facts (subject, predicate, object[, explicit][, rule, inferred_from]).

    Explicit facts are known already and give none. ``partitions`` (subject,
    partitions) names where a subject's statements belong and takes part in the id.
    ``meta`` has further values by predicate, those under ``*`` for all; they come
    out as a map. A rule and what it was inferred from are kept as they are given,
    the least of them if a fact comes more than once.
    """
    rows = facts.where(~F.col("explicit")) if "explicit" in facts.columns else facts
    if only_subjects is not None:
        rows = rows.join(only_subjects.select("subject").distinct(), "subject", "left_semi")
    why = [c for c in ("rule", "inferred_from") if c in rows.columns]
    keys = ["subject", "predicate", "object"]
    rows = rows.groupBy(*keys).agg(*[F.min(c).alias(c) for c in why]) if why else rows.select(*keys).distinct()
    rows = rows.join(partitions, "subject", "left") if partitions is not None else rows.withColumn("partitions", F.lit(None).cast("array<string>"))
    source = F.coalesce(F.col("partitions"), F.array(F.lit(provenance)) if provenance else F.array().cast("array<string>"))
    out = [statement_id(F.col("subject"), F.col("predicate"), F.col("object"), source).alias("_id"), *keys, "partitions", F.lit(provenance).cast("string").alias("provenance"), F.lit(when_ms).cast("bigint").alias("when_ms"), *why]
    if meta is not None:
        made = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map().cast("map<string,string>")
        value = made(meta.get("*", {}))
        for name, own in meta.items():
            if name != "*":
                value = F.when(F.col("predicate") == name, made({**meta.get("*", {}), **own})).otherwise(value)
        out.append(value.alias("meta"))
    return rows.select(*out)


def upsert_statements(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all statements, changed ones): by id, new values win but the first time stays; running again changes nothing."""
    body = [c for c in new.columns if c not in ("_id", "when_ms")]
    o = old.select("_id", *[F.col(c).alias(f"o_{c}") for c in [*body, "when_ms"]]).withColumn("__old", F.lit(True))
    n = new.dropDuplicates(["_id"]).withColumn("__new", F.lit(True))
    both = n.join(o, "_id", "full_outer")
    same = F.lit(True)
    for c in body:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    changed = F.coalesce("__new", F.lit(False)) & (F.col("__old").isNull() | ~same)
    out = both.select("_id", *[F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in body], F.when(F.col("__old"), F.col("o_when_ms")).otherwise(F.col("when_ms")).alias("when_ms"), changed.alias("__changed"))
    return out.drop("__changed"), out.where("__changed").drop("__changed")


def convert_literal(c: Column) -> Column:
    """The lexical value of a written literal: typed, language-tagged or quoted; other text as it is."""
    typed, tagged, quoted = r'^"([\s\S]*)"\^\^<(.*)>$', r'^"([\s\S]*)"@(.*)$', r'^"([\s\S]*)"$'
    return F.when(c.rlike(typed), F.regexp_extract(c, typed, 1)).when(c.rlike(tagged), F.regexp_extract(c, tagged, 1)).when(c.rlike(quoted), F.regexp_extract(c, quoted, 1)).otherwise(c)


def convert_xsd(c: Column) -> Column:
    """struct(lexical, kind, number, flag) of a typed literal; booleans, integers and decimals are converted."""
    pattern = r'^"([\s\S]*)"\^\^<?([^>]*)>?$'
    lexical = F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)
    dtype = F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 2))
    name = F.when(dtype.startswith(XSD), F.substring(dtype, len(XSD) + 1, 100))
    number = F.when(name == "integer", F.regexp_extract(lexical, r"^\s*([+-]?\d+)", 1).try_cast("double")).when(name.isin("decimal", "double", "float"), F.regexp_extract(lexical, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"))
    kind = F.when(name == "boolean", "boolean").when(name.isin("integer", "decimal", "double", "float"), "number").otherwise("string")
    return F.struct(lexical.alias("lexical"), kind.alias("kind"), number.alias("number"), F.when(name == "boolean", lexical == "true").alias("flag"))


FACT_PATTERN = r"^([IE])\(([\s\S]+?), ([\s\S]+?), ([\s\S]+)\)$"


def parse_facts(lines: DataFrame, col: str = "value") -> DataFrame:
    """(subject, predicate, object, explicit) of ``I(s, p, o)`` and ``E(s, p, o)`` texts; literal subjects are left out."""
    c = F.col(col)
    rows = lines.where(c.rlike(FACT_PATTERN)).select(F.regexp_extract(c, FACT_PATTERN, 1).alias("k"), *[F.regexp_extract(c, FACT_PATTERN, i).alias(n) for i, n in ((2, "subject"), (3, "predicate"), (4, "object"))])
    rows = rows.where(~F.col("subject").startswith('"') & (F.col("subject") != "IFALSE"))
    return rows.select("subject", "predicate", convert_literal(F.col("object")).alias("object"), (F.col("k") == "E").alias("explicit"))


def without_blank_nodes(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("subject").startswith("_:") & ~F.col("object").startswith("_:"))


def assemble(facts: DataFrame) -> DataFrame:
    """One row a subject: a map from predicate to its distinct objects, sorted."""
    per = facts.groupBy("subject", "predicate").agg(F.array_sort(F.collect_set("object")).alias("objects"))
    return per.groupBy("subject").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "objects")))).alias("properties"))


def strip_embedded_statements(value):
    """A JSON value without the rdf:Statement resources nested in it."""
    if isinstance(value, list):
        kept = [strip_embedded_statements(v) for v in value if not _is_statement(v)]
        return kept
    if isinstance(value, dict):
        return {k: strip_embedded_statements(v) for k, v in value.items() if not _is_statement(v)}
    return value


def _is_statement(value) -> bool:
    types = value.get("@type") if isinstance(value, dict) else None
    return types is not None and "rdf:Statement" in (types if isinstance(types, list) else [types])


def strip_statements_text(text: str | None) -> str | None:
    return None if text is None else json.dumps(strip_embedded_statements(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
