"""Forward chaining of class and property rules over distributed triples.

The rules that need one triple are drawn from the ontology into one table of
actions by class and property, with the hierarchies closed beforehand. A round
looks up the triples found new in the round before in that table, with one
broadcast join, and writes only what is new again. Rules of two triples join the
few triples that their axioms select. Rule names are those of the public OWL 2 RL
profile.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.documents import Routing, fold
from loamgraph.operators.hierarchy import closure
from loamgraph.operators.rdf import json_triples, statements
from loamgraph.runtime import arrow_udf, join_checked, materialize

RULES = ("cax-sco", "prp-spo1", "prp-dom", "prp-rng", "prp-inv", "prp-symp", "prp-trp", "cls-avf", "cls-int1", "cls-uni")
MAX_ROUNDS = 50

#: What an action makes of a triple (s, p, o) and its target.
_TYPE_OF_S, _TYPE_OF_O, _SAME, _TURNED = range(4)


def _axioms(tbox: DataFrame, p: str) -> DataFrame:
    return tbox.where(F.col("p") == p).select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()


def _hierarchies(tbox: DataFrame) -> DataFrame:
    """(p, a, b): both hierarchies closed at once; a name is told apart by the property that it is below."""
    edges = tbox.where(F.col("p").isin("rdfs:subClassOf", "rdfs:subPropertyOf")).select(F.concat_ws(" ", "p", "s").alias("child"), F.concat_ws(" ", "p", "o").alias("parent"))
    up = closure(edges).where("node <> ancestor")
    tail = lambda c: F.substr(F.col(c), F.instr(F.col(c), " ") + 1)
    return materialize(up.select(F.substring_index("node", " ", 1).alias("p"), tail("node").alias("a"), tail("ancestor").alias("b")))


#: What the axioms of each rule look like: a property of the ontology, or a class that its properties have.
_NEEDS = {
    "cax-sco": "rdfs:subClassOf", "prp-spo1": "rdfs:subPropertyOf", "prp-dom": "rdfs:domain", "prp-rng": "rdfs:range", "prp-inv": "owl:inverseOf", "prp-symp": "owl:SymmetricProperty",
    "prp-trp": "owl:TransitiveProperty", "cls-avf": "owl:allValuesFrom", "cls-int1": "owl:intersectionOf", "cls-uni": "owl:unionOf",
}


def _in_use(tbox: DataFrame, rules: tuple[str, ...]) -> tuple[str, ...]:
    """The rules for which there are axioms."""
    term = F.when(F.col("p") == "rdf:type", F.col("o")).otherwise(F.col("p"))
    there = {r[0] for r in tbox.select(term.alias("t")).where(F.col("t").isin(*_NEEDS.values())).distinct().collect()}
    return tuple(r for r in rules if _NEEDS[r] in there)


def _kind(tbox: DataFrame, name: str) -> DataFrame:
    return tbox.where((F.col("p") == "rdf:type") & (F.col("o") == name)).select(F.col("s").alias("a")).distinct()


def _actions(tbox: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """(is_type, key, acts): what follows from a type (key is the class) or from another triple (key is its property)."""
    inverse = _axioms(tbox, "owl:inverseOf")
    inverse = inverse.unionByName(inverse.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    symmetric = _kind(tbox, "owl:SymmetricProperty").withColumn("b", F.col("a"))
    union = _axioms(tbox, "owl:unionOf").select(F.col("b").alias("a"), F.col("a").alias("b"))
    up = _hierarchies(tbox) if {"cax-sco", "prp-spo1"} & set(rules) else None
    sources = {
        "cax-sco": (True, _TYPE_OF_S, lambda: up.where("p = 'rdfs:subClassOf'")),
        "prp-spo1": (False, _SAME, lambda: up.where("p = 'rdfs:subPropertyOf'")),
        "prp-dom": (False, _TYPE_OF_S, lambda: _axioms(tbox, "rdfs:domain")),
        "prp-rng": (False, _TYPE_OF_O, lambda: _axioms(tbox, "rdfs:range")),
        "prp-inv": (False, _TURNED, lambda: inverse),
        "prp-symp": (False, _TURNED, lambda: symmetric),
        "cls-uni": (True, _TYPE_OF_S, lambda: union),
    }
    parts = []
    for rule, (is_type, form, pairs) in sources.items():
        if rule in rules:
            act = F.struct(F.lit(RULES.index(rule)).alias("rule"), F.lit(form).alias("form"), F.col("b").alias("target"))
            parts.append(pairs().select(F.lit(is_type).alias("is_type"), F.col("a").alias("key"), act.alias("act")))
    if not parts:
        return tbox.select(F.lit(True).alias("is_type"), F.col("s").alias("key"), F.array().cast("array<struct<rule:int,form:int,target:string>>").alias("acts")).where("false")
    return reduce(DataFrame.unionByName, parts).groupBy("is_type", "key").agg(F.collect_list("act").alias("acts"))


def infer(abox: DataFrame, tbox: DataFrame, rules: tuple[str, ...] = RULES, keep_blank: bool = False) -> DataFrame:
    """(s, p, o, rule): the triples that follow and were not given.

    ``abox`` and ``tbox`` are triples (s, p, o). A triple that several rules give
    names the first in the order of ``RULES``. Blank nodes take part, but
    triples of them are left out of the result unless kept; nulls give nothing; empty tables give no rows.
    """
    unknown = set(rules) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    tbox = materialize(tbox.select("s", "p", "o").dropna().distinct())
    given = materialize(abox.select("s", "p", "o").dropna().distinct())
    rules = _in_use(tbox, rules)
    actions = materialize(_actions(tbox, rules))
    pairs = _pair_rules(tbox, rules)

    found: list[DataFrame] = []
    fresh = given.withColumn("rule", F.lit(-1))
    for _ in range(MAX_ROUNDS):
        known = reduce(DataFrame.unionByName, [given, *(f.drop("rule") for f in found)])
        out = [_applied(fresh, actions), *(make(fresh.drop("rule"), known) for make in pairs)]
        new = reduce(DataFrame.unionByName, out).where("s is not null and o is not null")
        new = new.groupBy("s", "p", "o").agg(F.min("rule").alias("rule")).join(known, ["s", "p", "o"], "left_anti")
        new = materialize(new)
        if new.isEmpty():
            break
        found.append(new)
        fresh = new
    else:
        raise RuntimeError(f"no fixpoint within {MAX_ROUNDS} rounds")
    names = F.array(*[F.lit(r) for r in RULES])
    every = reduce(DataFrame.unionByName, found) if found else given.withColumn("rule", F.lit(0)).where("false")
    every = every.select("s", "p", "o", F.get(names, F.col("rule")).alias("rule"))
    return every if keep_blank else every.where(~F.col("s").startswith("_:") & ~F.col("o").startswith("_:"))


def _applied(fresh: DataFrame, actions: DataFrame) -> DataFrame:
    """What the one-triple rules make of the fresh triples.

    The hierarchies are closed, so what a hierarchy gave needs no further step up the same one.
    """
    is_type = F.col("p") == "rdf:type"
    keyed = fresh.select("s", "p", "o", F.col("rule").alias("by"), is_type.alias("is_type"), F.when(is_type, F.col("o")).otherwise(F.col("p")).alias("key"))
    closed = [RULES.index("cax-sco"), RULES.index("prp-spo1")]
    each = join_checked(keyed, actions, ["is_type", "key"]).select("s", "p", "o", "by", F.explode("acts").alias("act"))
    each = each.where(~(F.col("by").isin(closed) & (F.col("act.rule") == F.col("by"))))
    form, target = F.col("act.form"), F.col("act.target")
    return each.select(
        F.when(form.isin(_TYPE_OF_O, _TURNED), F.col("o")).otherwise(F.col("s")).alias("s"),
        F.when(form.isin(_TYPE_OF_S, _TYPE_OF_O), "rdf:type").otherwise(target).alias("p"),
        F.when(form == _SAME, F.col("o")).when(form == _TURNED, F.col("s")).otherwise(target).alias("o"),
        F.col("act.rule").alias("rule"),
    )


def _pair_rules(tbox: DataFrame, rules: tuple[str, ...]) -> list:
    """The rules of several triples that have axioms, as functions of (fresh, known)."""
    out = []
    avf = tbox.where("p = 'owl:allValuesFrom'").select(F.col("s").alias("r"), F.col("o").alias("filler")).join(tbox.where("p = 'owl:onProperty'").select(F.col("s").alias("r"), F.col("o").alias("a")), "r")
    members = _axioms(tbox, "owl:intersectionOf")
    tables = {"prp-trp": _kind(tbox, "owl:TransitiveProperty"), "cls-avf": avf, "cls-int1": members}
    makers = {"prp-trp": _transitive, "cls-avf": _all_values, "cls-int1": _intersection}
    for rule, axioms in tables.items():
        if rule in rules:
            axioms = materialize(axioms)
            out.append(lambda fresh, known, make=makers[rule], axioms=axioms, n=RULES.index(rule): make(fresh, known, axioms).select("s", "p", "o", F.lit(n).alias("rule")))
    return out


def _transitive(fresh: DataFrame, known: DataFrame, axioms: DataFrame) -> DataFrame:
    props = axioms.select(F.col("a").alias("p"))
    left, every = join_checked(fresh, props, ["p"], "left_semi"), join_checked(known, props, ["p"], "left_semi")
    right = every.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"))
    on = lambda a, b: (F.col(a) == F.col(b)) & (F.col("p") == F.col("p2"))
    return left.join(right, on("o", "s2")).select("s", "p", F.col("o2").alias("o")).unionByName(left.join(right, on("s", "o2")).select(F.col("s2").alias("s"), "p", "o"))


def _all_values(fresh: DataFrame, known: DataFrame, axioms: DataFrame) -> DataFrame:
    typed = known.where("p = 'rdf:type'").select(F.col("s").alias("x"), F.col("o").alias("r"))
    has = join_checked(typed, axioms, ["r"]).select("x", "a", "filler")
    values = join_checked(known.select(F.col("s").alias("x"), F.col("p").alias("a"), F.col("o").alias("y")), materialize(axioms.select("a").distinct()), ["a"], "left_semi")
    return has.join(values, ["x", "a"]).select(F.col("y").alias("s"), F.lit("rdf:type").alias("p"), F.col("filler").alias("o"))


def _intersection(fresh: DataFrame, known: DataFrame, axioms: DataFrame) -> DataFrame:
    size = axioms.groupBy("a").agg(F.count(F.lit(1)).alias("need"))
    sized = materialize(axioms.join(size, "a"))
    got = join_checked(known.where("p = 'rdf:type'").select("s", F.col("o").alias("b")).distinct(), sized, ["b"])
    full = got.groupBy("s", "a", "need").agg(F.count(F.lit(1)).alias("have")).where("have = need")
    return full.select("s", F.lit("rdf:type").alias("p"), F.col("a").alias("o"))


def inconsistencies(triples: DataFrame, tbox: DataFrame) -> DataFrame:
    """(s, rule, detail): subjects that break the ontology.

    ``cax-dw`` two disjoint classes, ``cax-adc`` two of a list of disjoint classes,
    ``prp-irp`` an irreflexive property that loops, ``prp-asyp`` an asymmetric one
    both ways, ``prp-pdw`` two disjoint properties with one value. Lists of disjoint
    classes are counted per subject, not made into pairs.
    """
    triples = triples.select("s", "p", "o").dropna()
    tbox = materialize(tbox.select("s", "p", "o").dropna().distinct())
    types = triples.where("p = 'rdf:type'").select("s", F.col("o").alias("c")).distinct()
    ordered = lambda p: materialize(_axioms(tbox, p).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    pairs = ordered("owl:disjointWith")
    dw = join_checked(types.withColumnRenamed("c", "a"), pairs, ["a"]).join(types.withColumnRenamed("c", "b"), ["s", "b"])
    lists = materialize(_kind(tbox, "owl:AllDisjointClasses").join(_axioms(tbox, "owl:members"), "a"))
    adc = join_checked(types.withColumnRenamed("c", "b"), lists, ["b"]).groupBy("s", "a").agg(F.array_sort(F.collect_set("b")).alias("cs")).where("size(cs) > 1")
    of = lambda name: materialize(_kind(tbox, name).select(F.col("a").alias("p")))
    loops = join_checked(triples.where("s = o"), of("owl:IrreflexiveProperty"), ["p"])
    one = join_checked(triples, of("owl:AsymmetricProperty"), ["p"])
    both = one.join(one.select(F.col("s").alias("o"), "p", F.col("o").alias("s")), ["s", "p", "o"])
    apart = ordered("owl:propertyDisjointWith")
    first = join_checked(triples.withColumnRenamed("p", "a"), apart, ["a"])
    second = join_checked(triples.withColumnRenamed("p", "b"), materialize(apart.select("b").distinct()), ["b"], "left_semi")
    pdw = first.join(second, ["s", "b", "o"])
    row = lambda df, rule, detail: df.select("s", F.lit(rule).alias("rule"), detail.alias("detail"))
    out = [
        row(dw, "cax-dw", F.concat_ws("|", "a", "b")), row(adc, "cax-adc", F.array_join("cs", "|")), row(loops, "prp-irp", F.col("p")),
        row(both, "prp-asyp", F.concat_ws("|", "p", "o")), row(pdw, "prp-pdw", F.concat_ws("|", "a", "b", "o")),
    ]
    return reduce(DataFrame.unionByName, out).distinct()


def reason_collection(resources: DataFrame, triples: DataFrame, tbox: DataFrame, now_ms: int, id_col: str = "_id", reasoned: str = "reasoned_at") -> tuple[DataFrame, DataFrame]:
    """(inferred triples, resources stamped) of the rows not yet reasoned over.

    Only subjects that got an inference are stamped, so the others are taken up again.
    """
    open_ = resources.where(F.col(reasoned).isNull()).select(F.col(id_col).alias("s"))
    inferred = materialize(infer(triples.join(open_, "s", "left_semi"), tbox))
    got = inferred.select(F.col("s").alias(id_col)).distinct().withColumn("__hit", F.lit(True))
    stamped = resources.join(got, id_col, "left").withColumn(reasoned, F.when(F.col("__hit"), F.timestamp_millis(F.lit(now_ms))).otherwise(F.col(reasoned))).drop("__hit")
    return inferred, stamped


#: Collections that are never reasoned over.
NEVER_REASONED = ("statements",)


def reasoning_order(names: list[str], first: list[str] = (), never: tuple[str, ...] = NEVER_REASONED) -> list[str]:
    """The collections to reason over: the named ones that there are, each once, then the others as they are registered."""
    every = [n for n in names if n not in never]
    named = list(dict.fromkeys(n for n in first if n in every))
    return [*named, *(n for n in every if n not in named)]


def schema_closure(tbox: DataFrame) -> DataFrame:
    """(s, p, o, rule): superclasses and superproperties that the ontology implies and does not state."""
    up = _hierarchies(tbox.select("s", "p", "o").dropna().distinct())
    rule = F.when(F.col("p") == "rdfs:subClassOf", "scm-sco").otherwise("scm-spo")
    implied = up.select(F.col("a").alias("s"), "p", F.col("b").alias("o"), rule.alias("rule"))
    return implied.join(tbox.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")


def bootstrap_reasoner(ontology: DataFrame, old: DataFrame, provenance: str, now: str, now_ms: int, routing: Routing = Routing()) -> tuple[DataFrame, DataFrame]:
    """(ontology, statements) after the ontology was reasoned over: implied values merged in, their statements in place of those of the same provenance.

    ``ontology`` is (collection, _id, types, partitions, doc); ``old`` are all
    statements as ``rdf.statements`` makes them.
    """
    mine = F.col("provenance").eqNullSafe(F.lit(provenance))
    # What an earlier run inferred is no premise, so a second run infers it again.
    earlier = old.where(mine).select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))
    tri = materialize(json_triples(ontology).select("s", "p", "o").join(earlier, ["s", "p", "o"], "left_anti"))
    inferred = materialize(infer(tri, tri).unionByName(schema_closure(tri)).where(~F.col("s").startswith("_:") & ~F.col("o").startswith("_:")))
    merged, _ = merge_and_update(ontology, inferred.drop("rule"), now, routing)
    facts = inferred.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"))
    made = statements(facts, None, provenance, now_ms)
    kept = old.where(~mine)
    return merged, kept.unionByName(made.select(*kept.columns))


class Reasoner:
    """The ontology's triples, loaded once for all who ask at the same time, and passes over collections with it."""

    def __init__(self, load: Callable[[], DataFrame]):
        self._load, self._tbox, self._lock = load, None, threading.Lock()

    def ensure(self) -> DataFrame:
        """The triples of the ontology, loaded by the first who asks; a failure is not kept."""
        with self._lock:
            if self._tbox is None:
                self._tbox = materialize(self._load())
            return self._tbox

    def forget(self) -> None:
        """The next to ask loads the ontology anew."""
        with self._lock:
            self._tbox = None

    def reason(self, resources: DataFrame, names: list[str], now: str, first: list[str] = (), provenance: str | None = None) -> tuple[DataFrame, DataFrame | None, dict]:
        """(resources, statements, counts and seconds) of a pass over collections, in order; later ones see what earlier ones gave.

        Only resources that carry no stamp are taken up, and only those that get an
        inference are stamped.
        """
        tbox, made, totals = self.ensure(), None, {"resources": 0, "inferred": 0, "written": 0, "seconds": {}}
        for name in reasoning_order(names, list(first)):
            began = time.perf_counter()
            open_ = resources.where((F.col("collection") == name) & F.get_json_object("doc", f"$['{REASONED}']").isNull())
            totals["resources"] += open_.count()
            inferred = materialize(infer(json_triples(open_), tbox))
            mine = inferred.join(open_.select(F.col("_id").alias("s")).distinct(), "s", "left_semi")
            updated, written = merge_and_update(resources.where(F.col("collection") == name), mine.drop("rule"), now)
            resources = materialize(resources.where(F.col("collection") != name).unionByName(updated.select(*resources.columns)))
            facts = mine.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), "rule")
            where = open_.select(F.col("_id").alias("subject"), "partitions").where("size(partitions) > 0").dropDuplicates(["subject"])
            part = statements(facts, where, provenance)
            made = part if made is None else made.unionByName(part)
            totals["inferred"] += mine.count()
            totals["written"] += written.count()
            totals["seconds"][name] = time.perf_counter() - began
        return resources, made, totals


REASONED = "bold:reasoned"


def _merged_doc(doc: str | None, facts: str) -> str:
    """A resource with inferred values joined in; without the stamp, so that it can be compared."""
    old, new = json.loads(doc) if doc else {}, json.loads(facts)
    old.pop(REASONED, None)
    merged = fold([old, {"_id": old["_id"], **new}]) if old.get("_id") else new
    return json.dumps(merged, ensure_ascii=False, separators=(",", ":"))


def _unstamped(doc: str | None) -> str | None:
    if not doc:
        return None
    d = json.loads(doc)
    d.pop(REASONED, None)
    return json.dumps(d, ensure_ascii=False, separators=(",", ":"))


def _stamped(doc: str, now: str) -> str:
    return json.dumps({**json.loads(doc), REASONED: now}, ensure_ascii=False, separators=(",", ":"))


def assembled_json(inferred: DataFrame) -> DataFrame:
    """(_id, facts): inferred triples per subject as one JSON object of sorted value lists, types under ``@type``."""
    name = F.when(F.col("p") == "rdf:type", "@type").otherwise(F.col("p"))
    per = inferred.groupBy(F.col("s").alias("_id"), name.alias("p")).agg(F.array_sort(F.collect_set("o")).alias("o"))
    return per.groupBy("_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o"))))).alias("facts"))


def merge_and_update(resources: DataFrame, inferred: DataFrame, now: str, routing: Routing = Routing(), update_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(resources, written): inferred triples merged into the resources they are about, and stamped; ``written`` has the ids that changed.

    ``resources`` is (collection, _id, types, partitions, doc). Resources that get
    nothing new and were stamped before are left as they are, so a second run
    writes nothing. With ``update_only`` subjects that are not stored are left out,
    else they are added where they are routed to.
    """
    facts = materialize(assembled_json(inferred.dropna(subset=["s", "p", "o"])))
    both = resources.join(facts, "_id", "left" if update_only else "full_outer")
    types = F.from_json(F.get_json_object("merged", "$['@type']"), "array<string>")
    both = both.withColumn("merged", F.when(F.col("facts").isNotNull(), arrow_udf(_merged_doc, "string")(F.col("doc"), F.coalesce("facts", F.lit("{}")))))
    both = both.withColumn("merged", F.when(F.col("doc").isNull() & F.col("merged").isNotNull(), arrow_udf(_with_id, "string")(F.coalesce("merged", F.lit("{}")), F.col("_id"))).otherwise(F.col("merged")))
    stamp = F.get_json_object("doc", f"$['{REASONED}']")
    before = arrow_udf(_unstamped, "string")(F.col("doc"))
    both = materialize(both.withColumn("changed", F.col("merged").isNotNull() & (F.col("doc").isNull() | stamp.isNull() | (F.col("merged") != before))))
    new_types = F.when(F.col("changed"), F.coalesce(types, F.col("types"))).otherwise(F.col("types"))
    doc = F.when(F.col("changed"), arrow_udf(_stamped, "string")(F.coalesce("merged", F.lit("{}")), F.lit(now))).otherwise(F.col("doc"))
    collection = F.coalesce("collection", routing.collection(F.col("_id"), types))
    out = both.select(collection.alias("collection"), "_id", new_types.alias("types"), F.coalesce("partitions", F.array().cast("array<string>")).alias("partitions"), doc.alias("doc"))
    return out, both.where("changed").select("_id")


def _with_id(doc: str, id_: str) -> str:
    return json.dumps({"_id": id_, **json.loads(doc)}, ensure_ascii=False, separators=(",", ":"))


def update_one(resources: DataFrame, id_: str, update: dict, now: str, tbox: DataFrame | None = None, routing: Routing = Routing(), all_subjects: bool = False, provenance: str | None = None) -> tuple[DataFrame, dict]:
    """(resources, result): one resource merged with an update, reasoned over if there is an ontology, stamped and put back.

    The resource is found in the order in which collections are searched; one that
    is not there raises ``LookupError``. The id can not be changed. With
    ``all_subjects`` what follows about other stored resources is merged into them
    too. ``result`` has the resource, the number of inferences, the other subjects
    and the statements of the inferences (a table), whose ids depend on their content only.
    """
    names = [r[0] for r in resources.where(F.col("_id") == id_).select("collection").distinct().limit(1000).collect()]
    if not names:
        raise LookupError(f"no resource {id_!r}")
    chosen = next(n for n in routing.search_order(id_, sorted(names)) if n in names)
    is_it = (F.col("_id") == id_) & (F.col("collection") == chosen)
    old = resources.where(is_it).first()
    merged = fold([json.loads(old["doc"]), {**{k: v for k, v in update.items() if k not in ("_id", "@id")}, "_id": id_}])
    others: list[str] = []
    spark = resources.sparkSession
    row = spark.createDataFrame([(json.dumps(merged, ensure_ascii=False),)], "doc string")
    inferred = None
    if tbox is not None:
        mine = json_triples(row)
        inferred = materialize(infer(mine, tbox))
        facts = inferred if all_subjects else inferred.where(F.col("s") == id_)
        found = {r["_id"]: json.loads(r["facts"]) for r in assembled_json(facts.where(F.col("s") == id_)).collect()}
        if id_ in found:
            merged = fold([merged, {"_id": id_, **found[id_]}])
    merged[REASONED] = now
    types, parts = ([x.get("@id") if isinstance(x, dict) else x for x in _listed(merged.get(k))] for k in ("@type", "dcterms:isPartOf"))
    new = spark.createDataFrame([(chosen, id_, types, parts, json.dumps(merged, ensure_ascii=False, separators=(",", ":")))], "collection string, _id string, types array<string>, partitions array<string>, doc string")
    out = resources.where(~is_it).select(*new.columns).unionByName(new)
    made = None
    if inferred is not None:
        if all_subjects:
            out, written = merge_and_update(out, inferred.where(F.col("s") != id_), now, routing)
            others = sorted(r[0] for r in written.collect())
        facts = (inferred if all_subjects else inferred.where(F.col("s") == id_)).select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"))
        where = spark.createDataFrame([(id_, parts)], "subject string, partitions array<string>") if parts else None
        made = statements(facts, where, provenance)
    return out, {"resource": merged, "collection": chosen, "inferred": made.count() if made is not None else 0, "subjects": others, "statements": made}


def _listed(v) -> list:
    return [] if v is None else v if isinstance(v, list) else [v]


@dataclass
class RunState:
    """Single-flight state of background reasoning; requests during a run wait as one."""

    running: bool = False
    scope: str | None = None
    pending: bool = False
    pending_scope: str | None = None
    error: str | None = None
    totals: dict = field(default_factory=dict)
    runs: int = 0

    def begin(self, scope: str | None = None) -> bool:
        """True if the caller may run now; else its request is queued."""
        if not self.running:
            self.running, self.scope, self.error = True, scope, None
            self.totals, self.runs = {}, 0
            return True
        if not self.pending:
            self.pending, self.pending_scope = True, scope
        elif self.pending_scope != scope:
            self.pending_scope = None  # several scopes become all
        return False

    def take_pending(self) -> tuple[bool, str | None]:
        had, scope = self.pending, self.pending_scope
        self.pending, self.pending_scope = False, None
        if had:
            self.scope = scope
        return had, scope

    def record(self, result: dict) -> None:
        self.runs += 1
        for k, v in result.items():
            if isinstance(v, (int, float)):
                self.totals[k] = self.totals.get(k, 0) + v

    def finish(self) -> None:
        self.running, self.scope = False, None

    def fail(self, error: Exception) -> None:
        self.error, self.running, self.pending, self.pending_scope = str(error), False, False, None

    def snapshot(self) -> dict:
        return {"running": self.running, "scope": self.scope, "pending": self.pending, "error": self.error, "runs": self.runs, **self.totals}


def start_reasoning(state: RunState, once, scope: str | None = None) -> dict:
    """Like ``run_reasoning``, on a thread of its own: returns at once with ``started`` or, behind a run, ``queued``."""
    if not state.begin(scope):
        return {"queued": True, **state.snapshot()}
    threading.Thread(target=_until_done, args=(state, once, scope), daemon=True).start()
    return {"started": True, **state.snapshot()}


def _until_done(state: RunState, once, scope: str | None) -> None:
    try:
        _loop(state, once, scope)
    except Exception:  # noqa: BLE001 - kept in the state
        pass


def _loop(state: RunState, once, scope: str | None) -> None:
    try:
        while True:
            state.record(once(scope))
            again, scope = state.take_pending()
            if not again:
                break
        state.finish()
    except Exception as e:
        state.fail(e)
        raise


def run_reasoning(state: RunState, once, scope: str | None = None) -> dict:
    """Runs ``once(scope)`` until no request is pending; a second caller only queues."""
    if not state.begin(scope):
        return state.snapshot()
    _loop(state, once, scope)
    return state.snapshot()
