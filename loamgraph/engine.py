"""The engine as one object: a context, a store of resources and the operators over them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import reasoning
from loamgraph.operators.documents import Routing
from loamgraph.operators.rdf import json_triples
from loamgraph.plans.selector import find
from loamgraph.runtime import materialize
from loamgraph.sources import jsonld

SCHEMA = "collection string, _id string, types array<string>, partitions array<string>, doc string"


class LinkedData:
    """Expansion and compaction under a settled context."""

    def __init__(self, context: dict):
        self.context = context

    def expand(self, doc: dict) -> dict:
        return jsonld.expand(doc, self.context)

    def compact(self, doc: dict) -> dict:
        return jsonld.compact(doc, self.context, "_id")

    def expand_name(self, name: str) -> str:
        return jsonld.expand_name(name, self.context)

    def compact_name(self, iri: str) -> str:
        return jsonld.compact_name(iri, self.context)


class Engine:
    """Resources in collections, kept as one table (``SCHEMA``); each change makes a new, materialised table.

    ``initialize`` or ``import_data`` settles the context; before that ``ld`` raises.
    """

    def __init__(self, spark: SparkSession, routing: Routing = Routing()):
        self.spark, self.routing = spark, routing
        self.resources = spark.createDataFrame([], SCHEMA)
        self._context: dict | None = None
        self.reasoner = reasoning.Reasoner(self.ontology_triples)

    def ready(self) -> bool:
        return self._context is not None

    def ld(self) -> LinkedData:
        if self._context is None:
            raise RuntimeError("no context is loaded yet; initialize the engine first")
        return LinkedData(self._context)

    def initialize(self, paths: list[str], clear: list[str] | None = None, add_partitions: bool = False) -> list[tuple[str, str]]:
        """Imports files in order, after clearing the collections named; the files that failed and why."""
        if clear:
            self.delete_many(clear)
        found, context, failed = jsonld.bootstrap(self.spark, paths, self.routing, add_partitions, self.resources)
        self._context = context
        if found is not None:
            self._save(found)
        return failed

    def import_data(self, data, **options) -> dict:
        """Counters of an import of one document; errors do not stop it."""
        share = {k: options.pop(k) for k in ("share_tbox", "share_statements") if k in options}
        found, self._context = jsonld.import_data(self.spark, data, self._context, self.routing, stored=self.resources, **options)
        found = materialize(found)
        self._save(found, **share)
        return jsonld.import_stats(found).first().asDict()

    def _save(self, found: DataFrame, **share) -> None:
        self.resources = materialize(jsonld.save(self.resources, found, self.routing, **share).select("collection", "_id", "types", "partitions", "doc"))
        self.reasoner.forget()

    def collection(self, name: str) -> DataFrame:
        return self.resources.where(F.col("collection") == name)

    def get(self, id_: str) -> dict | None:
        """A resource, from the first collection in the order of search that has it."""
        rows = {r["collection"]: r["doc"] for r in self.resources.where(F.col("_id") == id_).collect()}
        order = [c for c in self.routing.search_order(id_, sorted(rows)) if c in rows]
        return json.loads(rows[order[0]]) if order else None

    def find(self, name: str, spec: dict | None = None, **options) -> DataFrame:
        return find(self.collection(name), spec, **options)

    def update_one(self, id_: str, update: dict, now: str, **options) -> dict:
        tbox = self.reasoner.ensure() if options.pop("reasoning", True) else None
        out, result = reasoning.update_one(self.resources, id_, update, now, tbox, self.routing, **options)
        self.resources = materialize(out)
        return result

    def delete_many(self, collections: list[str]) -> int:
        gone = self.resources.where(F.col("collection").isin(collections)).count()
        self.resources = materialize(self.resources.where(~F.col("collection").isin(collections)))
        return gone

    def ontology_triples(self) -> DataFrame:
        return json_triples(self.collection(self.routing.ontology)).select("s", "p", "o")

    def reason(self, now: str, first: list[str] = (), provenance: str | None = None) -> tuple[DataFrame | None, dict]:
        """(statements, counts) of a pass over all collections that are reasoned over."""
        names = sorted(r[0] for r in self.resources.select("collection").distinct().limit(1000).collect())
        self.resources, made, totals = self.reasoner.reason(self.resources, names, now, first, provenance)
        return made, totals

    def export(self, name: str, path: str) -> int:
        return jsonld.export_file(self.collection(name), self.ld().context, path)
