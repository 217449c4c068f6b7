"""Named collections, queries over them and read access from outside."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.windows import WindowedCollection, WindowProvider
from loamgraph.plans.selector import UnsupportedOperator, aggregate, column_name, find, selector
from loamgraph.runtime import materialize


class Collection:
    """Reads and writes of one table in the manner of a document store; ids are distinct.

    Writes of single rows are for stores of modest size: each is a new plan over
    the table. Many changes belong in ``documents.upsert`` or a stream of upserts.
    """

    def __init__(self, df: DataFrame):
        self.df = df

    def find(self, spec=None, **options) -> DataFrame:
        return find(self.df, spec, **options)

    def find_one(self, spec=None, **options):
        return self.find(spec, **options).first()

    def count_documents(self, spec=None) -> int:
        return self.find(spec).count()

    count = count_documents

    def distinct(self, name: str, spec=None) -> DataFrame:
        return self.find(spec).select(name).distinct()

    def aggregate(self, pipeline: list[dict]):
        return aggregate(self.df, pipeline)

    def delete_many(self, spec=None) -> int:
        """Drops the rows that match from this collection; returns how many there were."""
        gone = self.count_documents(spec)
        self.df = self.df.where(~selector(self.df, spec))
        return gone

    def insert_one(self, document: dict) -> None:
        self.insert_many([document])

    def insert_many(self, documents: list[dict]) -> int:
        """Adds documents; raises if an id is given twice or is there already, and then adds none."""
        ids = [d.get("_id") for d in documents]
        if None in ids or len(set(ids)) < len(ids) or self.find({"_id": {"$in": ids}}).limit(1).count():
            raise ValueError("insert: every document needs an id of its own")
        self.df = self.df.unionByName(self._rows(documents))
        return len(ids)

    def replace_one(self, spec: dict, document: dict, upsert: bool = False) -> dict:
        """The first row that matches gives way to a document, which keeps its id; else it is added with ``upsert``."""
        return self._write([("replace", spec, document, upsert)])[0]

    def update_one(self, spec: dict, update: dict, upsert: bool = False) -> dict:
        """``$set`` and ``$unset`` columns of the first row that matches; a row added by ``upsert`` also takes ``$setOnInsert`` and the selector's values."""
        unknown = set(update) - {"$set", "$unset", "$setOnInsert"}
        if unknown:
            raise UnsupportedOperator(", ".join(sorted(unknown)))
        return self._write([("update", spec, update, upsert)])[0]

    def bulk_write(self, operations: list[dict]) -> dict:
        """``insertOne``, ``updateOne``, ``replaceOne`` and ``deleteMany`` in order; the counts of all."""
        total = {"matched": 0, "modified": 0, "upserted": 0, "inserted": 0, "deleted": 0}
        for op in operations:
            (name, arg), *rest = op.items()
            if rest or name not in ("insertOne", "updateOne", "replaceOne", "deleteMany"):
                raise UnsupportedOperator(f"bulk_write: {sorted(op)}")
            if name == "insertOne":
                total["inserted"] += self.insert_many([arg["document"]])
            elif name == "deleteMany":
                total["deleted"] += self.delete_many(arg["filter"])
            else:
                done = self.replace_one(arg["filter"], arg["replacement"], arg.get("upsert", False)) if name == "replaceOne" else self.update_one(arg["filter"], arg["update"], arg.get("upsert", False))
                for k, v in done.items():
                    total[k] += v
        self.df = materialize(self.df)
        return total

    def _rows(self, documents: list[dict]) -> DataFrame:
        known = {c for d in documents for c in d}
        names = {c: column_name(self.df, c) for c in known}
        if missing := sorted(c for c, n in names.items() if n is None):
            raise ValueError(f"no such fields: {', '.join(missing)}")
        rows = [{names[k]: v for k, v in d.items()} for d in documents]
        return self.df.sparkSession.createDataFrame([tuple(r.get(c) for c in self.df.columns) for r in rows], self.df.schema)

    def _write(self, operations) -> list[dict]:
        out = []
        for kind, spec, change, upsert in operations:
            first = self.find(spec, sort=[("_id", 1)]).first()
            if first is None:
                if upsert:
                    given = {k: v for k, v in spec.items() if not k.startswith("$") and not isinstance(v, dict)}
                    new = {**given, **change} if kind == "replace" else {**given, **change.get("$setOnInsert", {}), **change.get("$set", {})}
                    self.insert_many([new])
                out.append({"matched": 0, "modified": 0, "upserted": int(upsert)})
                continue
            old = first.asDict()
            if kind == "replace":
                new = {c: None for c in old} | {column_name(self.df, k) or k: v for k, v in change.items()}
            else:
                new = old | {column_name(self.df, k) or k: v for k, v in change.get("$set", {}).items()} | {column_name(self.df, k) or k: None for k in change.get("$unset", {})}
            new["_id"] = old["_id"]
            modified = new != old
            if modified:
                rows = self._rows([new])
                self.df = self.df.where(~F.col("_id").eqNullSafe(F.lit(old["_id"]))).unionByName(rows)
            out.append({"matched": 1, "modified": int(modified), "upserted": 0})
        return out


@dataclass
class Query:
    """A stored query: a collection, a selector and options (sort, limit, projection)."""

    name: str
    collection: str
    selector: dict = field(default_factory=dict)
    opts: dict = field(default_factory=dict)
    count: int | None = None

    def to_document(self) -> dict:
        return {"@type": ["loamgraph:Query"], **{k: v for k, v in self.__dict__.items() if v is not None}}

    @classmethod
    def of(cls, doc: dict) -> Query:
        if not doc.get("name") or not doc.get("collection"):
            raise ValueError("a query needs a name and a collection")
        return cls(doc["name"], doc["collection"], dict(doc.get("selector") or {}), dict(doc.get("opts") or {}), doc.get("count"))

    def run(self, catalog: Catalog, public: bool = True) -> DataFrame:
        source = catalog.public(self.collection) if public and self.collection in catalog.windowed else catalog[self.collection]
        return source.find(self.selector, **{k: v for k, v in self.opts.items() if k in ("sort", "limit", "projection")})


class Catalog:
    """The registered collections; names in ``windowed`` are public only behind the window."""

    def __init__(self, collections: dict[str, DataFrame], provider: WindowProvider | None = None, windowed: dict[str, tuple[str, str]] | None = None):
        self._collections = {k: Collection(v) for k, v in collections.items()}
        self.provider, self.windowed = provider, windowed or {}

    def __getitem__(self, name: str) -> Collection:
        if name not in self._collections:
            raise KeyError(f"no collection {name!r}; registered: {', '.join(sorted(self._collections))}")
        return self._collections[name]

    def names(self) -> list[str]:
        return list(self._collections)

    def public(self, name: str) -> Collection | WindowedCollection:
        """The collection as the public may see it; without a provider a windowed one is refused."""
        whole = self[name]
        if name not in self.windowed:
            return whole
        if self.provider is None:
            raise PermissionError(f"{name} is windowed and there is no window")
        group, when = self.windowed[name]
        return WindowedCollection(whole.df, self.provider, group, when)


#: Documents up to which a collection is given out as one answer.
MAX_ANSWER = 50_000


def handle_request(catalog: Catalog, allowed: set[str], method: str, path: str) -> tuple[int, str]:
    """(status, JSON) of ``doc/<collection>/<id>`` and ``docs/<collection>``; only allowed collections are read.

    Parts of the path may be percent-encoded. A collection of more than
    ``MAX_ANSWER`` documents is refused with 413 and is to be exported instead.
    """
    if method != "GET":
        return 405, json.dumps({"error": "method not allowed"})
    parts = [unquote(p) for p in path.split("/") if p]
    if len(parts) < 2 or parts[0] not in ("doc", "docs") or (parts[0] == "doc" and len(parts) < 3):
        return 400, json.dumps({"error": "bad request"})
    if parts[1] not in allowed:
        return 403, json.dumps({"error": "forbidden"})
    try:
        rows = catalog.public(parts[1])
        if parts[0] == "docs":
            found = rows.find(limit=MAX_ANSWER + 1).collect()
            if len(found) > MAX_ANSWER:
                return 413, json.dumps({"error": f"more than {MAX_ANSWER} documents"})
            return 200, json.dumps([r.asDict(True) for r in found], default=str)
        row = rows.find_one({"_id": "/".join(parts[2:])})
        return (200, json.dumps(row.asDict(True), default=str)) if row else (404, json.dumps({"error": "not found"}))
    except Exception as e:  # noqa: BLE001
        return 500, json.dumps({"error": str(e)[:200]})


class CachedLookup:
    """Single documents by id through a fetch function; found and missing ones are kept, failures are not.

    Requests for one id at the same time wait for a single fetch.
    """

    def __init__(self, fetch: Callable[[str], dict | None]):
        self._fetch, self._kept = fetch, {}
        self._lock, self._busy = threading.Lock(), {}

    @staticmethod
    def path(collection: str, id_: str) -> str:
        """The path of a document, its parts percent-encoded."""
        return f"doc/{quote(collection, safe='')}/{quote(id_, safe='')}"

    def seed(self, *documents: dict) -> None:
        with self._lock:
            self._kept.update((d["_id"], d) for d in documents)

    def seed_all(self, fetch_all: Callable[[], list[dict]]) -> int:
        """Keeps all documents of a collection, fetched at once; returns how many."""
        documents = fetch_all()
        self.seed(*documents)
        return len(documents)

    def find_one(self, spec: dict) -> dict | None:
        if set(spec) != {"_id"} or not isinstance(spec["_id"], str):
            raise ValueError("only lookups by id are possible")
        key = spec["_id"]
        with self._lock:
            if key in self._kept:
                return self._kept[key]
            waiting = key in self._busy
            future = self._busy.setdefault(key, Future())
        if waiting:
            return future.result()
        try:
            found = self._fetch(key)
        except BaseException as e:
            with self._lock:
                del self._busy[key]
            future.set_exception(e)
            raise
        with self._lock:
            self._kept[key] = found
            del self._busy[key]
        future.set_result(found)
        return found

    def find(self, *_):
        raise NotImplementedError("only lookups by id are possible")

    count = count_documents = delete_many = aggregate = find
