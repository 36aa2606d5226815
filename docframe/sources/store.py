"""A database: collections as versioned Parquet under one folder.

Every commit publishes ``manifest/<version>.json``, which names the data files of all collections
and what the commit changed.  The name can be taken once, so commits are atomic over all
collections and a second writer of the same version gets Conflict.  Files are never changed:
updates and deletes rewrite only the files that hold a matching document.  A snapshot is a version;
while it is open a lease in ``leases/`` keeps ``compact`` from it.
"""

from __future__ import annotations

import dataclasses
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ClosureError, Conflict, DocframeError, DuplicateId, DuplicateValue, HintError, MultipleMatches, NotFound, PreconditionFailed, QueryError, ReadOnly, SnapshotTooOld
from ..functions import values as V
from ..functions.names import fresh
from ..operators import aggregate as agg
from ..operators import find as fnd
from ..operators import update as upd
from ..plans import ast as A
from ..plans import compile as C
from ..plans.parser import print_filter
from . import explain
from .files import Files, plain, plain_from_scan
from .rows import document, merge_schemas, schema_of, settled, to_spark

Docs = Iterable[dict] | DataFrame
#: Bytes of a collection's name at most.
NAME_BYTES = 255
#: Seconds that a lease holds without being renewed: a program that ended without closing leaves one.
LEASE_SECONDS = 24 * 3600
#: Seconds by which files must be older than a compaction's commit to be deleted: times may be whole seconds.
MARGIN = 2


def folder_of(name: str) -> str:
    """The folder of a collection's files: other names, other folders, and plain letters only."""
    if not isinstance(name, str) or not name or len(name.encode("utf-8", "surrogatepass")) > NAME_BYTES:
        raise QueryError(f"a collection's name has 1 to {NAME_BYTES} bytes: {name!r}")
    return "c-" + re.sub(rb"[^A-Za-z0-9-]", lambda m: b"_%02x" % m[0][0], name.encode("utf-8", "surrogatepass")).decode("ascii")


def generated_ids() -> Any:
    """A column of new ids: time-ordered UUIDs (version 7)."""
    ms = F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0")
    rest = F.expr("uuid()")
    return F.lower(F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(rest, 16, 3), F.lit("-"), F.substring(rest, 20, 17)))


@dataclass
class State:
    """What a manifest says of one collection."""

    schema: T.StructType
    files: list[str] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    #: Least and greatest _id of a file, where that is known: integers or strings.
    ranges: dict[str, list] = field(default_factory=dict)

    def to_json(self) -> dict:
        return {"schema": self.schema.jsonValue(), "files": self.files, "indexes": self.indexes, "ranges": {k: v for k, v in self.ranges.items() if k in set(self.files)}}

    @classmethod
    def from_json(cls, x: dict) -> State:
        return cls(T.StructType.fromJson(x["schema"]), list(x["files"]), dict(x["indexes"]), dict(x.get("ranges", {})))

    def copy(self) -> State:
        return State(self.schema, list(self.files), dict(self.indexes), dict(self.ranges))

    def may_hold(self, low: Any, high: Any) -> list[str]:
        """The files that may hold an _id between the two."""
        out = []
        for f in self.files:
            r = self.ranges.get(f)
            if r is None or type(r[0]) is not type(low) or not (r[1] < low or high < r[0]):
                out.append(f)
        return out


def typed(cls: type, doc: dict) -> Any:
    """An instance of a dataclass from a document; fields that it lacks take their defaults."""
    names = {x.name for x in dataclasses.fields(cls)}
    if "id" in names and "id" not in doc and "_id" in doc:
        doc = {**doc, "id": doc["_id"]}
    return cls(**{k: v for k, v in doc.items() if k in names})


class View:
    """Reads of one collection at one version."""

    def __init__(self, db: Database, name: str, version: int | None = None):
        self.db, self.name, self.version = db, name, version

    def _state(self) -> State | None:
        return self.db.manifest(self.version)["collections"].get(self.name)

    @property
    def df(self) -> DataFrame:
        """All documents, as any DataFrame: joins and SQL go from here."""
        return self.db.frame(self._state())

    def _hinted(self, f: A.Filter) -> None:
        if not f.hint:
            return
        state = self._state()
        known = [["_id"], *([i["fields"] for i in state.indexes.values()] if state else [])]
        if list(f.hint) not in known:
            raise HintError(f"no index on {', '.join(f.hint)}")
        head = f.hint[0]
        used = {x.path.dotted for x in A.walk(f.where) if hasattr(x, "path")} | {o.path.dotted for o in f.order if isinstance(o, A.Order)}
        if head not in used:
            raise HintError(f"the filter has no condition on {head}")

    def frame(self, f: Any = None, params: dict | None = None, now: datetime | None = None) -> DataFrame:
        """What the filter finds, as a DataFrame."""
        f = fnd.as_filter(f, params, now)
        self._hinted(f)
        return fnd.find(self.df, f)

    def find(self, f: Any = None, params: dict | None = None, now: datetime | None = None) -> list[dict]:
        out = self.frame(f, params, now)
        return [document(r, out.schema) for r in out.collect()]

    def cursor(self, f: Any = None, params: dict | None = None) -> Iterator[dict]:
        """Documents one by one, from one version, a partition at a time."""
        out = self.frame(f, params)
        return (document(r, out.schema) for r in out.toLocalIterator())

    def find_one(self, f: Any = None, params: dict | None = None) -> dict | None:
        f = fnd.as_filter(f, params)
        found = self.find(A.replace(f, limit=1 if f.limit is None else min(1, f.limit)))
        return found[0] if found else None

    def get(self, doc_id: Any) -> dict | None:
        return self.find_one(A.Filter().eq("_id", self._id(doc_id)))

    def _id(self, doc_id: Any) -> Any:
        """An id may be given as its text."""
        state = self._state()
        tagged = state is not None and any(f.name == "_id" and (f.metadata or {}).get("kind") == "id" for f in state.schema.fields)
        return V.DocId(doc_id) if tagged and isinstance(doc_id, str) else doc_id

    def count(self, f: Any = None, params: dict | None = None) -> int:
        f = fnd.as_filter(f, params)
        self._hinted(f)
        return fnd.count(self.df, f)

    def aggregate_frame(self, f: Any, a: Any, params: dict | None = None, now: datetime | None = None) -> DataFrame:
        return agg.aggregate(self.df, f, a, params, now)

    def aggregate(self, f: Any, a: Any, params: dict | None = None, now: datetime | None = None) -> list[dict]:
        """The rows; a value that is null is there as None."""
        out = self.aggregate_frame(f, a, params, now)
        return [{k: None for k in out.columns} | document(r, out.schema) for r in out.collect()]

    def find_as(self, cls: type, f: Any = None, params: dict | None = None) -> list:
        """Documents as instances of a dataclass; its field ``id`` takes the _id, other names drop out."""
        return [typed(cls, d) for d in self.find(f, params)]

    def aggregate_as(self, cls: type, f: Any, a: Any, params: dict | None = None) -> list:
        return [typed(cls, r) for r in self.aggregate(f, a, params)]

    def explain(self, f: Any = None, params: dict | None = None) -> dict:
        """The filter as read, Spark's plan for it, and what of it reaches the Parquet scan."""
        f = fnd.as_filter(f, params)
        self._hinted(f)
        plan = self.frame(f)._jdf.queryExecution().explainString(self.db.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        pushed = [x.strip() for x in plan.splitlines() if x.strip().startswith("PushedFilters")]
        return {"filter": print_filter(f), "plan": plan, "pushed": pushed}

    def explain_run(self, f: Any = None, params: dict | None = None, now: datetime | None = None) -> dict:
        """``explain``, and what the query did when run: documents examined, matched and returned, files
        and bytes read of those there are, and seconds."""
        given = fnd.as_filter(f, params, now)
        out = self.explain(given)
        state = self._state()
        out |= {"hinted": bool(given.hint), "sort": [o.path.dotted if isinstance(o, A.Order) else "a function" for o in given.order], "select": None if given.select is None else [p.dotted for p in given.select], "except": [p.dotted for p in given.without]}
        # a sort of everything changes no count, but takes samples of the rows first, which would be counted too
        counted = given if given.limit is not None or given.offset else A.replace(given, order=())
        return out | {"stats": explain.run(fnd.find(self.df, counted)) | {"files": len(state.files) if state else 0}}

    def explain_aggregate(self, f: Any, a: Any, params: dict | None = None, now: datetime | None = None) -> dict:
        """The plan of an aggregate and what it did; ``groups`` are those before having, skip and limit."""
        df = self.aggregate_frame(f, a, params, now)
        plan = df._jdf.queryExecution().explainString(self.db.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        state = self._state()
        return {"plan": plan, "stats": explain.run(agg.aggregate(self.df, f, a, params, now, ordered=False)) | {"files": len(state.files) if state else 0}}

    def fields(self, f: Any = None) -> list[dict]:
        """Paths, their kinds, and how many of the found documents hold a value there; _id first."""
        df = fnd.match(self.df, fnd.as_filter(f))
        leaves: list[tuple[str, C.Node]] = []

        def walk(path: str, node: C.Node) -> None:
            leaves.append((path, node))
            if isinstance(node.type, T.StructType):
                for x in node.type.fields:
                    walk(f"{path}.{x.name}", C.child(node, x.name))

        scope = C.Scope.of(df)
        for name in sorted(df.columns, key=lambda n: n != "_id"):
            walk(name, scope.root(name))
        counts = df.agg(*[F.count(n.column).alias(f"c{i}") for i, (_, n) in enumerate(leaves)]).first()
        return [{"path": p, "kind": n.kind, "documents": counts[f"c{i}"]} for i, (p, n) in enumerate(leaves)]

    def indexes(self) -> list[dict]:
        state = self._state()
        return [] if state is None else [{"name": k, **v} for k, v in sorted(state.indexes.items())]


class Collection(View):
    """Reads of the newest version, and writes."""

    def __init__(self, db: Database, name: str):
        super().__init__(db, name)

    def _one(self, add: Callable[[Batch], Any]) -> Any:
        batch = self.db.batch()
        add(batch)
        return batch.commit()[0]

    def insert(self, docs: dict | Docs) -> list:
        """Add documents; those without an _id get one.  Returns the ids (of a DataFrame: their number)."""
        many = [docs] if isinstance(docs, dict) else docs
        return self._one(lambda b: b.insert(self.name, many))

    def update(self, doc_id: Any, doc: dict) -> bool:
        """Replace a document whole; false if there is none."""
        return self._one(lambda b: b.replace(self.name, self._id(doc_id), doc)) > 0

    def delete(self, doc_id: Any) -> bool:
        return self._one(lambda b: b.delete(self.name, A.Filter().eq("_id", self._id(doc_id)))) > 0

    def update_many(self, f: Any, update: upd.Update | dict | Callable[[dict], dict | None], params: dict | None = None) -> int:
        """Change every document found, by operators or by a function; how many changed."""
        return self._one(lambda b: b.update(self.name, f, update, params))

    update_fields = update_many

    def delete_many(self, f: Any, params: dict | None = None) -> int:
        return self._one(lambda b: b.delete(self.name, f, params))

    def upsert(self, f: Any, doc: dict, params: dict | None = None) -> dict:
        """Replace the one document found, or insert: {"inserted": id} or {"updated": id}."""
        return self._one(lambda b: b.upsert(self.name, f, doc, params))

    def upsert_fields(self, f: Any, update: upd.Update | dict, params: dict | None = None) -> dict:
        return self._one(lambda b: b.upsert(self.name, f, upd.Update.of(update), params))

    def create_index(self, *fields: str, unique: bool = False, sparse: bool = False) -> str:
        return self._one(lambda b: b.create_index(self.name, fields, unique, sparse))

    def drop_index(self, name: str) -> None:
        self._one(lambda b: b.drop_index(self.name, name))

    def drop(self) -> None:
        self._one(lambda b: b.drop(self.name))

    def watch(self, f: Any = None, params: dict | None = None, **options: Any) -> Any:
        from ..streaming.live import LiveQuery

        return LiveQuery(self.db, self.name, f, params, **options)

    def watch_aggregate(self, f: Any, a: Any, params: dict | None = None, **options: Any) -> Any:
        from ..streaming.live import LiveAggregate

        return LiveAggregate(self.db, self.name, f, a, params, **options)


class Snapshot:
    """One moment of the database, for reading.  ``compact`` keeps it until it is closed."""

    def __init__(self, db: Database, version: int):
        self.db, self.version = db, version
        self._lease = db.lease(version)
        self.info = {"version": version, "committed": db.manifest(version)["at"], "pinned": self._lease is not None}

    def collection(self, name: str) -> View:
        return View(self.db, name, self.version)

    def collections(self) -> list[str]:
        return sorted(self.db.manifest(self.version)["collections"])

    def close(self) -> None:
        """Let go of the version; reads go on while it is there."""
        self.db.release(self._lease)
        self._lease = None

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


class Database:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.files, self.read_only = spark, Files(spark, root), read_only
        self.root = self.files.root
        self._cache: dict[int, dict] = {}
        if not read_only:
            for d in ("manifest", "data", "changes", "leases"):
                self.files.mkdirs(f"{self.root}/{d}")

    # ---- versions

    def version(self) -> int:
        names = [n for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json") and not n.startswith(".")]
        return int(names[-1][:-5]) if names else 0

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "at": None, "collections": {}, "changes": {}}
        if version not in self._cache:
            path = f"{self.root}/manifest/{version:012d}.json"
            if not self.files.exists(path):
                raise SnapshotTooOld(f"version {version} is no longer kept")
            x = json.loads(self.files.read(path))
            x["collections"] = {k: State.from_json(v) for k, v in x["collections"].items()}
            if len(self._cache) > 64:
                self._cache.clear()
            self._cache[version] = x
        return self._cache[version]

    # ---- leases

    def lease(self, version: int, onward: bool = False) -> str | None:
        """Keep a version (and, ``onward``, all later ones) from ``compact``; None if the database is read only."""
        if self.read_only or version == 0:
            return None
        path = f"{self.root}/leases/{uuid.uuid4().hex}.json"
        self.files.create(path, json.dumps({"version": version, "onward": onward, "until": time.time() + LEASE_SECONDS}))
        return path

    def release(self, lease: str | None) -> None:
        if lease is not None:
            self.files.delete(lease)

    def leased(self) -> list[dict]:
        """The leases that hold; those that ran out are deleted."""
        out = []
        for n in self.files.names(f"{self.root}/leases"):
            if n.startswith("."):
                continue
            x = json.loads(self.files.read(f"{self.root}/leases/{n}"))
            if x["until"] > time.time():
                out.append(x)
            elif not self.read_only:
                self.files.delete(f"{self.root}/leases/{n}")
        return out

    def frame(self, state: State | None, name_of_file: str | None = None) -> DataFrame:
        """All documents of a state; a column of that name gives each one's file."""
        if state is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField("_id", T.StringType())]))
        if not state.files:
            return self.spark.createDataFrame([], state.schema)
        df = self.spark.read.schema(state.schema).parquet(*[f"{self.root}/{x}" for x in state.files])
        return _tagged(df, state.schema, *([] if name_of_file is None else [df.metadataColumn("_metadata")["file_path"].alias(name_of_file)]))

    def collection(self, name: str) -> Collection:
        return Collection(self, name)

    def collections(self) -> list[str]:
        return sorted(self.manifest()["collections"])

    def register(self, name: str, df: DataFrame, id: str | None = None) -> Collection:
        """Make a collection of a DataFrame; column ``id`` is its _id, else ids are made."""
        c = self.collection(name)
        c.insert(df if id is None else df.withColumn("_id", F.col(id)))
        return c

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.version())

    def batch(self) -> Batch:
        return Batch(self)

    def subscribe(self, **options: Any) -> Any:
        from ..streaming.live import Changes

        return Changes(self, **options)

    # ---- care

    def check(self) -> dict:
        """Missing files, null or repeated ids, broken unique indexes; all lists empty if sound."""
        out: dict = {"missing": [], "ids": [], "unique": []}
        for name, state in self.manifest()["collections"].items():
            gone = [x for x in state.files if not self.files.exists(f"{self.root}/{x}")]
            out["missing"] += gone
            if gone:
                continue
            df = self.frame(state)
            if not df.groupBy("_id").count().where("count > 1 or _id is null").limit(1).isEmpty():
                out["ids"].append(name)
            for k, index in state.indexes.items():
                if index["unique"] and _repeated(df, index) is not None:
                    out["unique"].append(f"{name}.{k}")
        return out

    def stats(self) -> dict:
        m = self.manifest()
        own = {}
        for name, state in m["collections"].items():
            own[name] = {"documents": self.frame(state).count(), "files": len(state.files), "bytes": sum(self.files.size(f"{self.root}/{x}") for x in state.files), "indexes": len(state.indexes)}
        return {"version": m["version"], "collections": own}

    def info(self) -> dict:
        leases = self.leased()
        return {
            "root": self.root, "mode": "read only" if self.read_only else "read and write", "version": self.version(), "read_only": self.read_only, "collections": self.collections(),
            "versions": len([n for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json") and not n.startswith(".")]), "snapshots": sorted(x["version"] for x in leases if not x["onward"]), "feeds": sum(x["onward"] for x in leases),
            "options": {"name_bytes": NAME_BYTES, "lease_seconds": LEASE_SECONDS},
        }

    def compact(self, keep: int = 1, file_bytes: int = 256 << 20) -> dict:
        """Rewrite small files into fewer, keep the last ``keep`` versions and those that open snapshots
        and feeds lease, and delete what none of them names.

        Files younger than this commit stay: a batch that began after it may be about to name them, and
        one that began before it can no longer commit.
        """
        batch = self.batch()
        for name, state in batch.state.items():
            if len(state.files) > 1:
                size = sum(self.files.size(f"{self.root}/{x}") for x in state.files)
                wanted = max(1, -(-size // file_bytes))
                if wanted < len(state.files):
                    state.files = batch.write(name, self.frame(state).coalesce(wanted))
        batch.touched = True
        batch.commit()
        version = self.version()
        horizon = self.files.modified(f"{self.root}/manifest/{version:012d}.json") - 1000 * MARGIN
        return {"version": version, "deleted_files": self.sweep(version, keep, horizon)}

    def sweep(self, version: int, keep: int, horizon: int) -> int:
        """Delete versions before the last ``keep`` that no lease holds, and files older than ``horizon``
        (milliseconds) that no version left names; how many data files."""
        every = [int(n[:-5]) for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json") and not n.startswith(".")]
        leases = self.leased()
        kept = {v for v in every if v > version - keep or any(v == x["version"] or x["onward"] and v >= x["version"] for x in leases)}
        for v in set(every) - kept:
            for path in self.manifest(v)["changes"].values():
                self.files.delete(f"{self.root}/{path}")
            self.files.delete(f"{self.root}/manifest/{v:012d}.json")
            self._cache.pop(v, None)
        named = {x for v in kept for s in self.manifest(v)["collections"].values() for x in s.files}
        deleted = 0
        for path in self.files.data_below(f"{self.root}/data"):
            if path.removeprefix(self.root + "/") not in named and self.files.modified(path) < horizon:
                self.files.delete(path)
                deleted += 1
        return deleted


def _tagged(df: DataFrame, schema: T.StructType, *more: Any) -> DataFrame:
    """Field metadata back on the columns: a reader keeps it only for files that Spark wrote with it."""
    return df.select(*more, *[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) if f.metadata else F.col(f"`{f.name}`") for f in schema.fields])


def _repeated(df: DataFrame, index: dict, changed: DataFrame | None = None) -> Any:
    """A key that two documents share, or None.  Nulls are exempt; arrays count per element.

    With ``changed`` (_id) only keys of these documents are looked at.
    """
    keys = [C.Scope.of(df).walk(A.Path(tuple(A.Step(s.name) for s in A.Path.of(p).steps))) for p in index["fields"]]
    if any(k is None for k in keys):
        return None
    rows = df.select("_id", *[k.column.alias(f"k{i}") for i, k in enumerate(keys)])
    for i, k in enumerate(keys):
        if isinstance(k.type, T.ArrayType):
            rows = rows.withColumn(f"k{i}", F.explode(f"k{i}"))
    names = [f"k{i}" for i in range(len(keys))]
    for n in names:
        rows = rows.where(F.col(n).isNotNull())
    if changed is not None:
        rows = rows.join(rows.join(changed.select("_id"), "_id", "left_semi").select(*names).distinct(), names, "left_semi")
    return rows.distinct().groupBy(*names).count().where("count > 1").first()


class Batch:
    """Writes that become visible together, in order; ``commit`` returns each one's result.

    ``require`` and ``require_none`` refuse the whole batch unless a filter matches (or nothing does).
    """

    def __init__(self, db: Database):
        self.db = db
        self.base = db.manifest()
        self.state = {k: v.copy() for k, v in self.base["collections"].items()}
        self.steps: list[Callable[[], Any]] = []
        self.changes: dict[str, list[DataFrame]] = {}
        self.dropped: set[str] = set()
        self.touched = False

    # ---- what to do

    def insert(self, name: str, docs: dict | Docs) -> Batch:
        return self._step(lambda: self._insert(name, [docs] if isinstance(docs, dict) else docs))

    def replace(self, name: str, doc_id: Any, doc: dict) -> Batch:
        return self._step(lambda: self._replace(name, doc_id, doc))

    def update(self, name: str, f: Any, update: Any, params: dict | None = None) -> Batch:
        if not callable(update):
            update = upd.Update.of(update)
        f = fnd.as_filter(f, params)
        return self._step(lambda: self._update(name, f, update))

    def delete(self, name: str, f: Any, params: dict | None = None) -> Batch:
        f = fnd.as_filter(f, params)
        return self._step(lambda: self._delete(name, f))

    def upsert(self, name: str, f: Any, new: dict | upd.Update, params: dict | None = None) -> Batch:
        f = fnd.as_filter(f, params)
        if f.order or f.offset or f.limit is not None or f.select is not None or f.without:
            raise QueryError("an upsert's filter takes conditions only")
        return self._step(lambda: self._upsert(name, f, new))

    def require(self, name: str, f: Any, params: dict | None = None, none: bool = False) -> Batch:
        f = fnd.as_filter(f, params)
        if f.order or f.offset or f.limit is not None or f.select is not None or f.without:
            raise QueryError("a requirement's filter takes conditions only")

        def step() -> None:
            if fnd.match(self._frame(name), f).limit(1).isEmpty() != none:
                raise PreconditionFailed(f"{name}: {'a document meets' if none else 'no document meets'} {print_filter(f)}")

        return self._step(step)

    def require_none(self, name: str, f: Any, params: dict | None = None) -> Batch:
        return self.require(name, f, params, True)

    def create_index(self, name: str, fields: Iterable[str], unique: bool = False, sparse: bool = False) -> Batch:
        fields = list(fields)
        if not 1 <= len(fields) <= 8 or any(not p or not all(p.split(".")) or p.split(".")[0] == "_id" for p in fields):
            raise QueryError("an index takes 1 to 8 fields, without _id and without empty names")
        key = ",".join(fields)
        index = {"fields": fields, "unique": unique, "sparse": sparse}

        def step() -> str:
            own = self._own(name)
            if key in own.indexes and own.indexes[key] != index:
                raise QueryError(f"there is an index on {key} with other options")
            own.indexes[key] = index
            self._check_unique(name, only=key)
            self.touched = True
            return key

        return self._step(step)

    def drop_index(self, name: str, key: str) -> Batch:
        def step() -> None:
            if name not in self.state or key not in self.state[name].indexes:
                raise NotFound(f"{name} has no index {key}")
            del self.state[name].indexes[key]
            self.touched = True

        return self._step(step)

    def drop(self, name: str) -> Batch:
        def step() -> bool:
            self.changes.pop(name, None)
            self.dropped.add(name)
            return self.state.pop(name, None) is not None

        return self._step(step)

    # ---- commit

    def _step(self, step: Callable[[], Any]) -> Batch:
        self.steps.append(step)
        return self

    def commit(self, dry_run: bool = False) -> list:
        """Run the steps and publish one new version, or nothing if a step fails."""
        if self.db.read_only:
            raise ReadOnly("the database was opened for reading")
        try:
            return self._commit(dry_run)
        except DocframeError:
            raise
        except Exception as e:
            if self.db.version() > self.base["version"]:
                raise Conflict("another commit came first") from e
            raise

    def _commit(self, dry_run: bool) -> list:
        results = [step() for step in self.steps]
        if dry_run or not (self.changes or self.dropped or self.touched):
            return results
        for name in self.changes:
            if name in self.state:
                self._check_unique(name)
        version = self.base["version"] + 1
        feed = {}
        for name, parts in self.changes.items():
            path = f"changes/{version:012d}-{uuid.uuid4().hex}"
            self._net(parts).write.parquet(f"{self.db.root}/{path}")
            feed[name] = path
        manifest = {"version": version, "at": datetime.now(timezone.utc).isoformat(), "collections": {k: v.to_json() for k, v in self.state.items()}, "changes": feed, "dropped": sorted(self.dropped)}
        self.db.files.create(f"{self.db.root}/manifest/{version:012d}.json", json.dumps(manifest))
        return results

    @staticmethod
    def _net(parts: list[DataFrame]) -> DataFrame:
        """One row per document: what the whole batch did to it."""
        every = None
        for i, p in enumerate(parts):
            one = p.select(F.col("_id"), "op", F.lit(i).alias("nth"))
            every = one if every is None else every.unionByName(one)
        ends = every.groupBy("_id").agg(F.min_by("op", "nth").alias("a"), F.max_by("op", "nth").alias("b"))
        born, gone = F.col("a") == "inserted", F.col("b") == "deleted"
        op = F.when(born & gone, None).when(born, "inserted").when(gone, "deleted").otherwise("updated")
        return ends.select("_id", op.alias("op")).where("op is not null")

    def _check_unique(self, name: str, only: str | None = None) -> None:
        state = self.state[name]
        for key, index in state.indexes.items():
            if not index["unique"] or only not in (None, key):
                continue
            changed = None
            if only is None and name in self.changes and not self.created(name, key):
                changed = self._net(self.changes[name])
            if (found := _repeated(self._frame(name), index, changed)) is not None:
                raise DuplicateValue(f"{name}: {key} = {list(found)[:-1]} stands twice")

    def created(self, name: str, key: str) -> bool:
        """Did this batch make the index?"""
        old = self.base["collections"].get(name)
        return old is None or key not in old.indexes or name in self.dropped

    # ---- steps

    def _own(self, name: str) -> State:
        folder_of(name)
        if name not in self.state:
            self.state[name] = State(T.StructType([T.StructField("_id", T.StringType(), True, {"kind": "id"})]))
        return self.state[name]

    def _frame(self, name: str) -> DataFrame:
        return self.db.frame(self.state.get(name))

    def write(self, name: str, df: DataFrame) -> list[str]:
        """Write data files and note their ranges of ids."""
        folder = f"data/{folder_of(name)}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.db.root}/{folder}")
        out = self._files_in(folder)
        self._note_ranges(name, out)
        return out

    def _files_in(self, folder: str) -> list[str]:
        every = self.db.files.data_below(f"{self.db.root}/{folder}")
        return [x.removeprefix(self.db.root + "/") for x in every if self.db.files.size(x)]

    def _write_apart(self, name: str, df: DataFrame, keep: str) -> tuple[list[str], list[str]]:
        """Files of the rows where the column ``keep`` is true, and of the others; that column is in neither."""
        folder = f"data/{folder_of(name)}/{uuid.uuid4().hex}"
        df.write.partitionBy(keep).parquet(f"{self.db.root}/{folder}")
        kept, gone = (self._files_in(f"{folder}/{keep}={x}") for x in ("true", "false"))
        self._note_ranges(name, kept)
        return kept, gone

    def _fixed(self, name: str, ids: DataFrame) -> DataFrame:
        """Ids that stay the same however often they are read; the next compaction deletes the file."""
        path = f"{self.db.root}/data/{folder_of(name)}/{uuid.uuid4().hex}"
        ids.write.parquet(path)
        return self.db.spark.read.schema(ids.schema).parquet(path)

    def _note_ranges(self, name: str, files: list[str]) -> None:
        own = self._own(name)
        kind = next((x.dataType for x in own.schema.fields if x.name == "_id"), None)
        if not files or not isinstance(kind, (T.LongType, T.StringType)):
            return
        state = State(T.StructType([x for x in own.schema.fields if x.name == "_id"]), files)
        found = self.db.frame(state, "f").groupBy("f").agg(F.min("_id").alias("low"), F.max("_id").alias("high"), F.count_if(F.col("_id").isNull()).alias("nulls"))
        by_path = {plain(f"{self.db.root}/{x}"): x for x in files}
        for r in found.collect():  # a row for each file
            if not r["nulls"]:
                own.ranges[by_path[plain_from_scan(r["f"])]] = [r["low"], r["high"]]

    def _changed(self, name: str, ids: DataFrame, op: str) -> None:
        self.changes.setdefault(name, []).append(ids.select("_id", F.lit(op).alias("op")))

    def _insert(self, name: str, docs: Docs) -> Any:
        own = self._own(name)
        ids: Any
        if isinstance(docs, DataFrame):
            df = docs if "_id" in docs.columns else docs.withColumn("_id", generated_ids())
            schema = settled(df.schema)
        else:
            docs = [V.checked(d) for d in docs]
            docs = [d if d.get("_id") is not None else {"_id": V.DocId.new(), **d} for d in docs]
            if not docs:
                return []
            ids = [d["_id"] for d in docs]
            schema = schema_of(docs)
            df = self.db.spark.createDataFrame([to_spark(d, schema) for d in docs], schema)
        fresh = not own.files
        old = own.schema
        own.schema = T.StructType(sorted((schema if fresh else merge_schemas(own.schema, schema)).fields, key=lambda f: f.name != "_id"))
        if own.files and widened(old, own.schema):
            # Parquet's reader adds fields but does not turn integers into floats
            own.files = self.write(name, conform(self.db.frame(State(old, own.files)), own.schema))
        written = self.write(name, conform(df, own.schema))
        added = self.db.frame(State(own.schema, written))
        if not isinstance(docs, list):
            ids = added.count()
        again = added.groupBy("_id").count().where("count > 1 or _id is null").first()
        if again is not None:
            raise DuplicateId(f"{name}: _id {again['_id']} stands twice in what is inserted, or is null")
        ranges = [own.ranges.get(x) for x in written]
        near = own.files
        if written and all(ranges):
            near = own.may_hold(min(r[0] for r in ranges), max(r[1] for r in ranges))
        if near:
            there = self.db.frame(State(own.schema, near)).select("_id").join(added.select("_id"), "_id", "left_semi").first()
            if there is not None:
                raise DuplicateId(f"{name}: there is a document of _id {there['_id']}")
        own.files = own.files + written
        self._changed(name, added, "inserted")
        return ids

    def _chosen(self, name: str, f: A.Filter) -> DataFrame:
        """Ids of what the filter finds, with its sort, skip and limit."""
        found = fnd.match(self._frame(name), f)
        if f.order or f.offset or f.limit is not None:
            found = fnd.arrange(found, f)
        return found.select("_id")

    def _rewrite(self, name: str, f: A.Filter, change: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
        """Rewrite the files that hold a chosen document.

        ``change`` gets their rows and the names of two columns: the first says which are chosen, and
        it returns rows with both, of which the second says which stay.  Gives the ids of the
        rows hit, with the second column.
        """
        own = self._own(name)
        df = self._frame(name)
        plainly = not (f.order or f.offset or f.limit is not None)
        # names that no document ever has: they are columns of the files
        hit, keep = (f"{x}_{uuid.uuid4().hex}" for x in ("hit", "keep"))
        (path,) = fresh(own.schema.names, "file")
        located = self.db.frame(own, path) if own.files else df.withColumn(path, F.lit(""))
        if plainly:
            touched = fnd.match(located, f).select(path)
        else:
            chosen = self._fixed(name, self._chosen(name, f))
            touched = located.select("_id", path).join(chosen, "_id", "left_semi").select(path)
        # names of files, of which a collection has few beside its rows
        named = {plain_from_scan(r[0]) for r in touched.distinct().collect()}
        by_path = {plain(f"{self.db.root}/{x}"): x for x in own.files}
        if lost := named - by_path.keys():
            raise DocframeError(f"{name}: a document was found in a file that the manifest lacks: {sorted(lost)[0]}")
        mine = [x for x in own.files if plain(f"{self.db.root}/{x}") in named]
        if not mine:
            return df.limit(0).select("_id").withColumn(keep, F.lit(True))
        rows = self.db.frame(State(own.schema, mine))
        if plainly:
            test = C.where(f.where, C.Scope.of(rows))
            rows = rows.withColumn(hit, F.lit(True) if test is None else F.coalesce(test, F.lit(False)))
        else:
            rows = rows.join(chosen.withColumn(hit, F.lit(True)), "_id", "left").withColumn(hit, F.coalesce(F.col(hit), F.lit(False)))
        out = change(rows, hit, keep)
        schema = settled(T.StructType([x for x in out.schema.fields if x.name not in (hit, keep)]))
        merged = merge_schemas(own.schema, schema)
        if widened(own.schema, merged):
            # Parquet's reader adds fields but does not turn integers into floats
            rest = [x for x in own.files if x not in mine]
            if rest:
                own.files = mine + self.write(name, conform(self.db.frame(State(own.schema, rest)), merged))
        own.schema = merged
        flags = [T.StructField(hit, T.BooleanType()), T.StructField(keep, T.BooleanType())]
        # files keep the column of hits, which no read of documents names
        written, gone = self._write_apart(name, conform(out, T.StructType([*merged.fields, *flags])), keep)
        own.files = [x for x in own.files if x not in mine] + written
        fields = T.StructType([*[x for x in merged.fields if x.name == "_id"], flags[0]])
        parts = [self.db.frame(State(fields, files)).where(F.col(hit)).select("_id", F.lit(stays).alias(keep)) for files, stays in ((written, True), (gone, False)) if files]
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])

    def _delete(self, name: str, f: A.Filter) -> int:
        if name not in self.state:
            return 0
        gone = self._rewrite(name, f, lambda rows, hit, keep: rows.withColumn(keep, ~F.col(hit)))
        n = gone.count()
        if n:
            self._changed(name, gone, "deleted")
        return n

    def _update(self, name: str, f: A.Filter, update: Any) -> int:
        if name not in self.state:
            return 0

        def change(rows: DataFrame, hit: str, keep: str) -> DataFrame:
            if callable(update):
                return _by_function(rows, update, hit, keep)
            # the old values go along in the row: a document that comes out the same is not told as changed
            fields = [x for x in rows.schema.fields if x.name != hit]
            (old,) = fresh(rows.columns, "old")
            new = upd.columns(rows.withColumn(old, F.struct(*[F.col(f"`{x.name}`") for x in fields])), update, F.col(hit))
            same = F.lit(True)
            for x in new.schema.fields:
                if x.name in (old, hit):
                    continue
                was = next((y for y in fields if y.name == x.name), None)
                same = same & _unchanged(x, was, old)
            return new.withColumn(hit, F.col(hit) & ~same).drop(old).withColumn(keep, F.lit(True))

        done = self._rewrite(name, f, change)
        n = done.count()
        if n:
            self._changed(name, done, "updated")
        return n

    def _replace(self, name: str, doc_id: Any, doc: dict) -> int:
        doc = V.checked({**doc, "_id": doc_id})
        found = self._frame(name)
        f = A.Filter().eq("_id", doc_id)
        if fnd.match(found, f).limit(1).isEmpty():
            return 0
        changes = self.changes.get(name, [])[:]
        self._delete(name, f)
        self._insert(name, [doc])
        self.changes[name] = changes
        self._changed(name, self.db.spark.createDataFrame([(to_spark(doc_id, T.StringType()),)], T.StructType([next(x for x in self.state[name].schema.fields if x.name == "_id")])), "updated")
        return 1

    def _upsert(self, name: str, f: A.Filter, new: dict | upd.Update) -> dict:
        found = [r["_id"] for r in fnd.match(self._frame(name), f).select("_id").limit(2).collect()]
        if len(found) > 1:
            raise MultipleMatches(f"{name}: several documents meet {print_filter(f)}")
        if found:
            doc_id = V.DocId(found[0]) if any(x.name == "_id" and (x.metadata or {}).get("kind") == "id" for x in self.state[name].schema.fields) else found[0]
            if isinstance(new, upd.Update):
                self._update(name, A.Filter().eq("_id", doc_id), new)
            else:
                self._replace(name, doc_id, new)
            return {"updated": doc_id}
        doc = upd.apply(new, seed(f.where), inserting=True) if isinstance(new, upd.Update) else dict(new)
        return {"inserted": self._insert(name, [doc])[0]}


def widened(a: T.DataType, b: T.DataType) -> bool:
    """Does a field of both have another type in ``b``, but for fields added to objects?"""
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        new = {f.name: f.dataType for f in b.fields}
        return any(widened(f.dataType, new[f.name]) for f in a.fields)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return widened(a.elementType, b.elementType)
    return a != b


def seed(c: A.Condition) -> dict:
    """The document that an upsert starts from: the filter's equalities."""
    out: dict = {}

    def take(x: A.Condition) -> None:
        nonlocal out
        if isinstance(x, A.And):
            for y in x.items:
                take(y)
        elif isinstance(x, A.Compare) and x.op == "eq" and not x.path.each and x.path.steps and x.value is not None:
            there = upd._get(out, list(x.path.names))
            if there is not upd._NONE and not V.equal(there, x.value):
                raise QueryError(f"the filter gives {x.path.dotted!r} two values")
            out = upd._put(out, list(x.path.names), x.value, x.path.dotted)

    take(c)
    return out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``, in its order and types; missing ones are null."""

    def fit(node: C.Node | None, t: T.DataType) -> Any:
        if node is None:
            return F.lit(None).cast(t)
        if node.type == t:
            return node.column
        if isinstance(t, T.StructType) and isinstance(node.type, T.StructType):
            return F.when(node.column.isNotNull(), F.struct(*[fit(C.child(node, f.name), f.dataType).alias(f.name) for f in t.fields]))
        if isinstance(t, T.ArrayType) and isinstance(node.type, T.ArrayType):
            return F.transform(node.column, lambda e: fit(C.Node(e, node.type.elementType), t.elementType))
        return node.column.cast(t)

    scope = C.Scope.of(df)
    return df.select(*[fit(scope.root(f.name), f.dataType).alias(f.name, metadata=f.metadata or {}) for f in schema.fields])


def _unchanged(x: T.StructField, was: T.StructField | None, old: str) -> Any:
    """Is a field as it was in the struct ``old``?"""
    now = F.col(f"`{x.name}`")
    if was is None:
        return now.isNull()
    before = F.col(old).getField(x.name)
    if was.dataType == x.dataType and not _has_map(x.dataType):
        return now.eqNullSafe(before)
    # types that grew, and maps, have no equality; nulls do not show in JSON
    return F.to_json(F.struct(now.alias("x"))).eqNullSafe(F.to_json(F.struct(before.alias("x"))))


def _has_map(t: T.DataType) -> bool:
    return "map<" in t.simpleString() or "variant" in t.simpleString()


def _by_function(rows: DataFrame, function: Callable[[dict], dict | None], hit_name: str, keep_name: str) -> DataFrame:
    """Each hit document through a function, by Arrow batches; None leaves it as it is."""
    schema = T.StructType([x for x in rows.schema.fields if x.name != hit_name])

    def run(frames: Any) -> Any:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in frames:
            done = []
            for row in batch.to_pylist():
                hit = row.pop(hit_name)
                if hit:
                    try:
                        new = function(dict(row))
                    except Exception as e:
                        raise ClosureError(f"an update's function raised {e!r}") from e
                    hit = new is not None and new != row
                    row = {**(new if hit else row), "_id": row["_id"]}
                done.append({**{f.name: row.get(f.name) for f in schema.fields}, hit_name: hit, keep_name: True})
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    out = T.StructType([*schema.fields, T.StructField(hit_name, T.BooleanType()), T.StructField(keep_name, T.BooleanType())])
    return rows.select(*[F.col(f"`{f.name}`") for f in schema.fields], hit_name).mapInArrow(run, out)


__all__ = ["Batch", "Collection", "Database", "DocframeError", "Snapshot", "View"]
