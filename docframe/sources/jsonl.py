"""Collections as JSON lines: export, import and verification.

One file: a header, for each collection its name and its documents by id, and an end line with the
counts; it goes through the driver.  A folder: the same documents as text files that executors write and
read, and ``export.json`` with the names, indexes and counts, written last.  Values have the tags of
``functions.codec``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from ..errors import DocframeError
from ..functions import codec
from ..plans.documents import value
from .rows import document

FORMAT = {"$docframe": 1}


def whole_value(row: dict, schema: Any) -> dict:
    """A document from a row of an Arrow batch; nulls inside objects are left out."""

    def clean(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: clean(y) for k, y in x.items() if y is not None}
        return [clean(y) for y in x] if isinstance(x, list) else x

    return clean(value(row, schema))


class ImportFailed(DocframeError):
    """A line that cannot be imported, with its number."""


def lines(db: Any, version: int | None = None) -> Iterator[str]:
    """The export, line by line, of one version; documents come a partition at a time."""
    from .store import View

    version = db.version() if version is None else version
    yield json.dumps(FORMAT)
    counts = {}
    for name in sorted(db.manifest(version)["collections"]):
        yield json.dumps({"$collection": name, "$indexes": [{k: v for k, v in i.items() if k != "name"} for i in View(db, name, version).indexes()]})
        n = 0
        df = View(db, name, version).df
        for r in df.orderBy("_id").toLocalIterator():
            yield codec.dumps(document(r, df.schema))
            n += 1
        counts[name] = n
    yield json.dumps({"$end": counts})


def export(db: Any, path: str) -> dict:
    """Write the export to a local file, whole or not at all; counts by collection."""
    import os

    last = "{}"
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        for last in lines(db):
            f.write(last + "\n")
    os.replace(f"{path}.part", path)
    return json.loads(last)["$end"]


def load(db: Any, text: Iterable[str], batch: int = 1000, whole: bool = False) -> dict:
    """Add the documents of an export to the database, ``batch`` to a commit; counts by collection.

    Documents without an _id get one.  Batches before a bad line stay.  With ``whole`` a missing end
    line is an error.
    """
    name, held, counts, ended = None, [], {}, False

    def flush() -> None:
        nonlocal held
        if held:
            db.collection(name).insert(held)
            counts[name] = counts.get(name, 0) + len(held)
            held = []

    for number, line in enumerate(text, 1):
        if not line.strip():
            continue
        try:
            raw = json.loads(line)
            if not isinstance(raw, dict):
                raise ValueError("not an object")
            if number == 1 and raw.keys() == FORMAT.keys():
                continue
            if "$collection" in raw:
                flush()
                name = raw["$collection"]
                counts.setdefault(name, 0)
                for i in raw.get("$indexes", []):
                    db.collection(name).create_index(*i["fields"], unique=i["unique"], sparse=i["sparse"])
                continue
            if "$end" in raw:
                flush()
                ended = True
                if raw["$end"] != counts:
                    raise ValueError(f"the end counts {raw['$end']}, but {counts} came")
                continue
            if name is None or ended:
                raise ValueError("a document outside a collection")
            held.append(codec.from_plain(raw))
            if len(held) >= batch:
                flush()
        except (ValueError, KeyError, TypeError, DocframeError) as e:
            raise ImportFailed(f"line {number}: {e}") from e
    flush()
    if whole and not ended:
        raise ImportFailed("the export has no end line")
    return counts


def open_lines(path: str) -> Any:
    """A file to read line by line; lines end with a newline only, as other ends may stand in strings."""
    return open(path, encoding="utf-8", newline="\n")  # noqa: SIM115


def export_folder(db: Any, folder: str, version: int | None = None) -> dict:
    """Write an export as a folder in storage that executors share; counts by collection."""
    from .store import View, folder_of

    version = db.version() if version is None else version
    head: dict = {**FORMAT, "version": version, "collections": []}
    for name in sorted(db.manifest(version)["collections"]):
        view = View(db, name, version)
        df = view.df
        schema = df.schema

        def write(batches: Any, schema: Any = schema) -> Any:
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([codec.dumps({k: v for k, v in whole_value(d, schema).items() if v is not None}) for d in b.to_pylist()], pa.string())], ["value"])

        path = f"{folder}/{folder_of(name)}"
        df.sort("_id").mapInArrow(write, "value string").write.text(path, lineSep="\n")
        n = db.spark.read.text(path, lineSep="\n").count()
        head["collections"].append({"name": name, "folder": folder_of(name), "documents": n, "indexes": [{k: v for k, v in i.items() if k != "name"} for i in view.indexes()]})
    db.files.create(f"{folder}/export.json", json.dumps(head))
    return {c["name"]: c["documents"] for c in head["collections"]}


def import_folder(db: Any, folder: str) -> dict:
    """Add the documents of such a folder, a commit for each collection; counts by collection.

    Executors read the lines twice: once for the types of the fields, of which the driver gets a
    schema from each task, and once for the rows.
    """
    if not db.files.exists(f"{folder}/export.json"):
        raise ImportFailed(f"{folder} has no export.json: the export did not end")
    counts = {}
    for c in json.loads(db.files.read(f"{folder}/export.json"))["collections"]:
        text = db.spark.read.text(f"{folder}/{c['folder']}", lineSep="\n").where("value <> ''")
        found = typed_rows(text)
        n = 0
        if found is not None:
            n = db.collection(c["name"]).insert(found)
        counts[c["name"]] = n
        if n != c["documents"]:
            raise ImportFailed(f"{c['name']}: the export has {c['documents']} documents, but {n} came")
        for i in c["indexes"]:
            db.collection(c["name"]).create_index(*i["fields"], unique=i["unique"], sparse=i["sparse"])
    return counts


def typed_rows(text: Any) -> Any:
    """A DataFrame of the documents in column ``value``, with a column for each field; None without a line."""
    from pyspark.sql import types as T

    from .rows import merge_schemas, schema_of, settled, to_arrow_value

    def kinds(batches: Any) -> Any:
        import pyarrow as pa

        seen = None
        for b in batches:
            own = schema_of([codec.loads(x) for x in b.column(0).to_pylist()], whole=False)
            seen = own if seen is None else merge_schemas(seen, own)
        if seen is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seen.json()])], ["schema"])

    schema = None
    for r in text.mapInArrow(kinds, "schema string").distinct().collect():
        own = T.StructType.fromJson(json.loads(r["schema"]))
        schema = own if schema is None else merge_schemas(schema, own)
    if schema is None:
        return None
    schema = settled(schema)

    def rows(batches: Any) -> Any:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            docs = [codec.loads(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([to_arrow_value(d, schema) for d in docs], schema=arrow)

    return text.mapInArrow(rows, schema)


def verify(spark: Any, path: str, scratch: str) -> dict:
    """Restore an export into a scratch database, check it, and count its documents."""
    from .store import Database

    db = Database(spark, scratch)
    if db.files.exists(f"{path}/export.json"):
        counts = import_folder(db, path)
    else:
        with open_lines(path) as f:
            counts = load(db, f, whole=True)
    return {"collections": counts, "check": db.check()}


# ---- lines of batches


@dataclass(frozen=True)
class LineOp:
    """One line's operation: {"op": "insert", "collection": "c", "doc": {...}} and the like."""

    line: int
    op: str
    collection: str
    filter: Any = None
    change: Any = None


class BatchLines:
    """Operations read from JSON lines: insert (doc), update (filter, update), delete (filter), upsert
    (filter, doc or update), require and require_none (filter), drop.

    ``params`` are shared by the filters; one that no filter has is an error.  A bad line is
    ImportFailed with its number; ``failed_line`` tells which line a commit stopped at.
    """

    def __init__(self, text: Iterable[str], params: dict | None = None):
        from ..operators.update import Update
        from ..plans.template import Params, Template

        self.ops: list[LineOp] = []
        self.failed_line: int | None = None
        given, used = Params(params or {}), set()
        for number, line in enumerate(text, 1):
            if not line.strip():
                continue
            try:
                x = codec.loads(line)
                op, found, change = x["op"], None, None
                if op not in ("insert", "update", "delete", "upsert", "require", "require_none", "drop"):
                    raise ValueError(f"no operation {op!r}")
                if op not in ("insert", "drop"):
                    template = Template.filter(x["filter"])
                    used |= set(template.params)
                    found = template.bind(given.only(template.params))
                if op in ("insert", "upsert") and "doc" in x:
                    change = x["doc"]
                elif op in ("update", "upsert"):
                    change = Update.of(x["update"])
                elif op == "insert":
                    raise KeyError("doc")
                self.ops.append(LineOp(number, op, x["collection"], found, change))
            except (ValueError, KeyError, TypeError, DocframeError) as e:
                raise ImportFailed(f"line {number}: {e!r}") from e
        if unused := sorted(set(given) - used):
            raise ImportFailed(f"no line uses the parameter :{unused[0]}")

    def batch(self, db: Any) -> Any:
        """A batch of the operations, in order."""
        out = db.batch()
        for x in self.ops:
            if x.op == "insert":
                out.insert(x.collection, x.change)
            elif x.op in ("update", "upsert"):
                getattr(out, x.op)(x.collection, x.filter, x.change)
            elif x.op == "drop":
                out.drop(x.collection)
            else:
                getattr(out, x.op)(x.collection, x.filter)
            out.steps[-1] = self._told(x.line, out.steps[-1])
        return out

    def _told(self, line: int, step: Any) -> Any:
        def run() -> Any:
            self.failed_line = line
            done = step()
            self.failed_line = None
            return done

        return run


def read_batch(db: Any, text: Iterable[str], params: dict | None = None) -> Any:
    """A batch from such lines."""
    return BatchLines(text, params).batch(db)


__all__ = ["BatchLines", "ImportFailed", "LineOp", "export", "export_folder", "import_folder", "lines", "load", "open_lines", "read_batch", "verify"]
