"""Documents without a schema: one string column of tagged JSON beside _id.

Any field may hold any kind in any document, and a missing field is not a null one.  Filters run
as the in-memory evaluator over Arrow batches on the executors.  Sorting is native: an evaluator
adds one binary key per document whose byte order is the sort order over all kinds.  Aggregates
turn the fields they read into columns of canonical text, numbers and sort keys, and sum natively.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import codec
from ..functions import values as V
from ..operators import find as fnd
from ..plans import ast as A
from ..plans import evaluate as E
from ..plans.compile import time_ns

SCHEMA = "_id string, doc string"


def _text(value: bytes) -> bytes:
    """Bytes that end: zero bytes are escaped, and two zeros close."""
    return value.replace(b"\0", b"\0\xff") + b"\0\0"


def sort_bytes(value: Any, descending: bool = False) -> bytes:
    """Bytes in the order of ``values.order``; unordered values come last in both directions."""
    rank = V.rank(value)
    if rank == V.UNORDERED:
        return b"\xff"
    name = V.group(V.kind(value))
    body = b""
    if name == "bool":
        body = bytes([value])
    elif name == "number":
        # the nearest double, then what an integer lacks to it
        near = float(value) + 0.0
        bits = struct.unpack(">Q", struct.pack(">d", near))[0]
        bits = bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63
        rest = int(value) - int(near) if isinstance(value, int) else 0
        body = struct.pack(">QI", bits, rest + (1 << 31))
    elif name in ("string", "id"):
        body = _text(str(value).encode("utf-8", "surrogatepass"))
    elif name == "binary":
        body = _text(value)
    elif name == "datetime":
        body = _text(value.strftime("%Y").zfill(4).encode() + value.strftime("-%m-%dT%H:%M:%S.%f").encode())
    elif name == "date":
        body = value.isoformat().encode()
    elif name == "time":
        body = struct.pack(">Q", time_ns(value))
    out = bytes([rank]) + body
    return bytes(254 - b if i == 0 else 255 - b for i, b in enumerate(out)) if descending else out


def canonical_text(value: Any) -> str | None:
    """Equal values have equal texts; None for null and missing."""
    return None if value is None else repr(V.canonical(value))


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of documents; those without an _id get one."""
    from .store import generated_ids

    own = F.from_json("value", "_id string")["_id"]
    raw = spark.read.text(path).where("value <> ''")
    return raw.select(F.coalesce(own, generated_ids()).alias("_id"), F.col("value").alias("doc"))


def from_documents(spark: SparkSession, docs: list[dict]) -> DataFrame:
    docs = [d if d.get("_id") is not None else {"_id": V.DocId.new(), **d} for d in map(V.checked, docs)]
    return spark.createDataFrame([(str(d["_id"]), codec.dumps(d)) for d in docs], SCHEMA)


def documents(df: DataFrame) -> list[dict]:
    return [codec.loads(r["doc"]) for r in df.select("doc").collect()]


def _map(df: DataFrame, step: Any, schema: str) -> DataFrame:
    """``step`` of each document: a tuple for the schema, or None to drop it."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        for batch in batches:
            rows = [r for r in (step(i, x, codec.loads(x)) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) if r is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow) if rows else pa.RecordBatch.from_pylist([], schema=arrow)

    types = T._parse_datatype_string(schema)
    return df.select("_id", "doc").mapInArrow(run, types)


def find(df: DataFrame, f: Any = None, params: dict | None = None) -> DataFrame:
    """The documents found, cut to what is selected, as (_id, doc)."""
    f = fnd.as_filter(f, params)
    if any(isinstance(o, A.Key) for o in f.order[1:]):
        raise QueryError("only the first sort key can be a function")

    def key(doc: dict) -> bytes | None:
        out = b""
        for o in f.order:
            if isinstance(o, A.Key):
                x = o.function(doc)
                if x is None or x != x:
                    return None
                out += sort_bytes(float(x), o.descending)
            else:
                out += sort_bytes(E.one(doc, o.path), o.descending)
        return out + sort_bytes(doc.get("_id"))

    def step(i: str, text: str, doc: dict) -> tuple | None:
        if not E.matches(f.where, doc):
            return None
        k = key(doc)
        if k is None:
            return None
        whole = f.select is None and not f.without
        return i, text if whole else codec.dumps(E.project(doc, f.select, f.without)), k

    out = _map(df, step, f"{SCHEMA}, _key binary")
    if f.order:
        out = out.orderBy("_key")
    if f.offset:
        out = out.offset(f.offset)
    if f.limit is not None:
        out = out.limit(f.limit)
    return out.drop("_key")


def count(df: DataFrame, f: Any = None, params: dict | None = None) -> int:
    return find(df, f, params).count()


def aggregate(df: DataFrame, f: Any, a: Any, params: dict | None = None) -> DataFrame:
    """Rows of the aggregate, as one string column ``row`` of tagged JSON, in order."""
    f, a = fnd.bind_both(f, a, params)
    if (a.window is not None or a.group_window is not None) and (f.order or f.offset or f.limit is not None):
        raise QueryError("a window does not go with a filter's sort, skip or limit")
    found = find(df, A.replace(f, select=None, without=()))
    shape = ", ".join(f"c{i} struct<hit:boolean,text:string,whole:decimal(38,0),real:double,sort:binary,value:string,by:binary>" for i in range(len(a.columns)))
    numbers = lambda x: V.kind(x) in ("int", "float")

    def facts(i: str, text: str, doc: dict) -> tuple:
        out = []
        for c in a.columns:
            x = None if c.path is None else E.one(doc, c.path)
            by = b"" if c.by is None else sort_bytes(E.one(doc, c.by))
            own = {"hit": c.where is None or E.matches(c.where, doc), "text": canonical_text(x), "whole": None, "real": None, "sort": None if x is None else sort_bytes(x), "value": codec.dumps(x), "by": by + sort_bytes(doc.get("_id"))}
            if numbers(x):
                from decimal import Decimal

                own["whole"] = Decimal(x) if isinstance(x, int) else None
                own["real"] = float(x) if isinstance(x, float) else None
            out.append(own)
        groups = [E.one(doc, g) for g in a.group]
        return i, "\x1f".join(canonical_text(g) or "" for g in groups), codec.dumps(groups), sort_bytes(doc.get("_id")), *out

    if a.window is not None or a.group_window is not None:
        found = _windowed(found, a)
    if a.unwind:
        found = _unwound(found, a.unwind)
    rows = _map(found, facts, f"_id string, g string, groups string, idsort binary{', ' * bool(shape)}{shape}")
    columns = [_column(c, F.col(f"c{i}")).alias(f"c{i}") for i, c in enumerate(a.columns)]
    shown = F.min_by("groups", "idsort").alias("groups")
    summed = (rows.groupBy("g") if a.group else rows.groupBy()).agg(shown, *columns)
    plain = [g.names for g in a.group]
    names = [c.name for c in a.columns]

    def finish(i: str, text: str, doc: dict) -> tuple | None:
        row: dict = {}
        for path, value in zip(plain, doc["g"]):
            at = row
            for n in path[:-1]:
                at = at.setdefault(n, {})
            at[path[-1]] = value
        row |= dict(zip(names, doc["c"]))
        if not E.matches(a.having, row):
            return None
        orders = (*a.order, *(A.Order(g) for g in a.group))
        return i, codec.dumps(row), b"".join(sort_bytes(E.one(row, o.path), o.descending) for o in orders)

    parts = F.concat(F.lit('{"g":'), F.coalesce("groups", F.lit("[]")), F.lit(',"c":['), F.concat_ws(",", *[F.col(f"c{i}") for i in range(len(names))]), F.lit("]}"))
    out = _map(summed.select(F.lit("").alias("_id"), parts.alias("doc")), finish, "_id string, row string, _key binary").orderBy("_key")
    if a.offset:
        out = out.offset(a.offset)
    if a.limit is not None:
        out = out.limit(a.limit)
    return out.select("row")


def _column(c: A.Column, x: Column) -> Column:
    """A column of the aggregate as tagged JSON text."""
    hit = x["hit"]
    null = F.lit("null")
    if c.kind == "count":
        return F.count(F.when(hit, 1)).cast("string")
    if c.kind == "count_distinct":
        return F.count_distinct(F.when(hit, x["text"])).cast("string")
    whole, real = F.sum(F.when(hit, x["whole"])), F.sum(F.when(hit, x["real"]))
    if c.kind == "sum":
        floats = F.coalesce(whole.cast("double"), F.lit(0.0)) + F.coalesce(real, F.lit(0.0)) + F.lit(0.0)
        fits = F.coalesce(whole, F.lit(0).cast("decimal(38,0)")).between(V.INT_MIN, V.INT_MAX)
        return F.when(real.isNull() & fits, F.coalesce(whole, F.lit(0).cast("decimal(38,0)")).cast("string")).otherwise(_float(floats))
    if c.kind == "avg":
        n = F.count(F.when(hit, x["whole"])) + F.count(F.when(hit, x["real"]))
        mean = F.try_divide(F.coalesce(whole.cast("double"), F.lit(0.0)) + F.coalesce(real, F.lit(0.0)), n)
        return F.when(n == 0, null).otherwise(_float(mean))
    if c.kind in ("min", "max"):
        ordered = hit & x["sort"].isNotNull() & (F.substring(x["sort"], 1, 1) != F.lit(bytearray(b"\xff")))
        best = F.min_by(x["value"], F.when(ordered, F.struct(x["sort"], x["by"]))) if c.kind == "min" else F.max_by(x["value"], F.when(ordered, x["sort"]))
        other = F.min_by(x["value"], F.when(hit & x["sort"].isNotNull(), x["by"]))
        return F.coalesce(best, other, null)
    pick = F.min_by if c.kind == "first" else F.max_by
    return F.coalesce(pick(x["value"], F.when(hit, x["by"])), null)


def _float(x: Column) -> Column:
    special = lambda n: F.lit('{"$float":"' + n + '"}')
    return F.when(F.isnan(x), special("NaN")).when(x == float("inf"), special("Infinity")).when(x == float("-inf"), special("-Infinity")).otherwise(x.cast("string"))


def _windowed(df: DataFrame, a: A.Aggregate) -> DataFrame:
    from datetime import timedelta

    def step(i: str, text: str, doc: dict) -> tuple:
        micro = lambda w: int(t.timestamp() * 1_000_000) if w is not None and V.kind(t := E.one(doc, w.path)) == "datetime" else None
        key = None if a.group_window is None or E.one(doc, a.group_window.path) is None else sort_bytes(E.one(doc, a.group_window.path)) + sort_bytes(doc.get("_id"))
        return i, text, "\x1f".join(canonical_text(E.one(doc, g)) or "" for g in a.group), micro(a.window), micro(a.group_window), key

    out = _map(df, step, f"{SCHEMA}, g string, at long, gat long, newest binary")
    us = lambda d: d // timedelta(microseconds=1)
    if a.window is not None:
        newest = out.agg(F.max("at").alias("top"))
        out = out.join(F.broadcast(newest), F.col("at") >= F.col("top") - us(a.window.size)).drop("top")
    if a.group_window is not None:
        if isinstance(a.group_window.size, timedelta):
            tops = out.groupBy("g").agg(F.max("gat").alias("top"))
            out = out.join(tops, "g").where(F.col("gat") >= F.col("top") - us(a.group_window.size))
        else:
            nth = F.row_number().over(Window.partitionBy("g").orderBy(F.col("newest").desc()))
            out = out.where("newest is not null").withColumn("nth", nth).where(F.col("nth") <= a.group_window.size)
    return out.select("_id", "doc")


def _unwound(df: DataFrame, paths: tuple[A.Path, ...]) -> DataFrame:
    def step(i: str, text: str, doc: dict) -> tuple:
        return i, [codec.dumps(d) for _, d in E._unwind([((), doc)], paths)]

    return _map(df, step, "_id string, docs array<string>").select("_id", F.explode("docs").alias("doc"))


def fields(df: DataFrame) -> DataFrame:
    """(path, kind, documents): how many documents hold a value of that kind at that path."""

    def step(i: str, text: str, doc: dict) -> tuple:
        seen: set[tuple[str, str]] = set()

        def walk(path: str, value: Any) -> None:
            if path:
                seen.add((path, V.kind(value)))
            if isinstance(value, dict):
                for k, x in value.items():
                    walk(f"{path}.{k}" if path else k, x)
            elif isinstance(value, list):
                for x in value:
                    walk(f"{path}[*]", x)

        walk("", doc)
        return i, [{"path": p, "kind": k} for p, k in sorted(seen)]

    pairs = _map(df, step, "_id string, seen array<struct<path:string,kind:string>>").select(F.explode("seen").alias("x")).select("x.*")
    return pairs.groupBy("path", "kind").agg(F.count("*").alias("documents")).orderBy(F.col("path") != "_id", "path", "kind")
