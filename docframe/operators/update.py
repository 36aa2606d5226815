"""Update operators: on documents in memory, and as columns of a typed DataFrame.

In a typed DataFrame a null field counts as missing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, UpdateError
from ..functions import values as V
from ..functions.names import fresh
from ..plans import ast as A
from ..plans import compile as C

#: Fixed names of the operators in a document's form.
OPERATORS = {"$set": "set", "$setOnInsert": "set_on_insert", "$unset": "unset", "$inc": "inc", "$mul": "mul", "$min": "min", "$max": "max", "$rename": "rename", "$push": "push", "$addToSet": "add_to_set", "$pull": "pull", "$pop": "pop"}


@dataclass(frozen=True)
class Change:
    op: str
    path: str
    value: Any = None


@dataclass(frozen=True)
class Update:
    """Changes to a document, applied in order."""

    changes: tuple[Change, ...] = ()

    def _add(self, op: str, path: str, value: Any = None) -> Update:
        return replace(self, changes=(*self.changes, Change(op, path, value)))

    def set(self, path: str, value: Any) -> Update:
        return self._add("set", path, V.checked(value))

    def set_on_insert(self, path: str, value: Any) -> Update:
        return self._add("set_on_insert", path, V.checked(value))

    def unset(self, path: str) -> Update:
        return self._add("unset", path)

    def inc(self, path: str, by: int | float) -> Update:
        return self._add("inc", path, by)

    def mul(self, path: str, by: int | float) -> Update:
        return self._add("mul", path, by)

    def min(self, path: str, value: Any) -> Update:
        return self._add("min", path, V.checked(value))

    def max(self, path: str, value: Any) -> Update:
        return self._add("max", path, V.checked(value))

    def rename(self, path: str, to: str) -> Update:
        return self._add("rename", path, to)

    def push(self, path: str, value: Any) -> Update:
        return self._add("push_all", path, [V.checked(value)])

    def push_all(self, path: str, values: list) -> Update:
        return self._add("push_all", path, V.checked(list(values)))

    def add_to_set(self, path: str, value: Any) -> Update:
        return self._add("add_to_set", path, V.checked(value))

    def pull(self, path: str, value: Any) -> Update:
        return self._add("pull", path, V.checked(value))

    def pop_first(self, path: str) -> Update:
        return self._add("pop", path, -1)

    def pop_last(self, path: str) -> Update:
        return self._add("pop", path, 1)

    @classmethod
    def of(cls, spec: Update | dict) -> Update:
        """From ``{"$inc": {"hits": 1}, ...}``, in the order written."""
        if isinstance(spec, Update):
            return spec.check()
        out = cls()
        for name, fields in spec.items():
            if name not in OPERATORS:
                raise QueryError(f"no update operator: {name!r}")
            if not isinstance(fields, dict):
                raise QueryError(f"{name} takes an object of fields")
            for path, value in fields.items():
                op = OPERATORS[name]
                if op == "push":
                    many = isinstance(value, dict) and set(value) == {"$each"}
                    out = out.push_all(path, value["$each"]) if many else out.push(path, value)
                elif op == "pop":
                    if value not in (1, -1):
                        raise QueryError("$pop takes 1 or -1")
                    out = out._add("pop", path, value)
                else:
                    out = out._add(op, path, value if op == "rename" else V.checked(value))
        return out.check()

    def check(self) -> Update:
        for c in self.changes:
            for path in (c.path, c.value) if c.op == "rename" else (c.path,):
                _checked_path(path)
            if c.op in ("inc", "mul") and V.kind(c.value) not in ("int", "float"):
                raise QueryError(f"{c.path!r}: {c.op} needs a number")
            if c.op in ("min", "max") and (V.rank(c.value) in (0, V.UNORDERED) or V.kind(c.value) == "binary"):
                raise QueryError(f"{c.path!r}: {c.op} needs a value with an order")
            if c.op == "rename" and (c.value == c.path or c.value.startswith(c.path + ".") or c.path.startswith(c.value + ".")):
                raise QueryError(f"{c.path!r}: a field cannot be renamed onto, into or out of itself")
        return self


def _checked_path(path: Any) -> None:
    if not isinstance(path, str) or not all(path.split(".")):
        raise QueryError(f"not a field for an update: {path!r}")
    if "[" in path or "]" in path:
        raise QueryError(f"{path!r}: an update names one field, without brackets")
    if path.split(".")[0] == "_id":
        raise QueryError(f"{path!r}: an _id cannot be updated")


# ---- in memory

_NONE = object()


def _get(doc: Any, names: list[str]) -> Any:
    for n in names:
        if not isinstance(doc, dict) or n not in doc:
            return _NONE
        doc = doc[n]
    return doc


def _put(doc: dict, names: list[str], value: Any, path: str) -> dict:
    if len(names) == 1:
        return {**doc, names[0]: value}
    inner = doc.get(names[0], {})
    if not isinstance(inner, dict):
        raise UpdateError(f"{path!r} goes through {names[0]!r}, which is no object")
    return {**doc, names[0]: _put(inner, names[1:], value, path)}


def _remove(doc: dict, names: list[str]) -> dict:
    if len(names) == 1:
        return {k: v for k, v in doc.items() if k != names[0]}
    inner = doc.get(names[0])
    return {**doc, names[0]: _remove(inner, names[1:])} if isinstance(inner, dict) else doc


def _arithmetic(op: str, a: Any, by: Any, path: str) -> Any:
    if V.kind(a) not in ("int", "float"):
        raise UpdateError(f"{path!r}: {op} needs a number there, not {V.kind(a)}")
    out = a + by if op == "inc" else a * by
    if isinstance(out, int) and not V.INT_MIN <= out <= V.INT_MAX:
        raise UpdateError(f"{path!r}: {out} does not fit 64 bits")
    return out


def apply(update: Update, doc: dict, inserting: bool = False) -> dict:
    """The document after the update; the one given stays as it is."""
    for c in update.changes:
        names = c.path.split(".")
        at = _get(doc, names)
        if c.op == "set" or c.op == "set_on_insert" and inserting:
            doc = _put(doc, names, c.value, c.path)
        elif c.op == "unset":
            doc = _remove(doc, names)
        elif c.op in ("inc", "mul"):
            new = (c.value if c.op == "inc" else type(c.value)(0)) if at is _NONE else _arithmetic(c.op, at, c.value, c.path)
            doc = _put(doc, names, new, c.path)
        elif c.op in ("min", "max"):
            if at is _NONE or at is None:
                doc = _put(doc, names, c.value, c.path)
                continue
            order = V.compare(at, c.value)
            if order is None:
                raise UpdateError(f"{c.path!r}: {c.op} cannot compare {V.kind(at)} with {V.kind(c.value)}")
            if order == (1 if c.op == "min" else -1):
                doc = _put(doc, names, c.value, c.path)
        elif c.op == "rename":
            if at is not _NONE:
                doc = _put(_remove(doc, names), c.value.split("."), at, c.value)
        elif c.op != "set_on_insert":
            if at is _NONE:
                if c.op in ("pull", "pop"):
                    continue
                at = []
            if not isinstance(at, list):
                raise UpdateError(f"{c.path!r}: {c.op} needs an array there, not {V.kind(at)}")
            if c.op == "push_all":
                new = at + c.value
            elif c.op == "add_to_set":
                new = at if any(V.equal(x, c.value) for x in at) else [*at, c.value]
            elif c.op == "pull":
                new = [x for x in at if not V.equal(x, c.value)]
            else:
                new = at[1:] if c.value == -1 else at[:-1]
            doc = _put(doc, names, new, c.path)
    return doc


# ---- typed columns


def _plain_literal(value: Any) -> Column:
    name = V.kind(value)
    if name == "array":
        return F.array(*map(_plain_literal, value))
    if name == "object":
        return F.struct(*[_plain_literal(x).alias(k) for k, x in value.items()])
    if name == "int":
        return F.lit(value).cast("long")
    if name == "datetime":
        return C.moment(value, T.TimestampType())
    if name == "id":
        return F.lit(str(value))
    if name == "time":
        return F.lit(C.time_ns(value)).cast("long")
    if name == "binary":
        return F.lit(bytearray(value))
    return F.lit(value)


def _as(value: Any, node: C.Node, path: str) -> Column:
    """The value for a field of that type."""
    x = C.literal(value, node)
    if x is None and V.kind(value) in ("int", "float") and node.kind == "float":
        x = F.lit(float(value)).cast(node.type)
    if x is None:
        raise UpdateError(f"{path!r} holds {node.kind}, not {V.kind(value)} {value!r}")
    return x


def _write(df: DataFrame, names: list[str], value: Column, hit: Column, path: str) -> DataFrame:
    """Give the field the value in the rows that are hit; parents that are missing are made."""
    scope = C.Scope.of(df)
    head = scope.root(names[0])
    if len(names) == 1:
        old = F.lit(None) if head is None else head.column
        return df.withColumn(names[0], F.when(hit, value).otherwise(old))

    def build(node: C.Node | None, rest: list[str]) -> Column:
        if not rest:
            return value
        if node is None:
            return F.struct(build(None, rest[1:]).alias(rest[0]))
        if not isinstance(node.type, T.StructType):
            raise UpdateError(f"{path!r} goes through a field that is no object")
        inner = C.child(node, rest[0])
        parts = [(build(inner, rest[1:]) if f.name == rest[0] else node.column.getField(f.name)).alias(f.name) for f in node.type.fields]
        return F.struct(*parts, *([build(None, rest[1:]).alias(rest[0])] if inner is None else []))

    new = build(head, names[1:])
    if head is None:
        return df.withColumn(names[0], F.when(hit, new))
    if C.child(head, names[1]) is None or len(names) > 2 and scope.walk(A.Path.of(path)) is None:
        # the type grows: rows that aren't hit get a null there
        def grown(node: C.Node, rest: list[str]) -> Column:
            inner = C.child(node, rest[0])
            parts = [(grown(inner, rest[1:]) if f.name == rest[0] and len(rest) > 1 else node.column.getField(f.name)).alias(f.name) for f in node.type.fields]
            if inner is None:
                empty = F.when(F.lit(False), build(None, rest[1:]))
                parts.append(empty.alias(rest[0]))
            return F.when(node.column.isNotNull(), F.struct(*parts))

        return df.withColumn(names[0], F.when(hit, new).otherwise(grown(head, names[1:])))
    return df.withColumn(names[0], F.when(hit, new).otherwise(head.column))


def _equals(v: Column) -> Any:
    return lambda e: e.eqNullSafe(v)


def _differs(v: Column) -> Any:
    return lambda e: ~e.eqNullSafe(v)


def columns(df: DataFrame, update: Update, hit: Column, inserting: bool = False) -> DataFrame:
    """``df`` with the update applied to the rows where ``hit`` (a column of it) is true.

    A change that does not suit a field's type is an UpdateError here; an integer that overflows
    is an error when the rows are computed.
    """
    # the rows are chosen before anything changes
    chosen, renamed = fresh([*df.columns, *(x for c in update.changes for x in (c.path.split(".")[0], str(c.value).split(".")[0]))], "chosen", "renamed")
    df, hit = df.withColumn(chosen, hit), F.col(chosen)
    for c in update.check().changes:
        names = c.path.split(".")
        node = C.Scope.of(df).walk(A.Path.of(c.path))
        x = None if node is None else node.column
        if c.op == "set_on_insert" and not inserting:
            continue
        if c.op in ("set", "set_on_insert"):
            new = _plain_literal(c.value) if node is None else _as(c.value, node, c.path)
        elif c.op == "unset":
            if node is None:
                continue
            new = F.lit(None).cast(node.type)
        elif c.op in ("inc", "mul"):
            if node is None:
                new = _plain_literal(c.value if c.op == "inc" else type(c.value)(0))
            else:
                if node.kind not in ("int", "float"):
                    raise UpdateError(f"{c.path!r}: {c.op} needs a number there, not {node.kind}")
                if isinstance(c.value, float) and node.kind == "int":
                    raise UpdateError(f"{c.path!r} holds integers; set it to a float first")
                by = F.lit(c.value) if isinstance(c.value, float) else F.lit(c.value).cast("long")
                out = F.coalesce(x + by, by) if c.op == "inc" else F.coalesce(x * by, F.lit(0))
                new = out.cast(node.type)
        elif c.op in ("min", "max"):
            if node is None:
                new = _plain_literal(c.value)
            else:
                v = _as(c.value, node, c.path)
                new = F.when(x.isNull() | (x > v if c.op == "min" else x < v), v).otherwise(x)
        elif c.op == "rename":
            if node is None:
                continue
            df = df.withColumn(renamed, x)
            there = C.Scope.of(df).walk(A.Path.of(c.value))
            moved = F.col(renamed) if there is None else F.coalesce(F.col(renamed).cast(there.type), there.column)
            df = _write(df, c.value.split("."), moved, hit & F.col(renamed).isNotNull(), c.value)
            df = _write(df, names, F.lit(None).cast(node.type), hit, c.path).drop(renamed)
            continue
        else:
            if node is None and c.op in ("pull", "pop"):
                continue
            if node is not None and not isinstance(node.type, T.ArrayType):
                raise UpdateError(f"{c.path!r}: {c.op} needs an array there, not {node.kind}")
            if node is None:
                new = F.array(*map(_plain_literal, c.value if c.op == "push_all" else [c.value]))
            else:
                element = C.Node(x, node.type.elementType)
                have = F.coalesce(x, F.array().cast(node.type))
                if c.op == "push_all":
                    new = F.concat(have, F.array(*[_as(v, element, c.path) for v in c.value]).cast(node.type))
                elif c.op == "add_to_set":
                    v = _as(c.value, element, c.path)
                    new = F.when(F.exists(have, _equals(v)), have).otherwise(F.concat(have, F.array(v).cast(node.type)))
                elif c.op == "pull":
                    if isinstance(c.value, float) and math.isnan(c.value) or (v := C.literal(c.value, element)) is None:
                        continue
                    new = F.filter(x, _differs(v))
                else:
                    n = F.size(x)
                    new = F.when(n == 0, x).otherwise(F.slice(x, F.lit(2) if c.value == -1 else F.lit(1), n - 1))
                    new = F.when(x.isNull(), x).otherwise(new)
        df = _write(df, names, new, hit, c.path)
    return df.drop(chosen)
