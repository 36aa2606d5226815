"""Conditions, sort keys and projections as Spark columns over a typed schema.

Logic has two values: a missing field is null, and null never makes a result unknown.  Negation
is pushed to the leaves, so that positive leaves stay plain comparisons that reach the Parquet
scan and a null result of a leaf may stand for false.  Kinds are known from the schema, so
comparisons across kinds become constants.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from datetime import timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ClosureError, QueryError
from ..functions import values as V
from . import ast as A
from .documents import on_documents
from .patterns import java_pattern, literal_prefix, python_pattern

Bool = Column | bool
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
#: Operators under negation.
_OPPOSITE = {"lt": "gte", "lte": "gt", "gt": "lte", "gte": "lt"}


@dataclass(frozen=True)
class Node:
    """A column with its type; ``tag`` is the kind that a field's metadata names (id or time)."""

    column: Column
    type: T.DataType
    tag: str | None = None

    @property
    def kind(self) -> str:
        if self.tag in ("id", "time"):
            return self.tag
        for types, name in ((T.BooleanType, "bool"), (_INTS, "int"), ((*_FLOATS, T.DecimalType), "float"), ((T.StringType, T.CharType, T.VarcharType), "string"), (T.BinaryType, "binary"), ((T.TimestampType, T.TimestampNTZType), "datetime"), (T.DateType, "date"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object")):
            if isinstance(self.type, types):
                return name
        return "null"


def tag_of(f: T.StructField) -> str | None:
    return (f.metadata or {}).get("kind")


class Scope:
    """Where paths start: a DataFrame's columns, or a value."""

    def __init__(self, schema: T.StructType | None = None, value: Node | None = None):
        self.schema, self.value = schema, value

    @classmethod
    def of(cls, df: Any) -> Scope:
        return cls(df.schema)

    def root(self, name: str) -> Node | None:
        if self.value is not None:
            return child(self.value, name)
        for f in self.schema.fields:
            if f.name == name:
                return Node(F.col("`" + name.replace("`", "``") + "`"), f.dataType, tag_of(f))
        return None

    def walk(self, path: A.Path) -> Node | None:
        """The node at a path without [*]; None if the schema has no such field."""
        if not path.steps:
            return self.value
        node = self.root(path.steps[0].name)
        for s in path.steps[1:]:
            node = None if node is None else child(node, s.name)
        return node


def child(node: Node, name: str) -> Node | None:
    if isinstance(node.type, T.StructType):
        for f in node.type.fields:
            if f.name == name:
                return Node(node.column.getField(name), f.dataType, tag_of(f))
    if isinstance(node.type, T.MapType) and isinstance(node.type.keyType, T.StringType):
        return Node(F.try_element_at(node.column, F.lit(name)), node.type.valueType)
    return None


def col(b: Bool) -> Column:
    return F.lit(b) if isinstance(b, bool) else b


def sure(b: Bool) -> Bool:
    """Without null."""
    return b if isinstance(b, bool) else F.coalesce(b, F.lit(False))


def both(a: Bool, b: Bool) -> Bool:
    if a is False or b is False:
        return False
    return b if a is True else a if b is True else a & b


def either(a: Bool, b: Bool) -> Bool:
    if a is True or b is True:
        return True
    return b if a is False else a if b is False else a | b


def invert(b: Bool) -> Bool:
    return not b if isinstance(b, bool) else ~b


# ---- literals


def moment(value: Any, kind: T.DataType) -> Column:
    utc = value.astimezone(timezone.utc).replace(tzinfo=None)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(utc.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(utc.isoformat(sep=" ") + "+00:00").cast("timestamp")


def time_ns(t: Any) -> int:
    return ((t.hour * 60 + t.minute) * 60 + t.second) * 10**9 + t.microsecond * 1000


def literal(value: Any, node: Node) -> Column | None:
    """The value in the node's type; None if no value of that type equals it."""
    if value is None:
        return F.lit(None).cast(node.type)
    name = V.kind(value)
    if V.group(name) != V.group(node.kind):
        return None
    if name in ("int", "float"):
        if isinstance(value, float) and math.isnan(value):
            return None
        if isinstance(node.type, _INTS):
            whole = int(value) if math.isfinite(value) and value == int(value) else None
            if whole is None or not V.INT_MIN <= whole <= V.INT_MAX:
                return None
            bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(node.type), 64)
            return F.lit(whole).cast(node.type) if -(1 << bits - 1) <= whole < 1 << bits - 1 else None
        if isinstance(node.type, T.DecimalType):
            if isinstance(value, float) and not math.isfinite(value):
                return None
            exact = Decimal(value)
            digits = Decimal(1).scaleb(-node.type.scale)
            if abs(exact) >= Decimal(10) ** (node.type.precision - node.type.scale) or exact % digits:
                return None
            return F.lit(format(exact, "f")).cast(node.type)
        as_float = float(value)
        if isinstance(value, int) and int(as_float) != value:
            return None
        if isinstance(node.type, T.FloatType):
            import struct

            try:
                narrow = struct.unpack("f", struct.pack("f", as_float))[0]
            except OverflowError:
                return None
            return F.lit(as_float).cast("float") if narrow == as_float else None
        return F.lit(as_float)
    if name == "id":
        return F.lit(str(value))
    if name == "time":
        return F.lit(time_ns(value)).cast("long")
    if name == "datetime":
        return moment(value, node.type)
    if name == "binary":
        return F.lit(bytearray(value))
    if name == "array":
        if not isinstance(node.type, T.ArrayType):
            return None
        items = [literal(x, Node(node.column, node.type.elementType)) for x in value]
        return None if any(x is None for x in items) else F.array(*items).cast(node.type)
    if name == "object":
        if not isinstance(node.type, T.StructType) or not set(value) <= {f.name for f in node.type.fields}:
            return None
        parts = {f.name: literal(value.get(f.name), Node(node.column, f.dataType, tag_of(f))) for f in node.type.fields}
        return None if any(x is None for x in parts.values()) else F.struct(*[x.alias(k) for k, x in parts.items()]).cast(node.type)
    return F.lit(value)


def _bounds(value: int | float, node: Node, op: str) -> tuple[str, Column] | bool:
    """An ordering against a number, made exact in the column's own type."""
    if math.isinf(value):
        if isinstance(node.type, _FLOATS):
            return op, F.lit(value)
        return (value > 0) == (op in ("lt", "lte"))
    if isinstance(node.type, _INTS):
        low, high = math.floor(value), math.ceil(value)
        if low != high:  # between two whole numbers
            op, whole = ("lte", low) if op in ("lt", "lte") else ("gte", high)
        else:
            whole = low
        if whole > V.INT_MAX or whole < V.INT_MIN:
            return (whole > 0) == (op in ("lt", "lte"))
        return op, F.lit(whole).cast("long")
    if isinstance(node.type, T.DecimalType):
        return op, F.lit(Decimal(value)) if isinstance(value, int) else F.lit(float(value))
    f = float(value)
    if isinstance(value, int) and int(f) != value:
        # no double equals it: compare with the nearest on the other side
        below = f if int(f) < value else math.nextafter(f, -math.inf)
        return ("lte", F.lit(below)) if op in ("lt", "lte") else ("gte", F.lit(math.nextafter(below, math.inf)))
    return op, F.lit(f)


# ---- leaves


def _compare(node: Node | None, op: str, value: Any, negated: bool) -> Bool:
    if op == "ne":
        return _compare(node, "eq", value, not negated)
    if node is None:  # missing: as null
        return (value is None and op in ("eq", "lte", "gte")) != negated
    x = node.column
    if value is None:
        if op not in ("eq", "lte", "gte"):
            return negated
        return x.isNotNull() if negated else x.isNull()
    if V.group(V.kind(value)) != V.group(node.kind):
        return negated
    if op == "eq":
        v = literal(value, node)
        if v is None:
            return negated
        return ~x.eqNullSafe(v) if negated else x == v
    if op == "contains":
        folded = F.replace(F.lower(x), F.lit("ß"), F.lit("ss")).contains(F.lit(V.fold(value)))
        return x.isNull() | ~folded if negated else folded
    if op == "starts":
        hit = x.startswith(F.lit(bytearray(value) if isinstance(value, bytes) else value))
        return x.isNull() | ~hit if negated else hit
    if node.kind in ("array", "object"):
        return negated
    if node.kind in ("int", "float"):
        if isinstance(value, float) and math.isnan(value):
            return negated
        found = _bounds(value, node, op)
        if isinstance(found, bool):
            nan = F.isnan(x) if isinstance(node.type, _FLOATS) else F.lit(False)
            return (x.isNull() | nan if negated else x.isNotNull() & ~nan) if found else negated
        op, v = found
        if isinstance(node.type, T.FloatType):
            x = x.cast("double")
    else:
        v = literal(value, node)
    ways = {"lt": lambda: x < v, "lte": lambda: x <= v, "gt": lambda: x > v, "gte": lambda: x >= v}
    # Spark has NaN above all numbers and equal to itself
    may_nan = isinstance(node.type, _FLOATS)
    if not negated:
        out = ways[op]()
        infinite = isinstance(value, float) and math.isinf(value)
        if may_nan and (op in ("gt", "gte") or infinite):
            out = out & ~F.isnan(x)
        return out
    out = x.isNull() | ways[_OPPOSITE[op]]()
    return out | F.isnan(x) if may_nan and op in ("gt", "gte") else out


def _matches(node: Node | None, pattern: str, negated: bool) -> Bool:
    python_pattern(pattern)
    if node is None or node.kind != "string":
        return negated
    hit = node.column.rlike(java_pattern(pattern))
    if negated:
        return node.column.isNull() | ~hit
    prefix = literal_prefix(pattern)
    return node.column.startswith(prefix) & hit if prefix else hit


def _is_kind(node: Node | None, name: str, negated: bool) -> Bool:
    if node is None or name not in (node.kind, V.group(node.kind)):
        return negated
    return node.column.isNull() if negated else node.column.isNotNull()


def _size(node: Node | None, op: str, n: int) -> Bool:
    """For ``ne`` that of ``eq``."""
    if node is None or not isinstance(node.type, T.ArrayType):
        return False
    size = F.array_size(node.column)
    v = F.lit(n)
    return {"eq": size == v, "ne": size == v, "lt": size < v, "lte": size <= v, "gt": size > v, "gte": size >= v}[op]


def _has(node: Node | None, c: A.Condition) -> Bool:
    if node is None or not isinstance(node.type, T.ArrayType):
        return False
    element = node.type.elementType
    return F.exists(node.column, lambda e: col(sure(compile_condition(c, Scope(value=Node(e, element))))))


def _any(scope: Scope, path: A.Path, leaf: Callable[[Node | None], Bool]) -> Bool:
    """Does any value at the path meet the leaf?  Without [*] the leaf of the one value."""

    def go(node: Node | None, steps: tuple[A.Step, ...]) -> Bool:
        if not steps:
            return leaf(node)
        inner = (None if node is None else child(node, steps[0].name)) if node is not root else scope.root(steps[0].name)
        return spread(inner, steps[0].each, steps[1:])

    def spread(node: Node | None, each: int, rest: tuple[A.Step, ...]) -> Bool:
        if not each:
            return go(node, rest)
        if node is None or not isinstance(node.type, T.ArrayType):
            return False
        element = node.type.elementType
        if isinstance(one := spread(Node(F.lit(None).cast(element), element), each - 1, rest), bool) and not one:
            return False
        return sure(F.exists(node.column, lambda e: col(sure(spread(Node(e, element), each - 1, rest)))))

    root = object()
    if not path.steps:
        return leaf(scope.value)
    return go(root, path.steps)  # type: ignore[arg-type]


def _leaf(scope: Scope, path: A.Path, make: Callable[[Node | None, bool], Bool], negated: bool) -> Bool:
    if path.each:
        found = _any(scope, path, lambda n: make(n, False))
        return invert(sure(found)) if negated else found
    return make(scope.walk(path), negated)


def compile_condition(c: A.Condition, scope: Scope, negated: bool = False) -> Bool:
    """The condition as a column whose null stands for false, or a constant."""
    if isinstance(c, (A.And, A.Or)):
        join = both if isinstance(c, A.And) != negated else either
        out: Bool = join is both
        for x in c.items:
            out = join(out, compile_condition(x, scope, negated))
        return out
    if isinstance(c, A.Not):
        return compile_condition(c.item, scope, not negated)
    if isinstance(c, A.Compare):
        if isinstance(c.value, A.Param):
            raise QueryError(f"the parameter :{c.value.name} has no value")
        if c.op == "ne":
            return compile_condition(A.Compare(c.path, "eq", c.value), scope, not negated)
        return _leaf(scope, c.path, lambda n, no: _compare(n, c.op, c.value, no), negated)
    if isinstance(c, A.InList):
        return _in_list(c, scope, negated)
    if isinstance(c, A.Matches):
        return _leaf(scope, c.path, lambda n, no: _matches(n, c.pattern, no), negated)
    if isinstance(c, A.Exists):
        # a column of the schema is there in every row; a field of a null struct is not
        if c.path.each:
            return _leaf(scope, c.path, lambda n, no: (n is None) == no, negated)
        parent = scope.walk(A.Path(c.path.steps[:-1])) if len(c.path.steps) > 1 else None
        if scope.walk(c.path) is None:
            return negated
        if parent is None:
            return not negated
        return parent.column.isNull() if negated else parent.column.isNotNull()
    if isinstance(c, A.IsKind):
        return _leaf(scope, c.path, lambda n, no: _is_kind(n, c.kind, no), negated)
    if isinstance(c, A.Size):
        found = sure(_any(scope, c.path, lambda n: _size(n, c.op, c.n)))
        return invert(found) if negated != (c.op == "ne") else found
    if isinstance(c, A.Has):
        found = sure(_any(scope, c.path, lambda n: _has(n, c.condition)))
        return invert(found) if negated else found
    if isinstance(c, A.Custom):
        found = sure(_custom(c, scope))
        return invert(found) if negated else found
    raise QueryError("`now` must be resolved before a query is compiled")


def _in_list(c: A.InList, scope: Scope, negated: bool) -> Bool:
    negated = negated != c.negated
    if isinstance(c.values, A.Param):
        raise QueryError(f"the parameter :{c.values.name} has no value")

    def leaf(node: Node | None, no: bool) -> Bool:
        null = any(v is None for v in c.values)
        if node is None:
            return null != no
        own = [x for x in (literal(v, node) for v in c.values if v is not None) if x is not None]
        x = node.column
        if not own:
            return _compare(node, "eq", None, no) if null else no
        hit = x.isin(*own) if len(own) > 1 else x == own[0]
        if not no:
            return x.isNull() | hit if null else hit
        return x.isNotNull() & ~hit if null else x.isNull() | ~hit

    return _leaf(scope, c.path, leaf, negated)


def _custom(c: A.Custom, scope: Scope) -> Bool:
    """By Arrow batches of the named fields; one that the schema lacks is left out of the dict, a null is None."""

    def test(doc: dict) -> bool:
        try:
            return bool(c.function(doc))
        except Exception as e:
            raise ClosureError(f"a condition's function raised {e!r}") from e

    fields = [f for n in c.fields for f in scope.schema.fields if f.name == n]
    return on_documents(test, T.StructType(fields), "boolean")


def where(c: A.Condition, scope: Scope) -> Column | None:
    """For ``DataFrame.where``; None if it holds always."""
    out = compile_condition(c, scope)
    return None if out is True else col(out)


# ---- sorting


def sort_columns(orders: tuple[A.Order, ...], scope: Scope, last: tuple[str, ...] = ("_id",)) -> list[Column]:
    """Sort keys: null first ascending and last descending; values without an order last in both;
    then the columns ``last`` ascending, so that ties have one order."""
    out = []
    for o in orders:
        if o.path.each:
            raise QueryError("a sort does not go into arrays")
        node = scope.walk(o.path)
        if node is None:
            continue
        x = node.column
        if node.kind in ("array", "object"):
            out.append(x.isNotNull().asc())
            continue
        if isinstance(node.type, _FLOATS):
            out.append(F.coalesce(F.isnan(x), F.lit(False)).asc())
        out.append(x.desc_nulls_last() if o.descending else x.asc_nulls_first())
    for name in last:
        if (node := scope.root(name)) is not None and node.kind not in ("array", "object"):
            out.append(node.column.asc_nulls_first())
    return out


# ---- projection


def _tree(paths: tuple[A.Path, ...]) -> dict:
    """name -> tree below it; an empty tree is the whole field.  Paths end at their first [*]."""
    root: dict = {}
    whole = object()
    for p in paths:
        at = root
        for i, s in enumerate(p.steps):
            end = i == len(p.steps) - 1 or s.each
            if at.get(s.name) is whole:
                break
            if end:
                at[s.name] = whole
                break
            at = at.setdefault(s.name, {})
    clean = lambda t: {} if t is whole else {k: clean(v) for k, v in t.items()}
    return clean(root)


def _keep(node: Node, tree: dict) -> Column | None:
    if not tree:
        return node.column
    parts = []
    for name, below in tree.items():
        inner = child(node, name)
        kept = None if inner is None else _keep(inner, below)
        if kept is not None:
            parts.append(kept.alias(name))
    if not parts:
        return None
    return F.when(node.column.isNotNull(), F.struct(*parts))


def _drop(node: Node, tree: dict) -> Column | None:
    if not tree:
        return None
    if not isinstance(node.type, T.StructType):
        return node.column
    parts = []
    for f in node.type.fields:
        inner = child(node, f.name)
        kept = _drop(inner, tree[f.name]) if f.name in tree else inner.column
        if kept is not None:
            parts.append(kept.alias(f.name))
    # an object without fields has no Parquet form: a null stands for it
    return F.when(node.column.isNotNull(), F.struct(*parts)) if parts else F.lit(None).cast("string")


def project(select: tuple[A.Path, ...] | None, without: tuple[A.Path, ...], scope: Scope) -> list[Column]:
    """The columns handed out: _id always and first when selecting."""
    names = [f.name for f in scope.schema.fields]
    found: dict[str, Column]
    if select is None or any(not p.steps for p in select):
        found = {n: scope.root(n).column for n in names}
    else:
        tree = {"_id": {}} | _tree(select)
        found = {}
        for name, below in tree.items():
            node = scope.root(name)
            kept = None if node is None else _keep(node, {} if name == "_id" else below)
            if kept is not None:
                found[name] = kept
    if any(not p.steps for p in without):
        found = {n: x for n, x in found.items() if n == "_id"}
    for name, below in _tree(tuple(p for p in without if p.steps)).items():
        if name == "_id" or name not in found:
            continue
        node = scope.root(name)
        kept = _drop(node, below)
        if kept is None:
            del found[name]
        elif select is None:
            found[name] = kept
        else:
            # selected and cut: take away from what was kept
            found[name] = found[name].dropFields(*[".".join(p.names[1:]) for p in without if p.names[:1] == (name,)])
    return [x.alias(n) for n, x in found.items()]
