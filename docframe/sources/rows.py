"""Documents as typed rows, and back."""

from __future__ import annotations

from datetime import date, datetime, time, timezone
from typing import Any

from pyspark.sql import Row
from pyspark.sql import types as T

from ..errors import UpdateError
from ..functions import values as V
from ..plans.compile import tag_of, time_ns

_SIMPLE = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "id": T.StringType(), "datetime": T.TimestampType(), "date": T.DateType(), "time": T.LongType()}


def field_of(name: str, value: Any) -> T.StructField:
    kind = V.kind(value)
    if kind == "null":
        return T.StructField(name, T.NullType())
    if kind == "array":
        inner: T.DataType = T.NullType()
        for x in value:
            inner = merge(T.StructField("x", inner), field_of("x", x)).dataType
        return T.StructField(name, T.ArrayType(inner))
    if kind == "object":
        return T.StructField(name, T.StructType([field_of(k, x) for k, x in value.items()]))
    return T.StructField(name, _SIMPLE[kind], metadata={"kind": kind} if kind in ("id", "time") else None)


def merge(a: T.StructField, b: T.StructField) -> T.StructField:
    """One field for both; whole numbers widen to floats, objects have the fields of either."""
    x, y = a.dataType, b.dataType
    if isinstance(y, T.NullType) or x == y and tag_of(a) == tag_of(b):
        return a
    if isinstance(x, T.NullType):
        return b
    if isinstance(x, T.ArrayType) and isinstance(y, T.ArrayType):
        return T.StructField(a.name, T.ArrayType(merge(T.StructField("x", x.elementType), T.StructField("x", y.elementType)).dataType))
    if isinstance(x, T.StructType) and isinstance(y, T.StructType):
        return T.StructField(a.name, merge_schemas(x, y))
    numbers = (T.LongType, T.DoubleType, T.IntegerType, T.FloatType)
    if isinstance(x, numbers) and isinstance(y, numbers) and not (tag_of(a) or tag_of(b)):
        both = {type(x), type(y)}
        return T.StructField(a.name, T.DoubleType() if both & {T.DoubleType, T.FloatType} else T.LongType())
    times = (T.TimestampType, T.TimestampNTZType)
    if isinstance(x, times) and isinstance(y, times):
        return a
    raise UpdateError(f"field {a.name!r} cannot hold both {x.simpleString()} and {y.simpleString()}")


def merge_schemas(a: T.StructType, b: T.StructType) -> T.StructType:
    found = {f.name: f for f in a.fields}
    for f in b.fields:
        found[f.name] = merge(found[f.name], f) if f.name in found else f
    return T.StructType(list(found.values()))


def settled(t: T.DataType) -> T.DataType:
    """The type with strings where only nulls were seen: Parquet has no column of nulls."""
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(settled(t.elementType))
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, settled(f.dataType), True, f.metadata) for f in t.fields])
    return t


def schema_of(docs: list[dict], whole: bool = True) -> T.StructType:
    """The fields of the documents; if they are not the ``whole`` of them, fields of nulls stay open."""
    out = T.StructType([])
    for d in docs:
        out = merge_schemas(out, T.StructType([field_of(k, v) for k, v in d.items()]))
    return settled(out) if whole else out


def to_arrow_value(value: Any, t: T.DataType) -> Any:
    """A value as Arrow takes it for that type."""
    if isinstance(t, T.StructType):
        return None if value is None else {f.name: to_arrow_value(value.get(f.name), f.dataType) for f in t.fields}
    if isinstance(t, T.ArrayType):
        return None if value is None else [to_arrow_value(x, t.elementType) for x in value]
    out = to_spark(value, t)
    return bytes(out) if isinstance(out, bytearray) else out


def to_spark(value: Any, t: T.DataType) -> Any:
    kind = V.kind(value)
    if kind == "null":
        return None
    if kind == "id":
        return str(value)
    if kind == "time":
        return time_ns(value)
    if kind == "binary":
        return bytearray(value)
    if kind == "array":
        return [to_spark(x, t.elementType) for x in value]
    if kind == "object":
        return tuple(to_spark(value.get(f.name), f.dataType) for f in t.fields)
    if kind == "int" and isinstance(t, (T.DoubleType, T.FloatType)):
        return float(value)
    if kind == "datetime" and isinstance(t, T.TimestampNTZType):
        return value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def from_spark(value: Any, t: T.DataType, tag: str | None = None) -> Any:
    """A value of a document from one of a row; nulls inside objects are left out."""
    if value is None:
        return None
    if isinstance(value, Row) or isinstance(t, T.StructType):
        return {f.name: from_spark(value[f.name], f.dataType, tag_of(f)) for f in t.fields if value[f.name] is not None}
    if isinstance(t, T.ArrayType):
        return [from_spark(x, t.elementType) for x in value]
    if isinstance(t, T.MapType):
        return {k: from_spark(x, t.valueType) for k, x in value.items()}
    if tag == "id":
        return V.DocId(value)
    if tag == "time":
        us = value // 1000
        return time(us // 3_600_000_000, us // 60_000_000 % 60, us // 1_000_000 % 60, us % 1_000_000)
    if isinstance(value, datetime):
        return value.replace(tzinfo=timezone.utc) if isinstance(t, T.TimestampNTZType) else value.astimezone(timezone.utc)
    if isinstance(value, bytearray):
        return bytes(value)
    return value if not hasattr(value, "as_tuple") else float(value) if not isinstance(value, date) else value


def document(row: Row, schema: T.StructType) -> dict:
    return from_spark(row, schema)
