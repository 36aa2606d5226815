"""Values of documents: kinds, equality, order.

A value is None, bool, int, float, str, bytes, DocId, datetime (aware, UTC), date, time, list or
dict.  Kinds never compare with one another, but int and float do, exactly.
"""

from __future__ import annotations

import math
import os
import time as clock
import uuid
from datetime import date, datetime, time, timezone
from typing import Any

KINDS = ("bool", "int", "float", "number", "string", "binary", "array", "object", "id", "datetime", "date", "time")
INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
#: Place of a kind in sorting; kinds that aren't here have no order and come last either way.
RANK = {"null": 0, "bool": 1, "number": 2, "string": 3, "id": 4, "datetime": 5, "binary": 6, "date": 7, "time": 8}
UNORDERED = 9


class DocId(uuid.UUID):
    """A document's id: 16 bytes that order by the time they were made (version 7)."""

    @classmethod
    def new(cls) -> DocId:
        ms = clock.time_ns() // 1_000_000
        rest = int.from_bytes(os.urandom(10), "big")
        return cls(int=ms << 80 | 7 << 76 | (rest >> 68) << 64 | 2 << 62 | rest & (1 << 62) - 1)


def kind(value: Any) -> str:
    if value is None:
        return "null"
    for types, name in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string"), ((bytes, bytearray), "binary"), (uuid.UUID, "id"), (datetime, "datetime"), (date, "date"), (time, "time"), ((list, tuple), "array"), (dict, "object")):
        if isinstance(value, types):
            return name
    raise TypeError(f"not a value of a document: {value!r}")


def group(name: str) -> str:
    """The kinds that compare with one another: int and float are numbers."""
    return "number" if name in ("int", "float") else name


def checked(value: Any, depth: int = 0) -> Any:
    """The value in its normal form; an error for what no document can hold."""
    if depth > 64:
        raise ValueError("a document nests at most 64 levels")
    name = kind(value)
    if name == "int" and not INT_MIN <= value <= INT_MAX:
        raise ValueError(f"{value} does not fit 64 bits")
    if name == "datetime":
        if value.tzinfo is None:
            raise ValueError("a datetime needs a time zone")
        return value.astimezone(timezone.utc)
    if name == "array":
        return [checked(x, depth + 1) for x in value]
    if name == "object":
        if not all(isinstance(k, str) for k in value):
            raise ValueError("names in a document are strings")
        return {k: checked(x, depth + 1) for k, x in value.items()}
    if name == "id" and not isinstance(value, DocId):
        return DocId(int=value.int)
    return value


def fold(text: str) -> str:
    """The form in which ``contains`` compares."""
    return text.lower().replace("ß", "ss")


def equal(a: Any, b: Any) -> bool:
    ka, kb = kind(a), kind(b)
    if group(ka) != group(kb):
        return False
    if ka == "array":
        return len(a) == len(b) and all(map(equal, a, b))
    if ka == "object":
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    return bool(a == b)


def compare(a: Any, b: Any) -> int | None:
    """-1, 0 or 1; None for values without an order between them."""
    ka = group(kind(a))
    if ka != group(kind(b)) or ka in ("null", "array", "object"):
        return None
    if isinstance(a, float) and math.isnan(a) or isinstance(b, float) and math.isnan(b):
        return None
    if ka == "string":
        a, b = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
    return (a > b) - (a < b)


def rank(value: Any) -> int:
    if isinstance(value, float) and math.isnan(value):
        return UNORDERED
    return RANK.get(group(kind(value)), UNORDERED)


def order(a: Any, b: Any, descending: bool = False) -> int:
    """Order in sorting, over all kinds; unordered values are equal and last in both directions."""
    ra, rb = rank(a), rank(b)
    if UNORDERED in (ra, rb):
        return (ra > rb) - (ra < rb)
    out = (ra > rb) - (ra < rb) or (compare(a, b) or 0 if ra else 0)
    return -out if descending else out


def canonical(value: Any) -> Any:
    """A hashable form, the same for equal values: 1 as 1.0, objects without their order."""
    name = kind(value)
    if name in ("int", "float"):
        if isinstance(value, float):
            if math.isnan(value):
                return ("number", "nan")
            if value.is_integer():
                value = int(value)
        return ("number", value)
    if name == "array":
        return ("array", tuple(map(canonical, value)))
    if name == "object":
        return ("object", tuple(sorted((k, canonical(v)) for k, v in value.items())))
    return (name, bytes(value) if name == "binary" else value)
