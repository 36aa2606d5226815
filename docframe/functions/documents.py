"""Reading single documents: a value by its path, and as a kind or not at all."""

from __future__ import annotations

from datetime import date, datetime, time
from typing import Any

from .values import DocId, kind


def get(doc: Any, path: str) -> Any:
    """The value at a path like ``a.b.0.c``: names of fields and places in arrays; None if there is none."""
    for step in path.split(".") if path else ():
        if isinstance(doc, dict):
            doc = doc.get(step)
        elif isinstance(doc, list) and step.isdecimal() and int(step) < len(doc):
            doc = doc[int(step)]
        else:
            return None
    return doc


def _as(value: Any, *names: str) -> Any:
    return value if value is not None and kind(value) in names else None


def as_bool(value: Any) -> bool | None:
    return _as(value, "bool")


def as_int(value: Any) -> int | None:
    return _as(value, "int")


def as_float(value: Any) -> float | None:
    """Integers too."""
    found = _as(value, "int", "float")
    return None if found is None else float(found)


def as_str(value: Any) -> str | None:
    return _as(value, "string")


def as_bytes(value: Any) -> bytes | None:
    return _as(value, "binary")


def as_datetime(value: Any) -> datetime | None:
    return _as(value, "datetime")


def as_date(value: Any) -> date | None:
    return _as(value, "date")


def as_time(value: Any) -> time | None:
    return _as(value, "time")


def as_id(value: Any) -> DocId | None:
    return _as(value, "id")


def as_list(value: Any) -> list | None:
    return _as(value, "array")


def as_dict(value: Any) -> dict | None:
    return _as(value, "object")
