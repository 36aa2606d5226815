"""Documents as JSON text, with tags for what JSON lacks."""

from __future__ import annotations

import base64
import json
import math
import re
from datetime import date, datetime, time, timezone
from typing import Any

from .values import INT_MAX, INT_MIN, DocId, kind

#: Fixed names of the format.
TAGS = ("$id", "$date", "$time", "$binary", "$float", "$object")
_MOMENT = re.compile(r"(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})")
_TIME = re.compile(r"(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?")


def _micros(fraction: str | None) -> int:
    digits = (fraction or "").ljust(9, "0")
    if digits[6:].strip("0"):
        raise ValueError("times finer than a microsecond are not supported")
    return int(digits[:6])


def parse_datetime(text: str) -> datetime:
    if not (m := _MOMENT.fullmatch(text)):
        raise ValueError(f"not a moment like 2026-05-01T12:00:00Z: {text!r}")
    day, hms, fraction, zone = m.groups()
    zone = "+00:00" if zone in "Zz" else zone
    return datetime.fromisoformat(f"{day}T{hms}{zone}").replace(microsecond=_micros(fraction)).astimezone(timezone.utc)


def parse_date(text: str) -> date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"not a day like 2026-05-01: {text!r}")
    return date.fromisoformat(text)


def parse_time(text: str) -> time:
    if not (m := _TIME.fullmatch(text)):
        raise ValueError(f"not a time like 14:05:30.5: {text!r}")
    h, mi, s, fraction = m.groups()
    return time(int(h), int(mi), int(s or 0), _micros(fraction))


def text_of(value: datetime | date | time) -> str:
    """RFC 3339, without a fraction that is zero."""
    if isinstance(value, datetime):
        value = value.astimezone(timezone.utc)
        return value.strftime("%Y-%m-%dT%H:%M:%S") + (f".{value.microsecond:06d}".rstrip("0") if value.microsecond else "") + "Z"
    if isinstance(value, time):
        return value.strftime("%H:%M:%S") + (f".{value.microsecond:06d}".rstrip("0") if value.microsecond else "")
    return value.isoformat()


def to_plain(value: Any) -> Any:
    """The value as what json.dumps takes."""
    name = kind(value)
    if name == "array":
        return [to_plain(x) for x in value]
    if name == "object":
        plain = {k: to_plain(x) for k, x in value.items()}
        return {"$object": plain} if len(plain) == 1 and next(iter(plain)) in TAGS else plain
    if name == "id":
        return {"$id": str(value)}
    if name in ("datetime", "date"):
        return {"$date": text_of(value)}
    if name == "time":
        return {"$time": text_of(value)}
    if name == "binary":
        return {"$binary": base64.b64encode(value).decode("ascii")}
    if name == "float" and not math.isfinite(value):
        return {"$float": "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"}
    return value


def from_plain(value: Any) -> Any:
    if isinstance(value, list):
        return [from_plain(x) for x in value]
    if isinstance(value, int) and not isinstance(value, bool) and not INT_MIN <= value <= INT_MAX:
        raise ValueError(f"{value} does not fit 64 bits")
    if not isinstance(value, dict):
        return value
    if len(value) == 1 and (tag := next(iter(value))) in TAGS:
        inner = value[tag]
        if tag == "$object":
            return {k: from_plain(x) for k, x in inner.items()}
        if not isinstance(inner, str):
            raise ValueError(f"{tag} takes a string")
        if tag == "$id":
            return DocId(inner)
        if tag == "$date":
            return parse_date(inner) if len(inner) == 10 else parse_datetime(inner)
        if tag == "$time":
            return parse_time(inner)
        if tag == "$binary":
            return base64.b64decode(inner, validate=True)
        return {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}[inner]
    return {k: from_plain(x) for k, x in value.items()}


def dumps(value: Any) -> str:
    return json.dumps(to_plain(value), ensure_ascii=False, separators=(",", ":"))


def loads(text: str) -> Any:
    def refuse(name: str) -> Any:
        raise ValueError(f"{name} is written as a tagged value")

    return from_plain(json.loads(text, parse_constant=refuse))
