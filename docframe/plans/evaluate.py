"""Filters and aggregates on documents in memory: for tests of single documents, for documents
without a schema, and as the model that the Spark translation is tested against."""

from __future__ import annotations

import copy
import functools
import math
from collections.abc import Iterator
from datetime import timedelta
from fractions import Fraction
from typing import Any

from ..errors import ClosureError, QueryError
from ..functions import values as V
from . import ast as A
from .patterns import found

_MISSING = object()


def reach(value: Any, steps: tuple[A.Step, ...]) -> Iterator[Any]:
    """The values at a path; _MISSING where a field is absent, nothing where [*] meets no array."""
    if not steps:
        yield value
        return
    step, rest = steps[0], steps[1:]
    level = [value.get(step.name, _MISSING) if isinstance(value, dict) else _MISSING]
    for _ in range(step.each):
        level = [x for items in level if isinstance(items, list) for x in items]
    for x in level:
        yield from reach(x, rest)


def one(value: Any, path: A.Path) -> Any:
    """The value at a path without [*]; None if missing."""
    out = next(reach(value, path.steps), None)
    return None if out is _MISSING else out


def _meets(found: Any, op: str, v: Any) -> bool:
    x = None if found is _MISSING else found
    if op == "eq":
        return V.equal(x, v)
    if op == "ne":
        return not V.equal(x, v)
    if op == "contains":
        return isinstance(x, str) and isinstance(v, str) and V.fold(v) in V.fold(x)
    if op == "starts":
        return isinstance(x, str) and isinstance(v, str) and x.startswith(v) or isinstance(x, bytes) and isinstance(v, bytes) and x.startswith(v)
    if v is None:
        return x is None and op in ("lte", "gte")
    c = V.compare(x, v)
    return c is not None and {"lt": c < 0, "lte": c <= 0, "gt": c > 0, "gte": c >= 0}[op]


def _count_meets(n: int, op: str, m: int) -> bool:
    return {"eq": n == m, "ne": n != m, "lt": n < m, "lte": n <= m, "gt": n > m, "gte": n >= m}[op]


def matches(c: A.Condition, doc: Any) -> bool:
    """Does the document (or element) meet the condition?  ``now`` and parameters must be resolved."""
    if isinstance(c, A.And):
        return all(matches(x, doc) for x in c.items)
    if isinstance(c, A.Or):
        return any(matches(x, doc) for x in c.items)
    if isinstance(c, A.Not):
        return not matches(c.item, doc)
    if isinstance(c, A.Compare):
        if c.op == "ne":
            return not any(_meets(x, "eq", c.value) for x in reach(doc, c.path.steps))
        return any(_meets(x, c.op, c.value) for x in reach(doc, c.path.steps))
    if isinstance(c, A.InList):
        return c.negated != any(_meets(x, "eq", v) for v in c.values for x in reach(doc, c.path.steps))
    if isinstance(c, A.Matches):
        test = found(c.pattern)
        return any(isinstance(x, str) and test(x) for x in reach(doc, c.path.steps))
    if isinstance(c, A.Exists):
        return any(x is not _MISSING for x in reach(doc, c.path.steps))
    if isinstance(c, A.IsKind):
        return any(x is not _MISSING and x is not None and c.kind in (V.kind(x), V.group(V.kind(x))) for x in reach(doc, c.path.steps))
    if isinstance(c, A.Size):
        hit = any(isinstance(x, list) and _count_meets(len(x), "eq" if c.op == "ne" else c.op, c.n) for x in reach(doc, c.path.steps))
        return hit != (c.op == "ne")
    if isinstance(c, A.Has):
        return any(isinstance(x, list) and any(matches(c.condition, e) for e in x) for x in reach(doc, c.path.steps))
    if isinstance(c, A.Custom):
        try:
            return bool(c.function({k: doc[k] for k in c.fields if k in doc}))
        except Exception as e:
            raise ClosureError(f"a condition's function raised {e!r}") from e
    raise QueryError(f"cannot be evaluated unresolved: {type(c).__name__}")


def _less(a: dict, b: dict, orders: tuple[A.Order, ...]) -> int:
    for o in orders:
        if c := V.order(one(a, o.path), one(b, o.path), o.descending):
            return c
    return V.order(a.get("_id"), b.get("_id"))


def project(doc: dict, select: tuple[A.Path, ...] | None, without: tuple[A.Path, ...]) -> dict:
    def cut(names: tuple[str, ...], value: Any, out: Any) -> Any:
        if not names:
            return value
        if not isinstance(value, dict) or names[0] not in value:
            return out if isinstance(out, dict) else _MISSING
        have = out if isinstance(out, dict) else {}
        inner = cut(names[1:], value[names[0]], have.get(names[0], _MISSING))
        if inner is not _MISSING:
            have = {**have, names[0]: inner}
        return have

    if select is not None and not any(not p.steps for p in select):
        out: dict = {"_id": doc["_id"]} if "_id" in doc else {}
        for p in select:
            out = cut(_plain(p), doc, out)
    else:
        out = doc
    for p in without:
        if not p.steps:
            out = {k: v for k, v in out.items() if k == "_id"}
        elif p.names[0] != "_id":
            out = _drop(out, _plain(p))
    return out


def _plain(p: A.Path) -> tuple[str, ...]:
    """The names up to the first [*]: projections do not walk into arrays."""
    out = []
    for s in p.steps:
        out.append(s.name)
        if s.each:
            break
    return tuple(out)


def _drop(value: Any, names: tuple[str, ...]) -> Any:
    if not isinstance(value, dict) or names[0] not in value:
        return value
    if len(names) == 1:
        return {k: v for k, v in value.items() if k != names[0]}
    return {**value, names[0]: _drop(value[names[0]], names[1:])}


def apply(f: A.Filter, docs: list[dict]) -> list[dict]:
    """What the filter finds among the documents."""
    found = [d for d in docs if matches(f.where, d)]
    if f.order and isinstance(f.order[0], A.Key):
        key = f.order[0]
        scored = [(key.function(d), d) for d in found]
        scored = [(s, d) for s, d in scored if s is not None and not math.isnan(s)]
        scored.sort(key=functools.cmp_to_key(lambda a, b: ((a[0] > b[0]) - (a[0] < b[0])) * (-1 if key.descending else 1) or _less(a[1], b[1], f.order[1:])))
        found = [d for _, d in scored]
    elif f.order:
        found.sort(key=functools.cmp_to_key(lambda a, b: _less(a, b, f.order)))
    found = found[f.offset :]
    if f.limit is not None:
        found = found[: f.limit]
    return [project(d, f.select, f.without) for d in found]


def put(doc: dict, names: tuple[str, ...], value: Any) -> dict:
    if len(names) == 1:
        return {**doc, names[0]: value}
    return {**doc, names[0]: put(doc[names[0]], names[1:], value)}


def _unwind(docs: list[tuple], paths: tuple[A.Path, ...]) -> list[tuple]:
    for p in paths:
        out = []
        for where, doc in docs:
            v = one(doc, p)
            if isinstance(v, list):
                out += [((*where, i), put(doc, p.names, x)) for i, x in enumerate(v)]
            elif v is not None:
                out.append((where, doc))
        docs = out
    return docs


def _column(c: A.Column, rows: list[tuple]) -> Any:
    rows = [r for r in rows if c.where is None or matches(c.where, r[1])]
    if c.kind == "count":
        return len(rows)
    if c.kind in ("first", "last"):
        best = None
        for where, doc in rows:
            key = one(doc, c.by) if c.by is not None else None
            at = (key, where)
            if best is None:
                best = (at, doc)
                continue
            less = V.order(key, best[0][0]) or ((where > best[0][1]) - (where < best[0][1]))
            if less < 0 if c.kind == "first" else less > 0:
                best = (at, doc)
        return None if best is None else one(best[1], c.path)
    found = [one(d, c.path) for _, d in rows]
    if c.kind == "count_distinct":
        return len({V.canonical(x) for x in found if x is not None})
    if c.kind in ("min", "max"):
        best = None
        for x in found:
            if x is None:
                continue
            if best is None or V.rank(x) != V.UNORDERED and (V.rank(best) == V.UNORDERED or (V.order(x, best) < 0 if c.kind == "min" else V.order(x, best) > 0)):
                best = x
        return best
    numbers = [x for x in found if V.kind(x) in ("int", "float")]
    if c.kind == "avg" and not numbers:
        return None
    if all(isinstance(x, int) for x in numbers):
        total: Any = sum(numbers)
        if c.kind == "avg":
            return float(Fraction(total, len(numbers)))
        return total if V.INT_MIN <= total <= V.INT_MAX else float(total)
    if all(math.isfinite(x) for x in numbers):
        exact = sum(map(Fraction, numbers), Fraction())
        return float(exact / len(numbers)) if c.kind == "avg" else _to_float(exact)
    total = sum(float(x) for x in numbers)
    return total / len(numbers) if c.kind == "avg" else total


def _to_float(x: Fraction) -> float:
    try:
        return float(x) + 0.0
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def aggregate(a: A.Aggregate, docs: list[dict]) -> list[dict]:
    """The rows of the aggregate over these documents."""
    a.check()
    if a.window is not None:
        docs = _recent(docs, a.window)
    group_of = lambda d: tuple(V.canonical(one(d, g)) for g in a.group)
    if a.group_window is not None:
        parts: dict = {}
        for d in docs:
            parts.setdefault(group_of(d), []).append(d)
        docs = [d for part in parts.values() for d in (_recent(part, a.group_window) if isinstance(a.group_window.size, timedelta) else _newest(part, a.group_window))]
    docs = sorted(docs, key=functools.cmp_to_key(lambda x, y: V.order(x.get("_id"), y.get("_id"))))
    rows = _unwind([((i,), d) for i, d in enumerate(docs)], a.unwind)
    groups: dict = {} if a.group else {(): []}
    for r in rows:
        groups.setdefault(group_of(r[1]), []).append(r)
    out = []
    for members in groups.values():
        row: dict = {}
        for g in a.group:
            at = row
            for name in g.names[:-1]:
                at = at.setdefault(name, {})
            at[g.names[-1]] = copy.deepcopy(one(members[0][1], g))
        for c in a.columns:
            row[c.name] = _column(c, members)
        out.append(row)
    orders = (*a.order, *(A.Order(g) for g in a.group))
    out = [r for r in out if matches(a.having, r)]
    out.sort(key=functools.cmp_to_key(lambda x, y: _less(x, y, orders)))
    out = out[a.offset :]
    return out if a.limit is None else out[: a.limit]


def _recent(docs: list[dict], w: A.Window) -> list[dict]:
    at = [(one(d, w.path), d) for d in docs]
    at = [(t, d) for t, d in at if V.kind(t) == "datetime"]
    newest = max((t for t, _ in at), default=None)
    return [d for t, d in at if t >= newest - w.size]


def _newest(docs: list[dict], w: A.Window) -> list[dict]:
    found = [d for d in docs if one(d, w.path) is not None]
    found.sort(key=functools.cmp_to_key(lambda x, y: V.order(one(x, w.path), one(y, w.path), True) or -V.order(x.get("_id"), y.get("_id"))))
    return found[: w.size]
