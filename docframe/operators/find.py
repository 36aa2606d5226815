"""Find and count."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ClosureError, QueryError
from ..functions.names import fresh
from ..plans import ast as A
from ..plans import compile as C
from ..plans.documents import on_documents
from ..plans.parser import parse_aggregate, parse_filter


def as_filter(f: Any, params: dict[str, Any] | None = None, now: datetime | None = None, used: set[str] | None = None) -> A.Filter:
    """A filter from text, a condition or a filter, with its parameters bound and ``now`` fixed."""
    if f is None or isinstance(f, str):
        f = parse_filter(f or "")
    elif isinstance(f, A.Condition):
        f = A.Filter(where=f)
    f = A.bind(f, params, used)
    return A.resolve_now(f, now or datetime.now(timezone.utc)) if f.reads_now else f


def as_aggregate(a: Any, params: dict[str, Any] | None = None, used: set[str] | None = None, now: datetime | None = None) -> A.Aggregate:
    a = parse_aggregate(a) if isinstance(a, str) else a
    a = A.bind(a, params, used).check()
    return A.resolve_now(a, now or datetime.now(timezone.utc))


def bind_both(f: Any, a: Any, params: dict[str, Any] | None, now: datetime | None = None) -> tuple[A.Filter, A.Aggregate]:
    """A filter and an aggregate that share parameters and ``now``."""
    used: set[str] = set()
    now = now or datetime.now(timezone.utc)
    out = as_filter(f, params, now, used), as_aggregate(a, params, used, now)
    if unused := set(params or {}) - used:
        raise A.BindError(f"no text uses the parameter :{sorted(unused)[0]}")
    return out


def match(df: DataFrame, f: A.Filter) -> DataFrame:
    """The rows that meet the filter's condition, unsorted."""
    condition = C.where(f.where, C.Scope.of(df))
    return df if condition is None else df.where(condition)


def _by_key(df: DataFrame, key: A.Key) -> tuple[DataFrame, list]:
    """``df`` with the function's number for each document, where it gives one, and the sort by it."""
    (name,) = fresh(df.columns, "sort_key")

    def score(doc: dict) -> float | None:
        try:
            out = key.function(doc)
        except Exception as e:
            raise ClosureError(f"a sort key's function raised {e!r}") from e
        return None if out is None else float(out)

    out = df.withColumn(name, on_documents(score, df.schema, "double"))
    out = out.where(F.col(name).isNotNull() & ~F.isnan(name))
    return out, [F.col(name).desc() if key.descending else F.col(name).asc()]


def arrange(df: DataFrame, f: A.Filter) -> DataFrame:
    """Sort, skip and limit; a sort with a limit is a top-k in Spark's plan."""
    columns, names = [], df.columns
    if f.order:
        rest = f.order
        if isinstance(f.order[0], A.Key):
            df, columns = _by_key(df, f.order[0])
            rest = f.order[1:]
        if any(isinstance(o, A.Key) for o in rest):
            raise QueryError("only the first sort key can be a function")
        df = df.orderBy(*columns, *C.sort_columns(rest, C.Scope.of(df)))
    # without a sort any rows will do
    if f.offset:
        df = df.offset(f.offset)
    if f.limit is not None:
        df = df.limit(f.limit)
    return df.select(*[F.col(f"`{c}`") for c in names])


def find(df: DataFrame, f: Any = None, params: dict[str, Any] | None = None, now: datetime | None = None) -> DataFrame:
    """The documents that the filter finds, in its order, as far as it selects them."""
    f = as_filter(f, params, now)
    out = arrange(match(df, f), f)
    if f.select is None and not f.without:
        return out
    return out.select(*C.project(f.select, f.without, C.Scope.of(out)))


def count(df: DataFrame, f: Any = None, params: dict[str, Any] | None = None, now: datetime | None = None) -> int:
    """How many documents ``find`` gives.  Sorting by fields changes nothing and is left out."""
    f = as_filter(f, params, now)
    f = replace(f, order=f.order[:1] if f.order and isinstance(f.order[0], A.Key) else ())
    found = match(df, f)
    if f.order:
        found = arrange(found, replace(f, limit=None, offset=0))
    n = max(0, found.count() - f.offset)
    return n if f.limit is None else min(n, f.limit)


def any_match(df: DataFrame, f: Any = None, params: dict[str, Any] | None = None) -> bool:
    return not match(df, as_filter(f, params)).limit(1).isEmpty()


