"""Windows, unwinding, groups, columns, having, and the rows' order."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.names import fresh
from ..plans import ast as A
from ..plans import compile as C
from .find import arrange, as_aggregate, bind_both, match


def _interval(d: timedelta) -> Column:
    us = d // timedelta(microseconds=1)
    return F.make_dt_interval(F.lit(us // 86_400_000_000), F.lit(0), F.lit(0), F.lit(us % 86_400_000_000 / 1e6).cast("decimal(18,6)"))


def _moments(df: DataFrame, path: A.Path) -> Column | None:
    node = C.Scope.of(df).walk(path)
    return None if node is None or node.kind != "datetime" else node.column


def _recent(df: DataFrame, w: A.Window) -> DataFrame:
    """Documents no older than the newest less the duration.

    The newest is looked up first: as a plain number the bound reaches the scan, which passes over
    the files and row groups that are older.
    """
    at = _moments(df, w.path)
    if at is None:
        return df.where(F.lit(False))
    zoned = not isinstance(C.Scope.of(df).walk(w.path).type, T.TimestampNTZType)
    newest = df.agg(F.unix_micros(F.max(at)) if zoned else F.max(at)).first()[0]
    if newest is None:
        return df.where(F.lit(False))
    if zoned:
        return df.where(at >= F.timestamp_micros(F.lit(newest - w.size // timedelta(microseconds=1))))
    return df.where(at >= C.moment((newest - w.size).replace(tzinfo=timezone.utc), T.TimestampNTZType()))


def _recent_per_group(df: DataFrame, w: A.Window, group: tuple[A.Path, ...]) -> DataFrame:
    scope = C.Scope.of(df)
    keys = [n.column for g in group if (n := scope.walk(g)) is not None] or [F.lit(1)]
    node = scope.walk(w.path)
    if node is None or isinstance(w.size, timedelta) and node.kind != "datetime":
        return df.where(F.lit(False))
    nth, newest, *names = fresh(df.columns, "nth", "newest", *(f"{x}{i}" for x in "gk" for i in range(len(keys))))
    if isinstance(w.size, timedelta):
        # partial maxima first, so a hot group is summed before it is dealt
        there, here = names[: len(keys)], names[len(keys) :]
        latest = df.groupBy(*[k.alias(n) for k, n in zip(keys, there)]).agg(F.max(node.column).alias(newest))
        marked = df.withColumns(dict(zip(here, keys)))
        on = [F.col(h).eqNullSafe(F.col(t)) for h, t in zip(here, there)]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        joined = marked.join(latest, condition).where(node.column >= F.col(newest) - _interval(w.size))
        return joined.select(*[F.col(f"`{c}`") for c in df.columns])
    ordered = Window.partitionBy(*keys).orderBy(*_newest_first(node), F.col("_id").desc())
    numbered = df.where(node.column.isNotNull()).withColumn(nth, F.row_number().over(ordered))
    return numbered.where(F.col(nth) <= w.size).drop(nth)


def _newest_first(node: C.Node) -> list[Column]:
    if node.kind in ("array", "object"):
        return [F.lit(1)]
    nan = [F.isnan(node.column).asc()] if isinstance(node.type, (T.FloatType, T.DoubleType)) else []
    return [*nan, node.column.desc()]


def unwind(df: DataFrame, path: A.Path, position: str | None = None) -> DataFrame:
    """A row per element of the array at the path, the element in its place.

    No rows for a missing, null or empty one; a null element stays; what isn't an array stays itself.
    """
    scope = C.Scope.of(df)
    node = scope.walk(path)
    if node is None:
        return df.where(F.lit(False))
    if not isinstance(node.type, T.ArrayType):
        out = df.where(node.column.isNotNull())
        return out if position is None else out.withColumn(position, F.lit(0))
    at, element = fresh([*df.columns, position or ""], "pos", "element")
    out = df.select("*", F.posexplode(node.column).alias(position or at, element))
    head = path.names[0]
    if len(path.names) == 1:
        value = F.col(element)
    else:
        value = F.col(f"`{head}`").withField(".".join(f"`{n}`" for n in path.names[1:]), F.col(element))
    out = out.withColumn(head, value).drop(element)
    return out if position else out.drop(at)


#: A power of two: numbers divided by it lose nothing (but the tiniest), and sums of 2**64 of them stay finite.
_SCALE = 2.0**64


def _finite(total: Any, value: Column) -> Column:
    """``total`` (a sum or mean) of doubles; where numbers on the way to it are too large, it is made of scaled ones."""
    plain, scaled = total(value), total(value / F.lit(_SCALE)) * F.lit(_SCALE)
    return F.when(F.isnan(plain) | (F.abs(plain) == F.lit(float("inf"))), scaled).otherwise(plain)


def _sum(x: C.Node, value: Column) -> Column:
    if isinstance(x.type, (T.FloatType, T.DoubleType)):
        return F.coalesce(_finite(F.sum, value.cast("double")), F.lit(0.0)) + F.lit(0.0)
    if isinstance(x.type, T.DecimalType):
        return F.coalesce(F.sum(value), F.lit(0))
    # exact over any number of rows; a total that doesn't fit 64 bits is an error
    return F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("long")


def column(c: A.Column, scope: C.Scope, ids: list[Column]) -> Column:
    """One column of the aggregate.  ``ids`` order documents and elements for first and last."""
    test = None if c.where is None else C.compile_condition(c.where, scope)
    test = None if test is None or test is True else C.col(test)
    only = lambda x: x if test is None else F.when(test, x)
    if c.kind == "count":
        return F.count(only(F.lit(1)))
    node = scope.walk(c.path)
    number = node is not None and node.kind in ("int", "float")
    if c.kind == "count_distinct":
        return F.count(F.lit(None)) if node is None else F.count_distinct(only(node.column))
    if c.kind == "sum":
        return _sum(node, only(node.column)) if number else F.coalesce(F.sum(F.lit(0)), F.lit(0)).cast("long")
    if c.kind == "avg":
        if number and isinstance(node.type, (T.FloatType, T.DoubleType)):
            return _finite(F.avg, only(node.column).cast("double"))
        return F.avg(only(node.column)) if number else F.max(F.lit(None).cast("double"))
    if node is None:
        return F.max(F.lit(None).cast("string"))
    x = node.column
    if c.kind in ("min", "max"):
        best = F.min if c.kind == "min" else F.max
        if node.kind in ("array", "object"):
            # no order among them: the earliest
            return F.min_by(x, F.when((test if test is not None else F.lit(True)) & x.isNotNull(), F.struct(*ids)))
        if isinstance(node.type, (T.FloatType, T.DoubleType)):
            return F.coalesce(best(only(F.when(~F.isnan(x), x))), best(only(x)))
        return best(only(x))
    by = [] if c.by is None else [_orderable(scope.walk(c.by))]
    pick = F.min_by if c.kind == "first" else F.max_by
    # a struct is never null, so a null value or a null `by` counts like any other
    return pick(x, only(F.struct(*[k.alias(f"k{i}") for i, k in enumerate([*by, *ids])])))


def _orderable(node: C.Node | None) -> Column:
    if node is None:
        return F.lit(0)
    if node.kind in ("array", "object"):
        return node.column.isNotNull()
    return node.column


def run(df: DataFrame, a: A.Aggregate, ordered: bool = True) -> DataFrame:
    """The rows of the aggregate over all rows of ``df``; in any order if not ``ordered`` and none is cut off.

    Columns are summed in one aggregation with partial sums; group values are shown at their paths.
    """
    if a.window is not None:
        df = _recent(df, a.window)
    if a.group_window is not None:
        df = _recent_per_group(df, a.group_window, a.group)
    names = fresh(df.columns, *(f"pos{i}" for i in range(len(a.unwind))))
    for name, path in zip(names, a.unwind):
        df = unwind(df, path, name)
    positions = [F.col(n) for n in names]
    scope = C.Scope.of(df)
    ids = [*([F.col("_id")] if "_id" in df.columns else []), *positions] or [F.lit(0)]
    *groups, rows_name = fresh([c.name for c in a.columns], *(f"group{i}" for i in range(len(a.group))), "rows")
    keys = [(k, g, scope.walk(g)) for k, g in zip(groups, a.group)]
    columns = [column(c, scope, ids).alias(c.name) for c in a.columns]
    grouped = df.groupBy(*[(F.lit(None).cast("string") if n is None else n.column).alias(k) for k, _, n in keys])
    rows = grouped.agg(*columns, F.count(F.lit(1)).alias(rows_name)).drop(rows_name)
    rows = rows.select(*_nested(keys), *[F.col(f"`{c.name}`") for c in a.columns])
    scope = C.Scope.of(rows)
    having = C.where(a.having, scope)
    if having is not None:
        rows = rows.where(having)
    order = C.sort_columns((*a.order, *(A.Order(g) for g in a.group)), scope, last=())
    if order and a.group and (ordered or a.offset or a.limit is not None):
        rows = rows.orderBy(*order)
    if a.offset:
        rows = rows.offset(a.offset)
    return rows if a.limit is None else rows.limit(a.limit)


def _nested(keys: list[tuple]) -> list[Column]:
    """Group values at their paths: ``a.b`` is field b of struct a."""
    tree: dict = {}
    for k, g, _ in keys:
        at = tree
        for name in g.names[:-1]:
            at = at.setdefault(name, {})
        at[g.names[-1]] = k

    def build(t: Any) -> Column:
        return F.col(t) if isinstance(t, str) else F.struct(*[build(x).alias(n) for n, x in t.items()])

    return [build(t).alias(n) for n, t in tree.items()]


def aggregate(df: DataFrame, f: Any, a: Any, params: dict[str, Any] | None = None, now: datetime | None = None, ordered: bool = True) -> DataFrame:
    """The documents that the filter finds, summed up."""
    f, a = bind_both(f, a, params, now)
    if (a.window is not None or a.group_window is not None) and (f.order or f.offset or f.limit is not None):
        raise QueryError("a window does not go with a filter's sort, skip or limit")
    found = match(df, f)
    if f.offset or f.limit is not None:
        found = arrange(found, f)
    return run(found, a, ordered)


__all__ = ["aggregate", "as_aggregate", "run", "unwind"]
