"""Trees of filters and aggregates, and builders for them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, is_dataclass, replace
from datetime import datetime, timedelta, timezone
from typing import Any

from ..errors import BindError, QueryError
from ..functions.values import KINDS, kind

#: Words that need backticks as names.
RESERVED = ("and", "or", "not", "true", "false", "null", "select", "where", "order", "limit", "offset")
_BARE = re.compile(r"[^\W\d]\w*")


@dataclass(frozen=True)
class Step:
    """A name, then so many ``[*]``."""

    name: str
    each: int = 0


@dataclass(frozen=True)
class Path:
    """Steps from the document; none of them is the document, or the element inside ``has``."""

    steps: tuple[Step, ...] = ()

    @classmethod
    def of(cls, text: str | Path) -> Path:
        """From ``a.b[*].c``; "" and "@" are the value itself.  A dot always separates."""
        if isinstance(text, Path):
            return text
        if text in ("", "@"):
            return cls()
        out = []
        for part in text.split("."):
            name, each = part, 0
            while name.endswith("[*]"):
                name, each = name[:-3], each + 1
            if not name or "[" in name or "]" in name:
                raise QueryError(f"not a path: {text!r}")
            out.append(Step(name, each))
        return cls(tuple(out))

    @property
    def each(self) -> bool:
        return any(s.each for s in self.steps)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(s.name for s in self.steps)

    @property
    def dotted(self) -> str:
        return ".".join(s.name + "[*]" * s.each for s in self.steps)

    def __str__(self) -> str:
        if not self.steps:
            return "@"
        quote = lambda n: n if _BARE.fullmatch(n) and n.lower() not in RESERVED else "`" + n.replace("`", "``") + "`"
        return ".".join(quote(s.name) + "[*]" * s.each for s in self.steps)


@dataclass(frozen=True)
class Param:
    """A place for a value, named."""

    name: str


class Condition:
    """A test of a document; ``&``, ``|`` and ``~`` combine."""

    def __and__(self, other: Condition) -> Condition:
        return And((*(self.items if isinstance(self, And) else (self,)), *(other.items if isinstance(other, And) else (other,))))

    def __or__(self, other: Condition) -> Condition:
        return Or((*(self.items if isinstance(self, Or) else (self,)), *(other.items if isinstance(other, Or) else (other,))))

    def __invert__(self) -> Condition:
        return Not(self)


@dataclass(frozen=True)
class Compare(Condition):
    """``op``: eq ne lt lte gt gte contains starts."""

    path: Path
    op: str
    value: Any


@dataclass(frozen=True)
class InList(Condition):
    path: Path
    values: Any  # tuple or Param
    negated: bool = False


@dataclass(frozen=True)
class Matches(Condition):
    path: Path
    pattern: Any


@dataclass(frozen=True)
class Exists(Condition):
    path: Path


@dataclass(frozen=True)
class IsKind(Condition):
    path: Path
    kind: str

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise QueryError(f"no kind of value: {self.kind!r}")


@dataclass(frozen=True)
class Size(Condition):
    path: Path
    op: str
    n: Any


@dataclass(frozen=True)
class Has(Condition):
    """One element of the array meets the whole condition."""

    path: Path
    condition: Condition


@dataclass(frozen=True)
class AgainstNow(Condition):
    path: Path
    op: str
    offset: timedelta = timedelta()

    def __post_init__(self) -> None:
        if self.op not in ("lt", "lte", "gt", "gte"):
            raise QueryError("`now` goes with <, <=, > and >= only")


@dataclass(frozen=True)
class And(Condition):
    items: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Or(Condition):
    items: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Not(Condition):
    item: Condition


@dataclass(frozen=True)
class Custom(Condition):
    """A Python function of the named top-level fields, given as a dict; it has no text form."""

    fields: tuple[str, ...]
    function: Callable[[dict], bool] = field(compare=False)


TRUE, FALSE = And(), Or()


def rebuild(node: Any, change: Callable[[Any], Any]) -> Any:
    """The tree with ``change`` applied to every dataclass node, leaves first."""
    if isinstance(node, tuple):
        return tuple(rebuild(x, change) for x in node)
    if is_dataclass(node) and not isinstance(node, type):
        new = {f.name: rebuild(getattr(node, f.name), change) for f in fields(node) if isinstance(getattr(node, f.name), tuple) or is_dataclass(getattr(node, f.name))}
        return change(replace(node, **new) if new else node)
    return node


def walk(node: Any) -> Iterable[Any]:
    if isinstance(node, tuple):
        for x in node:
            yield from walk(x)
    elif is_dataclass(node) and not isinstance(node, type):
        yield node
        for f in fields(node):
            yield from walk(getattr(node, f.name))


@dataclass(frozen=True)
class Order:
    path: Path
    descending: bool = False


@dataclass(frozen=True)
class Key:
    """A sort by a function of the document that gives a float; None and NaN drop the document."""

    function: Callable[[dict], float | None] = field(compare=False)
    descending: bool = False


@dataclass(frozen=True)
class Filter:
    """Which documents, in what order, how many, and what of them.

    ``select`` None is everything; () is the ids alone.
    """

    where: Condition = TRUE
    order: tuple[Order | Key, ...] = ()
    limit: Any = None
    offset: Any = 0
    select: tuple[Path, ...] | None = None
    without: tuple[Path, ...] = ()
    hint: tuple[str, ...] | None = None  # index fields; () is no index

    def _and(self, c: Condition) -> Filter:
        return replace(self, where=c if self.where == TRUE else self.where & c)

    def matching(self, c: Condition) -> Filter:
        return self._and(c)

    def eq(self, path: str, value: Any) -> Filter:
        return self._and(Compare(Path.of(path), "eq", value))

    def ne(self, path: str, value: Any) -> Filter:
        return self._and(Compare(Path.of(path), "ne", value))

    def lt(self, path: str, value: Any) -> Filter:
        return self._and(Compare(Path.of(path), "lt", value))

    def lte(self, path: str, value: Any) -> Filter:
        return self._and(Compare(Path.of(path), "lte", value))

    def gt(self, path: str, value: Any) -> Filter:
        return self._and(Compare(Path.of(path), "gt", value))

    def gte(self, path: str, value: Any) -> Filter:
        return self._and(Compare(Path.of(path), "gte", value))

    def contains(self, path: str, value: str) -> Filter:
        return self._and(Compare(Path.of(path), "contains", value))

    def starts_with(self, path: str, value: str | bytes) -> Filter:
        return self._and(Compare(Path.of(path), "starts", value))

    def matches(self, path: str, pattern: str) -> Filter:
        return self._and(Matches(Path.of(path), pattern))

    def is_in(self, path: str, values: Iterable) -> Filter:
        return self._and(InList(Path.of(path), tuple(values)))

    def not_in(self, path: str, values: Iterable) -> Filter:
        return self._and(InList(Path.of(path), tuple(values), True))

    def is_null(self, path: str) -> Filter:
        return self.eq(path, None)

    def not_null(self, path: str) -> Filter:
        return self.ne(path, None)

    def exists(self, path: str) -> Filter:
        return self._and(Exists(Path.of(path)))

    def missing(self, path: str) -> Filter:
        return self._and(Not(Exists(Path.of(path))))

    def is_kind(self, path: str, name: str) -> Filter:
        return self._and(IsKind(Path.of(path), name))

    def size(self, path: str, op: str, n: int) -> Filter:
        return self._and(Size(Path.of(path), op, n))

    def has(self, path: str, condition: Condition) -> Filter:
        return self._and(Has(Path.of(path), condition))

    def older_than(self, path: str, age: timedelta) -> Filter:
        return self._and(AgainstNow(Path.of(path), "lt", -age))

    def newer_than(self, path: str, age: timedelta) -> Filter:
        return self._and(AgainstNow(Path.of(path), "gte", -age))

    def custom(self, names: Iterable[str], function: Callable[[dict], bool]) -> Filter:
        return self._and(Custom(tuple(names), function))

    def sort_asc(self, path: str) -> Filter:
        return replace(self, order=(Order(Path.of(path)),))

    def sort_desc(self, path: str) -> Filter:
        return replace(self, order=(Order(Path.of(path), True),))

    def then_asc(self, path: str) -> Filter:
        return replace(self, order=(*self.order, Order(Path.of(path))))

    def then_desc(self, path: str) -> Filter:
        return replace(self, order=(*self.order, Order(Path.of(path), True)))

    def sort_by_key(self, function: Callable[[dict], float | None], descending: bool = False) -> Filter:
        return replace(self, order=(Key(function, descending),))

    def skip(self, n: int) -> Filter:
        return replace(self, offset=n)

    def first(self, n: int) -> Filter:
        return replace(self, limit=n)

    def selecting(self, *paths: str) -> Filter:
        return replace(self, select=(*(self.select or ()), *map(Path.of, paths)))

    def excepting(self, *paths: str) -> Filter:
        return replace(self, without=(*self.without, *map(Path.of, paths)))

    def use_index(self, *names: str) -> Filter:
        return replace(self, hint=names)

    def no_index(self) -> Filter:
        return replace(self, hint=())

    def now_is(self, now: datetime) -> Filter:
        return resolve_now(self, now)

    @property
    def reads_now(self) -> bool:
        return any(isinstance(x, AgainstNow) for x in walk(self.where))


@dataclass(frozen=True)
class Column:
    """``kind``: count count_distinct sum avg min max first last."""

    kind: str
    path: Path | None
    name: str
    by: Path | None = None
    where: Condition | None = None


@dataclass(frozen=True)
class Window:
    path: Path
    size: Any  # timedelta, or a number of documents
    per_group: bool = False


@dataclass(frozen=True)
class Aggregate:
    columns: tuple[Column, ...] = ()
    group: tuple[Path, ...] = ()
    window: Window | None = None
    group_window: Window | None = None
    unwind: tuple[Path, ...] = ()
    having: Condition = TRUE
    order: tuple[Order, ...] = ()
    limit: Any = None
    offset: Any = 0

    def _add(self, kind: str, path: str | None, name: str, **more: Any) -> Aggregate:
        return replace(self, columns=(*self.columns, Column(kind, None if path is None else Path.of(path), name, **more)))

    def count(self, name: str, where: Condition | None = None) -> Aggregate:
        return self._add("count", None, name, where=where)

    def count_distinct(self, path: str, name: str, where: Condition | None = None) -> Aggregate:
        return self._add("count_distinct", path, name, where=where)

    def sum(self, path: str, name: str, where: Condition | None = None) -> Aggregate:
        return self._add("sum", path, name, where=where)

    def avg(self, path: str, name: str, where: Condition | None = None) -> Aggregate:
        return self._add("avg", path, name, where=where)

    def min(self, path: str, name: str, where: Condition | None = None) -> Aggregate:
        return self._add("min", path, name, where=where)

    def max(self, path: str, name: str, where: Condition | None = None) -> Aggregate:
        return self._add("max", path, name, where=where)

    def first(self, path: str, name: str, by: str | None = None, where: Condition | None = None) -> Aggregate:
        return self._add("first", path, name, by=None if by is None else Path.of(by), where=where)

    def last(self, path: str, name: str, by: str | None = None, where: Condition | None = None) -> Aggregate:
        return self._add("last", path, name, by=None if by is None else Path.of(by), where=where)

    def group_by(self, *paths: str) -> Aggregate:
        return replace(self, group=(*self.group, *map(Path.of, paths)))

    def unwinding(self, *paths: str) -> Aggregate:
        return replace(self, unwind=(*self.unwind, *map(Path.of, paths)))

    def check(self) -> Aggregate:
        """The aggregate itself, or a QueryError for what it must not ask."""

        def plain(path: Path, what: str, no_id: bool = False) -> None:
            if not path.steps or path.each:
                raise QueryError(f"{what} needs a field, without [*]")
            if no_id and path.names[0] == "_id":
                raise QueryError(f"{what} does not go with _id")

        inside = lambda path, over: path.names[: len(over.names)] == over.names
        for w in (self.window, self.group_window):
            if w is not None:
                plain(w.path, "a window", True)
                if any(inside(w.path, u) for u in self.unwind):
                    raise QueryError("a window's field cannot be inside an unwound one")
        for u in self.unwind:
            plain(u, "unwind", True)
        for i, g in enumerate(self.group):
            plain(g, "group by")
            if self.group_window is not None and any(inside(g, u) for u in self.unwind):
                raise QueryError("with a window per group, no group field can be inside an unwound one")
            if any(inside(g, h) or inside(h, g) for h in self.group[:i]):
                raise QueryError("group fields cannot be equal or one inside another")
        heads = {g.names[0] for g in self.group}
        seen: set[str] = set()
        for c in self.columns:
            if c.path is not None:
                plain(c.path, f"column {c.name!r}")
            if c.by is not None:
                plain(c.by, f"column {c.name!r}")
                if c.kind not in ("first", "last"):
                    raise QueryError("only first and last go by another field")
            if not c.name or "." in c.name or "[" in c.name or "]" in c.name:
                raise QueryError(f"not a column's name: {c.name!r}")
            if c.name in seen or c.name in heads:
                raise QueryError(f"column {c.name!r} is named twice")
            seen.add(c.name)
        known = lambda path: path.names and (path.names[0] in seen or any(inside(path, g) or inside(g, path) for g in self.group))
        for o in self.order:
            if not known(o.path):
                raise QueryError(f"rows have no column {o.path.dotted!r} to sort by")
        for x in walk(self.having):
            if isinstance(x, (Compare, InList, Matches, Exists, IsKind, Size, Has, AgainstNow)) and x.path.steps and not known(x.path) and not _within_has(self.having, x):
                raise QueryError(f"rows have no column {x.path.dotted!r} for having")
        return self


def _within_has(tree: Condition, node: Any) -> bool:
    return any(isinstance(x, Has) and any(y is node for y in walk(x.condition)) for x in walk(tree))


def resolve_now(tree: Any, now: datetime) -> Any:
    """The tree with every comparison with ``now`` made one with a moment; it saturates at the years' ends."""
    low, high = datetime(1, 1, 1, tzinfo=timezone.utc), datetime(9999, 12, 31, 23, 59, 59, 999999, tzinfo=timezone.utc)

    def change(node: Any) -> Any:
        if not isinstance(node, AgainstNow):
            return node
        try:
            moment = now + node.offset
        except OverflowError:
            moment = high if node.offset > timedelta() else low
        return Compare(node.path, node.op, moment)

    return rebuild(tree, change)


def bind(tree: Any, params: dict[str, Any] | None = None, used: set[str] | None = None) -> Any:
    """The tree with its parameters' values in place.  ``used`` collects names instead of refusing unused ones."""
    params = params or {}
    seen: set[str] = set()

    def value(x: Any) -> Any:
        if not isinstance(x, Param):
            return x
        if x.name not in params:
            raise BindError(f"no value for the parameter :{x.name}")
        seen.add(x.name)
        return params[x.name]

    def whole(x: Any) -> Any:
        out = value(x)
        if isinstance(x, Param) and (kind(out) != "int" or out < 0):
            raise BindError(f"the parameter :{x.name} must be a whole number from 0")
        return out

    def change(node: Any) -> Any:
        if isinstance(node, Compare):
            got = value(node.value)
            if isinstance(node.value, Param) and node.op in ("contains", "starts") and kind(got) not in (("string",) if node.op == "contains" else ("string", "binary")):
                raise BindError(f"the parameter :{node.value.name} must be a string")
            return replace(node, value=got)
        if isinstance(node, InList):
            values = value(node.values)
            if isinstance(node.values, Param) and kind(values) != "array":
                raise BindError(f"the parameter :{node.values.name} must be a list")
            return replace(node, values=tuple(map(value, values)))
        if isinstance(node, Matches):
            got = value(node.pattern)
            if not isinstance(got, str):
                raise BindError("a pattern must be a string")
            return replace(node, pattern=got)
        if isinstance(node, Size):
            return replace(node, n=whole(node.n))
        if isinstance(node, (Filter, Aggregate)):
            return replace(node, limit=whole(node.limit), offset=whole(node.offset))
        if isinstance(node, Window):
            return replace(node, size=whole(node.size)) if isinstance(node.size, Param) else node
        return node

    # parameters are leaves of the nodes that hold them, so they are not rebuilt themselves
    out = rebuild(tree, lambda n: n if isinstance(n, Param) else change(n))
    if used is not None:
        used |= seen
    elif unused := set(params) - seen:
        raise BindError(f"no text uses the parameter :{sorted(unused)[0]}")
    return out
