"""The text language of filters and aggregates, read and printed."""

from __future__ import annotations

import json
import re
from datetime import timedelta
from typing import Any

from ..errors import BindError, ParseError, QueryError
from ..functions import codec
from ..functions.values import INT_MAX, INT_MIN, KINDS, DocId, kind
from . import ast as A

_NAME = re.compile(r"[^\W\d]\w*")
_SPACE = re.compile(r"\s*")
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?")
_OPS = (("<=", "lte"), (">=", "gte"), ("!=", "ne"), ("<>", "ne"), ("=", "eq"), ("<", "lt"), (">", "gt"))
_SYMBOL = {"eq": "=", "ne": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
#: Microseconds of the units of durations; ns is read by hand.
_UNITS = {"us": 1, "ms": 1000, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6}
_FUNCTIONS = ("count", "sum", "avg", "min", "max", "first", "last")


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.skip()

    def skip(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def fail(self, why: str, at: int | None = None) -> Any:
        raise ParseError(why, self.text, self.at if at is None else at)

    def expected(self, what: str) -> Any:
        found = re.match(r"\w+|\S|", self.text[self.at :])[0]
        return self.fail(f"expected {what}, found " + (f"`{found}`" if found else "the end"))

    def name_ahead(self) -> str:
        m = _NAME.match(self.text, self.at)
        return m[0].lower() if m else ""

    def words_ahead(self, *words: str) -> int:
        """Where the text goes on after these keywords, in any case; 0 if they aren't there."""
        at = self.at
        for w in words:
            m = _NAME.match(self.text, at)
            if not m or m[0].lower() != w:
                return 0
            at = _SPACE.match(self.text, m.end()).end()
        return at or len(self.text)

    def word(self, *words: str) -> bool:
        if at := self.words_ahead(*words):
            self.at = at
            return True
        return False

    def sign(self, s: str) -> bool:
        if self.text.startswith(s, self.at):
            self.at += len(s)
            self.skip()
            return True
        return False

    def need(self, s: str) -> None:
        if not self.sign(s):
            self.expected(f"`{s}`")

    def ended(self) -> bool:
        return self.at >= len(self.text)

    # ---- parts

    def one_name(self) -> str:
        if self.text.startswith("`", self.at):
            start, at, out = self.at, self.at + 1, ""
            while True:
                end = self.text.find("`", at)
                if end < 0:
                    self.fail("a name in backticks doesn't end", start)
                out += self.text[at:end]
                if not self.text.startswith("`", end + 1):
                    break
                out, at = out + "`", end + 2
            if not out or "." in out or "[" in out or "]" in out:
                self.fail("not a name", start)
            self.at = end + 1
            return out
        m = _NAME.match(self.text, self.at)
        if not m or m[0].lower() in A.RESERVED:
            return self.expected("a name")
        self.at = m.end()
        return m[0]

    def path(self) -> A.Path:
        if self.text.startswith("@", self.at):
            self.at += 1
            self.skip()
            return A.Path()
        steps = []
        while True:
            name, each = self.one_name(), 0
            while self.text.startswith("[*]", self.at):
                self.at, each = self.at + 3, each + 1
            steps.append(A.Step(name, each))
            if not self.text.startswith(".", self.at):
                break
            self.at += 1
        self.skip()
        return A.Path(tuple(steps))

    def paths(self) -> tuple[A.Path, ...]:
        out = [self.path()]
        while self.sign(","):
            out.append(self.path())
        return tuple(out)

    def param(self) -> A.Param | None:
        if not self.text.startswith(":", self.at):
            return None
        self.at += 1
        out = A.Param(self.one_name())
        self.skip()
        return out

    def whole(self) -> Any:
        if p := self.param():
            return p
        m = re.compile(r"\d+").match(self.text, self.at)
        if not m:
            return self.expected("a whole number")
        self.at = m.end()
        self.skip()
        return int(m[0])

    def string(self) -> str:
        if not self.text.startswith('"', self.at):
            return self.expected("a string in double quotes")
        return self.json()

    def json(self) -> Any:
        start = self.at
        try:
            value, self.at = json.JSONDecoder(parse_constant=lambda x: self.fail(f"{x} is written as a tagged value", start)).raw_decode(self.text, self.at)
            value = codec.from_plain(value)
        except ParseError:
            raise
        except (ValueError, KeyError) as e:
            return self.fail(f"not a value: {e}", start)
        self.skip()
        return value

    def value(self) -> Any:
        """A value, a Param, or None for null."""
        if p := self.param():
            return p
        start, c = self.at, self.text[self.at : self.at + 1]
        if c and c in '"{[':
            return self.json()
        if m := _NUMBER.match(self.text, self.at):
            self.at = m.end()
            self.skip()
            if m[1] or m[2]:
                return float(m[0])
            n = int(m[0])
            return n if INT_MIN <= n <= INT_MAX else self.fail(f"{n} does not fit 64 bits", start)
        word = self.name_ahead()
        for name, v in (("null", None), ("true", True), ("false", False)):
            if word == name:
                self.word(name)
                return v
        if word in ("id", "datetime", "date", "time"):
            self.word(word)
            self.need("(")
            text = self.string()
            self.need(")")
            try:
                if word == "id":
                    return DocId(text)
                if word == "time":
                    return codec.parse_time(text)
                return codec.parse_datetime(text) if word == "datetime" or len(text) > 10 else codec.parse_date(text)
            except ValueError as e:
                return self.fail(str(e), start)
        return self.expected("a value")

    def duration(self) -> timedelta:
        m = re.compile(r"(\d+)(ns|us|ms|s|m|h|d)\b").match(self.text, self.at)
        if not m:
            return self.expected("a duration like 10m")
        start, self.at = self.at, m.end()
        self.skip()
        if m[2] == "ns":
            if int(m[1]) % 1000:
                return self.fail("durations finer than a microsecond are not supported", start)
            return timedelta(microseconds=int(m[1]) // 1000)
        try:
            return timedelta(microseconds=int(m[1]) * _UNITS[m[2]])
        except OverflowError:
            return self.fail("the duration is too long", start)

    def operator(self) -> str | None:
        for sign, op in _OPS:
            if self.sign(sign):
                return op
        return None

    # ---- conditions

    def condition(self) -> A.Condition:
        items = [self.all_of()]
        while self.word("or"):
            items.append(self.all_of())
        return items[0] if len(items) == 1 else A.Or(tuple(items))

    def all_of(self) -> A.Condition:
        items = [self.one()]
        while self.word("and"):
            items.append(self.one())
        return items[0] if len(items) == 1 else A.And(tuple(items))

    def one(self) -> A.Condition:
        if self.word("not"):
            return A.Not(self.one())
        if self.sign("("):
            c = self.condition()
            self.need(")")
            return c
        if self.word("true"):
            return A.TRUE
        if self.word("false"):
            return A.FALSE
        called = lambda w: (at := self.words_ahead(w)) and self.text.startswith("(", at)
        if called("exists"):
            self.word("exists")
            self.need("(")
            p = self.path()
            self.need(")")
            return A.Exists(p)
        if called("size"):
            self.word("size")
            self.need("(")
            p = self.path()
            self.need(")")
            op = self.operator() or self.expected("a comparison")
            return A.Size(p, op, self.whole())
        return self.test(self.path())

    def test(self, p: A.Path) -> A.Condition:
        start = self.at
        if op := self.operator():
            if self.words_ahead("now"):
                self.word("now")
                offset = timedelta()
                if self.sign("-"):
                    offset = -self.duration()
                elif self.sign("+"):
                    offset = self.duration()
                try:
                    return A.AgainstNow(p, op, offset)
                except QueryError as e:
                    return self.fail(str(e), start)
            return A.Compare(p, op, self.value())
        negated = bool(self.words_ahead("not", "in")) and self.word("not")
        if self.word("in"):
            if q := self.param():
                return A.InList(p, q, negated)
            self.need("(")
            values = []
            while not self.sign(")"):
                if values:
                    self.need(",")
                values.append(self.value())
            return A.InList(p, tuple(values), negated)
        if self.word("contains"):
            return A.Compare(p, "contains", self.param() or self.string())
        if self.word("starts", "with"):
            at = self.at
            v = self.value()
            if not isinstance(v, (str, bytes, A.Param)):
                return self.fail("expected a string or binary", at)
            return A.Compare(p, "starts", v)
        if self.word("matches"):
            return A.Matches(p, self.param() or self.string())
        if self.word("is"):
            out: A.Condition
            no = self.word("not")
            if self.word("null"):
                return A.Compare(p, "ne" if no else "eq", None)
            if self.name_ahead() not in KINDS:
                return self.expected("a kind of value")
            out = A.IsKind(p, self.name_ahead())
            self.word(out.kind)
            return A.Not(out) if no else out
        if self.word("has"):
            self.need("(")
            c = self.condition()
            self.need(")")
            return A.Has(p, c)
        return self.expected("a comparison")

    def orders(self) -> tuple[A.Order, ...]:
        out = []
        while True:
            p = self.path()
            out.append(A.Order(p, self.word("desc")))
            if not out[-1].descending:
                self.word("asc")
            if not self.sign(","):
                return tuple(out)

    # ---- whole texts

    def filter(self) -> A.Filter:
        out: dict[str, Any] = {}
        clause = lambda w: self.words_ahead(w) and not self._tested(w)
        if self.word("select"):
            if not self.sign("*"):
                out["select"] = self.paths()
        if clause("except"):
            self.word("except")
            out["without"] = self.paths()
        where = self.word("where")
        if where or not (self.ended() or self.name_ahead() in ("order", "limit", "offset") or self._hint_ahead()):
            if out and not where:
                self.expected("`where`")
            out["where"] = self.condition()
        if self.word("order", "by"):
            out["order"] = self.orders()
        while self.name_ahead() in ("limit", "offset"):
            key = self.name_ahead()
            if key in out:
                self.fail(f"`{key}` stands twice")
            self.word(key)
            out[key] = self.whole()
        if self.word("use", "no", "index"):
            out["hint"] = ()
        elif self.word("use", "index"):
            if self.sign("("):
                out["hint"] = tuple(p.dotted for p in self.paths())
                self.need(")")
            else:
                out["hint"] = (self.path().dotted,)
        if not self.ended():
            self.expected("the end")
        return A.Filter(**out)

    def _hint_ahead(self) -> bool:
        return bool(self.words_ahead("use", "index") or self.words_ahead("use", "no", "index"))

    def _tested(self, word: str) -> bool:
        """Is this word the name of a field that a condition tests?"""
        at = self.words_ahead(word)
        rest = self.text[at:]
        return bool(re.match(r"[=<>!.\[]|(contains|starts|matches|is|has|in|not)\b", rest, re.I))

    def aggregate(self) -> A.Aggregate:
        out: dict[str, Any] = {}
        while self.word("window"):
            start, p = self.at, self.path()
            q = self.param()
            if q is None and re.compile(r"\d+\s*(per\b|$)").match(self.text, self.at):
                q = self.whole()
            size = q if q is not None else self.duration()
            per = self.word("per", "group")
            if not per and not isinstance(size, timedelta):
                self.expected("`per group`")
            key = "group_window" if per else "window"
            if key in out:
                self.fail("two windows of a kind", start)
            out[key] = A.Window(p, size, per)
        if self.words_ahead("unwind"):
            self.word("unwind")
            out["unwind"] = self.paths()
        columns = []
        while self.name_ahead() in _FUNCTIONS:
            columns.append(self.column())
            if not self.sign(","):
                break
        out["columns"] = tuple(columns)
        if self.word("group", "by"):
            out["group"] = self.paths()
        if self.word("having"):
            out["having"] = self.condition()
        if self.word("order", "by"):
            out["order"] = self.orders()
        while self.name_ahead() in ("limit", "offset"):
            key = self.name_ahead()
            self.word(key)
            out[key] = self.whole()
        if not self.ended():
            self.expected("a column or the end" if not columns else "the end")
        try:
            return A.Aggregate(**out).check()
        except QueryError as e:
            return self.fail(str(e), len(self.text))

    def column(self) -> A.Column:
        name = self.name_ahead()
        self.word(name)
        self.need("(")
        path = by = None
        if name == "count":
            if self.word("distinct"):
                name, path = "count_distinct", self.path()
            else:
                self.sign("*")
        else:
            path = self.path()
            if self.word("order", "by"):
                by = self.path()
        self.need(")")
        where = None
        if self.word("filter"):
            self.need("(")
            if not self.word("where"):
                self.expected("`where`")
            where = self.condition()
            self.need(")")
        if not self.word("as"):
            self.expected("`as` and a name")
        alias = self.one_name()
        self.skip()
        return A.Column(name, path, alias, by, where)


def parse_filter(text: str) -> A.Filter:
    return _Reader(text).filter()


def parse_condition(text: str) -> A.Condition:
    r = _Reader(text)
    c = r.condition()
    return c if r.ended() else r.expected("the end")


def parse_aggregate(text: str) -> A.Aggregate:
    return _Reader(text).aggregate()


def parse_param(text: str) -> Any:
    """A parameter's value as a command line gives it: JSON, id("..."), date("...") and so on, else the string."""
    text = text.strip() if re.match(r"\s*(id|datetime|date|time)\(", text) else text
    if re.match(r"(id|datetime|date|time)\(", text):
        r = _Reader(text)
        v = r.value()
        return v if r.ended() else r.expected("the end")
    try:
        return codec.loads(text)
    except ValueError:
        if text[:1] in ("{", "[", '"'):
            raise BindError(f"not a value: {text!r}") from None
        return text


# ---- printing


def print_value(v: Any) -> str:
    if isinstance(v, A.Param):
        return f":{v.name}"
    name = kind(v)
    if name == "id":
        return f'id("{v}")'
    if name in ("datetime", "date", "time"):
        return f'{name}("{codec.text_of(v)}")'
    return codec.dumps(v)


def print_duration(d: timedelta) -> str:
    us = abs(d) // timedelta(microseconds=1)
    unit = next(u for u in reversed(_UNITS) if us % _UNITS[u] == 0 or u == "us")
    return f"{us // _UNITS[unit]}{unit}"


def print_condition(c: A.Condition, inside: str = "") -> str:
    if isinstance(c, (A.And, A.Or)):
        word = "and" if isinstance(c, A.And) else "or"
        if not c.items:
            return "true" if word == "and" else "false"
        if len(c.items) == 1:
            return print_condition(c.items[0], inside)
        text = f" {word} ".join(print_condition(x, word) for x in c.items)
        return f"({text})" if inside in ("not", word) or inside == "and" else text
    if isinstance(c, A.Not):
        if isinstance(c.item, A.IsKind):
            return f"{c.item.path} is not {c.item.kind}"
        return f"not {print_condition(c.item, 'not')}"
    if isinstance(c, A.Compare):
        if c.value is None and c.op in ("eq", "ne"):
            return f"{c.path} is {'not ' if c.op == 'ne' else ''}null"
        return f"{c.path} {_SYMBOL.get(c.op) or {'contains': 'contains', 'starts': 'starts with'}[c.op]} {print_value(c.value)}"
    if isinstance(c, A.InList):
        values = f":{c.values.name}" if isinstance(c.values, A.Param) else "(" + ", ".join(map(print_value, c.values)) + ")"
        return f"{c.path} {'not ' * c.negated}in {values}"
    if isinstance(c, A.Matches):
        return f"{c.path} matches {print_value(c.pattern)}"
    if isinstance(c, A.Exists):
        return f"exists({c.path})"
    if isinstance(c, A.IsKind):
        return f"{c.path} is {c.kind}"
    if isinstance(c, A.Size):
        return f"size({c.path}) {_SYMBOL[c.op]} {print_value(c.n)}"
    if isinstance(c, A.Has):
        return f"{c.path} has ({print_condition(c.condition)})"
    if isinstance(c, A.AgainstNow):
        sign = "" if not c.offset else " + " if c.offset > timedelta() else " - "
        return f"{c.path} {_SYMBOL[c.op]} now{sign}{print_duration(c.offset) if c.offset else ''}"
    raise QueryError("a condition by a function has no text")


def _tail(node: A.Filter | A.Aggregate) -> list[str]:
    out = []
    if node.order:
        if any(isinstance(o, A.Key) for o in node.order):
            raise QueryError("a sort by a function has no text")
        out.append("order by " + ", ".join(f"{o.path}{' desc' * o.descending}" for o in node.order))
    if node.limit is not None:
        out.append(f"limit {print_value(node.limit)}")
    if node.offset:
        out.append(f"offset {print_value(node.offset)}")
    return out


def print_filter(f: A.Filter) -> str:
    out = []
    if f.select is not None:
        out.append("select " + ", ".join(map(str, f.select or (A.Path.of("_id"),))))
    if f.without:
        out.append(("select * " if f.select is None else "") + "except " + ", ".join(map(str, f.without)))
    if f.where != A.TRUE:
        out.append(("where " if out else "") + print_condition(f.where))
    out += _tail(f)
    if f.hint is not None:
        out.append("use index " + (str(A.Path.of(f.hint[0])) if len(f.hint) == 1 else f"({', '.join(str(A.Path.of(x)) for x in f.hint)})") if f.hint else "use no index")
    return " ".join(out)


def print_aggregate(a: A.Aggregate) -> str:
    out = []
    for w in (a.window, a.group_window):
        if w is not None:
            size = print_duration(w.size) if isinstance(w.size, timedelta) else print_value(w.size)
            out.append(f"window {w.path} {size}{' per group' * w.per_group}")
    if a.unwind:
        out.append("unwind " + ", ".join(map(str, a.unwind)))
    columns = []
    for c in a.columns:
        inner = f"distinct {c.path}" if c.kind == "count_distinct" else "" if c.path is None else str(c.path)
        inner += f" order by {c.by}" if c.by is not None else ""
        where = f" filter (where {print_condition(c.where)})" if c.where is not None else ""
        columns.append(f"{c.kind.split('_')[0]}({inner}){where} as {A.Path((A.Step(c.name),))}")
    if columns:
        out.append(", ".join(columns))
    if a.group:
        out.append("group by " + ", ".join(map(str, a.group)))
    if a.having != A.TRUE:
        out.append("having " + print_condition(a.having))
    return " ".join(out + _tail(a))
