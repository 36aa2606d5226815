"""Random filters and aggregates: the Spark translation against the in-memory model."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import types as T

from docframe.functions import values as V
from docframe.operators.aggregate import aggregate
from docframe.operators.find import count, find
from docframe.plans import ast as A
from docframe.plans import evaluate as E
from docframe.plans.parser import parse_aggregate, parse_filter, print_aggregate, print_filter

UTC = timezone.utc
BASE = datetime(2026, 1, 1, tzinfo=UTC)
SCHEMA = T.StructType([
    T.StructField("_id", T.LongType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType()),
    T.StructField("b", T.BooleanType()), T.StructField("at", T.TimestampType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("grid", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("o", T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.StringType())])),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("q", T.LongType())]))),
])
INTS = [None, 0, 1, 2, -1, 5, 2**53, 2**53 + 1, V.INT_MAX, V.INT_MIN]
FLOATS = [None, 0.0, -0.0, 1.0, 1.5, -2.5, math.nan, math.inf, -math.inf, 2.0**53]
STRINGS = [None, "", "a", "A", "ab", "Straße", "STRASSE", "ä", "z", "5"]
LITERALS = [None, True, False, 0, 1, 2, 5, 1.5, -0.5, 2**53 + 1, V.INT_MAX, 1e300, math.nan, math.inf, -math.inf, float(2**53), "", "a", "A", "ab", "ss", "z", "5", BASE, BASE + timedelta(hours=3), ["a"], ["a", None], [1, 2.0], {"x": 1, "y": "a"}, {"x": 1.0, "y": None}, {"z": 1}]


def documents(rng, n=120):
    pick = rng.choice
    out = []
    for i in range(n):
        out.append({
            "_id": i, "i": pick(INTS), "f": pick(FLOATS), "s": pick(STRINGS), "b": pick([None, True, False]), "at": pick([None, *(BASE + timedelta(hours=h) for h in range(6))]),
            "tags": pick([None, [], ["a"], ["A", "b"], [None], ["a", None, "ab"]]), "grid": pick([None, [], [[]], [[1], [2, 3]], [None, [5]]]),
            "o": pick([None, {"x": 1, "y": "a"}, {"x": None, "y": None}, {"x": 2, "y": "b"}]),
            "items": pick([None, [], [{"k": "a", "q": 1}, {"k": "b", "q": 5}], [{"k": None, "q": 2}], [None], [{"k": "a", "q": 5}]]),
        })
    return out


PATHS = ["i", "f", "s", "b", "at", "tags", "tags[*]", "grid[*]", "grid[*][*]", "o", "o.x", "o.y", "items", "items[*].k", "items[*].q", "nowhere", "o.nowhere", "s[*]", "_id"]


def condition(rng, depth=3, paths=PATHS):
    kind = rng.randrange(14 if depth else 9)
    p = A.Path.of(rng.choice(paths))
    if kind < 4:
        op = rng.choice(["eq", "ne", "lt", "lte", "gt", "gte"])
        return A.Compare(p, op, rng.choice(LITERALS))
    if kind == 4:
        return rng.choice([A.Compare(p, "contains", rng.choice(["", "a", "SS", "ß"])), A.Compare(p, "starts", rng.choice(["", "a", "S"])), A.Matches(p, rng.choice(["^a", "[aä]$", "^S.*e", "a|z"]))])
    if kind == 5:
        return A.InList(p, tuple(rng.choice(LITERALS) for _ in range(rng.randrange(4))), rng.random() < 0.4)
    if kind == 6:
        return A.IsKind(p, rng.choice(V.KINDS))
    if kind == 7:
        return A.Size(p, rng.choice(["eq", "ne", "lt", "gte"]), rng.randrange(4))
    if kind == 8:
        return A.TRUE if rng.random() < 0.5 else A.FALSE
    if kind == 9:
        inner = ["k", "q", ""] if rng.random() < 0.7 else [""]
        return A.Has(A.Path.of(rng.choice(["items", "tags", "grid", "grid[*]", "i"])), condition(rng, depth - 1, inner))
    if kind == 10:
        return A.Not(condition(rng, depth - 1, paths))
    parts = tuple(condition(rng, depth - 1, paths) for _ in range(rng.randrange(1, 4)))
    return A.And(parts) if kind < 12 else A.Or(parts)


def frame(spark, docs):
    rows = [tuple(None if d[f.name] is None else d[f.name] for f in SCHEMA.fields) for d in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=UTC) if x.tzinfo is None else x.astimezone(UTC)
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


@pytest.fixture(scope="module")
def data(spark):
    docs = documents(random.Random(1))
    return docs, frame(spark, docs)


@pytest.mark.parametrize("seed", range(6))
def test_conditions(data, seed):
    from docframe.plans import compile as C
    from pyspark.sql import functions as F

    docs, df = data
    rng = random.Random(100 + seed)
    conditions = [condition(rng) for _ in range(60)]
    scope = C.Scope.of(df)
    tests = [F.coalesce(C.col(C.compile_condition(c, scope)), F.lit(False)).alias(f"c{i}") for i, c in enumerate(conditions)]
    tests += [F.coalesce(C.col(C.compile_condition(c, scope, True)), F.lit(False)).alias(f"n{i}") for i, c in enumerate(conditions)]
    rows = {r["_id"]: r for r in df.select("_id", *tests).collect()}
    for i, c in enumerate(conditions):
        for d in docs:
            want = E.matches(c, d)
            assert rows[d["_id"]][f"c{i}"] == want, (c, d)
            assert rows[d["_id"]][f"n{i}"] == (not want), ("not", c, d)


def test_text_round_trip():
    rng = random.Random(7)
    for _ in range(400):
        f = A.Filter(where=condition(rng), limit=rng.choice([None, 3]), offset=rng.choice([0, 2]), order=rng.choice([(), (A.Order(A.Path.of("i"), True), A.Order(A.Path.of("s")))]))
        text = print_filter(f)
        again = parse_filter(text)
        assert print_filter(parse_filter(print_filter(again))) == print_filter(again)
        docs = documents(rng, 12)
        assert E.apply(again, docs) == E.apply(f, docs) or "nan" in text.lower()


@pytest.mark.parametrize("seed", range(3))
def test_sorted_and_cut(data, seed):
    docs, df = data
    rng = random.Random(200 + seed)
    for _ in range(8):
        order = tuple(A.Order(A.Path.of(rng.choice(["i", "f", "s", "b", "at", "tags", "o.x", "nowhere", "o"])), rng.random() < 0.5) for _ in range(rng.randrange(1, 3)))
        f = A.Filter(where=condition(rng, 1), order=order, limit=rng.choice([None, 0, 7]), offset=rng.choice([0, 5]))
        want = [d["_id"] for d in E.apply(f, docs)]
        assert [r["_id"] for r in find(df, f).collect()] == want, print_filter(f)
        assert count(df, f) == len(want)


@pytest.mark.parametrize("seed", range(4))
def test_aggregates(data, seed):
    docs, df = data
    rng = random.Random(300 + seed)
    for _ in range(6):
        a = A.Aggregate(group=tuple(map(A.Path.of, rng.choice([(), ("s",), ("b", "o.y"), ("nowhere",), ("i",)]))))
        if rng.random() < 0.4:
            a = a.unwinding(*rng.choice([("tags",), ("items",), ("b",)])) if a.group != (A.Path.of("b"), A.Path.of("o.y")) else a
        if rng.random() < 0.3:
            a = A.replace(a, window=A.Window(A.Path.of("at"), timedelta(hours=rng.randrange(5))))
        if rng.random() < 0.3:
            a = A.replace(a, group_window=A.Window(A.Path.of("at"), rng.choice([timedelta(hours=2), 3]), True))
        for i in range(rng.randrange(1, 5)):
            where = condition(rng, 1, ["i", "f", "s", "b", "at", "o.x"]) if rng.random() < 0.4 else None
            kind, path = rng.choice(["count", "count_distinct", "avg", "min", "max", "first", "last", "sum"]), rng.choice(["f", "s", "at", "o.x", "b", "nowhere", "items.q"] if any(u.names == ("items",) for u in a.unwind) else ["f", "s", "at", "o.x", "b", "nowhere"])
            if kind == "count":
                a = a.count(f"c{i}", where)
            elif kind in ("first", "last"):
                a = getattr(a, kind)(path, f"c{i}", rng.choice([None, "i", "at"]), where)
            else:
                a = getattr(a, kind)(path, f"c{i}", where)
        text = print_aggregate(a)
        assert print_aggregate(parse_aggregate(text)) == text
        base = [d for d in docs if d["f"] is None or math.isfinite(d["f"])]
        want = E.aggregate(a, base)
        got = [plain(r.asDict(recursive=True)) for r in aggregate(df, "not f in (" + ", ".join(['{"$float": "Infinity"}', '{"$float": "-Infinity"}']) + ")", a).where("true").collect()]
        if any(d["f"] is not None and math.isnan(d["f"]) for d in docs):
            want = E.aggregate(a, [d for d in docs if not (d["f"] in (math.inf, -math.inf))])
        assert got == [plain(r) for r in want], text
