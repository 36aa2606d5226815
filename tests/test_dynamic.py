"""Documents without a schema, against the in-memory model; JSON lines; the text language."""

import functools
import json
import random
from datetime import date, datetime, time, timedelta, timezone

import pytest

from docframe import errors as X
from docframe.functions import codec
from docframe.functions import values as V
from docframe.plans import ast as A
from docframe.plans import evaluate as E
from docframe.plans.parser import parse_aggregate, parse_condition, parse_filter, parse_param, print_aggregate, print_filter
from docframe.sources import dynamic as D
from docframe.sources import jsonl
from docframe.sources.store import Database

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
POOL = [None, True, False, 0, 1, -7, 2**53, 2**53 + 1, V.INT_MAX, V.INT_MIN, 1.0, 1.5, -0.25, 1e300, "", "a", "B", "ä", "a\0b", b"", b"\0a", BASE, BASE + timedelta(minutes=5), date(2026, 5, 1), time(14, 5), V.DocId(int=7), [], [1, "a"], {"x": 1}, {"x": 1.0}, {}]


def docs(rng, n=80):
    out = []
    for i in range(n):
        d = {"_id": i}
        for k in ("a", "b", "c"):
            if rng.random() < 0.8:
                d[k] = rng.choice(POOL)
        if rng.random() < 0.5:
            d["items"] = [rng.choice(POOL) for _ in range(rng.randrange(3))]
        d["at"] = BASE + timedelta(minutes=rng.randrange(60))
        out.append(d)
    return out


def test_sort_bytes_are_in_order():
    for a in POOL + [float("nan")]:
        for b in POOL:
            for desc in (False, True):
                x, y = D.sort_bytes(a, desc), D.sort_bytes(b, desc)
                assert (x > y) - (x < y) == V.order(a, b, desc), (a, b, desc)


def test_codec_round_trip():
    for v in [*POOL, {"$id": 1}, {"$date": "x"}, {"n": {"$object": 1}}, float("inf")]:
        back = codec.loads(codec.dumps(v))
        assert V.canonical(back) == V.canonical(v) and V.kind(back) == V.kind(v)
    for bad in ('{"$id":"x"}', "NaN", "9223372036854775808", '{"$date":"2026-13-01"}'):
        with pytest.raises(ValueError):
            codec.loads(bad)


@pytest.mark.parametrize("seed", range(2))
def test_find_and_aggregate_match_the_model(spark, seed):
    rng = random.Random(seed)
    every = docs(rng)
    df = D.from_documents(spark, every).repartition(3)
    for text in ("a is number order by b desc, a", "not exists(a) or a is null order by c limit 7 offset 2", 'items[*] = 1 or a = {"x": 1}', "select a, b where c != 1 order by _id", "except a, at where a > 0 order by a desc"):
        want = E.apply(parse_filter(text), every)
        got = D.documents(D.find(df, text))
        assert sorted(got, key=str) == sorted(want, key=str) and ("order" not in text or got == want), text
    for text in ("count() as n, count(distinct b) as d, min(b) as lo, max(b) as hi, first(c) as f, last(c order by at) as l group by a", "sum(a) as s, avg(a) as m, count() filter (where b is string) as k", "window at 20m count() as n group by b", "window at 3 per group count() as n, max(at) as t group by a", "window at 9m per group count() as n group by a having n > 1 order by n desc limit 4", "unwind items count() as n, min(items) as lo group by items"):
        want = E.aggregate(parse_aggregate(text), every)
        got = [codec.loads(r["row"]) for r in D.aggregate(df, "", text).collect()]
        # groups of arrays and objects have no order among themselves
        shown = lambda rows: [str(V.canonical(r)) for r in rows if not any(isinstance(r.get(k), (list, dict)) for k in ("a", "b", "items"))]
        assert shown(got) == shown(want) and sorted(str(V.canonical(r)) for r in got) == sorted(str(V.canonical(r)) for r in want), text
    found = {(r["path"], r["kind"]): r["documents"] for r in D.fields(df).collect()}
    assert found["_id", "int"] == len(every) and found.get(("a", "string"), 0) == sum(V.kind(d.get("a")) == "string" for d in every)


def test_export_and_import(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/a")
    db.collection("c").insert([{"_id": i, "n": i, "at": BASE, "raw": b"x", "o": {"k": "v"}} for i in range(5)])
    db.collection("c").create_index("n", unique=True)
    db.collection("d").insert({"t": time(1, 2), "s": "x"})
    counts = jsonl.export(db, f"{tmp_path}/out.jsonl")
    assert counts == {"c": 5, "d": 1}
    other = Database(spark, f"file://{tmp_path}/b")
    with open(tmp_path / "out.jsonl") as f:
        assert jsonl.load(other, f) == counts
    assert other.collection("c").find("order by _id") == db.collection("c").find("order by _id")
    assert other.collection("d").find() == db.collection("d").find() and other.collection("c").indexes() == db.collection("c").indexes()
    assert jsonl.verify(spark, f"{tmp_path}/out.jsonl", f"file://{tmp_path}/v") == {"collections": counts, "check": {"missing": [], "ids": [], "unique": []}}
    with pytest.raises(jsonl.ImportFailed, match="line 2"):
        jsonl.load(other, ['{"$collection":"x"}', "{bad"])
    batch = jsonl.read_batch(other, [json.dumps({"op": "insert", "collection": "e", "doc": {"_id": 1, "n": 1}}), json.dumps({"op": "update", "collection": "e", "filter": "n = :x", "update": {"$inc": {"n": 5}}})], {"x": 1})
    batch.commit()
    assert other.collection("e").get(1)["n"] == 6


@pytest.mark.parametrize("text", ["a = 1 and (b != \"x\" or not c < 2.5)", "select a.b, `first name` where exists(x[*].y) order by a desc, b limit 3 offset 4 use index (a, b)", "select * except body", "tags[*] in (1, null, \"x\") and size(tags) >= 2", "a starts with \"q\" and b contains \"z\" and c matches \"^x\\\\d+\"", "items has (sku = \"A\" and @ is not string)", "at < now - 10m and at >= now + 1h", "a = :x and b in :y limit :n", "a = date(\"2026-05-01\") and b = time(\"14:05:00\") and c = id(\"0192f0c4-7d7a-7c43-9e0b-1f6d1b8f0a11\")", "use = 1 and except = 2", "true", ""])
def test_filters_print_as_read(text):
    f = parse_filter(text)
    assert parse_filter(print_filter(f)) == f


@pytest.mark.parametrize("text", ["count() as n group by a.b, c having n > 3 order by n desc limit 2 offset 1", "window at 5m window at 10 per group last(x order by at) filter (where y = 1) as l group by g", "unwind items, items.parts count(distinct a) as d, sum(b) as s", "window at 90s per group avg(load) as mean group by server"])
def test_aggregates_print_as_read(text):
    a = parse_aggregate(text)
    assert parse_aggregate(print_aggregate(a)) == a


@pytest.mark.parametrize("text", ["a =", "a = Ada", "a = 'x'", "order = 3", "a = now", "a != now", "(a = 1", "a in (1", "select a b = 1", "limit -1", "a = 99999999999999999999", "a is thing", "a. = 1", "a = \"x", "at < now - 5x"])
def test_bad_filters_say_where(text):
    with pytest.raises(X.ParseError) as e:
        parse_filter(text)
    assert "line 1 column" in str(e.value)


@pytest.mark.parametrize("text", ["window _id 5m count() as n", "window at[*] 5m count() as n", "unwind a window a.b 5m count() as n", "count() as n group by a, a.b", "count() as n, sum(x) as n", "sum(x) as a.b", "count() as a group by a", "sum(a[*]) as s", "count() as n having m > 1", "count() as n order by m", "window at 5m window at 6m count() as n", "window at 10 count() as n", "min(a order by b) as m"])
def test_bad_aggregates_are_refused(text):
    with pytest.raises((X.ParseError, X.QueryError)):
        parse_aggregate(text)


def test_parameters():
    f = parse_filter("a = :x and b in :y and size(c) > :n limit :n")
    bound = A.bind(f, {"x": 1, "y": [1, 2], "n": 3})
    assert bound == parse_filter("a = 1 and b in (1, 2) and size(c) > 3 limit 3")
    for bad in ({}, {"x": 1, "y": 2, "n": 3}, {"x": 1, "y": [], "n": -1}, {"x": 1, "y": [], "n": 1, "z": 1}):
        with pytest.raises(X.BindError):
            A.bind(f, bad)
    assert [parse_param(t) for t in ("open", "20", "007", '"20"', 'date("2026-05-01")', "[1]")] == ["open", 20, "007", "20", date(2026, 5, 1), [1]]
    assert parse_condition("a = 1") == A.Compare(A.Path.of("a"), "eq", 1)
    assert functools.reduce(lambda a, b: a & b, [A.TRUE, A.FALSE]) is not None
