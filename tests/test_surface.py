"""Templates, document helpers, batch lines, exports, explaining, and reports."""

import json
from datetime import date, datetime, time, timezone

import pytest

from docframe import Database, Params, Template, parse_filter
from docframe import errors as X
from docframe.functions import documents as D
from docframe.functions.names import fresh
from docframe.functions.values import DocId
from docframe.sources import jsonl


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def test_templates_bind_again_and_again():
    t = Template.filter("n > :low and s in :many and q matches :p order by n limit :k")
    assert t.params == ["low", "many", "p", "k"]
    params = Params().set("low", 1).set("many", ["a"]).set("p", "^x").set("k", 3)
    assert t.bind(params) == parse_filter('n > 1 and s in ("a") and q matches "^x" order by n limit 3')
    assert t.bind(params, low=2) == parse_filter('n > 2 and s in ("a") and q matches "^x" order by n limit 3')
    for bad in ({"low": 1}, {**params, "more": 1}, {**params, "many": 1}, {**params, "k": -1}, {**params, "p": "("}, {**params, "p": 5}):
        with pytest.raises(X.BindError):
            t.bind(bad)
    a = Template.aggregate("count() as n group by g having n > :n")
    assert a.params == ["n"] and params.only(t.params) == params and params.set("n", 1).unused(t) == ["n"] and params.unused(t, a) == []
    assert params.names() == ["k", "low", "many", "n", "p"]


def test_values_by_path_and_kind():
    doc = {"a": {"b": [{"c": 1}, 2.5]}, "s": "x", "t": True, "raw": b"\0", "at": datetime(2026, 1, 1, tzinfo=timezone.utc), "d": date(2026, 1, 1), "h": time(1), "i": DocId.new()}
    assert D.get(doc, "a.b.0.c") == 1 and D.get(doc, "a.b.7") is None and D.get(doc, "s.x") is None and D.get(doc, "") == doc
    assert D.as_int(D.get(doc, "a.b.0.c")) == 1 and D.as_int(True) is None and D.as_float(1) == 1.0 and D.as_float("1") is None and D.as_int(1.0) is None
    assert D.as_bool(doc["t"]) and D.as_bool(1) is None and D.as_str("x") == "x" and D.as_bytes(doc["raw"]) == b"\0" and D.as_datetime(doc["at"]) and D.as_date(doc["at"]) is None
    assert D.as_date(doc["d"]) and D.as_time(doc["h"]) and D.as_id(doc["i"]) and D.as_list(doc["a"]["b"]) and D.as_dict(doc["a"]) and D.as_dict([]) is None


def test_fresh_names():
    assert fresh(["a", "_N", "_n_"], "n", "n", "x") == ["_n__", "_n___", "_x"]


def test_batch_lines_tell_where_they_fail(db):
    c = db.collection("c")
    c.insert([{"_id": i, "n": i} for i in range(4)])
    lines = ['{"op": "update", "collection": "c", "filter": "n >= :nn and s != \\":n\\"", "update": {"$inc": {"n": 10}}}', "", '{"op": "require", "collection": "c", "filter": "n = :n"}', '{"op": "drop", "collection": "other"}']
    read = jsonl.BatchLines(lines, {"n": 12, "nn": 2})
    assert [(x.line, x.op, x.collection) for x in read.ops] == [(1, "update", "c"), (3, "require", "c"), (4, "drop", "other")]
    assert read.batch(db).commit()[0] == 2 and read.failed_line is None
    read = jsonl.BatchLines(lines, {"n": 1000, "nn": 2})
    with pytest.raises(X.PreconditionFailed):
        read.batch(db).commit()
    assert read.failed_line == 3
    for text, params in (('{"op": "what", "collection": "c"}', {}), ("{", {}), ('{"op": "delete", "collection": "c", "filter": "n ="}', {}), ('{"op": "delete", "collection": "c", "filter": "n = :x"}', {}), ('{"op": "drop", "collection": "c"}', {"x": 1}), ('{"op": "insert", "collection": "c"}', {})):
        with pytest.raises(jsonl.ImportFailed):
            jsonl.BatchLines([text], params)


def test_exports_with_any_line_ends(db, spark, tmp_path):
    c = db.collection("my c")
    docs = [{"_id": i, "s": f"a b\u0085c\rd\n{i}", "n": None if i == 1 else i / 2, "o": {"x": [1, None], "t": time(1, 2)}, "b": b"\xff", "at": datetime(2026, 1, 1, tzinfo=timezone.utc)} for i in range(40)]
    c.insert(docs)
    c.create_index("n", unique=True)
    path = tmp_path / "e.jsonl"
    jsonl.export(db, str(path))
    # as another program may write it
    path.write_text("\n".join(json.dumps(json.loads(x), ensure_ascii=False) for x in path.read_text().split("\n") if x), newline="\n")
    assert jsonl.verify(spark, str(path), f"file://{tmp_path}/v")["collections"] == {"my c": 40}
    (tmp_path / "cut").write_text("\n".join(path.read_text().split("\n")[:-1]))
    with pytest.raises(jsonl.ImportFailed):
        jsonl.verify(spark, str(tmp_path / "cut"), f"file://{tmp_path}/v2")
    assert jsonl.export_folder(db, f"file://{tmp_path}/parts") == {"my c": 40}
    other = Database(spark, f"file://{tmp_path}/other")
    assert jsonl.import_folder(other, f"file://{tmp_path}/parts") == {"my c": 40}
    assert other.collection("my c").find("order by _id") == c.find("order by _id") and other.collection("my c").indexes() == c.indexes()
    with pytest.raises(jsonl.ImportFailed):
        jsonl.import_folder(other, f"file://{tmp_path}/nowhere")


def test_explaining_a_run(db):
    c = db.collection("c")
    c.insert([{"_id": i, "n": i % 5, "s": "x"} for i in range(50)])
    c.insert([{"_id": 100 + i, "n": 9, "s": "y"} for i in range(10)])
    c.create_index("n")
    found = c.explain_run("select n where n < 3 order by n desc limit 4 use index n")
    stats = found["stats"]
    assert (stats["documents_matched"], stats["documents_returned"]) == (30, 4) and 30 <= stats["documents_examined"] <= 60 and stats["elapsed"] > 0
    assert found["hinted"] and found["sort"] == ["n"] and found["select"] == ["n"] and found["filter"]
    assert c.explain_run("order by s")["stats"]["documents_examined"] == 60
    assert c.explain_run("_id >= 100")["stats"]["documents_matched"] == 10
    stats = c.explain_aggregate("", "count() as k group by n having k > 10", None)["stats"]
    assert stats["groups"] == 6 and stats["documents_returned"] == 0 and stats["documents_examined"] == 60


def test_reports(db):
    c = db.collection("c")
    c.insert({"_id": 1})
    with db.snapshot() as s:
        info = db.info()
        assert info["snapshots"] == [1] and info["mode"] == "read and write" and info["collections"] == ["c"] and s.info["pinned"]
    assert db.info()["snapshots"] == [] and Database(db.spark, db.root, read_only=True).info()["mode"] == "read only"


def test_large_numbers(db):
    c = db.collection("c")
    c.insert([{"_id": i, "x": x} for i, x in enumerate([1.7e308, 1.7e308, -1.7e308])])
    assert c.aggregate("", "avg(x) as m, sum(x) as s") == [{"m": pytest.approx(1.7e308 / 3), "s": pytest.approx(1.7e308)}]
    assert c.aggregate("_id < 2", "avg(x) as m") == [{"m": 1.7e308}]
    c.insert({"_id": 9, "x": float("inf")})
    assert c.aggregate("", "avg(x) as m, sum(x) as s") == [{"m": float("inf"), "s": float("inf")}]
