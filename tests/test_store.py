"""Collections: writes, batches, snapshots, unique indexes, refusals."""

from datetime import datetime, time, timezone

import pytest

from docframe import errors as X
from docframe.functions.values import DocId
from docframe.operators.update import Update, apply
from docframe.plans import ast as A
from docframe.sources.store import Database


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def test_documents_come_back(db):
    c = db.collection("things")
    doc = {"n": 1, "f": 1.5, "s": "x", "b": True, "raw": b"\x00\x01", "at": datetime(2026, 5, 1, 12, tzinfo=timezone.utc), "t": time(14, 5), "tags": ["a", None], "o": {"x": 1, "deep": {"y": "z"}}, "ref": DocId.new()}
    (i,) = c.insert(doc)
    assert isinstance(i, DocId) and c.get(i) == {"_id": i, **doc} and c.get(str(i)) == c.get(i)
    c.insert({"n": 2.5, "more": 1})
    assert c.count("n > 1.5") == 1 and c.count("n = 1") == 1 and c.count("t = time(\"14:05\")") == 1
    assert c.count(f'ref = id("{doc["ref"]}")') == 1 and c.count('ref = "x"') == 0
    assert [f["path"] for f in c.fields()][0] == "_id" and {"path": "o.deep.y", "kind": "string", "documents": 1} in c.fields()
    with pytest.raises(X.DuplicateId):
        c.insert({"_id": i})
    with pytest.raises(X.DuplicateId):
        db.collection("other").insert([{"_id": 5}, {"_id": 5}])
    assert db.collections() == ["things"]
    assert db.check() == {"missing": [], "ids": [], "unique": []}


UPDATES = [
    {"$set": {"n": 9, "o.x": 3, "new": "v", "p.q": 1}},
    {"$unset": {"s": 1, "o.x": 1, "nowhere": 1}},
    {"$inc": {"n": 2, "hits": 1}, "$mul": {"f": 2}},
    {"$mul": {"zero": 3}, "$min": {"n": 2, "lowest": 1}, "$max": {"f": 2.5, "s": "b"}},
    {"$rename": {"s": "title", "nowhere": "x"}},
    {"$push": {"tags": "z", "list": 1}},
    {"$push": {"tags": {"$each": ["y", "z"]}}, "$addToSet": {"tags": "a"}},
    {"$addToSet": {"tags": "q"}, "$pull": {"tags": "b"}},
    {"$pop": {"tags": 1}},
    {"$pop": {"tags": -1}, "$pull": {"nowhere": 1}},
]
DOCS = [{"_id": 1, "n": 1, "f": 1.0, "s": "a", "tags": ["a", "b"], "o": {"x": 1, "y": "k"}}, {"_id": 2, "n": 5, "f": 4.0, "s": "c", "tags": []}, {"_id": 3, "n": -3, "tags": ["b", "b"], "o": {"y": "m"}}]


def bare(x):
    """Without nulls and empty objects: typed rows cannot tell them from missing fields."""
    if isinstance(x, dict):
        return {k: v for k, v in ((k, bare(v)) for k, v in x.items()) if v is not None and v != {}}
    return x


@pytest.mark.parametrize("spec", UPDATES, ids=lambda s: "".join(s))
def test_updates_match_the_model(db, spec):
    c = db.collection("c")
    c.insert(DOCS)
    want = [apply(Update.of(spec), d) if d["n"] > -2 else d for d in DOCS]
    n = c.update_many("n > -2", spec)
    assert [bare(d) for d in c.find("order by _id")] == [bare(d) for d in want]
    assert n == sum(bare(a) != bare(b) for a, b in zip(want, DOCS))


def test_updates_refuse(db):
    c = db.collection("c")
    c.insert(DOCS)
    for spec in ({"$set": {"": 1}}, {"$set": {"a[*]": 1}}, {"$set": {"_id.x": 1}}, {"$inc": {"n": "1"}}, {"$min": {"n": []}}, {"$rename": {"a": "a.b"}}, {"$what": {"a": 1}}):
        with pytest.raises(X.QueryError):
            c.update_many("", spec)
    for spec in ({"$push": {"n": 1}}, {"$inc": {"s": 1}}, {"$set": {"s.x": 1}}):
        with pytest.raises(X.UpdateError):
            c.update_many("", spec)
    with pytest.raises(Exception, match="(?i)overflow"):
        c.update_many("", {"$inc": {"n": (1 << 63) - 1}})
    assert [bare(d) for d in c.find("order by _id")] == [bare(d) for d in DOCS]


def test_delete_replace_upsert(db):
    c = db.collection("c")
    c.insert(DOCS)
    assert c.delete_many("order by n limit 1") == 1 and c.get(3) is None
    assert c.update(2, {"n": 7}) and not c.update(99, {"n": 7}) and c.get(2) == {"_id": 2, "n": 7}
    assert c.delete(1) and not c.delete(1)
    assert c.upsert_fields("n = 7", {"$inc": {"n": 1}, "$setOnInsert": {"first": 1}}) == {"updated": 2}
    made = c.upsert("_id = 50 and n = 1", {"_id": 50, "n": 1})
    assert made == {"inserted": 50} and c.count() == 2
    c.insert({"_id": 51, "n": 1})
    with pytest.raises(X.MultipleMatches):
        c.upsert("n = 1", {"n": 3})
    with pytest.raises(X.QueryError):
        c.upsert("n = 1 limit 1", {"n": 3})
    assert c.update_many("n = 1", lambda d: {**d, "n": d["n"] + 10} if d["_id"] == 51 else None) == 1
    assert c.get(51)["n"] == 11


def test_batches_snapshots_and_conflicts(db):
    a, b = db.collection("a"), db.collection("b")
    a.insert(DOCS)
    before = db.snapshot()
    batch = db.batch().require("a", "_id = 1").insert("b", {"_id": 1}).update("a", "_id = 1", {"$inc": {"n": 1}}).delete("a", "_id = 2")
    other = db.batch().insert("b", {"_id": 9})
    assert batch.commit()[1:] == [[1], 1, 1]
    assert a.count() == 2 and b.count() == 1 and before.collection("a").count() == 3 and before.collections() == ["a"]
    with pytest.raises(X.Conflict):
        other.commit()
    with pytest.raises(X.PreconditionFailed):
        db.batch().insert("b", {"_id": 2}).require_none("a", "_id = 1").commit()
    assert b.count() == 1
    db.batch().insert("b", {"_id": 3}).commit(dry_run=True)
    assert b.count() == 1
    a.drop()
    assert db.collections() == ["b"]
    for i in range(4):
        b.insert({"_id": 100 + i})
    files = db.stats()["collections"]["b"]["files"]
    db.compact()
    assert db.stats()["collections"]["b"]["files"] < files and b.count() == 5
    # an open snapshot keeps its version
    assert before.info["pinned"] and before.collection("a").count() == 3
    before.close()
    db.compact()
    with pytest.raises(X.SnapshotTooOld):
        before.collection("a").count()
    with pytest.raises(X.ReadOnly):
        Database(db.spark, db.root, read_only=True).collection("b").insert({"_id": 1})


@pytest.mark.parametrize("name", ["data", "my tasks", "a%b", "a%20b", "é/../x", "_hidden", ".dot", "x{y}*?[z]", "c-a", "changes"])
def test_any_name_is_written_and_changed(spark, tmp_path, name):
    db = Database(spark, f"file://{tmp_path}/a b%41/data/d")
    c = db.collection(name)
    c.insert([{"_id": i, "n": i} for i in range(6)])
    assert c.update_many("n > 3", {"$inc": {"n": 10}}) == 2 and c.delete_many("n = 0") == 1 and c.delete_many("order by n desc limit 1") == 1
    assert c.upsert_fields("_id = 1", {"$set": {"n": 7}}) == {"updated": 1} and c.update(2, {"n": 8})
    db.batch().update(name, "_id = 3", {"$set": {"n": 9}}).insert(name, {"_id": 50, "n": 0}).delete(name, "_id = 4").commit()
    assert [(d["_id"], d["n"]) for d in c.find("order by _id")] == [(1, 7), (2, 8), (3, 9), (50, 0)]
    db.compact()
    assert c.count() == 4 and db.collections() == [name] and db.check() == {"missing": [], "ids": [], "unique": []}


def test_names_have_bounds(db):
    for name in ("", "x" * 256):
        with pytest.raises(X.QueryError):
            db.collection(name).insert({"_id": 1})


def test_a_batch_across_a_compaction_keeps_its_files(db, monkeypatch):
    import time

    c = db.collection("c")
    for i in range(3):
        c.insert({"_id": i})
    late = db.batch().insert("c", {"_id": 10})
    real, made = Database.sweep, []

    def sweep(self, version, keep, horizon):
        # another batch begins after the compaction's commit and has only its manifest left to publish
        batch = self.batch().insert("c", {"_id": 11})
        files = self.files
        monkeypatch.setattr(files, "create", lambda p, text: made.append((p, text)))
        batch.commit()
        monkeypatch.undo()
        out = real(self, version, keep, horizon)
        files.create(*made[0])
        return out

    monkeypatch.setattr(Database, "sweep", sweep)
    time.sleep(3)
    assert db.compact()["deleted_files"] > 0
    assert db.check() == {"missing": [], "ids": [], "unique": []} and c.count() == 4
    with pytest.raises(X.Conflict):
        late.commit()


def test_inserts_read_only_files_that_may_hold_the_ids(db):
    c = db.collection("c")
    c.insert([{"_id": i} for i in range(10)])
    c.insert([{"_id": i} for i in range(100, 110)])
    state = c._state()
    assert sorted(state.ranges[f] for f in state.may_hold(105, 200)) and all(state.ranges[f][1] >= 100 for f in state.may_hold(105, 200))
    assert state.may_hold(20, 50) == [] and len(state.may_hold("a", "b")) == len(state.files)
    with pytest.raises(X.DuplicateId):
        c.insert([{"_id": 50}, {"_id": 104}])
    c.insert({"_id": 50})
    c.update_many("_id = 50", {"$set": {"n": 1}})
    with pytest.raises(X.DuplicateId):
        c.insert({"_id": 50})


def test_a_function_may_widen_a_field_of_some_files(db):
    c = db.collection("c")
    c.insert([{"_id": 1, "n": 1}])
    c.insert([{"_id": 2, "n": 2}])
    assert c.update_many("_id = 1", {"$unset": {"n": 1}}) == 1 and c.insert({"_id": 3, "n": 2.5}) == [3]
    assert [d.get("n") for d in c.find("order by _id")] == [None, 2.0, 2.5]


def test_functions_see_nulls_and_integers(db):
    c = db.collection("c")
    c.insert([{"_id": 1, "n": 1, "t": time(1, 2)}, {"_id": 2, "n": None, "o": {"x": 5}}, {"_id": 3, "n": (1 << 60) + 1, "tags": [1, None]}])
    seen = lambda d: (d["n"], type(d["n"]).__name__)
    find = lambda f: [d["_id"] for d in c.find(A.Filter().custom(["n", "t", "o", "tags", "nowhere"], f))]
    assert find(lambda d: d["n"] is None) == [2] and find(lambda d: seen(d) == ((1 << 60) + 1, "int")) == [3]
    assert find(lambda d: d["t"] == time(1, 2)) == [1] and find(lambda d: d["o"] == {"x": 5}) == [2] and find(lambda d: d["tags"] == [1, None]) == [3]
    assert find(lambda d: "nowhere" in d) == []
    assert [d["_id"] for d in c.find(A.Filter().sort_by_key(lambda d: 9.0 if d["n"] is None else -float(d["n"])))] == [3, 1, 2]


def test_indexes(db):
    c = db.collection("c")
    c.insert([{"_id": 1, "e": "x", "k": 1}, {"_id": 2, "e": None, "k": 1}, {"_id": 3, "k": 2}])
    c.create_index("e", unique=True)
    c.create_index("k")
    with pytest.raises(X.DuplicateValue):
        c.insert({"_id": 4, "e": "x"})
    with pytest.raises(X.DuplicateValue):
        c.update_many("_id = 3", {"$set": {"e": "x"}})
    assert c.count("k = 1 use index k") == 2 and c.count("use no index") == 3
    for text in ("k = 1 use index e", "k = 1 use index nowhere"):
        with pytest.raises(X.HintError):
            c.count(text)
    with pytest.raises(X.QueryError):
        c.create_index("_id")
    plan = c.explain("k = 1")
    assert plan["filter"] == "k = 1" and "EqualTo(k,1)" in plan["pushed"][0]
    c.drop_index("e")
    c.insert({"_id": 4, "e": "x"})


def test_dataclasses(db):
    from dataclasses import dataclass

    @dataclass
    class Thing:
        id: int
        n: int = 0

    @dataclass
    class Total:
        s: int

    c = db.collection("c")
    c.insert([{"_id": 1, "n": 4, "more": "x"}, {"_id": 2}])
    assert c.find_as(Thing, "order by _id") == [Thing(1, 4), Thing(2)]
    assert c.aggregate_as(Total, "", "sum(n) as s") == [Total(4)]
