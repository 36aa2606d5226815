"""Change feeds and live queries."""

import functools
import json
import random
import time
from datetime import datetime, timedelta, timezone

import pytest

from docframe.errors import NotLive, SnapshotTooOld
from docframe.plans import evaluate as E
from docframe.plans.parser import parse_filter
from docframe.sources.store import Database
from docframe.streaming import live as L


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, f"file://{tmp_path}/db")


def test_commits_tell_net_changes(db):
    with db.subscribe() as feed:
        c = db.collection("c")
        c.insert([{"_id": 1, "n": 1}, {"_id": 2, "n": 2}])
        db.batch().insert("c", {"_id": 3, "n": 3}).update("c", "_id = 3", {"$inc": {"n": 1}}).delete("c", "_id = 1").insert("c", {"_id": 4, "n": 0}).delete("c", "_id = 4").commit()
        c.drop()
        got = [(e.version, [(x.id, x.op) for x in e.changes]) for e in feed.drain()]
    assert got == [(1, [(1, "inserted"), (2, "inserted")]), (2, [(1, "deleted"), (3, "inserted")]), (3, [(None, "dropped")])]


def test_watch_unsorted(db):
    c = db.collection("c")
    c.insert([{"_id": i, "n": i} for i in range(4)])
    with c.watch("n >= :x", {"x": 2}) as feed:
        assert [(type(e), e.id) for e in feed.drain()] == [(L.Entered, 2), (L.Entered, 3)]
        c.update_many("_id = 0 or _id = 3", {"$inc": {"n": 10}})
        c.update_many("_id = 2", {"$set": {"n": 0}})
        c.delete(3)
        c.insert({"_id": 9, "n": 1})
        assert [(type(e), e.id, e.doc and e.doc["n"]) for e in feed.drain()] == [(L.Entered, 0, 10), (L.Changed, 3, 13), (L.Left, 2, 0), (L.Left, 3, None)]
    assert feed.ended
    for text in ("limit 3", "order by n offset 1"):
        with pytest.raises(NotLive):
            c.watch(text)


def replay(events, start=()):
    now = list(start)
    for e in events:
        if isinstance(e, (L.Left, L.RowLeft)):
            now.pop(e.from_)
        elif isinstance(e, (L.Entered, L.RowEntered)):
            now.insert(e.at, e.doc if isinstance(e, L.Entered) else e.row)
        else:
            now.pop(e.from_)
            now.insert(e.at, e.doc if isinstance(e, L.Changed) else e.row)
    return now


def test_watch_sorted_and_aggregate(db):
    c = db.collection("c")
    c.insert([{"_id": i, "n": i, "g": "ab"[i % 2]} for i in range(6)])
    top = "order by n desc limit 3"
    rows = "count() as k, sum(n) as s group by g having k > 1 order by s desc"
    with c.watch(top) as a, c.watch_aggregate("", rows) as b:
        lists = replay(a.drain()), replay(b.drain())
        for change in (lambda: c.update_many("_id = 0", {"$set": {"n": 99}}), lambda: c.delete_many("n > 4"), lambda: c.insert([{"_id": 50, "n": 3, "g": "c"}, {"_id": 51, "n": 7, "g": "c"}]), lambda: c.delete_many('g = "a"')):
            change()
            lists = replay(a.drain(), lists[0]), replay(b.drain(), lists[1])
            assert lists[0] == c.find(top) and lists[1] == c.aggregate("", rows)


def test_clock_moves_documents(db):
    c = db.collection("c")
    now = datetime.now(timezone.utc)
    c.insert([{"_id": 1, "at": now - timedelta(hours=1)}, {"_id": 2, "at": now + timedelta(seconds=4)}, {"_id": 3, "at": now + timedelta(hours=1)}])
    with c.watch("at < now", clock_every=0.5) as feed:
        assert feed.next(30).id == 1
        e = feed.next(40)
        assert isinstance(e, L.Entered) and e.id == 2


def naive(was, found, written, orders, left):
    """The same events from plain lists, every place counted anew."""
    less = lambda a, b: E._less(a, b, orders) < 0
    ids, events, now = [d["_id"] for d in found], [], list(was)
    while gone := [d for d in now if d["_id"] not in ids]:
        at = now.index(gone[0])
        events.append(L.Left(gone[0]["_id"], left.get(str(gone[0]["_id"])), at))
        del now[at]
    for d in found:
        here = [i for i, x in enumerate(now) if x["_id"] == d["_id"]]
        if here and str(d["_id"]) not in written:
            continue
        for i in here:
            del now[i]
        at = sum(less(x, d) for x in now)
        now.insert(at, d)
        events.append(L.Changed(d["_id"], d, here[0], at) if here else L.Entered(d["_id"], d, at))
    return events


def test_sorted_events_match_a_model_of_plain_lists():
    rng = random.Random(5)
    orders = parse_filter("order by n desc, m").order
    order = functools.cmp_to_key(lambda a, b: E._less(a, b, orders))
    for _ in range(300):
        docs = {i: {"_id": i, "n": rng.choice([None, 1, 2, 2.5, float("nan")]), "m": rng.randint(0, 3)} for i in range(rng.randint(0, 9))}
        limit = rng.choice([3, 5, 100])
        was = sorted(docs.values(), key=order)[:limit]
        after = dict(docs)
        written = set()
        for i in rng.sample(range(12), rng.randint(0, 4)):
            written.add(str(i))
            if rng.random() < 0.3:
                after.pop(i, None)
            else:
                after[i] = {"_id": i, "n": rng.choice([None, 1, 2, 3]), "m": rng.randint(0, 3)}
        found = sorted(after.values(), key=order)[:limit]
        left = {str(i): d for i, d in after.items()}
        events = list(L.reorder(was, found, written, orders, left))
        assert repr(events) == repr(naive(was, found, written, orders, left))
        assert repr(replay(events, was)) == repr(found)
        assert all(str(e.id) in written for e in events if isinstance(e, L.Changed))


def test_only_the_written_document_is_told(db):
    c = db.collection("c")
    c.insert([{"_id": i, "n": i} for i in range(3)])
    with c.watch("select m where n < 50 order by n") as feed:
        assert [(type(e), e.id, e.at, e.doc) for e in feed.drain()] == [(L.Entered, i, i, {"_id": i}) for i in range(3)]
        c.update_many("_id = 0", {"$set": {"n": 9, "m": 1}})
        assert feed.drain() == [L.Changed(0, {"_id": 0, "m": 1}, 0, 2)]
        c.update_many("_id = 1", {"$set": {"n": 99, "m": 2}})
        assert feed.drain() == [L.Left(1, {"_id": 1, "m": 2}, 0)]


def test_a_feed_begins_at_its_own_version(spark, tmp_path):
    """Old commits are not gone through again."""
    root = tmp_path / "db"
    db = Database(spark, f"file://{root}")
    db.collection("c").insert({"_id": 1, "n": 1})
    first = json.loads((root / "manifest/000000000001.json").read_text())
    for v in range(2, 520):
        (root / f"manifest/{v:012d}.json").write_text(json.dumps({**first, "version": v}))
    db = Database(spark, f"file://{root}")
    with db.subscribe() as feed, db.subscribe(since=517) as earlier:
        began = time.monotonic()
        db.collection("c").insert({"_id": 2})
        made = time.monotonic()
        assert feed.next(60).version == 520
        # a stream's first batch included
        assert time.monotonic() - made < 20, (made - began)
        assert [e.version for e in earlier.drain()] == [518, 519, 520]
        db.compact()
        assert db.manifest(519) and feed.drain() == []
    db.compact()
    with pytest.raises(SnapshotTooOld):
        db.manifest(517)


def test_patterns_of_later_versions():
    import re

    for v in (0, 9, 19, 159, 999_999, 123_456_789_012):
        way = re.compile("(" + "|".join(x.replace("*", ".*") for x in L.later_than(v)[1:-6].split(",")) + r")\.json")
        for w in (0, 1, v - 1, v, v + 1, v + 9, v + 100, 10**11, 9 * 10**11):
            if w >= 0:
                assert bool(way.fullmatch(f"{w:012d}.json")) == (w > v)
