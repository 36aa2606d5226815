"""Change feeds and live queries over a database's commits.

A commit is one file in ``manifest/``.  Structured Streaming reads the files of later versions than
the feed's first as a file source, and ``foreachBatch`` turns each into events, in order: an unsorted
live query joins only the documents that the commit changed, a sorted one compares its list before
and after, an aggregate its rows.  No watermark is used: late documents count as soon as they are
committed.  A lease keeps the versions that a feed has yet to tell from ``compact``.
"""

from __future__ import annotations

import bisect
import functools
import queue
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotLive, QueryError
from ..functions import values as V
from ..operators import aggregate as agg
from ..operators import find as fnd
from ..plans import ast as A
from ..plans import compile as C
from ..plans import evaluate as E
from ..sources.rows import document

#: Events that a feed holds until they are asked for; the stream waits beyond that.
HELD = 100_000
#: Versions after which a feed renews its lease.
RENEW = 50


@dataclass(frozen=True)
class Change:
    collection: str
    id: Any
    op: str  # inserted, updated, deleted; dropped for a collection, without an id


@dataclass(frozen=True)
class Commit:
    version: int
    changes: list[Change]


@dataclass(frozen=True)
class Entered:
    id: Any
    doc: dict
    at: int | None = None


@dataclass(frozen=True)
class Left:
    id: Any
    doc: dict | None
    from_: int | None = None


@dataclass(frozen=True)
class Changed:
    id: Any
    doc: dict
    from_: int | None = None
    at: int | None = None


@dataclass(frozen=True)
class RowEntered:
    row: dict
    at: int


@dataclass(frozen=True)
class RowLeft:
    group: dict
    row: dict | None
    from_: int


@dataclass(frozen=True)
class RowChanged:
    row: dict
    from_: int
    at: int


def later_than(version: int) -> str:
    """A pattern of the manifest names of all later versions: for each digit a greater one, and any behind it."""
    digits = f"{version:012d}"
    ways = [f"{digits[:i]}[{int(d) + 1}-9]*" for i, d in enumerate(digits) if d != "9"]
    return "{" + ",".join(ways) + "}.json"


class Feed:
    """A queue of events; an error of the query ends it and is raised once.

    It tells the commits after version ``since``, by default the newest.
    """

    def __init__(self, db: Any, every: float = 0.1, clock_every: float | None = None, since: int | None = None):
        self.db, self.every = db, every
        self._events: queue.Queue = queue.Queue(HELD)
        self._closed = threading.Event()
        self._error: BaseException | None = None
        self._seen = db.version() if since is None else since
        self._lease, self._leased = db.lease(max(1, self._seen), onward=True), self._seen
        self._lock = threading.Lock()
        self._checkpoint = f"{self.db.root}/streams/{uuid.uuid4().hex}"
        self._firsts = threading.Thread(target=self._begin, daemon=True)
        self._ready = threading.Event()
        self._firsts.start()
        self._stream = self._start()
        self._clock = None
        if clock_every is not None:
            self._clock = threading.Thread(target=self._tick, args=(clock_every,), daemon=True)
            self._clock.start()

    def _begin(self) -> None:
        # no commit is taken in before what is there has been told
        with self._lock:
            self._ready.set()
            self._guard(self._first)

    def _start(self) -> Any:
        self._ready.wait()
        source = self.db.spark.readStream.schema("value string").option("pathGlobFilter", later_than(self._seen)).text(f"{self.db.root}/manifest")
        versions = source.select(F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("long").alias("version")).distinct()

        def each(batch: DataFrame, _: int) -> None:
            for r in sorted(r["version"] for r in batch.collect()):
                with self._lock:
                    if r > self._seen and not self._closed.is_set():
                        self._guard(self._advance, self._seen, r)
                        self._seen = r
                        self._renew()

        return versions.writeStream.foreachBatch(each).option("checkpointLocation", self._checkpoint).trigger(processingTime=f"{max(1, int(self.every * 1000))} milliseconds").start()

    def _renew(self) -> None:
        if self._seen - self._leased >= RENEW and not self._closed.is_set():
            old, self._lease, self._leased = self._lease, self.db.lease(self._seen, onward=True), self._seen
            self.db.release(old)

    def _guard(self, f: Any, *args: Any) -> None:
        try:
            for e in f(*args):
                while not self._closed.is_set():
                    try:
                        self._events.put(e, timeout=0.1)
                        break
                    except queue.Full:
                        continue
        except BaseException as e:
            self._error = e
            self._closed.set()

    def _first(self) -> Iterator[Any]:
        return iter(())

    def _advance(self, old: int, new: int) -> Iterator[Any]:
        raise QueryError("a feed is of changes, of a filter or of an aggregate")

    def _on_clock(self) -> Iterator[Any]:
        return iter(())

    def _tick(self, every: float) -> None:
        while not self._closed.wait(every):
            with self._lock:
                self._guard(self._on_clock)

    @property
    def ended(self) -> bool:
        return self._closed.is_set() and self._events.empty()

    def next(self, timeout: float | None = None) -> Any:
        """The next event; None after ``timeout`` seconds without one, or at the end."""
        until = None if timeout is None else time.monotonic() + timeout
        while True:
            try:
                return self._events.get(timeout=0.05)
            except queue.Empty:
                if self._error is not None:
                    error, self._error = self._error, None
                    raise error from None
                if self._closed.is_set() or until is not None and time.monotonic() >= until:
                    return None

    def __iter__(self) -> Iterator[Any]:
        while (e := self.next()) is not None:
            yield e

    def _told(self, version: int, until: float) -> Iterator[Any]:
        """Events up to that version, as they come."""
        self._firsts.join()
        while True:
            # a version counts as seen when its events are in the queue
            done = self._seen >= version or self._closed.is_set()
            try:
                yield self._events.get(timeout=0 if done else 0.02)
                continue
            except queue.Empty:
                if done:
                    return
            if time.monotonic() > until:
                raise TimeoutError(f"version {version} was not reached")

    def drain(self, timeout: float = 60) -> list:
        """All events of the commits made so far."""
        out = []
        until, version = time.monotonic() + timeout, self.db.version()
        while self._firsts.is_alive():
            try:
                out.append(self._events.get(timeout=0.02))
            except queue.Empty:
                if time.monotonic() > until:
                    raise TimeoutError("what there is was not told in time") from None
        out += self._told(version, until)
        if self._error is not None:
            error, self._error = self._error, None
            raise error
        return out

    def close(self) -> None:
        """Stop; versions that were kept for this feed may go."""
        if not self._closed.is_set() or self._lease is not None:
            self._closed.set()
            self._stream.stop()
            self.db.release(self._lease)
            self._lease = None
            self.db.files.delete(self._checkpoint)

    def __enter__(self) -> Feed:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


class Changes(Feed):
    """One Commit for each commit, in order: what it did to each document, net."""

    def _advance(self, old: int, new: int) -> Iterator[Commit]:
        for v in range(old + 1, new + 1):
            m = self.db.manifest(v)
            changes = [Change(name, None, "dropped") for name in m.get("dropped", [])]
            for name, path in sorted(m["changes"].items()):
                rows = self.db.spark.read.parquet(f"{self.db.root}/{path}")
                changes += [Change(name, r["_id"], r["op"]) for r in rows.orderBy("_id").toLocalIterator()]
            if changes:
                yield Commit(v, changes)


class LiveQuery(Feed):
    """A filter kept up to date: first Entered for what matches, then what each commit changes."""

    def __init__(self, db: Any, name: str, f: Any = None, params: dict | None = None, clock_every: float = 1.0, **options: Any):
        if f is None or isinstance(f, str):
            from ..plans.parser import parse_filter

            f = parse_filter(f or "")
        elif isinstance(f, A.Condition):
            f = A.Filter(where=f)
        self.name, self.filter = name, A.bind(f, params)
        if self.filter.offset:
            raise NotLive("a live query takes no skip")
        if self.filter.limit is not None and not self.filter.order:
            raise NotLive("a live query with a limit needs a sort")
        self._now = datetime.now(timezone.utc)
        super().__init__(db, clock_every=clock_every if self.filter.reads_now else None, **options)

    def _found(self, version: int, now: datetime) -> DataFrame:
        return fnd.find(self.db.frame(self.db.manifest(version)["collections"].get(self.name)), self.filter, now=now)

    def _whole(self, version: int, now: datetime) -> list[dict]:
        """What a sorted query finds, in its order, all fields."""
        f = A.replace(self.filter, select=None, without=())
        df = fnd.find(self.db.frame(self.db.manifest(version)["collections"].get(self.name)), f, now=now)
        return [document(r, df.schema) for r in df.collect()]

    def _shown(self, doc: dict | None) -> dict | None:
        return None if doc is None else E.project(doc, self.filter.select, self.filter.without)

    def _documents(self, version: int, ids: list) -> dict[str, dict]:
        """Documents of a version by their ids, whatever the filter says of them."""
        state = self.db.manifest(version)["collections"].get(self.name)
        if state is None or not ids:
            return {}
        df = self.db.frame(state)
        few = df.where(C.where(A.InList(A.Path.of("_id"), tuple(ids)), C.Scope.of(df))) if len(ids) <= 1000 else df.join(self.db.spark.createDataFrame([(str(i) if isinstance(i, V.DocId) else i,) for i in ids], df.select("_id").schema), "_id", "left_semi")
        return {_key(d): d for d in (document(r, df.schema) for r in few.collect())}

    def _first(self) -> Iterator[Entered]:
        if self.filter.order:
            self._members = self._whole(self._seen, self._now)
            for i, doc in enumerate(self._members):
                yield Entered(doc["_id"], self._shown(doc), i)
            return
        df = self._found(self._seen, self._now)
        for r in df.toLocalIterator():
            doc = document(r, df.schema)
            yield Entered(doc["_id"], doc)

    def _advance(self, old: int, new: int) -> Iterator[Any]:
        now = datetime.now(timezone.utc)
        before, self._now = self._now, now
        for v in range(old + 1, new + 1):
            m = self.db.manifest(v)
            dropped = self.name in m.get("dropped", [])
            if self.name not in m["changes"] and not dropped:
                continue
            ids = None
            if not dropped:
                ids = self.db.spark.read.parquet(f"{self.db.root}/{m['changes'][self.name]}").select("_id")
            yield from self._sorted(v, before, now, ids) if self.filter.order else self._unsorted(v, before, now, ids)
            before = now

    def _unsorted(self, v: int, before: datetime, now: datetime, ids: DataFrame | None) -> Iterator[Any]:
        was, found = self._found(v - 1, before), self._found(v, now)
        if ids is not None:
            was, found = was.join(ids, "_id", "left_semi"), found.join(ids, "_id", "left_semi")
        old = {_key(d): d for d in (document(r, was.schema) for r in was.toLocalIterator())}
        for r in found.orderBy("_id").toLocalIterator():
            doc = document(r, found.schema)
            yield Changed(doc["_id"], doc) if old.pop(_key(doc), None) is not None else Entered(doc["_id"], doc)
        if old:
            state = self.db.manifest(v)["collections"].get(self.name)
            left = {}
            if state is not None and ids is not None:
                df = self.db.frame(state).join(ids, "_id", "left_semi")
                left = {_key(d): d for d in (document(r, df.schema) for r in df.toLocalIterator())}
            for k, d in old.items():
                yield Left(d["_id"], left.get(k))

    def _sorted(self, v: int, before: datetime, now: datetime, ids: DataFrame | None) -> Iterator[Any]:
        written = {_text(r["_id"]) for r in ids.toLocalIterator()} if ids is not None else {_key(d) for d in self._members}
        yield from self._moved(v, now, written)

    def _moved(self, version: int, now: datetime, written: set[str]) -> Iterator[Any]:
        was, self._members = self._members, self._whole(version, now)
        there = {_key(d) for d in self._members}
        left = self._documents(version, [d["_id"] for d in was if _key(d) not in there])
        for e in reorder(was, self._members, written, self.filter.order, left):
            yield A.replace(e, doc=self._shown(e.doc))

    def _on_clock(self) -> Iterator[Any]:
        before, self._now = self._now, datetime.now(timezone.utc)
        if self.filter.order:
            yield from self._moved(self._seen, self._now, set())
            return
        # only documents that the clock moved over an edge of the filter
        df = self.db.frame(self.db.manifest(self._seen)["collections"].get(self.name))
        old, new = (C.where(A.resolve_now(self.filter, at).where, C.Scope.of(df)) for at in (before, self._now))
        holds = lambda c: F.lit(True) if c is None else F.coalesce(c, F.lit(False))
        for r in df.where(holds(old) & ~holds(new)).toLocalIterator():
            doc = self._shown(document(r, df.schema))
            yield Left(doc["_id"], doc)
        for r in df.where(holds(new) & ~holds(old)).toLocalIterator():
            doc = self._shown(document(r, df.schema))
            yield Entered(doc["_id"], doc)


def _text(x: Any) -> str:
    return str(x)


def _key(d: dict) -> str:
    return _text(d["_id"])


def reorder(was: list[dict], found: list[dict], written: set[str], orders: tuple, left: dict[str, dict]) -> Iterator[Any]:
    """Events that turn one sorted list into the other: those that left first, from the front, then
    those written or come in, in their new order.  Documents that were not written do not move.

    ``from_`` and ``at`` are places in the list as it is when the event is applied; ``left`` has the
    documents that left, as they are now.  A place is found by halving, so the cost is that of the events.
    """
    there = {_key(d) for d in found}
    place = functools.cmp_to_key(_comparison(orders))
    now: list = []
    gone = []
    for d in was:
        if _key(d) in there:
            now.append(place(d))
        else:
            # of those that left, the ones before this one are gone already
            gone.append(Left(d["_id"], left.get(_key(d)), len(now)))
    yield from gone
    old = {_key(d): place(d) for d in was if _key(d) in there}
    for d in found:
        k = _key(d)
        if k in old and k not in written:
            continue
        start = None
        if k in old:
            start = bisect.bisect_left(now, old[k])
            del now[start]
        at = bisect.bisect_left(now, place(d))
        now.insert(at, place(d))
        yield Entered(d["_id"], d, at) if start is None else Changed(d["_id"], d, start, at)


def _comparison(orders: tuple) -> Any:
    """Order of whole documents by a filter's sort; a function's number comes first where it has one."""
    if orders and isinstance(orders[0], A.Key):
        key, rest = orders[0], orders[1:]

        def compare(a: dict, b: dict) -> int:
            x, y = key.function(a), key.function(b)
            return ((x > y) - (x < y)) * (-1 if key.descending else 1) or E._less(a, b, rest)

        return compare
    return lambda a, b: E._less(a, b, orders)


class LiveAggregate(Feed):
    """An aggregate run again for each commit to its collection; its rows' changes as events."""

    def __init__(self, db: Any, name: str, f: Any, a: Any, params: dict | None = None, clock_every: float = 1.0, **options: Any):
        self.name = name
        from ..plans.parser import parse_aggregate, parse_filter

        f = parse_filter(f or "") if f is None or isinstance(f, str) else A.Filter(where=f) if isinstance(f, A.Condition) else f
        a = parse_aggregate(a) if isinstance(a, str) else a
        used: set[str] = set()
        self.filter, self.aggregate = A.bind(f, params, used), A.bind(a, params, used).check()
        if unused := set(params or {}) - used:
            raise A.BindError(f"no text uses the parameter :{sorted(unused)[0]}")
        if self.filter.offset or self.filter.limit is not None and not self.filter.order:
            raise NotLive("a live aggregate's filter takes no skip, and a limit needs a sort")
        self._rows: list[dict] = []
        super().__init__(db, clock_every=clock_every if self.filter.reads_now else None, **options)

    def _first(self) -> Iterator[Any]:
        return self._again(self._seen)

    def _advance(self, old: int, new: int) -> Iterator[Any]:
        for v in range(old + 1, new + 1):
            m = self.db.manifest(v)
            if self.name in m["changes"] or self.name in m.get("dropped", []):
                yield from self._again(v)

    def _on_clock(self) -> Iterator[Any]:
        return self._again(self._seen)

    def _run(self, version: int, a: A.Aggregate) -> list[dict]:
        df = agg.aggregate(self.db.frame(self.db.manifest(version)["collections"].get(self.name)), self.filter, a)
        return [{k: None for k in df.columns} | document(r, df.schema) for r in df.collect()]

    def _group(self, row: dict) -> Any:
        from ..plans.evaluate import one

        return tuple(V.canonical(one(row, g)) for g in self.aggregate.group)

    def _again(self, version: int) -> Iterator[Any]:
        was, found = self._rows, self._run(version, self.aggregate)
        self._rows = found
        there, old = {self._group(r) for r in found}, {self._group(r): r for r in was}
        gone = [r for r in was if self._group(r) not in there]
        whole: dict = {}
        if gone and (self.aggregate.having != A.TRUE or self.aggregate.limit is not None or self.aggregate.offset):
            # rows that only having or the limit took away are told as they are now
            free = A.replace(self.aggregate, having=A.TRUE, limit=None, offset=0)
            whole = {self._group(r): r for r in self._run(version, free)}
        now: list = []
        for r in was:
            g = self._group(r)
            if g in there:
                now.append(g)
            else:
                yield RowLeft({x.dotted: r.get(x.names[0]) for x in self.aggregate.group}, whole.get(g), len(now))
        # rows stay in their old order but for those that moved; the others stand as they should already
        for i, r in enumerate(found):
            g = self._group(r)
            if g not in old:
                now.insert(i, g)
                yield RowEntered(r, i)
                continue
            at = i if now[i] == g else now.index(g, i)
            if at != i or V.canonical(old[g]) != V.canonical(r):
                now.insert(i, now.pop(at))
                yield RowChanged(r, at, i)


__all__ = ["Changes", "LiveAggregate", "LiveQuery", "QueryError"]
