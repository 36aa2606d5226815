"""Registered queries of writes: states after updates, batches, snapshots and live queries."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import update as upd
from .plans import compile as C
from .plans.parser import parse_condition
from .queries import Query, baskets, load, nullable_orders
from .sources import dynamic, jsonl
from .sources.store import Database
from .streaming import live as L

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared scratch folder; a local session may lack one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docframe-")
    return f"{root.rstrip('/')}/docframe-db/{uuid.uuid4().hex}"


def _hit(df: DataFrame, text: str) -> Column:
    return F.coalesce(C.col(C.compile_condition(parse_condition(text), C.Scope.of(df))), F.lit(False))


def _updated(name: str, source: Query, where: str, spec: dict, columns: list[str], sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = source(spark, sf)
        return upd.columns(df, upd.Update.of(spec), _hit(df, where)).selectExpr(*columns)

    _QUERIES[name], _SQL[name] = run, sql


_O = "(SELECT o_orderkey AS _id, o_custkey, o_totalprice, o_orderpriority, nullif(o_orderstatus, 'F') AS status, CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS price FROM orders)"
_B = "(SELECT event_id AS _id, user_id, [{'sku': event_type, 'qty': CAST(floor(value % 7) AS BIGINT)}, {'sku': 'gift', 'qty': CAST(event_id % 3 AS BIGINT)}] AS items FROM events WHERE user_id IS NOT NULL)"
_updated("update_set", nullable_orders, "status is null", {"$set": {"status": "done", "seen": True}}, ["_id", "status", "seen"], f"SELECT _id, coalesce(status, 'done') AS status, CASE WHEN status IS NULL THEN true END AS seen FROM {_O}")
_updated("update_unset", nullable_orders, 'status = "O"', {"$unset": {"price": 1}}, ["_id", "price"], f"SELECT _id, CASE WHEN status IS DISTINCT FROM 'O' THEN price END AS price FROM {_O}")
_updated("update_inc", nullable_orders, "o_custkey > 50", {"$inc": {"o_custkey": 3, "hits": 1, "price": 0.5}}, ["_id", "o_custkey", "hits", "price"], f"SELECT _id, o_custkey + CASE WHEN o_custkey > 50 THEN 3 ELSE 0 END AS o_custkey, CASE WHEN o_custkey > 50 THEN 1::BIGINT END AS hits, CASE WHEN o_custkey > 50 THEN coalesce(price + 0.5, 0.5) ELSE price END AS price FROM {_O}")
_updated("update_mul", nullable_orders, 'status = "P"', {"$mul": {"o_custkey": 2, "none": 5}}, ["_id", "o_custkey", "none"], f"SELECT _id, CASE WHEN status = 'P' THEN o_custkey * 2 ELSE o_custkey END AS o_custkey, CASE WHEN status = 'P' THEN 0::BIGINT END AS none FROM {_O}")
_updated("update_min_max", nullable_orders, "true", {"$min": {"price": 100000.0}, "$max": {"o_custkey": 40}}, ["_id", "price", "o_custkey"], f"SELECT _id, least(coalesce(price, 100000.0), 100000.0) AS price, greatest(o_custkey, 40) AS o_custkey FROM {_O}")
_updated("update_rename", nullable_orders, "true", {"$rename": {"o_orderpriority": "urgency"}}, ["_id", "urgency", "o_orderpriority"], f"SELECT _id, o_orderpriority AS urgency, NULL::VARCHAR AS o_orderpriority FROM {_O}")
_updated("update_push", baskets, "_id < 500", {"$push": {"items": {"sku": "extra", "qty": 1}}}, ["_id", "size(items) AS n", "items[size(items) - 1].sku AS last"], f"SELECT _id, (2 + CASE WHEN _id < 500 THEN 1 ELSE 0 END)::INTEGER AS n, CASE WHEN _id < 500 THEN 'extra' ELSE 'gift' END AS last FROM {_B}")
_updated("update_add_to_set", baskets, "true", {"$addToSet": {"items": {"sku": "gift", "qty": 2}}}, ["_id", "size(items) AS n"], f"SELECT _id, (2 + CASE WHEN len(list_filter(items, lambda x: x.sku = 'gift' AND x.qty = 2)) = 0 THEN 1 ELSE 0 END)::INTEGER AS n FROM {_B}")
_updated("update_pull", baskets, "true", {"$pull": {"items": {"sku": "gift", "qty": 0}}}, ["_id", "size(items) AS n"], f"SELECT _id, len(list_filter(items, lambda x: NOT (x.sku = 'gift' AND x.qty = 0)))::INTEGER AS n FROM {_B}")
_updated("update_pop", baskets, "user_id < 20", {"$pop": {"items": -1}}, ["_id", "items[0].sku AS first"], f"SELECT _id, CASE WHEN user_id < 20 THEN 'gift' ELSE items[1].sku END AS first FROM {_B}")


def _stored(spark: SparkSession, sf: str, table: str) -> tuple[Database, Any]:
    db = Database(spark, scratch(spark))
    return db, db.register(table, load(spark, sf, table))


def delete_many(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _stored(spark, sf, "customer")
    c.delete_many("c_acctbal < 0 or c_nationkey in (1, 2)")
    return c.frame("select c_name")


def batch(spark: SparkSession, sf: str) -> DataFrame:
    db, c = _stored(spark, sf, "customer")
    db.batch().require("customer", "c_nationkey = 3").update("customer", "c_nationkey = 3", {"$inc": {"c_acctbal": 1.0}, "$set": {"vip": True}}).delete("customer", "c_nationkey = 4").insert("customer", {"_id": -1, "c_name": "new", "c_acctbal": 0.0, "c_nationkey": 99}).commit()
    return c.frame("select c_acctbal, vip")


def upsert(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _stored(spark, sf, "nation")
    c.upsert_fields("_id = 3", {"$set": {"n_name": "three"}})
    c.upsert_fields("_id = 777", {"$set": {"n_name": "made"}, "$setOnInsert": {"n_regionkey": 9}})
    return c.frame("select n_name, n_regionkey")


def snapshot_read(spark: SparkSession, sf: str) -> DataFrame:
    db, c = _stored(spark, sf, "supplier")
    before = db.snapshot()
    c.delete_many("s_nationkey < 20")
    return before.collection("supplier").frame("select s_name where s_acctbal > 5000")


def update_by_function(spark: SparkSession, sf: str) -> DataFrame:
    _, c = _stored(spark, sf, "supplier")
    c.update_many("s_nationkey = 7", lambda d: {**d, "s_name": d["s_name"].upper()})
    return c.frame("select s_name")


def _commits(spark: SparkSession, sf: str) -> tuple[Database, Any, list]:
    db, c = _stored(spark, sf, "customer")
    steps = [lambda: c.update_many("c_nationkey = 5", {"$inc": {"c_acctbal": 1000.0}}), lambda: c.delete_many("c_nationkey = 6"), lambda: c.insert({"_id": -5, "c_name": "late", "c_acctbal": 9999.5, "c_nationkey": 5, "c_mktsegment": "BUILDING"})]
    return db, c, steps


def live_filter_final(spark: SparkSession, sf: str) -> DataFrame:
    """The set that the events of a live query build up, after three commits."""
    _, c, steps = _commits(spark, sf)
    now: dict = {}
    with c.watch("c_acctbal > 9000") as feed:
        for step in [lambda: None, *steps]:
            step()
            for e in feed.drain():
                if isinstance(e, L.Left):
                    del now[e.id]
                else:
                    now[e.id] = e.doc["c_acctbal"]
    return spark.createDataFrame(list(now.items()), "_id long, c_acctbal double")


def live_sorted_final(spark: SparkSession, sf: str) -> DataFrame:
    _, c, steps = _commits(spark, sf)
    now: list = []
    with c.watch("order by c_acctbal desc limit 12") as feed:
        for step in [lambda: None, *steps]:
            step()
            for e in feed.drain():
                if not isinstance(e, L.Entered):
                    now.pop(e.from_)
                if not isinstance(e, L.Left):
                    now.insert(e.at, (e.id, e.doc["c_acctbal"]))
    return spark.createDataFrame([(i, *x) for i, x in enumerate(now)], "place long, _id long, c_acctbal double")


def live_filter_events(spark: SparkSession, sf: str) -> DataFrame:
    """What a live query tells of each commit."""
    _, c, steps = _commits(spark, sf)
    rows = []
    with c.watch("c_acctbal > 9000") as feed:
        feed.drain()
        for n, step in enumerate(steps):
            step()
            rows += [(n, type(e).__name__, e.id) for e in feed.drain()]
    return spark.createDataFrame(rows, "step int, event string, _id long")


def live_sorted_events(spark: SparkSession, sf: str) -> DataFrame:
    """What a sorted live query tells of each commit, with the places."""
    _, c = _stored(spark, sf, "customer")
    low = c.find_one("c_nationkey = 5 order by _id limit 1")["_id"]
    steps = [lambda: c.update_many("_id = :i", {"$inc": {"c_acctbal": 100000.0}}, {"i": low}), lambda: c.delete_many("c_nationkey = 6"), lambda: c.insert({"_id": -5, "c_name": "late", "c_acctbal": 20.0, "c_nationkey": 5})]
    rows = []
    with c.watch("c_nationkey in (5, 6) order by c_acctbal desc") as feed:
        feed.drain()
        for n, step in enumerate(steps):
            step()
            rows += [(n, type(e).__name__, e.id, getattr(e, "from_", None), getattr(e, "at", None), None if e.doc is None else e.doc["c_acctbal"]) for e in feed.drain()]
    return spark.createDataFrame(rows, "step int, event string, _id long, was int, at int, c_acctbal double")


def update_odd_names(spark: SparkSession, sf: str) -> DataFrame:
    """Updates and deletes in collections of any name."""
    db, out = Database(spark, scratch(spark)), None
    for name in ("data", "my tasks", "a%b", "_x/{y}*"):
        c = db.register(name, load(spark, sf, "nation"))
        c.update_many("n_regionkey = 1", {"$set": {"n_name": "one"}})
        c.delete_many("n_regionkey = 2")
        rows = c.frame("select n_name").withColumn("collection", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def live_aggregate_final(spark: SparkSession, sf: str) -> DataFrame:
    _, c, steps = _commits(spark, sf)
    now: dict = {}
    with c.watch_aggregate("", "count() as n, max(c_acctbal) as top group by c_nationkey having n > 2") as feed:
        for step in [lambda: None, *steps]:
            step()
            for e in feed.drain():
                if isinstance(e, L.RowLeft):
                    del now[e.group["c_nationkey"]]
                else:
                    now[e.row["c_nationkey"]] = (e.row["n"], e.row["top"])
    return spark.createDataFrame([(k, *v) for k, v in now.items()], "c_nationkey int, n long, top double")


def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    db, c, steps = _commits(spark, sf)
    with db.subscribe() as feed:
        for step in steps:
            step()
        rows = [(x.version, x.changes[0].collection, e.id, e.op) for x in feed.drain() for e in x.changes]
    return spark.createDataFrame(rows, "version long, collection string, id long, op string").groupBy("version", "op").agg(F.count("*").alias("n"))


def dynamic_find(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select(F.col("event_id").cast("string").alias("_id"), F.concat(F.lit('{"_id":'), "event_id", F.lit(',"kind":"'), "event_type", F.lit('","props":'), "props", F.lit("}")).alias("doc"))
    found = dynamic.find(events, 'kind = "click" and props.k >= 90 order by props.k desc, _id limit 40')
    return found.select(F.col("_id").cast("long").alias("_id"))


def dynamic_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select(F.col("event_id").cast("string").alias("_id"), F.concat(F.lit('{"_id":'), "event_id", F.lit(',"kind":"'), "event_type", F.lit('","props":'), "props", F.lit("}")).alias("doc"))
    rows = dynamic.aggregate(events, "", "count() as n, sum(props.k) as s, max(props.k) as top, count(distinct props.k) as d group by kind")
    return rows.select(F.from_json("row", "kind string, n long, s long, top long, d long").alias("r")).select("r.*")


def dynamic_fields(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events").select(F.col("event_id").cast("string").alias("_id"), F.concat(F.lit('{"_id":'), "event_id", F.lit(',"props":'), "props", F.lit("}")).alias("doc"))
    return dynamic.fields(events)


def export_import(spark: SparkSession, sf: str) -> DataFrame:
    """A collection written as JSON lines and restored into another database."""
    db, _ = _stored(spark, sf, "supplier")
    other = Database(spark, scratch(spark))
    jsonl.load(other, jsonl.lines(db))
    return other.collection("supplier").frame("select s_name, s_acctbal")


def compacted(spark: SparkSession, sf: str) -> DataFrame:
    db, c = _stored(spark, sf, "nation")
    c.delete_many("n_regionkey = 2")
    c.insert({"_id": 500, "n_name": "late", "n_regionkey": 0})
    db.compact()
    return c.frame("select n_name")


for _f in (export_import, compacted, delete_many, batch, upsert, snapshot_read, update_by_function, update_odd_names, live_filter_events, live_sorted_events, live_filter_final, live_sorted_final, live_aggregate_final, change_feed, dynamic_find, dynamic_aggregate, dynamic_fields):
    _QUERIES[_f.__name__] = _f
_LATE = "SELECT c_custkey AS _id, c_nationkey, c_acctbal + CASE WHEN c_nationkey = 5 THEN 1000.0 ELSE 0 END AS c_acctbal FROM customer WHERE c_nationkey <> 6 UNION ALL SELECT -5, 5, 9999.5"
_FIVE_SIX = "SELECT c_custkey AS _id, c_nationkey, c_acctbal + CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 5) THEN 100000.0 ELSE 0 END AS now, c_acctbal AS was FROM customer WHERE c_nationkey IN (5, 6)"
_SQL |= {
    "update_odd_names": "SELECT n_nationkey AS _id, CASE WHEN n_regionkey = 1 THEN 'one' ELSE n_name END AS n_name, collection FROM nation, (SELECT unnest(['data', 'my tasks', 'a%b', '_x/{y}*']) AS collection) WHERE n_regionkey <> 2",
    "live_filter_events": "SELECT 0 AS step, CASE WHEN c_acctbal > 9000 THEN 'Changed' ELSE 'Entered' END AS event, c_custkey AS _id FROM customer WHERE c_nationkey = 5 AND c_acctbal + 1000 > 9000 UNION ALL SELECT 1, 'Left', c_custkey FROM customer WHERE c_nationkey = 6 AND c_acctbal > 9000 UNION ALL SELECT 2, 'Entered', -5",
    "live_sorted_events": f"""
WITH t AS ({_FIVE_SIX}),
b AS (SELECT *, row_number() OVER (ORDER BY was DESC, _id) - 1 AS before, row_number() OVER (ORDER BY now DESC, _id) - 1 AS behind FROM t)
SELECT 0 AS step, 'Changed' AS event, _id, before::INTEGER AS was, behind::INTEGER AS at, now AS c_acctbal FROM b WHERE now <> was
UNION ALL
SELECT 1, 'Left', _id, (SELECT count(*) FROM b x WHERE x.c_nationkey = 5 AND x.behind < b.behind)::INTEGER, NULL, NULL FROM b WHERE c_nationkey = 6
UNION ALL
SELECT 2, 'Entered', -5, NULL, (SELECT count(*) FROM b WHERE c_nationkey = 5 AND now > 20.0)::INTEGER, 20.0""",
    "export_import": "SELECT s_suppkey AS _id, s_name, s_acctbal FROM supplier",
    "compacted": "SELECT n_nationkey AS _id, n_name FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 500, 'late'",
    "delete_many": "SELECT c_custkey AS _id, c_name FROM customer WHERE NOT (c_acctbal < 0 OR c_nationkey IN (1, 2))",
    "batch": "SELECT c_custkey AS _id, c_acctbal + CASE WHEN c_nationkey = 3 THEN 1.0 ELSE 0 END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN true END AS vip FROM customer WHERE c_nationkey <> 4 UNION ALL SELECT -1, 0.0, NULL",
    "upsert": "SELECT n_nationkey AS _id, CASE WHEN n_nationkey = 3 THEN 'three' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 777, 'made', 9",
    "snapshot_read": "SELECT s_suppkey AS _id, s_name FROM supplier WHERE s_acctbal > 5000",
    "update_by_function": "SELECT s_suppkey AS _id, CASE WHEN s_nationkey = 7 THEN upper(s_name) ELSE s_name END AS s_name FROM supplier",
    "live_filter_final": f"SELECT _id, c_acctbal FROM ({_LATE}) WHERE c_acctbal > 9000",
    "live_sorted_final": f"SELECT row_number() OVER (ORDER BY c_acctbal DESC, _id) - 1 AS place, _id, c_acctbal FROM ({_LATE}) ORDER BY place LIMIT 12",
    "live_aggregate_final": f"SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS top FROM ({_LATE}) GROUP BY 1 HAVING count(*) > 2",
    "change_feed": "SELECT 2::BIGINT AS version, 'updated' AS op, count(*) AS n FROM customer WHERE c_nationkey = 5 UNION ALL SELECT 3, 'deleted', count(*) FROM customer WHERE c_nationkey = 6 UNION ALL SELECT 4, 'inserted', 1",
    "dynamic_find": "SELECT event_id AS _id FROM events WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS BIGINT) >= 90 ORDER BY CAST(json_extract(props, '$.k') AS BIGINT) DESC, event_id LIMIT 40",
    "dynamic_aggregate": "SELECT event_type AS kind, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS s, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS top, count(DISTINCT json_extract(props, '$.k')) AS d FROM events GROUP BY 1",
    "dynamic_fields": "SELECT * FROM (SELECT '_id' AS path, 'int' AS kind, count(*) AS documents FROM events UNION ALL SELECT 'props', 'object', count(*) FROM events UNION ALL SELECT 'props.k', 'int', count(*) FROM events)",
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
