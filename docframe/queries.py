"""Registered queries: one for each operator, with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.aggregate import aggregate
from .operators.find import count, find
from .plans import ast as A

#: The column that is a table's _id.
IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a collection: its key is also _id."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "conversations":
        return df.withColumn("_id", F.format_string("%010d-%06d", "conv_id", "turn"))
    return df.withColumn("_id", F.col(IDS[name])) if name in IDS else df


def nullable_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls in them: status F and prices below 50,000 are null."""
    return load(spark, sf_dir, "orders").withColumns({"status": F.nullif("o_orderstatus", F.lit("F")), "price": F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice"))})


def nested_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "customer")
    return df.select("_id", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("at")).alias("who"), F.struct(F.col("c_acctbal").alias("balance")).alias("money"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user with an array of structs: the last digits of the value, and the type."""
    df = load(spark, sf_dir, "events").where("user_id is not null")
    return df.select("_id", "user_id", F.array(F.struct(F.col("event_type").alias("sku"), F.floor(F.col("value") % 7).cast("long").alias("qty")), F.struct(F.lit("gift").alias("sku"), (F.col("_id") % 3).cast("long").alias("qty"))).alias("items"))


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_NULLABLE = "(SELECT o_orderkey AS _id, o_totalprice, nullif(o_orderstatus, 'F') AS status, CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS price, o_orderpriority FROM orders)"
_BASKETS = "(SELECT event_id AS _id, user_id, [{'sku': event_type, 'qty': CAST(floor(value % 7) AS BIGINT)}, {'sku': 'gift', 'qty': CAST(event_id % 3 AS BIGINT)}] AS items FROM events WHERE user_id IS NOT NULL)"


def _found(name: str, table: str | Query, text: str | A.Filter, sql: str, columns: str = "_id", now: datetime | None = None, params: dict | None = None) -> None:
    source = table if callable(table) else lambda spark, sf, t=table: load(spark, sf, t)
    _QUERIES[name] = lambda spark, sf: find(source(spark, sf), text, params, now).select(*columns.split(", "))
    _SQL[name] = sql


def _summed(name: str, table: str | Query, filter_: str, text: str, sql: str, rounded: str = "", now: datetime | None = None, flat: list[str] | None = None) -> None:
    source = table if callable(table) else lambda spark, sf, t=table: load(spark, sf, t)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = aggregate(source(spark, sf), filter_, text, None, now)
        for c in rounded.split():
            df = df.withColumn(c, F.round(c, 2))
        return df if flat is None else df.selectExpr(*flat)

    _QUERIES[name], _SQL[name] = run, sql


def _orders(where: str) -> str:
    return f"SELECT o_orderkey AS _id FROM orders WHERE {where}"


def _nulls(where: str) -> str:
    return f"SELECT _id FROM {_NULLABLE} WHERE {where}"


_found("find_flagship", "orders", 'o_orderstatus = "F" and o_totalprice >= 1000 order by o_totalprice desc limit 10', "SELECT o_orderkey AS _id, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "_id, o_totalprice")
_found("eq", nullable_orders, 'status = "O"', _nulls("status = 'O'"))
_found("ne", nullable_orders, 'status != "O"', _nulls("status IS DISTINCT FROM 'O'"))
_found("lt", nullable_orders, "price < 90000.5", _nulls("price < 90000.5"))
_found("lte", nullable_orders, "price <= 90000", _nulls("price <= 90000"))
_found("gt", nullable_orders, "price > 400000", _nulls("price > 400000"))
_found("gte", nullable_orders, "price >= 400000", _nulls("price >= 400000"))
_found("compare_null", nullable_orders, "price <= null and status != null", _nulls("price IS NULL AND status IS NOT NULL"))
_found("not_is_two_valued", nullable_orders, 'not (price > 90000 or status = "O")', _nulls("NOT (coalesce(price > 90000, false) OR coalesce(status = 'O', false))"))
_found("kinds_apart", nullable_orders, 'price != "x" and not status < 5', _nulls("true"))
_found("int_vs_float", "orders", "_id >= 10.5 and _id < 99.5", _orders("o_orderkey >= 11 AND o_orderkey <= 99"))
_found("contains_fold", "part", 'p_name contains "RED"', "SELECT p_partkey AS _id FROM part WHERE contains(lower(p_name), 'red')")
_found("starts_with", "orders", 'o_orderpriority starts with "1"', _orders("starts_with(o_orderpriority, '1')"))
_found("regex", "part", 'p_name matches "(blue|red)\\\\s+w"', "SELECT p_partkey AS _id FROM part WHERE regexp_matches(p_name, '(blue|red)\\s+w')")
_found("regex_prefix", "orders", 'o_orderpriority matches "^1-U"', _orders("starts_with(o_orderpriority, '1-U')"))
_found("in_list", nullable_orders, 'status in ("O", "P", null)', _nulls("status IN ('O', 'P') OR status IS NULL"))
_found("not_in", nullable_orders, 'status not in ("O", "x")', _nulls("status IS NULL OR status NOT IN ('O', 'x')"))
_found("is_null", nullable_orders, "price is null", _nulls("price IS NULL"))
_found("not_null", nullable_orders, "price is not null", _nulls("price IS NOT NULL"))
_found("exists", nullable_orders, "exists(status) and not exists(nowhere)", _nulls("true"))
_found("is_kind", nullable_orders, "price is number and status is string and o_orderdate is datetime and price is not int", _nulls("price IS NOT NULL AND status IS NOT NULL"))
_found("and_or_not", nullable_orders, '(status = "O" or price < 60000) and not o_orderpriority starts with "5"', _nulls("(coalesce(status = 'O', false) OR coalesce(price < 60000, false)) AND NOT starts_with(o_orderpriority, '5')"))
_found("true_false", "nation", "true and not false", "SELECT n_nationkey AS _id FROM nation")
_found("id_lookup", "orders", "_id = 77", _orders("o_orderkey = 77"))
_found("id_in", "orders", "_id in (1, 2, 3.0, 4.5)", _orders("o_orderkey IN (1, 2, 3)"))
_found("parameters", nullable_orders, "status in :s and price >= :p", _nulls("status IN ('O', 'P') AND price >= 300000"), params={"s": ["O", "P"], "p": 300000})
_found("array_any", "embeddings", "embedding[*] > 0.4", "SELECT vec_id AS _id FROM embeddings WHERE len(list_filter(embedding, lambda x: x::DOUBLE > 0.4)) > 0")
_found("array_none", baskets, 'items[*].sku != "click"', f"SELECT _id FROM {_BASKETS} WHERE len(list_filter(items, lambda x: x.sku = 'click')) = 0")
_found("array_size", "embeddings", "size(embedding) = 64 and size(label) != 3", "SELECT vec_id AS _id FROM embeddings WHERE len(embedding) = 64")
_found("elem_match", baskets, 'items has (sku = "gift" and qty > 1)', f"SELECT _id FROM {_BASKETS} WHERE len(list_filter(items, lambda x: x.sku = 'gift' AND x.qty > 1)) > 0")
_found("elem_match_self", "embeddings", "embedding has (@ > 0.25 and @ < 0.26)", "SELECT vec_id AS _id FROM embeddings WHERE len(list_filter(embedding, lambda x: x::DOUBLE > 0.25 AND x::DOUBLE < 0.26)) > 0")
_found("object_equality", nested_customers, 'who.at = {"segment": "BUILDING", "nation": 3.0}', "SELECT c_custkey AS _id FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
_found("datetime_range", "events", 'ts >= datetime("2024-01-02T00:00:00Z") and ts < datetime("2024-01-03T02:00:00+02:00")', "SELECT event_id AS _id FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03'")
_found("now_resolved", "events", "ts >= now - 36h and ts < now", "SELECT event_id AS _id FROM events WHERE ts >= TIMESTAMP '2024-01-03 12:00:00' AND ts < TIMESTAMP '2024-01-05'", now=datetime(2024, 1, 5, tzinfo=timezone.utc))
_found("custom_condition", "orders", A.Filter().custom(["o_orderkey", "o_orderstatus"], lambda d: d["o_orderstatus"] == "P" and d["o_orderkey"] % 5 == 0), _orders("o_orderstatus = 'P' AND o_orderkey % 5 = 0"))
_found("select", "customer", "select c_name, nowhere where c_nationkey = 4", "SELECT c_custkey AS _id, c_name FROM customer WHERE c_nationkey = 4", "*")
_found("except", "nation", "except n_name where n_regionkey = 1", "SELECT n_nationkey, n_regionkey, n_nationkey AS _id FROM nation WHERE n_regionkey = 1", "*")
_found("nested_select", nested_customers, "select who.at.segment where money.balance > 9000", "SELECT c_custkey AS _id, c_mktsegment AS segment FROM customer WHERE c_acctbal > 9000", "_id, who.at.segment")
_found("nested_except", nested_customers, "except who.at.segment where who.at.nation = 7", "SELECT c_custkey AS _id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer WHERE c_nationkey = 7", "_id, who.name, who.at.nation, money.balance")
_found("sort_multi", nullable_orders, "order by status desc, price limit 50", f"SELECT _id, status, price FROM {_NULLABLE} ORDER BY status DESC NULLS LAST, price ASC NULLS FIRST, _id LIMIT 50", "_id, status, price")
_found("top_k", "events", "order by value desc limit 25", "SELECT event_id AS _id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 25", "_id, value")
_found("skip_limit", "part", "order by p_size, p_name desc limit 10 offset 20", "SELECT p_partkey AS _id FROM part ORDER BY p_size NULLS FIRST, p_name DESC, p_partkey LIMIT 10 OFFSET 20")
_found("key_sort", "part", A.Filter().sort_by_key(lambda d: None if d["p_size"] % 2 else float(d["p_size"] * 7 % 11)).first(15), "SELECT p_partkey AS _id FROM part WHERE p_size % 2 = 0 ORDER BY p_size * 7 % 11, p_partkey LIMIT 15")
_found("index_order_walk", "orders", 'o_orderstatus = "P" order by _id limit 20 use index _id', _orders("o_orderstatus = 'P'") + " ORDER BY o_orderkey LIMIT 20")
_found("find_one", "customer", 'c_mktsegment = "BUILDING" order by _id limit 1', "SELECT c_custkey AS _id FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")
_found("json_path", lambda s, d: load(s, d, "events").select("_id", F.from_json("props", "k bigint").alias("props")), "props.k > 95", "SELECT event_id AS _id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 95")

_summed("group_count", "orders", "", "count() as n group by o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
_summed("count_distinct", "lineitem", "", "count(distinct l_suppkey) as n group by l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2")
_summed("sum_avg", "lineitem", "l_quantity <= 40", "sum(l_quantity) as q, sum(l_linenumber) as lines, avg(l_discount) as d group by l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, sum(l_linenumber)::BIGINT AS lines, round(avg(l_discount), 2) AS d FROM lineitem WHERE l_quantity <= 40 GROUP BY 1, 2", "q d")
_summed("min_max", nullable_orders, "", "min(price) as low, max(status) as high, min(o_orderdate) as first group by o_orderpriority", f"SELECT o_orderpriority, min(CASE WHEN o_totalprice >= 50000 THEN o_totalprice END) AS low, max(nullif(o_orderstatus, 'F')) AS high, min(o_orderdate) AS first FROM orders GROUP BY 1")
_summed("first_last", "orders", "", "first(o_totalprice) as a, last(o_totalprice) as b group by o_orderstatus", "SELECT o_orderstatus, arg_min(o_totalprice, o_orderkey) AS a, arg_max(o_totalprice, o_orderkey) AS b FROM orders GROUP BY 1")
_summed("first_last_by", "events", "", "last(value order by ts) as newest, first(event_id order by value) as least group by user_id", "SELECT user_id, arg_max(value, {'t': ts, 'i': event_id}) AS newest, arg_min(event_id, {'v': value, 'i': event_id}) AS least FROM events GROUP BY 1")
_summed("filter_column", nullable_orders, "", 'count() filter (where status = "O") as o, sum(price) filter (where price > 400000) as big, avg(price) filter (where status is null) as m group by o_orderpriority', f"SELECT o_orderpriority, count(*) FILTER (WHERE status = 'O') AS o, round(coalesce(sum(price) FILTER (WHERE price > 400000), 0), 2) AS big, round(avg(price) FILTER (WHERE status IS NULL), 2) AS m FROM {_NULLABLE} GROUP BY 1", "big m")
_summed("having", "orders", "", "count() as n, max(o_totalprice) as top group by o_custkey having n > 14 and top < 480000", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) > 14 AND max(o_totalprice) < 480000")
_summed("row_sort_limit", "orders", "", "count() as n group by o_custkey order by n desc limit 10 offset 5", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10 OFFSET 5")
_summed("no_group", "orders", '_id < 0', "count() as n, sum(o_totalprice) as s, avg(o_totalprice) as m", "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS s, NULL::DOUBLE AS m")
_summed("unwind", baskets, "", "unwind items count() as n, sum(items.qty) as q group by items.sku", f"SELECT i.sku, count(*) AS n, sum(i.qty)::BIGINT AS q FROM (SELECT unnest(items) AS i FROM {_BASKETS}) GROUP BY i.sku", flat=["items.sku", "n", "q"])
_summed("window_all", "events", "", "window ts 12h count() as n, sum(value) as s group by event_type", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS s FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR GROUP BY 1", "s")
_summed("window_per_group_time", "events", "", "window ts 90m per group count() as n, min(ts) as since group by user_id", "SELECT user_id, count(*) AS n, min(ts) AS since FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS newest FROM events) WHERE ts >= newest - INTERVAL 90 MINUTE GROUP BY 1")
_summed("newest_per_group", "events", "", "window ts 5 per group count() as n, avg(value) as m group by user_id", "SELECT user_id, count(*) AS n, round(avg(value), 2) AS m FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5 GROUP BY 1", "m")
_summed("pricing_summary", "lineitem", 'l_shipdate <= datetime("1998-09-02T00:00:00Z")', "sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_price, avg(l_quantity) as avg_qty, avg(l_extendedprice) as avg_price, avg(l_discount) as avg_disc, count() as n group by l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_quantity), 2) AS avg_qty, round(avg(l_extendedprice), 2) AS avg_price, round(avg(l_discount), 2) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2", "sum_qty sum_price avg_qty avg_price avg_disc")


def odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with line ends in a text, nulls in an integer, and very large numbers."""
    df = load(spark, sf_dir, "orders")
    text = F.concat(F.lit("a"), F.element_at(F.array(*[F.lit(x) for x in ("", "\n", "\r", "\r\nb", "\nb")]), (F.col("_id") % 5 + 1).cast("int")))
    return df.select("_id", "o_orderstatus", text.alias("line"), F.when(F.col("_id") % 3 != 0, F.col("o_custkey")).alias("n"), F.lit(2.0**1023).alias("huge"))


def clashing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with columns of the names that operators like for their own."""
    df = load(spark, sf_dir, "events")
    names = ("_nth", "_newest", "newest", "_g0", "_k0", "_pos", "_pos0", "_element", "_sort_key", "_rows", "_group0", "_chosen", "_renamed", "_hit", "_keep")
    return df.withColumns({n: F.concat(F.lit("x"), F.col("_id") % 2) for n in names}).withColumn("items", F.array(F.col("_id"), -F.col("_id")))


_ODD = "(SELECT o_orderkey AS _id, o_orderstatus, 'a' || CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN chr(10) WHEN 2 THEN chr(13) WHEN 3 THEN chr(13) || chr(10) || 'b' ELSE chr(10) || 'b' END AS line, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS n, 8.98846567431158e307::DOUBLE AS huge FROM orders)"
_found("custom_null", odd_values, A.Filter().custom(["n", "line"], lambda d: d["n"] is None or d["n"] % 10 == 0 and isinstance(d["n"], int)), f"SELECT _id FROM {_ODD} WHERE n IS NULL OR n % 10 = 0")
_found("key_sort_null", odd_values, A.Filter().sort_by_key(lambda d: -1.0 if d["n"] is None else float(d["n"])).first(400), f"SELECT _id FROM {_ODD} ORDER BY coalesce(n, -1), _id LIMIT 400")
_found("regex_line_ends", odd_values, 'line matches "^a$" or line matches "a.b?$" or line matches "(?m)^b$" and not line matches "(?m)a$"', f"SELECT _id FROM {_ODD} WHERE _id % 5 IN (0, 2, 3)")
_summed("avg_large", odd_values, "", "avg(huge) as m, max(huge) as top, avg(n) as k group by o_orderstatus", f"SELECT o_orderstatus, avg(huge / 4294967296) * 4294967296 AS m, max(huge) AS top, round(avg(n), 2) AS k FROM {_ODD} GROUP BY 1", "k")
_summed("clashing_names", clashing_events, "", "window ts 3 per group unwind items count() as n, sum(items) as s group by _nth, _pos0", "SELECT 'x' || (event_id % 2) AS _nth, 'x' || (event_id % 2) AS _pos0, 2 * count(*) AS n, 0::BIGINT AS s FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 2 ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 3 GROUP BY 1, 2")
_summed("clashing_window", clashing_events, "", "window ts 90m per group count() as n, min(_rows) as r group by user_id, newest", "SELECT user_id, 'x' || (event_id % 2) AS newest, count(*) AS n, min('x' || (event_id % 2)) AS r FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, event_id % 2) AS late FROM events) WHERE ts >= late - INTERVAL 90 MINUTE GROUP BY 1, 2")


def _count(spark: SparkSession, sf: str) -> DataFrame:
    n = count(load(spark, sf, "orders"), 'o_orderstatus = "O" offset 7')
    return spark.createDataFrame([(n,)], "n long")


_QUERIES["count"] = _count
_SQL["count"] = "SELECT greatest(count(*) - 7, 0) AS n FROM orders WHERE o_orderstatus = 'O'"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
