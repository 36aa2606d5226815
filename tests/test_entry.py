"""The registry, the registered queries against DuckDB, the command line, and plans."""

import glob
import math
import re

import pytest

import __spark_entry__ as entry
from docframe import queries, queries_writes
from docframe.__main__ import main
from docframe.operators.aggregate import aggregate
from docframe.operators.find import find
from docframe.queries import load
from docframe.sources.store import Database

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else f"{x:.8g}"
    if isinstance(x, bool) or x is None:
        return "null" if x is None else str(int(x))
    return str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


CORE = queries.queries() | queries_writes.queries()
SQL = queries.oracle_sql() | queries_writes.oracle_sql()


@pytest.mark.parametrize("name", list(CORE))
def test_query_equals_sql(spark, sf, duck, name):
    df = CORE[name](spark, sf)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_every_query_is_registered():
    known = entry.queries()
    assert set(CORE) <= set(known) and set(entry.oracle_sql()) <= set(known) and set(SQL) == set(CORE)


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditions_reach_the_scan(spark, sf):
    orders = load(spark, sf, "orders")
    p = plan(find(orders, 'o_orderstatus = "F" and o_totalprice >= 1000 and o_orderpriority starts with "1" and not o_custkey in (1, 2)'))
    pushed = p[p.index("PushedFilters") :]
    for part in ("EqualTo(o_orderstatus,F)", "GreaterThanOrEqual(o_totalprice,1000.0)", "StringStartsWith(o_orderpriority,1)", "Not(In(o_custkey"):
        assert part in pushed, p
    assert "PushedFilters: [" in plan(find(orders, 'o_orderpriority matches "^1-U"')) and "StringStartsWith(o_orderpriority,1-U)" in plan(find(orders, 'o_orderpriority matches "^1-U"'))


def test_a_window_bounds_the_scan(spark, sf):
    p = plan(aggregate(load(spark, sf, "events"), "", "window ts 12h count() as n group by event_type"))
    assert "GreaterThanOrEqual(ts," in p[p.index("PushedFilters") :] and "Join" not in p


def test_updates_compare_without_a_join(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    c = db.collection("c")
    c.insert([{"_id": i, "n": i, "tags": ["a"]} for i in range(5)])
    asked = []
    real = type(db.batch())._write_apart
    type(db.batch())._write_apart = lambda self, name, df, keep: (asked.append(plan(df)), real(self, name, df, keep))[1]
    try:
        assert c.update_many("n > 1", {"$max": {"n": 3}, "$addToSet": {"tags": "a"}}) == 1
    finally:
        type(db.batch())._write_apart = real
    assert "Join" not in asked[0] and "Exchange" not in asked[0]


def test_broken_modules_do_not_hide(tmp_path):
    """Without the folder the other queries are there; with a broken one the import fails."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(queries.__file__).parent.parent
    for name in ("docframe", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    whole = run()
    if (tmp_path / "docframe/llm").exists():
        (tmp_path / "docframe/llm/queries.py").write_text("import nowhere_to_be_found\n")
        assert run().returncode == 1
        shutil.rmtree(tmp_path / "docframe/llm")
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert whole.returncode == 0 and run().stdout.split()[0] == str(len(CORE))


def test_only_named_columns_are_read(spark, sf):
    p = plan(find(load(spark, sf, "orders"), "select o_custkey where o_totalprice > 5"))
    schema = p[p.index("ReadSchema") :]
    assert "o_custkey" in schema and "o_orderdate" not in schema
    assert "TakeOrderedAndProject" in plan(find(load(spark, sf, "orders"), "order by o_totalprice desc limit 5"))


def test_command_line(spark, tmp_path, capsys):
    root, said = f"file://{tmp_path}/db", []
    call = lambda *a: main(list(a), spark, said.append)
    assert call("insert", root, "c", '{"_id": 1}') == 1
    assert call("insert", root, "c", '{"_id": 1, "n": 1}', '{"_id": 2, "n": 5}', "--create") == 0
    assert call("delete", root, "c", "") == 1 and call("update", root, "c", "", '{"$set": {"n": 0}}') == 1
    assert call("update", root, "c", "n > :x", '{"$inc": {"n": 1}}', "--param", "x=3") == 0
    assert call("find", root, "c", "order by n desc limit 1") == 0
    assert call("aggregate", root, "c", "", "sum(n) as s") == 0
    assert call("count", root, "c") == 0 and call("get", root, "c", "1") == 0 and call("delete", root, "c", "n = 1") == 0
    assert said == ["1", "2", "1", '{"_id":2,"n":6}', '{"s":7}', "2", '{"_id":1,"n":1}', "1"]
    assert call("find", root, "c", "n = Ada") == 2 and "^" in capsys.readouterr().err
    assert call("find", root, "c", "n = :x") == 2 and call("find", root, "c", "n = 1 use index n") == 1
    assert call("export", root, f"{tmp_path}/e.jsonl") == 0 and call("verify", f"{tmp_path}/e.jsonl") == 0
    for text in ("info", "check", "compact"):
        assert call(text, root) == 0
    said.clear()
    (tmp_path / "ops").write_text('{"op": "insert", "collection": "c", "doc": {"_id": 7, "n": 1}}\n\n{"op": "require", "collection": "c", "filter": "n = :x"}\n')
    assert call("delete", root, "c", "", "--all", "--dry-run") == 0 and call("update", root, "c", "_id = 9", '{"$set": {"n": 3}}', "--upsert") == 0
    assert call("batch", root, f"{tmp_path}/ops", "--param", "x=8") == 1 and "line 3" in capsys.readouterr().err
    assert call("batch", root, f"{tmp_path}/ops", "--param", "x=1") == 0 and call("count", root, "c") == 0
    assert said == ["1", '{"inserted":9}', "[[7],null]", "3"]
    assert call("explain", root, "c", "n > 2", "--run", "--json") == 0 and call("aggregate", root, "c", "", "count() as k group by n", "--explain") == 0
    assert '"documents_returned": 2' in said[-2] and '"groups": 3' in said[-1]
    assert call("export", root, f"file://{tmp_path}/parts") == 0 and call("verify", f"file://{tmp_path}/parts") == 0
    assert call("import", f"file://{tmp_path}/other", f"file://{tmp_path}/parts") == 0 and said[-1] == '{"c": 3}'


def test_core_does_not_know_the_llm_folder():
    for path in glob.glob(f"{queries.__file__.rpartition('/')[0]}/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"\bllm\b", open(path).read()), path
