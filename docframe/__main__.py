"""Command line: python -m docframe COMMAND ROOT ...

  info|check|compact ROOT                     about the database
  export ROOT FILE, import ROOT FILE, verify FILE
  find|count|fields|explain ROOT COLLECTION [FILTER]
  get ROOT COLLECTION ID
  aggregate ROOT COLLECTION FILTER AGGREGATE [--explain]
  watch ROOT COLLECTION [FILTER] [--aggregate AGGREGATE]
                                              events as JSON lines, until stopped
  insert ROOT COLLECTION DOCUMENT...          documents as JSON; - reads lines; --create makes the collection
  update ROOT COLLECTION FILTER UPDATE        operators as JSON; --upsert, --dry-run, --all
  delete ROOT COLLECTION FILTER               --dry-run, --all
  batch ROOT FILE                             operations as JSON lines; - reads lines; --dry-run
  index ROOT COLLECTION FIELD... [--unique], drop ROOT COLLECTION

Export and import take a file, or with a URI a folder that executors write and read.  An update or
delete without conditions needs --all; --dry-run tells what would be done.  --run explains a query
that is run, --json gives reports as one JSON object.  --param name=value gives a parameter of the
texts.  Errors end with exit code 1, texts that don't read with 2 and a mark under the place.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from typing import Any

from .errors import BindError, DocframeError, ParseError
from .functions import codec
from .operators.update import Update
from .plans.ast import Filter
from .plans.parser import parse_filter, parse_param
from .sources import jsonl
from .sources.store import Database

COMMANDS = ("info", "check", "compact", "export", "import", "verify", "find", "count", "fields", "explain", "get", "aggregate", "watch", "insert", "update", "delete", "batch", "index", "drop")


def session() -> Any:
    from pyspark.sql import SparkSession

    out = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out


def event(e: Any) -> str:
    return codec.dumps({"event": type(e).__name__, **{k: v for k, v in asdict(e).items() if v is not None}})


def _lines(name: str) -> Any:
    return sys.stdin if name == "-" else jsonl.open_lines(name)


def _everything(args: argparse.Namespace, text: str) -> None:
    if not args.all and parse_filter(text) == Filter():
        raise DocframeError(f"{args.command} without conditions takes every document; --all says so")


def run(args: argparse.Namespace, spark: Any, out: Any = print) -> None:
    params = {}
    for p in args.param:
        name, given, value = p.partition("=")
        if not given or name in params:
            raise BindError(f"--param takes name=value, once for a name: {p!r}")
        params[name] = parse_param(value)
    command, rest = args.command, args.rest
    need = lambda n: rest if len(rest) >= n else sys.exit(f"{command} needs {n} arguments after the database")
    if command == "verify":
        from .queries_writes import scratch

        out(json.dumps(jsonl.verify(spark, args.root, scratch(spark))))
        return
    db = Database(spark, args.root, read_only=command in ("info", "check", "find", "count", "fields", "explain", "get", "aggregate", "export"))
    if command in ("info", "check", "compact"):
        out(json.dumps(getattr(db, command)()))
    elif command == "export":
        path = need(1)[0]
        out(json.dumps(jsonl.export_folder(db, path) if "://" in path else jsonl.export(db, path)))
    elif command == "import":
        path = need(1)[0]
        if "://" in path:
            out(json.dumps(jsonl.import_folder(db, path)))
        else:
            with _lines(path) as f:
                out(json.dumps(jsonl.load(db, f)))
    elif command == "batch":
        with _lines(need(1)[0]) as f:
            read = jsonl.BatchLines(f, params)
        try:
            out(codec.dumps([x if not isinstance(x, tuple) else list(x) for x in read.batch(db).commit(args.dry_run)]))
        except DocframeError as e:
            raise DocframeError(f"line {read.failed_line}: {e}" if read.failed_line else str(e)) from e
    else:
        c = db.collection(need(1)[0])
        text = rest[1] if len(rest) > 1 else ""
        if command == "find":
            for d in c.cursor(text, params):
                out(codec.dumps(d))
        elif command == "count":
            out(str(c.count(text, params)))
        elif command == "fields":
            for f in c.fields(text):
                out(json.dumps(f))
        elif command == "explain":
            found = (c.explain_run if args.run else c.explain)(text, params)
            out(json.dumps(found) if args.json else found["filter"] + "\n" + found["plan"] + (json.dumps(found["stats"]) if args.run else ""))
        elif command == "get":
            found = c.get(parse_param(need(2)[1]))
            out("null" if found is None else codec.dumps(found))
        elif command == "aggregate":
            if args.explain:
                found = c.explain_aggregate(text, need(3)[2], params)
                out(json.dumps(found) if args.json else found["plan"] + json.dumps(found["stats"]))
                return
            for r in c.aggregate(text, need(3)[2], params):
                out(codec.dumps(r))
        elif command == "watch":
            with c.watch_aggregate(text, args.aggregate, params) if args.aggregate else c.watch(text, params) as feed:
                for e in feed:
                    out(event(e))
        elif command == "insert":
            if not args.create and rest[0] not in db.collections():
                raise DocframeError(f"no collection {rest[0]!r}; --create makes it")
            docs = [codec.loads(x) for x in (sys.stdin if need(2)[1:] == ["-"] else rest[1:]) if x.strip()]
            for i in c.insert(docs):
                out(codec.dumps(i))
        elif command == "update":
            change = codec.loads(need(3)[2])
            if args.upsert:
                out(codec.dumps(db.batch().upsert(rest[0], text, Update.of(change), params).commit(args.dry_run)[0]))
                return
            _everything(args, text)
            out(str(db.batch().update(rest[0], text, change, params).commit(args.dry_run)[0]))
        elif command == "delete":
            _everything(args, text)
            out(str(db.batch().delete(rest[0], text, params).commit(args.dry_run)[0]))
        elif command == "index":
            out(c.create_index(*need(2)[1:], unique=args.unique))
        elif command == "drop":
            c.drop()


def main(argv: list[str] | None = None, spark: Any = None, out: Any = print) -> int:
    parser = argparse.ArgumentParser(prog="docframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("root")
    parser.add_argument("rest", nargs="*")
    parser.add_argument("--param", action="append", default=[])
    parser.add_argument("--aggregate")
    for flag in ("unique", "json", "all", "upsert", "dry-run", "create", "explain", "run"):
        parser.add_argument(f"--{flag}", action="store_true")
    args = parser.parse_args(argv)
    try:
        run(args, spark or session(), out)
    except ParseError as e:
        text = next((x for x in args.rest if e.offset <= len(x)), "")
        line = text.split("\n")[e.line - 1] if text else ""
        print(f"docframe: {e}\n  {line}\n  {' ' * (e.column - 1)}^", file=sys.stderr)
        return 2
    except BindError as e:
        print(f"docframe: {e}", file=sys.stderr)
        return 2
    except DocframeError as e:
        print(f"docframe: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
