"""A small command line over a store: python -m lorekeep.cli <store> <command> ..."""

from __future__ import annotations

import argparse
import datetime as dt

from lorekeep.operators import forgetting
from lorekeep.plans.engine import MemoryEngine
from lorekeep.plans.memory_query import MemoryQuery
from lorekeep.session import build_session
from lorekeep.sources import exchange, generate
from lorekeep.sources.store import GraphStore


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lorekeep", description=__doc__)
    out.add_argument("store")
    sub = out.add_subparsers(dest="command", required=True)
    for name in ("stats", "demo", "verify", "clean-orphans", "compact", "health"):
        sub.add_parser(name)
    listing = sub.add_parser("list")
    listing.add_argument("table")
    query = sub.add_parser("query")
    query.add_argument("--text")
    query.add_argument("--all", action="store_true")
    query.add_argument("--source")
    query.add_argument("--min-confidence", type=float)
    query.add_argument("--min-importance", type=float)
    query.add_argument("--key")
    query.add_argument("--value")
    query.add_argument("--limit", type=int, default=20)
    get = sub.add_parser("get")
    get.add_argument("table")
    get.add_argument("id")
    delete = sub.add_parser("delete")
    delete.add_argument("id")
    walk = sub.add_parser("connected")
    walk.add_argument("id")
    walk.add_argument("--depth", type=int, default=2)
    path = sub.add_parser("paths")
    path.add_argument("source")
    path.add_argument("target")
    path.add_argument("--depth", type=int, default=4)
    for name in ("export", "import", "backup"):
        sub.add_parser(name).add_argument("path")
    one = sub.add_parser("export-collection")
    one.add_argument("collection")
    one.add_argument("path")
    forget = sub.add_parser("forget")
    forget.add_argument("--older-than-days", type=float)
    forget.add_argument("--max-importance", type=float)
    forget.add_argument("--expired", action="store_true")
    return out


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = build_session()
    store = GraphStore(spark, args.store)
    engine = MemoryEngine(store.tables(), store=store)
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    if args.command == "stats":
        engine.stats().show()
    elif args.command == "demo":
        store.load(generate.demo(spark))
    elif args.command == "list":
        store.ids(args.table).orderBy(*store.ids(args.table).columns).show(1000, False)
    elif args.command == "get":
        store.get(args.table, args.id).show(1, False, True)
    elif args.command == "query":
        criteria = {k: getattr(args, k) for k in ("text", "source", "min_confidence", "min_importance", "key", "value", "limit")}
        engine.query(MemoryQuery(exact=args.all, **criteria)).show(args.limit, False)
    elif args.command == "delete":
        store.batch().delete_memories(spark.createDataFrame([(args.id,)], "id string")).commit()
    elif args.command == "connected":
        found, on_way = engine.connected(args.id, args.depth)
        found.show(100, False)
        on_way.show(100, False)
    elif args.command == "paths":
        engine.paths(args.source, args.target, args.depth).show(100, False)
    elif args.command == "export":
        exchange.export_json(engine.tables, args.path)
    elif args.command == "backup":
        print(exchange.backup(engine.tables, args.path, now))
    elif args.command == "export-collection":
        exchange.export_json(exchange.collection_export(engine.tables, args.collection), args.path)
    elif args.command == "import":
        store.load(exchange.import_json(spark, args.path))
    elif args.command == "verify":
        for name, rows in engine.verify().items():
            print(name)
            rows.show(100, False)
    elif args.command == "clean-orphans":
        print(engine.clean_orphans())
    elif args.command == "compact":
        store.compact()
        store.vacuum()
    elif args.command == "health":
        engine.health(now).show(1, False, True)
    elif args.command == "forget":
        if args.expired:
            policy = forgetting.ttl_policy()
        elif args.max_importance is not None:
            policy = forgetting.importance_policy(args.max_importance)
        else:
            policy = forgetting.age_policy(args.older_than_days if args.older_than_days is not None else 365)
        print(engine.forget(policy, now))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
