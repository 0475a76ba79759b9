"""Command line: info, search, get, export of a store."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.schema import decode_key
from .plans.search import Search
from .plans.store import Store


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparquarry")
    parser.add_argument("--json", action="store_true")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, extra in (("info", []), ("search", ["collection", "query"]), ("get", ["collection", "key"]), ("export", ["collection"])):
        p = sub.add_parser(name)
        p.add_argument("store")
        for x in extra:
            p.add_argument(x)
        if name == "search":
            p.add_argument("--field", default="body")
            p.add_argument("--top-k", type=int, default=10)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparquarry").getOrCreate()
    snap = Store(spark, args.store, create=False).reader()
    if args.command == "info":
        out = snap.stats() | {"collections": snap.collections(), "spaces": snap.spaces()}
    elif args.command == "search":
        hits = snap.search(args.collection, Search().text(args.field, args.query).top_k(args.top_k)).collect()
        out = [{"rank": h["rank"], "key": decode_key(h["key"]), "score": h["score"], "collection": h["collection"]} for h in hits]
    elif args.command == "get":
        out = snap.get(args.collection, args.key)
    else:
        out = [json.loads(r[0]) for r in snap.export(args.collection).toLocalIterator()]
    if args.json:
        print(json.dumps(out, default=str))
    else:
        for line in out if isinstance(out, list) else [out]:
            print(line)
    return 0 if out is not None else 1


if __name__ == "__main__":
    sys.exit(main())
