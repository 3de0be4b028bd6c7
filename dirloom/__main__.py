"""``python -m dirloom index DATA OUT`` writes the postings of a data directory; ``search DATA LINE`` answers a query or statement; ``query DATA NAME`` runs a registered query."""

from __future__ import annotations

import argparse
import sys


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="dirloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("data")
    index.add_argument("out")
    index.add_argument("--kinds", default="EXACT,CIDR,SOUNDEX")
    index.add_argument("--files", type=int)
    search = sub.add_parser("search")
    search.add_argument("data")
    search.add_argument("line")
    search.add_argument("--limit", type=int, default=20)
    query = sub.add_parser("query")
    query.add_argument("data")
    query.add_argument("name")
    args = parser.parse_args(arguments)

    from dataclasses import replace

    from pyspark.sql import SparkSession

    from .operators import postings
    from .plans.catalogue import QUERIES
    from .runtime import table
    from .session import Session

    spark = SparkSession.builder.appName("dirloom").getOrCreate()
    if args.command == "index":
        found = postings.postings(table(spark, args.data, "records"), table(spark, args.data, "attr_defs"), tuple(args.kinds.split(",")))
        postings.write_sorted(found, args.out, args.files)
    elif args.command == "query":
        QUERIES[args.name](spark, args.data).show(truncate=False)
    else:
        session = Session.open(spark, args.data)
        session.settings = replace(session.settings, limit=args.limit)
        answer = session.run(args.line)
        if answer.rows is not None:
            lines = session.shown(answer.rows).select("line") if "av" in answer.rows.columns else answer.rows
            for row in lines.toLocalIterator():
                print(":".join(str(x) for x in row))
        print(*answer.lines(), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
