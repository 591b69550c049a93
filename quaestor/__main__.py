"""Command line: ``python -m quaestor <command>`` over a directory of tables, of an ingested corpus, or of files."""

from __future__ import annotations

import argparse
import datetime
import inspect
import sys

from pyspark.sql import DataFrame

from quaestor import api, registry
from quaestor.session import session

#: Commands that are a route, with the argument that comes without a name.
ROUTES = {"search": ("search_documents", "q"), "entities": ("list_entities", "type"), "timeline": ("get_timeline", "entity"), "forensics": ("document_forensics", "doc_id"), "graph": ("graph_centrality", "metric"), "show": ("get_document", "doc_id")}


def value(text: str):
    """An argument as the number, truth value, list or text that it spells."""
    if "," in text:
        return [value(x) for x in text.split(",")]
    if text.lower() in ("true", "false", "none"):
        return {"true": True, "false": False, "none": None}[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def arguments(words: list[str], first: str | None = None) -> dict:
    """``name=value`` words; one word without a name is ``first``'s value."""
    out = {}
    for w in words:
        name, equal, rest = w.partition("=")
        if equal:
            out[name] = value(rest)
        elif first and first not in out:
            out[first] = w if first in ("q", "entity", "type") else value(w)
        else:
            raise ValueError(f"{w!r} has no name: write name=value")
    return out


def shown(answer, rows: int, json: str | None) -> None:
    parts = answer if isinstance(answer, dict) else {"": answer}
    for name, df in parts.items():
        if not isinstance(df, DataFrame):
            print(df)
        elif json:
            df.write.mode("overwrite").json(f"{json}/{name}" if name else json)
        else:
            if name:
                print(f"{name}:")
            df.show(rows, truncate=80)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quaestor", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    commands.add_parser("routes", help="routes and their arguments")
    run = commands.add_parser("run", help="run a query and show its first rows")
    run.add_argument("query")
    run.add_argument("--tables", required=True)
    for name in ("ask", "stats", "resolve", *ROUTES):
        c = commands.add_parser(name, help="a route with name=value arguments" if name == "ask" else None)
        if name == "ask":
            c.add_argument("route")
        c.add_argument("arguments", nargs="*")
        c.add_argument("--tables")
        c.add_argument("--corpus")
    for c in [c for n, c in commands.choices.items() if n not in ("list", "routes")]:
        c.add_argument("--rows", type=int, default=20)
        c.add_argument("--json", help="write the whole result there instead")
    scan = commands.add_parser("scan", help="read a folder of files into a document table")
    mails = commands.add_parser("mails", help="read a folder of mail files into a table")
    ingest = commands.add_parser("ingest", help="read a folder of files into the tables of a corpus")
    for c in (scan, mails, ingest):
        c.add_argument("folder")
        c.add_argument("--to", required=True)
    ingest.add_argument("--batch", required=True)
    ingest.add_argument("--source", default="")
    report = commands.add_parser("report", help="write a page about an entity")
    report.add_argument("entity", type=int)
    report.add_argument("--to", required=True)
    report.add_argument("--tables")
    report.add_argument("--corpus")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    if args.command == "routes":
        print("\n".join(f"{n}{inspect.signature(f)}".replace("c: 'Corpus', ", "").replace("c: 'Corpus'", "") for n, f in sorted(api.ROUTES.items())))
        return 0
    spark = session("quaestor")
    try:
        return command(spark, args)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2


def command(spark, args) -> int:
    from quaestor.bindings import Corpus
    from quaestor.operators import ingest, resolve
    from quaestor.sources import files, reports

    if args.command == "run":
        if args.query not in registry.queries():
            raise ValueError(f"no query {args.query}")
        shown(registry.queries()[args.query](spark, args.tables), args.rows, args.json)
    elif args.command in ("scan", "mails"):
        table = files.documents(spark, args.folder) if args.command == "scan" else files.emails(spark, args.folder)
        table.write.mode("overwrite").parquet(args.to)
        print(f"{spark.read.parquet(args.to).count()} rows in {args.to}")
    elif args.command == "ingest":
        n = ingest.ingest(spark, args.folder, args.to, batch=args.batch, at=datetime.datetime.now().strftime("%Y-%m-%d %H"), source=args.source)
        print(f"{n} new documents in {args.to}")
    else:
        if not args.tables and not args.corpus:
            raise ValueError("name --tables or --corpus")
        c = ingest.corpus(spark, args.corpus) if args.corpus else Corpus(spark, args.tables)
        if args.command == "report":
            with open(args.to, "w", encoding="utf-8") as out:
                out.write(reports.entity_report(api.entity_report(c, args.entity)))
            print(args.to)
        elif args.command == "stats":
            counts = {name: c[name].count() for name in ("docs", "entities", "mentions", "links", "dated")}
            shown(spark.createDataFrame(list(counts.items()), "table string, rows long"), args.rows, args.json)
        elif args.command == "resolve":
            shown(resolve.candidates(c["entities"], c["mentions"]), args.rows, args.json)
        else:
            route, first = (args.route, None) if args.command == "ask" else ROUTES[args.command]
            shown(api.call(c, route, **arguments(args.arguments, first)), args.rows, args.json)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
