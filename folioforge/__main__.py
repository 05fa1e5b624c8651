"""The command line: python -m folioforge --store URI add|list|remove|pull|search|outline|page|reindex|serve ..."""

from __future__ import annotations

import argparse
import os
import sys

from .functions import text as T
from .operators import search
from .operators.catalog import CatalogError
from .plans.engine import Engine


def _pair(text: str) -> tuple[str, str]:
    name, sign, value = text.partition("=")
    if not sign or not name:
        raise argparse.ArgumentTypeError(f"{text!r} is not NAME=VALUE")
    return name, value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioforge")
    p.add_argument("--store", default="file://" + os.path.expanduser("~/.folioforge"), help="folder of the corpus, as Spark names it")
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("add")
    add.add_argument("spec")
    add.add_argument("--name")
    add.add_argument("--kind", choices=["website", "llms_txt", "github", "local"])
    add.add_argument("--refresh", default="7d")
    add.add_argument("--max", type=int, default=0)
    add.add_argument("--header", action="append", type=_pair, metavar="NAME=VALUE", help="sent with each request; ${NAME} is taken from the environment")
    add.add_argument("--cookie", action="append", type=_pair, metavar="NAME=VALUE")
    add.add_argument("--pull", action="store_true")
    add.add_argument("--render", action="store_true", help="with --pull: fetch pages that come out empty again by a browser")
    sub.add_parser("list")
    remove = sub.add_parser("remove", aliases=["rm"])
    remove.add_argument("name")
    remove.add_argument("--keep-files", action="store_true")
    for name in ("pull", "reindex", "outline"):
        sub.add_parser(name).add_argument("names", nargs="*")
    sub.choices["pull"].add_argument("--render", action="store_true")
    find = sub.add_parser("search")
    find.add_argument("query")
    find.add_argument("--source", action="append")
    find.add_argument("--limit", type=int, default=search.LIMIT)
    page = sub.add_parser("page")
    page.add_argument("source")
    page.add_argument("path")
    sub.add_parser("compact")
    sub.add_parser("serve").add_argument("--read-only", action="store_true")
    return p


def run(engine: Engine, args: argparse.Namespace, say=print) -> int:
    """One command; 1 if it fails."""
    c = args.command
    try:
        if c == "add":
            say(f"added {engine.add_source(args.spec, args.name, args.kind, args.refresh, args.max, dict(args.header or ()) or None, dict(args.cookie or ()) or None, pull=args.pull, render=args.render)}")
        elif c == "list":
            now = engine.clock()
            from pyspark.sql import functions as F

            for r in engine.list_sources(now).withColumn("ago", T.human_ago("last_synced_at", F.lit(now).cast("timestamp"))).collect():
                say(f"{r.name}\t{r.kind}\t{r.page_count} pages\t{r.ago}\t{r.refresh_after}" + "\tstale" * r.stale)
        elif c in ("remove", "rm"):
            engine.remove_source(args.name, args.keep_files)
        elif c == "pull":
            for r in engine.refresh_source(args.names or None, render=args.render):
                say(f"{r.source}: {r.pages} pages, {r.chunks} chunks, {r.skipped} skipped, {len(r.errors)} errors")
                for e in r.errors[:3]:
                    say(f"  {e}")
        elif c == "search":
            hits = engine.search_docs(args.query, args.source, args.limit)
            for r in hits.select(T.format_hit("rank", "source", "heading_path", "url", T.trim_snippet("snippet")).alias("line")).collect():
                say(r.line)
        elif c == "outline":
            for r in engine.get_outline(args.names or None).collect():
                say(f"{r.source}\t{r.path}#{r.anchor}\t{' › '.join(r.heading_path)}")
        elif c == "page":
            text = engine.get_page(args.source, args.path)
            if text is None:
                raise ValueError("no such page")
            say(text)
        elif c == "reindex":
            say(f"{engine.reindex(args.names or None)} chunks")
        elif c == "compact":
            say(f"{engine.compact()} folders deleted")
        else:
            from .plans.serve import serve

            engine.read_only = engine.read_only or args.read_only
            serve(engine)
    except (CatalogError, ValueError, PermissionError) as e:
        say(f"error: {e}")
        return 1
    return 0


def main() -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args()
    spark = SparkSession.builder.appName("folioforge").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return run(Engine(spark, args.store), args)


if __name__ == "__main__":
    sys.exit(main())
